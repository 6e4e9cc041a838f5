import pytest
from codestrata.functions.text import detect_style, normalize_path
from codestrata.operators import structure as S
from codestrata.plans.report import scores
from codestrata.schema import ISSUE_COLUMNS, Limits
from pyspark.sql import functions as F

from .helpers import entries, files_of


def many(folder, n, end=".txt"):
    return [f"{folder}f{i}{end}" for i in range(n)]


def test_styles(spark):
    want = {"utils": "kebab", "userStore.ts": "camel", "__tests__": "mixed", "A": "upper", "a.b.c.ts": "mixed", "MyWidget.test.tsx": "pascal", "my_store": "snake", "[id]": "special", ".env": "dotted", "API_KEY": "upper", "a.ts\n": "kebab"}
    got = spark.createDataFrame([(k,) for k in want], "n string").select("n", detect_style(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == want


def test_normalize_path(spark):
    want = {"a/./b//c": "a/b/c", "a/../../b": "b", "": "", "..": "", "a/b/..": "a"}
    got = spark.createDataFrame([(k,) for k in want], "p string").select("p", normalize_path(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in got} == want


def test_deep_nesting(spark):
    assert files_of(S.deep_nesting(entries(spark, "a/b/c/d/e/x.ts"))) == []
    assert files_of(S.deep_nesting(entries(spark, "a/b/c/d/e/f/x.ts"))) == ["a/b/c/d/e/f"]
    assert len(files_of(S.deep_nesting(entries(spark, "a/b/c/d/e/f/g/h/x.ts")))) == 3


@pytest.mark.parametrize("folder,n,want", [("lib/", 18, []), ("lib/", 19, ["lib/"]), ("", 20, []), ("", 21, ["./"])])
def test_fat_folder(spark, folder, n, want):
    assert files_of(S.fat_folder(entries(spark, *many(folder, n)))) == want


def test_naming(spark):
    at = lambda *names: entries(spark, *[f"src/{n}/x.txt" for n in names])
    assert files_of(S.naming_folders(at("utils", "user-card", "MyWidget"))) == ["src/"]
    assert files_of(S.naming_folders(at("utils", "MyWidget"))) == []
    assert files_of(S.naming_folders(at("utils", "hooks", "__tests__"))) == ["src/"]
    assert files_of(S.naming_folders(at("utils", "hooks", "[id]", ".vscode", "API"))) == []
    assert files_of(S.naming_files(entries(spark, "Button.tsx", "format-date.ts", "userStore.ts"))) == ["./"]
    assert files_of(S.naming_files(entries(spark, "Button.tsx", "Card.ts", "Store.ts"))) == []


def test_misplaced(spark):
    found = S.misplaced_files(entries(spark, "src/utils/Card.tsx", "src/utils/Card.test.tsx", "src/__tests__/a.test.ts", "src/jest.config.ts", "src/schema.prisma", "prisma/schema.prisma", "components/Card.tsx"))
    got = {r.file: r.target_dir for r in found.collect()}
    tests = "a dedicated tests/ or __tests__/ directory"
    assert got == {"src/utils/Card.tsx": "components/", "src/utils/Card.test.tsx": "components/", "src/__tests__/a.test.ts": tests, "src/jest.config.ts": "correct directory", "src/schema.prisma": "prisma/"}


def test_barrels(spark):
    assert files_of(S.missing_barrel(entries(spark, *many("hooks/", 2, ".ts")))) == []
    assert files_of(S.missing_barrel(entries(spark, *many("Hooks/", 3, ".ts")))) == ["Hooks/"]
    assert files_of(S.missing_barrel(entries(spark, *many("hooks/", 3, ".ts"), "hooks/index.ts"))) == []
    assert files_of(S.missing_barrel(entries(spark, *many("", 3, ".ts"), project="hooks"))) == ["/"]


def test_duplicates(spark):
    found = S.duplicate_concept(entries(spark, "utils/a", "Lib/a", "types/a", "models/a", "x/lib/a"))
    assert sorted(tuple(r.duplicates) for r in found.collect()) == [("lib", "utils"), ("models", "types")]
    assert S.duplicate_concept(entries(spark, "Utils/a", "utils/a")).count() == 1


def test_root_chaos(spark):
    assert files_of(S.root_chaos(entries(spark, "a.ts", "b.ts", "next.config.ts"))) == []
    assert files_of(S.root_chaos(entries(spark, "a.ts", "b.ts", "c.ts", "next.config.ts"))) == ["."]
    assert files_of(S.root_chaos(entries(spark, "index.ts", "app.ts", "main.ts", "server.ts", "entry.ts"))) == []


def test_scattered_config_by_mode(spark):
    tree = entries(spark, "config/jest.config.js", "jest.config.js")
    assert files_of(S.scattered_config(tree)) == [] and files_of(S.scattered_config(tree, Limits(mode="intended"))) == ["config/jest.config.js"]


def test_scores_and_grades(spark):
    projects = spark.createDataFrame([(p,) for p in "abcdef"], "project_id string")
    data = [("b", 10), ("c", 20), ("d", 35), ("e", 50), ("f", 101)]
    got = {r.project_id: (r.score, r.grade) for r in scores(projects, spark.createDataFrame(data, "project_id string, penalty int")).collect()}
    assert got == {"a": (100, "A"), "b": (90, "A"), "c": (80, "B"), "d": (65, "C"), "e": (50, "D"), "f": (0, "F")}


def test_issues_do_not_depend_on_order(spark):
    tree = entries(spark, *many("src/lib/", 30, ".ts"), "src/utils/Card.tsx", "a/b/c/d/e/f/x")
    one = S.structural_issues(tree)
    two = S.structural_issues(tree.orderBy(F.desc("rel_path")).repartition(7))
    assert one.columns == ISSUE_COLUMNS and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert S.structural_issues(tree.limit(0)).count() == 0


def test_listing_is_read_once_and_shuffled_once(spark, tmp_path):
    entries(spark, *many("src/lib/", 30, ".ts"), "a/b/c/d/e/f/x").write.parquet(str(tmp_path / "e"))
    found = S.structural_issues(spark.read.parquet(str(tmp_path / "e")), Limits(mode="intended"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    whole = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and whole.count("Exchange hashpartitioning") == 1 and "rel_path" in whole.split("Exchange hashpartitioning")[1][:60]


def test_samples_of_a_crowded_folder_are_the_first_names(spark):
    names = [f"{'Card' if i % 2 else 'card-'}{i:05}.tsx" for i in range(3000)]
    (found,) = S.naming_files(entries(spark, *[f"src/ui/{n}" for n in names]).repartition(5)).collect()
    assert found.snippet == "PascalCase: Card00001.tsx, Card00003.tsx  |  other: card-00000.tsx, card-00002.tsx"
