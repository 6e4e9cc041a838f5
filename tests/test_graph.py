import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from codestrata.functions.text import strip_comments
from codestrata.operators import graph as G
from codestrata.operators.components import strong_components, tarjan
from codestrata.schema import ALIASES, Limits
from codestrata.sources.fstree import load_aliases
from pyspark.sql import functions as F

from .helpers import files_of, sources


def edges(spark, *pairs, project="p"):
    return spark.createDataFrame([(project, a, b) for a, b in pairs], "project_id string, from_path string, to_path string")


def specs(spark, text):
    return [r.spec for r in G.extract_imports(sources(spark, {"a.ts": text})).sort("spec_ord").collect()]


def test_import_forms(spark):
    text = "import a from './a'; export * from \"./b\"; import './c'; import('./d'); require('./e'); import a2 from './a'"
    assert specs(spark, text) == ["./a", "./b", "./c", "./d", "./e"]
    assert specs(spark, "// import x from './x'\n/* import y\n from './y' */") == [] and specs(spark, "import{a}from'./a'") == []
    assert specs(spark, "import {\n a,\n b } from `./m`") == ["./m"]


def test_strip_comments(spark):
    got = spark.createDataFrame([("a // b\nc /* d\n e */ f 'http://x' \"//y\"",)], "t string").select(strip_comments(F.col("t"))).first()[0]
    assert got == "a \nc  f 'http://x' \"//y\""


def test_deep_counts(spark):
    text = "import a from '../../x'; import b from '../../../x'; import c from './../../../x'"
    found = G.extract_imports(sources(spark, {"a/b/c/d.ts": text}))
    assert [r.deep for r in found.sort("spec_ord").collect()] == [2, 3, 0]
    assert [r.snippet for r in G.deep_relative_imports(found).collect()] == ["../../../x"]


def resolve(spark, spec, files, start="src/a.ts", aliases=()):
    rows = [("p", "tsconfig.json", "", [tuple(a) for a in aliases], len(aliases))] if aliases else []
    imports = spark.createDataFrame([("p", start, spec)], "project_id string, from_path string, spec string")
    known = spark.createDataFrame([("p", f) for f in files], "project_id string, rel_path string")
    return [r.to_path for r in G.resolve_imports(imports, known, spark.createDataFrame(rows, ALIASES)).collect()]


@pytest.mark.parametrize("spec,files,want", [
    ("./m", ["src/m.ts", "src/m.tsx", "src/m/index.ts"], ["src/m.ts"]), ("./m", ["src/m/index.tsx"], ["src/m/index.tsx"]), ("./m.js", ["src/m.ts"], []),
    ("./m.ts", ["src/m.ts"], ["src/m.ts"]), ("components/Button", ["components/Button.tsx"], ["components/Button.tsx"]), ("react", ["src/x.ts"], []),
    ("..", ["index.js", "src/index.js"], ["index.js"]), ("../../x", ["x.ts"], []), (".", ["src/index.ts"], ["src/index.ts"]),
])
def test_resolution_order(spark, spec, files, want):
    assert resolve(spark, spec, files) == want


def test_alias_order(spark):
    aliases = [(0, "@/", "", True, 0, "src/*"), (1, "@/lib/", "", True, 0, "lib/*"), (2, "pre-", "-post", True, 0, "gen/*.ts"), (3, "exact", "", False, 0, "src/one")]
    assert resolve(spark, "@/lib/x", ["src/lib/x.ts", "lib/x.ts"], aliases=aliases) == ["src/lib/x.ts"]
    assert resolve(spark, "@/lib/x", ["lib/x.ts"], aliases=aliases) == ["lib/x.ts"]
    assert resolve(spark, "pre-k-post", ["gen/k.ts"], aliases=aliases) == ["gen/k.ts"]
    assert resolve(spark, "exact", ["src/one.ts"], aliases=aliases) == ["src/one.ts"] and resolve(spark, "exactly", ["src/one.ts"], aliases=aliases) == []


def test_declaration_files_indexes_and_odd_names(spark):
    assert resolve(spark, "./m", ["src/m.d.ts"]) == ["src/m.d.ts"] and resolve(spark, "./m.d", ["src/m.d.ts"]) == ["src/m.d.ts"]
    assert resolve(spark, "./index", ["src/index.ts", "src/index/index.ts"]) == ["src/index.ts"]
    assert resolve(spark, "./m", ["src/m/index.d.ts", "src/m/index.cjs"]) == ["src/m/index.cjs"]
    assert resolve(spark, "./m", ["src/m"]) == ["src/m"] and resolve(spark, ".", ["src.ts", "src/.ts"]) == ["src.ts"] and resolve(spark, "./m", ["src/mindex.ts", "src/m/xindex.ts"]) == []


def test_five_thousand_aliases_in_order(spark):
    n = 5000
    aliases = [(i, f"@a{i}/", "" if i % 2 else ".x", True, 0, f"p{i}/*") for i in range(n)] + [(n, "@a", "", True, 0, "late/*"), (n + 1, "exact", "", False, 0, "p0/one")]
    table = spark.createDataFrame([("p", "tsconfig.json", "", aliases, len(aliases))], ALIASES)
    imports = spark.createDataFrame([("p", f"f{i % 7}.ts", f"@a{i}/m" + ("" if i % 2 else ".x")) for i in range(n)] + [("p", "f.ts", "@a77777/m"), ("p", "f.ts", "exact")], "project_id string, from_path string, spec string")
    files = spark.createDataFrame([("p", f"p{i}/m.ts") for i in range(n)] + [("p", "late/77777/m.ts"), ("p", "late/1/m.ts"), ("p", "p0/one.ts")], "project_id string, rel_path string")
    got = {r.spec: r.to_path for r in G.resolve_imports(imports, files, table).collect()}
    assert got == {**{f"@a{i}/m" + ("" if i % 2 else ".x"): f"p{i}/m.ts" for i in range(n)}, "@a77777/m": "late/77777/m.ts", "exact": "p0/one.ts"}
    assert G.import_bases(imports, table).where("base IS NOT NULL").count() <= 4 * n


def test_a_base_is_one_key(spark):
    imports = spark.createDataFrame([("p", "a.ts", "./m"), ("p", "a.ts", "lib/x")], "project_id string, from_path string, spec string")
    assert G.import_bases(imports, spark.createDataFrame([], ALIASES)).count() == 2


def test_alias_files_by_mode(spark):
    text = '{ "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["src/*"] } }, "include": ["**/*.ts"] }'
    jsonc = '{ // base\n "compilerOptions": { "paths": { "b/*": ["x/*", "y/*"], "a": ["z"], }, }, }'
    configs = spark.createDataFrame([("p", "tsconfig.json", text), ("q", "tsconfig.json", "broken"), ("q", "jsconfig.json", jsonc), ("r", "package.json", "{}"), ("s", "tsconfig.json", "null")], "project_id string, name string, content string")
    got = {r.project_id: r for r in load_aliases(configs).collect()}
    assert set(got) == {"q"} and got["q"].config_file == "jsconfig.json" and [(p.prefix, p.target) for p in got["q"].paths] == [("b/", "x/*"), ("b/", "y/*"), ("a", "z")]
    assert {r.project_id for r in load_aliases(configs, "intended").collect()} == {"p", "q"}


def test_cycles(spark):
    found = G.circular_dependencies(edges(spark, ("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "g")))
    assert sorted((r.file, len(r.cycle)) for r in found.collect()) == [("a", 2), ("c", 3)]
    pairs = [p for i in range(13) for p in ((f"x{i:02}", f"y{i:02}"), (f"y{i:02}", f"x{i:02}"))]
    assert G.circular_dependencies(edges(spark, *pairs)).count() == 12
    assert G.circular_dependencies(edges(spark)).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_colouring_equals_tarjan(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}") for _ in range(45)]
    want = sorted(sorted(g) for g in tarjan([p for p in pairs if p[0] != p[1]]))
    for limit in (1_000_000, 1):
        groups = {}
        for r in strong_components(edges(spark, *pairs), local_edges=limit).collect():
            groups.setdefault(r.component, []).append(r.node)
        assert sorted(sorted(g) for g in groups.values()) == want and all(k == min(g) for k, g in groups.items())


def test_graph_rules(spark):
    files = {
        "lib/x.ts": "export const x = 1", "lib/y.ts": "const y = 1", "src/app/x.ts": "export const a = 1", "x.test.ts": "export {}", "vite.config.ts": "export default 1", "index.ts": "export * from './lib/used'",
        "lib/used.ts": "export const u = 1\nimport './used'", "two.ts": "import a from './lib/used'; import b from './lib/used.ts'",
        "l399.ts": "\n" * 398, "l400.ts": "\n" * 399, "empty.ts": "", "many.ts": "".join(f"import a{i} from './m/f{i}';" for i in range(30)), "few.ts": "".join(f"import a{i} from './m/f{i}';" for i in range(29)),
        **{f"m/f{i}.ts": "x" for i in range(30)},
    }
    graph = G.build_graph(sources(spark, files))
    assert files_of(G.orphan_files(graph.nodes, graph.edges)) == ["lib/x.ts"]
    assert files_of(G.god_files(graph.nodes)) == ["l400.ts", "many.ts"]
    nodes = {r.rel_path: r for r in graph.nodes.collect()}
    assert nodes["empty.ts"].loc == 0 and nodes["two.ts"].import_count == 1 and nodes["lib/used.ts"].fan_in == 2
    stats = G.graph_stats(graph).first()
    assert stats.edges == 1 + 2 + 30 + 29 and stats.total_imports == 1 + 1 + 30 + 29 and stats.max_fan_in == 2 and stats.max_fan_in_file == "lib/used.ts"
    assert {r.rule for r in G.graph_issues(graph, Limits()).collect()} == {"orphan-file", "god-file"}


def test_average_imports_rounds_the_exact_binary_value(spark):
    rng = random.Random(1)
    pairs = [(7, 20), (0, 5), (5, 0), (1, 1), (3, 20), (1, 20), (1, 3), (29, 20), (5, 2)] + [(rng.randrange(3000), rng.choice([20, 40, 7, 60, 200, 999])) for _ in range(300)]
    got = spark.createDataFrame(pairs, "t long, f long").select("t", "f", G.average_imports(F.col("t"), F.col("f")).alias("a")).collect()
    for r in got:
        want = float(Decimal(r.t / r.f).quantize(Decimal("0.1"), ROUND_HALF_UP)) if r.f else 0.0
        assert r.a == want, (r.t, r.f)
