"""Small projects from disk to reports and plans."""

import json
import os

import pytest
from codestrata.operators.profile import detect_stack
from codestrata.operators.structure import empty_dirs, project_stats, structural_issues
from codestrata.plans import migration, render, report
from codestrata.schema import Limits
from codestrata.sources.fstree import read_configs, read_entries, read_sources

from .helpers import entries, files_of, make_tree

FILES = {
    "package.json": json.dumps({"name": "shop", "dependencies": {"next": "^14.2.3"}}), "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}', "pnpm-lock.yaml": "", "a.ts": "import b from '@/b'", "b.ts": "import './a'",
    "c.ts": "export const c = 1", "d.ts": "", "index.ts": "", "x.d.ts": "", "next.config.ts": "export default {}", "src/app/page.tsx": "", "src/b.ts": "export const b = 1; import('../a')", ".env": "A=1", ".x/y.ts": "", "__tests__/a.ts": "", "src/_app.tsx": "",
    "node_modules/m/index.js": "", "it's $(rm).ts": "",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = make_tree(tmp_path_factory.mktemp("shop"), FILES, ["void", "only/node_modules"])
    os.symlink(os.path.join(root, "src"), os.path.join(root, "link"))
    projects = {"shop": root}
    tree = read_entries(spark, projects).cache()
    return tree, read_sources(tree, projects), read_configs(tree, projects)


def test_walk_sees_everything_but_skipped(project):
    tree, sources, _ = project
    rows = {r.rel_path: r for r in tree.collect()}
    assert {".env", ".x/y.ts", "__tests__/a.ts", "src/_app.tsx", "d.ts", "void", "", "link"} <= set(rows) and not any("node_modules" in p for p in rows)
    assert rows["link"].kind == "other" and rows["d.ts"].size == 0 and rows["src/app"].depth == 2 and rows[""].parent is None and rows["src/app/page.tsx"].depth == 2
    texts = {r.rel_path: r.content for r in sources.collect()}
    assert texts["a.ts"] == FILES["a.ts"] and "x.d.ts" not in texts and ".x/y.ts" in texts


def test_empty_folders(project):
    assert files_of(empty_dirs(project[0])) == ["only/", "void/"]


def test_unreadable_and_missing_roots(spark, tmp_path):
    rows = read_entries(spark, {"gone": str(tmp_path / "none")}).collect()
    assert [(r.rel_path, r.readable) for r in rows] == [("", False)] and structural_issues(read_entries(spark, {"gone": str(tmp_path / "none")})).count() == 0


def test_stats_and_stack(project):
    tree, _, configs = project
    stats = project_stats(tree).first()
    assert stats.max_depth == 2 and stats.total_dirs == 6 and stats.total_files == len(FILES)  # the link counts, the skipped file does not
    stack = detect_stack(tree, configs).first()
    assert (stack.name, stack.labels, stack.pm, stack.has_src, stack.has_tests) == ("shop", ["Next.js 14", "TypeScript", "App Router"], "pnpm", True, True)


def test_report(project):
    made = report.report(*project)
    row = made.first()
    rules = {i.rule for i in row.issues}
    assert {"root-chaos", "empty-dir", "circular-dependency", "orphan-file"} <= rules and row.score == max(0, 100 - sum(i.penalty for i in row.issues)) and row.framework.pm == "pnpm"
    assert row.graph_stats.alias_config == "tsconfig.json" and row.graph_stats.alias_count == 1
    assert json.loads(report.report_json(made).first().json)["score"] == row.score


def test_plan_and_scripts(project):
    tree, _, _ = project
    issues = structural_issues(tree)
    moves = migration.plan_moves(tree, issues)
    assert sorted(r.from_path for r in moves.collect()) == ["a.ts", "b.ts", "c.ts", "d.ts", "index.ts", "it's $(rm).ts"]
    removes, guidance = migration.plan_removes(issues), migration.plan_guidance(issues)
    bash = render.bash_script(tree, moves, removes, guidance).first().script
    assert "git mv -- 'it'\\''s $(rm).ts' 'src/it'\\''s $(rm).ts'" in bash and "rmdir -- 'void'" in bash and bash.startswith("#!") and bash.count("mkdir") == 1
    shell = render.powershell_script(tree, moves, removes, guidance).first().script
    assert "git mv -- 'it''s $(rm).ts'" in shell
    text = render.markdown_plan(project_stats(tree), moves, removes, guidance).first().script
    assert "| `a.ts` | `src/a.ts` |" in text and "- `void`" in text
    brief = render.agent_brief(issues, project_stats(tree)).first().brief
    assert "[root-chaos] .:" in brief


def test_plan_of_deep_nesting_is_empty(spark):
    issues = structural_issues(entries(spark, "a/b/c/d/e/f/x.txt"))
    assert [r.rule for r in issues.collect()] == ["deep-nesting"] and migration.plan_guidance(issues).count() == 0
    assert [r.target for r in migration.migration_plan(issues).collect()] == ["one or two levels less, or a path alias"]


def test_migration_plan_counts_the_rest(spark):
    issues = structural_issues(entries(spark, *[f"d{i}/utils/Card.tsx" for i in range(15)]))
    plan = migration.migration_plan(issues).collect()
    assert len(plan) == 12 and {r.remaining for r in plan} == {3} and {r.target for r in plan} == {"components/"}


def test_tree_view(project):
    tree, _, _ = project
    view = render.render_tree(render.tree_rows(tree, report.issue_map(structural_issues(tree))), "shop")
    assert "├── only/  [empty-dir]" in view and "more files" in view and "(empty)" in view


def test_moves_of_nested_configuration(spark):
    tree = entries(spark, "config/jest.config.js", "src/jest.config.js")
    issues = structural_issues(tree, Limits(mode="intended"))
    assert sorted((r.from_path, r.to_path) for r in migration.plan_moves(tree, issues).collect()) == [("config/jest.config.js", "jest.config.js"), ("src/jest.config.js", "jest.config.js")]


def test_views(spark):
    flags = spark.createDataFrame([("p", True, False, True, False, True, False, True)], "project_id string, has_app boolean, has_pages boolean, has_prisma boolean, has_src boolean, has_public boolean, has_tests boolean, has_actions boolean")
    layout = render.recommended_structure(flags).first().layout
    assert "app/  routes" in layout and "prisma/" in layout and "src/" not in layout and "actions/" in layout
    bars = spark.createDataFrame([(0,), (50,), (100,)], "s int").select(render.progress_bar(__import__("pyspark").sql.functions.col("s"))).collect()
    assert [r[0].count("█") for r in bars] == [0, 15, 30]
