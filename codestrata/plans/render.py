"""Text views: migration scripts, trees, recommended layouts, briefs.

Scripts and trees are one aggregation per project; names are shell-quoted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import dirname
from ..schema import RULES
from ..scratch import Tables


def bash_quote(name: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def powershell_quote(name: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'"))


def _lines(rows: DataFrame, section: int, line: Column, order: Column) -> DataFrame:
    return rows.select("project_id", F.struct(F.lit(section).alias("section"), order.cast("string").alias("order"), line.alias("line")).alias("row"))


def _script(projects: DataFrame, parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.join(projects.select("project_id").distinct(), "project_id", "left_semi")
    return every.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r.line), "\n").alias("script"))


def _comment(text: Column) -> Column:
    """One line: a name cannot end a comment."""
    return F.regexp_replace(text, r"[\r\n]+", " ")


def bash_script(projects: DataFrame, moves: DataFrame, removes: DataFrame, guidance: DataFrame) -> DataFrame:
    """(project_id, script).  The script runs nothing here."""
    heads = projects.select("project_id").distinct()
    targets = moves.select("project_id", dirname(F.col("to_path")).alias("dir")).where("dir <> ''").distinct()
    number = F.lpad(F.col("n").cast("string"), 6, "0")
    return _script(projects, [
        _lines(heads, 0, F.lit("#!/usr/bin/env bash\n# Review before running; commit first.\nset -euo pipefail"), F.lit("")),
        _lines(targets, 1, F.concat(F.lit("mkdir -p -- "), bash_quote(F.col("dir"))), F.col("dir")),
        _lines(moves, 2, F.concat(F.lit("git mv -- "), bash_quote(F.col("from_path")), F.lit(" "), bash_quote(F.col("to_path"))), F.col("from_path")),
        _lines(removes, 3, F.concat(F.lit("rmdir -- "), bash_quote(F.col("path")), F.lit(" 2>/dev/null || echo "), bash_quote(F.concat(F.lit("kept (not empty): "), "path"))), F.col("path")),
        _lines(guidance, 4, F.concat(F.lit("# "), F.col("n").cast("string"), F.lit(". "), _comment(F.concat_ws(": ", "title", "detail"))), number),
    ])


def powershell_script(projects: DataFrame, moves: DataFrame, removes: DataFrame, guidance: DataFrame) -> DataFrame:
    heads = projects.select("project_id").distinct()
    targets = moves.select("project_id", dirname(F.col("to_path")).alias("dir")).where("dir <> ''").distinct()
    number = F.lpad(F.col("n").cast("string"), 6, "0")
    path = powershell_quote(F.col("path"))
    return _script(projects, [
        _lines(heads, 0, F.lit("# Review before running; commit first.\n$ErrorActionPreference = 'Stop'"), F.lit("")),
        _lines(targets, 1, F.concat(F.lit("New-Item -ItemType Directory -Force -Path "), powershell_quote(F.col("dir")), F.lit(" | Out-Null")), F.col("dir")),
        _lines(moves, 2, F.concat(F.lit("git mv -- "), powershell_quote(F.col("from_path")), F.lit(" "), powershell_quote(F.col("to_path"))), F.col("from_path")),
        _lines(removes, 3, F.concat(F.lit("if (-not (Get-ChildItem -LiteralPath "), path, F.lit(" -Force)) { Remove-Item -LiteralPath "), path, F.lit(" }")), F.col("path")),
        _lines(guidance, 4, F.concat(F.lit("# "), F.col("n").cast("string"), F.lit(". "), _comment(F.concat_ws(": ", "title", "detail"))), number),
    ])


def markdown_plan(stats: DataFrame, moves: DataFrame, removes: DataFrame, guidance: DataFrame) -> DataFrame:
    cell = lambda c: F.concat(F.lit("`"), F.replace(_comment(F.col(c)), F.lit("|"), F.lit("\\|")), F.lit("`"))
    none = stats.select("project_id").join(moves.select("project_id").distinct(), "project_id", "left_anti")
    number = F.lpad(F.col("n").cast("string"), 6, "0")
    return _script(stats, [
        _lines(stats, 0, F.format_string("# Migration plan\n\n%d files, %d directories, depth %d\n\n## Moves\n", "total_files", "total_dirs", "max_depth"), F.lit("")),
        _lines(none, 1, F.lit("None."), F.lit("")),
        _lines(moves.select("project_id").distinct(), 1, F.lit("| From | To |\n|-|-|"), F.lit("")),
        _lines(moves, 2, F.concat(F.lit("| "), cell("from_path"), F.lit(" | "), cell("to_path"), F.lit(" |")), F.col("from_path")),
        _lines(stats, 3, F.lit("\n## Removals\n"), F.lit("")),
        _lines(removes, 4, F.concat(F.lit("- "), cell("path")), F.col("path")),
        _lines(stats, 5, F.lit("\n## Guidance\n"), F.lit("")),
        _lines(guidance, 6, F.concat(F.lit("### "), F.col("n").cast("string"), F.lit(". "), _comment(F.col("title")), F.lit("\n\n"), F.col("detail")), number),
        _lines(stats, 7, F.lit("\n## Verify\n\nRun the scan and the type checker again."), F.lit("")),
    ])


def tree_rows(entries: DataFrame, tags: DataFrame, max_depth: int = 4, top_files: int = 6) -> DataFrame:
    """Rows of a tree view: folders, and the first files of each folder; the last
    shown file of a folder carries the number of hidden ones, a folder how many
    files and folders it holds (``hint``)."""
    kids = entries.where("parent IS NOT NULL").where(F.col("depth") <= F.when(F.col("kind") == "dir", max_depth).otherwise(max_depth - 1))
    order = W.partitionBy("project_id", "parent", F.col("kind") == "dir").orderBy(F.expr("name COLLATE UNICODE"), "name")
    total = kids.groupBy("project_id", "parent").agg(F.count_if(F.col("kind") != "dir").alias("n_files"))
    rows = kids.withColumn("place", F.row_number().over(order)).where((F.col("kind") == "dir") | (F.col("place") <= top_files))
    rows = rows.join(total, ["project_id", "parent"]).join(tags.withColumnRenamed("path", "rel_path"), ["project_id", "rel_path"], "left")
    inside = entries.where("parent IS NOT NULL").groupBy("project_id", F.col("parent").alias("rel_path")).agg(F.count_if(F.col("kind") == "file").alias("files_in"), F.count_if(F.col("kind") == "dir").alias("dirs_in"))
    rows = rows.join(inside, ["project_id", "rel_path"], "left")
    hint = F.when(F.col("kind") == "dir", F.format_string("%df %dd", F.coalesce("files_in", F.lit(0)), F.coalesce("dirs_in", F.lit(0))))
    hidden = F.when((F.col("kind") != "dir") & (F.col("place") == top_files), F.greatest(F.col("n_files") - top_files, F.lit(0))).otherwise(0)
    return rows.select("project_id", "rel_path", "parent", "name", "kind", "place", hidden.alias("hidden"), hint.alias("hint"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def tree_text(rows: DataFrame, max_depth: int = 4) -> DataFrame:
    """(project_id, tree): an ASCII tree of each project from ``tree_rows``.

    A row's place in pre-order is the list of its ancestors' places and its own; it
    and the strokes before a name are handed down level by level, in as many joins
    as the tree is deep."""
    among = W.partitionBy("project_id", "parent").orderBy(F.col("kind") != "dir", "place")
    tables = Tables(rows.sparkSession, "tree")  # every level is joined to the rows, and every line comes from a level
    rows = tables.keep(rows.withColumns({"n": F.row_number().over(among), "last": F.lead("kind").over(among).isNull() & (F.col("hidden") == 0)}))
    own = ["project_id", "rel_path", "kind", "name", "hidden", "hint", "tags", "last"]
    level = rows.where("parent = ''").select(*own, F.array("n").alias("key"), F.lit("").alias("lead"))
    every = level
    for _ in range(max_depth - 1):
        above = level.where("kind = 'dir'").select("project_id", F.col("rel_path").alias("parent"), F.col("key").alias("up"), F.concat("lead", F.when(F.col("last"), "    ").otherwise("│   ")).alias("lead"))
        level = rows.join(above, ["project_id", "parent"]).select(*own, F.concat("up", F.array("n")).alias("key"), "lead")
        every = every.unionByName(level)
    every = tables.keep(every)
    name = F.concat("name", F.when(F.col("kind") == "dir", "/").otherwise(""), F.when(F.size("tags") > 0, F.concat(F.lit("  ["), F.array_join("tags", ", "), F.lit("]"))).otherwise(""), F.coalesce(F.concat(F.lit("  "), "hint"), F.lit("")))
    shown = every.select("project_id", "key", F.concat("lead", F.when(F.col("last"), "└── ").otherwise("├── "), name).alias("line"))
    more = every.where("hidden > 0").select("project_id", F.concat("key", F.array(F.lit(1))).alias("key"), F.concat("lead", F.format_string("└── … %d more files", "hidden")).alias("line"))
    inside = rows.select("project_id", F.col("parent").alias("rel_path")).distinct()
    bare = every.where("kind = 'dir'").join(inside, ["project_id", "rel_path"], "left_anti")
    empty = bare.select("project_id", F.concat("key", F.array(F.lit(1))).alias("key"), F.concat("lead", F.when(F.col("last"), "    ").otherwise("│   "), F.lit("└── (empty)")).alias("line"))
    lines = shown.unionByName(more).unionByName(empty)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "line"))), lambda r: r.line), "\n")
    return lines.groupBy("project_id").agg(F.concat("project_id", F.lit("/\n"), text).alias("tree"))


def render_tree(rows: DataFrame, project_id: str, max_depth: int = 4) -> str:
    """The tree of one project as a string; of one without entries, its name."""
    found = tree_text(rows.where(F.col("project_id") == project_id), max_depth).first()
    return found.tree if found else f"{project_id}/"


#: Folders whose existence decides on a layout.
PROBES = {
    "has_app": ("app", "src/app"), "has_pages": ("pages", "src/pages"), "has_prisma": ("prisma",), "has_src": ("src",),
    "has_public": ("public",), "has_tests": ("__tests__", "tests"), "has_actions": ("actions", "src/actions"),
}
_IN_SRC, _AT_ROOT = "(has_src OR NOT has_app)", "(has_app AND NOT has_src)"
_SRC_APP, _SRC_PAGES = "(has_src AND has_app)", "(has_pages AND NOT has_app)"
# The paths of the recommended layouts; when each belongs to one; a note of ours.
LAYOUT = (
    ("next.config.ts, tsconfig.json, package.json", "true", "configuration stays here"), ("README.md", "true", "what this is"), (".env.local, .env.example", "true", "settings, and a sample of them"),
    ("public/icons/, public/images/", "has_public", "static files"), ("prisma/schema.prisma, prisma/migrations/, prisma/seed.ts", "has_prisma", "schema and its history"),
    ("src/", _IN_SRC, "all sources"), ("src/app/", _SRC_APP, "routes"), ("src/app/(auth)/, src/app/(dashboard)/, src/app/api/, src/app/layout.tsx, src/app/page.tsx", _SRC_APP, "groups, handlers, frame and start page"),
    ("src/pages/", _SRC_PAGES, "routes"), ("src/pages/api/, src/pages/_app.tsx, src/pages/_document.tsx, src/pages/index.tsx", _SRC_PAGES, "handlers, frame and start page"),
    ("src/components/ui/, src/components/layout/, src/components/forms/, src/components/index.ts", _IN_SRC, "PascalCase, by concern, with an index"), ("src/lib/db.ts, src/lib/auth.ts, src/lib/index.ts", _IN_SRC, "ties to other systems"),
    ("src/actions/posts.ts, src/actions/users.ts", f"{_IN_SRC} AND has_actions", "server actions"), ("src/utils/index.ts", _IN_SRC, "pure functions"), ("src/hooks/index.ts", _IN_SRC, "hooks"),
    ("src/types/index.ts", _IN_SRC, "shared types"), ("src/config/", _IN_SRC, "constants"),
    ("app/", _AT_ROOT, "routes"), ("app/(auth)/login/, app/(auth)/register/, app/(dashboard)/settings/, app/(dashboard)/profile/, app/api/, app/layout.tsx, app/page.tsx", _AT_ROOT, "groups, handlers, frame and start page"),
    ("components/ui/, components/layout/, components/forms/, components/index.ts", _AT_ROOT, "PascalCase, by concern, with an index"), ("lib/, utils/, hooks/, types/", _AT_ROOT, "code of one kind each"),
    ("actions/", f"{_AT_ROOT} AND has_actions", "server actions"), ("config/", _AT_ROOT, "constants"),
    ("__tests__/unit/, __tests__/e2e/, __tests__/integration/", "has_tests", "tests, in the order of the sources"),
)


def layout_flags(entries: DataFrame) -> DataFrame:
    """(project_id, flags): which of the folders of ``PROBES`` exist."""
    return entries.groupBy("project_id").agg(*[F.bool_or(F.col("rel_path").isin(*paths)).alias(flag) for flag, paths in PROBES.items()])


def recommended_structure(flags: DataFrame) -> DataFrame:
    """(project_id, layout): a folder layout by what exists; ``flags`` has
    has_app, has_pages, has_prisma, has_src, has_public, has_tests, has_actions."""
    rows = [F.when(F.expr(when), f"{path}  {note}") for path, when, note in LAYOUT]
    return flags.select("project_id", F.array_join(F.array_compact(F.array(*rows)), "\n").alias("layout"))


def progress_bar(score: Column, cells: int = 30) -> Column:
    full = F.round(score / 100 * cells).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(cells) - full))


def agent_brief(issues: DataFrame, stats: DataFrame) -> DataFrame:
    """(project_id, brief): plain text with facts, conventions, the issues in
    report order, and the order of work.  Text only; nothing is run."""
    rank = {r[0]: r[6] for r in RULES}
    order = F.coalesce(F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])[F.col("rule")], F.lit(99))
    listed = _lines(issues, 2, F.concat(F.lit("- ["), "rule", F.lit("] "), _comment(F.col("file")), F.lit(": "), _comment(F.col("snippet"))), F.concat(F.lpad(order.cast("string"), 3, "0"), "file"))
    work = "\nOrder of work: " + ", ".join(r[0] for r in sorted((r for r in RULES if r[7]), key=lambda r: r[7])) + ".\nUpdate every import of what you move, and scan again after each kind of issue."
    head = F.format_string("Project: %d files, %d directories, depth %d\nConventions: sources in src/, folders in kebab-case, components in PascalCase, configuration at the root.\n", "total_files", "total_dirs", "max_depth")
    made = _script(stats, [_lines(stats, 0, head, F.lit("")), listed, _lines(stats, 3, F.lit(work), F.lit(""))])
    return made.withColumnRenamed("script", "brief")
