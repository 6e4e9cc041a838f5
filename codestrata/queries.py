"""Registered queries of the source-structure engine and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from .functions import text as X
from .operators import graph as G
from .operators import structure as S
from .operators.components import strong_components
from .operators.profile import detect_stack
from .plans import migration, render, report
from .schema import ALIASES, BARREL_DIRS, CONCEPTS, ENTRY_NAMES, ISSUE_TYPES, RULES, Limits, rules
from .scratch import Tables, shared_dir
from .sources.fstree import load_aliases, read_entries, source_files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = "WITH RECURSIVE " + sql.strip().rstrip(",")
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flat(issues: DataFrame) -> DataFrame:
    """Issues with their extras in one text column."""
    text = lambda c: F.col(c).cast("string")
    joined = lambda c: F.array_join(c, ",")
    detail = F.concat_ws("|", text("depth"), text("file_count"), joined("styles"), text("source_file_count"), joined("duplicates"), joined("cycle"), text("loc"), text("import_count"), text("deep"), "target_dir")
    return issues.select("project_id", "rule", "type", "severity", "file", F.col("penalty").cast("long").alias("penalty"), "snippet", detail.alias("detail"))


def _flat_sql(rule: str, file: str, detail: str, snippet: str, rows: str) -> str:
    severity, penalty = next((r[4], r[5]) for r in RULES if r[0] == rule)
    return f"SELECT project_id, '{rule}' AS rule, '{ISSUE_TYPES[rule][0]}' AS type, '{severity}' AS severity, {file} AS file, CAST({penalty} AS BIGINT) AS penalty, {snippet} AS snippet, {detail} AS detail FROM {rows}"


def _names(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


PAGES, DOCS, DEEP = A.PAGE_PATHS_SQL + A.ENTRIES_SQL, A.DOCUMENT_PATHS_SQL + A.ENTRIES_SQL, A.DEEP_PATHS_SQL + A.ENTRIES_SQL
STYLED = f", based AS (SELECT *, {A.BASE_SQL} AS base FROM entries), styled AS (SELECT *, {A.STYLE_SQL} AS style FROM based)"


def page_entries(spark, d):
    return A.entries_from_paths(A.page_paths(spark, d))


def doc_entries(spark, d):
    return A.entries_from_paths(A.document_paths(spark, d))


def deep_entries(spark, d):
    return A.entries_from_paths(A.deep_paths(spark, d))


# --- scans, functions ---------------------------------------------------------------------------


@query("style_detect", A.PART_NAMES_SQL + f", based AS (SELECT *, {A.BASE_SQL} AS base FROM names) SELECT p_partkey, name, {A.STYLE_SQL} AS style FROM based")
def style_detect(spark, d):
    return A.part_names(spark, d).select("p_partkey", "name", X.detect_style(F.col("name")).alias("style"))


@query("style_counts", A.PART_NAMES_SQL + f", based AS (SELECT *, {A.BASE_SQL} AS base FROM names) SELECT project_id, {A.STYLE_SQL} AS style, count(*) AS n FROM based GROUP BY ALL")
def style_counts(spark, d):
    return A.part_names(spark, d).groupBy("project_id", X.detect_style(F.col("name")).alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query("entries_listing", PAGES + " SELECT project_id, rel_path, name, parent, CAST(depth AS BIGINT) AS depth, kind, CAST(coalesce(size, -1) AS BIGINT) AS size FROM entries")
def entries_listing(spark, d):
    return page_entries(spark, d).select("project_id", "rel_path", "name", "parent", F.col("depth").cast("long").alias("depth"), "kind", F.coalesce("size", F.lit(-1)).alias("size"))


@query("source_file_listing", DOCS + r" SELECT project_id, rel_path FROM entries WHERE kind <> 'dir' AND regexp_matches(name, '\.(ts|tsx|js|jsx|mjs|cjs)$') AND NOT regexp_matches(name, '\.d\.ts$')")
def source_file_listing(spark, d):
    return source_files(doc_entries(spark, d)).select("project_id", "rel_path")


KIDS_SQL = """, kids AS (SELECT project_id, parent, count(*) FILTER (WHERE kind <> 'dir') AS files, count(*) FILTER (WHERE kind = 'dir') AS dirs FROM entries WHERE parent IS NOT NULL GROUP BY ALL)"""


@query("dir_stats", PAGES + KIDS_SQL + " SELECT e.project_id, e.rel_path, CAST(e.depth AS BIGINT) AS depth, coalesce(files, 0) AS files, coalesce(dirs, 0) AS dirs FROM entries e LEFT JOIN kids k ON e.project_id = k.project_id AND e.rel_path = k.parent WHERE kind = 'dir'")
def dir_stats(spark, d):
    return S.dir_stats(page_entries(spark, d)).select("project_id", "rel_path", F.col("depth").cast("long").alias("depth"), "files", "dirs")


@query("project_stats", PAGES + """ SELECT project_id, count(*) FILTER (WHERE kind <> 'dir') AS total_files, count(*) FILTER (WHERE kind = 'dir' AND rel_path <> '') AS total_dirs,
  CAST(max(depth) FILTER (WHERE kind = 'dir') AS BIGINT) AS max_depth, CAST(coalesce(sum(floor(size / 1024.0 + 0.5)) FILTER (WHERE kind <> 'dir'), 0) AS BIGINT) AS total_kb FROM entries GROUP BY project_id""")
def project_stats(spark, d):
    return S.project_stats(page_entries(spark, d)).withColumn("max_depth", F.col("max_depth").cast("long"))


@query("normalize_path", r"""specs AS (SELECT l_linenumber AS n, l_partkey % 7 AS m FROM lineitem),
paths AS (SELECT CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, repeat('a/', CAST(m AS BIGINT)) || './/' || repeat('../', CAST(n AS BIGINT)) || 'x' AS path FROM specs)
SELECT n, m, path, array_to_string(list_concat(list_transform(range(greatest(m - n, 0)), lambda x: 'a'), ['x']), '/') AS folded FROM paths""")
def normalize_path(spark, d):
    rows = A.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 7).alias("m"))
    rows = rows.withColumn("path", F.expr("concat(repeat('a/', cast(m as int)), './/', repeat('../', cast(n as int)), 'x')"))
    return rows.select("n", "m", "path", X.normalize_path(F.col("path")).alias("folded"))


@query("loc_count", A.DOCUMENT_SOURCES_SQL + " SELECT project_id, rel_path, CAST(CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END AS BIGINT) AS loc FROM sources")
def loc_count(spark, d):
    return A.document_sources(spark, d).select("project_id", "rel_path", X.line_count(F.col("content")).cast("long").alias("loc"))


@query("exports_predicate", A.DOCUMENT_SOURCES_SQL + r" SELECT project_id, rel_path, regexp_matches(content, '(?:^|[\n;])\s*export\b') AS exports_something FROM sources")
def exports_predicate(spark, d):
    return A.document_sources(spark, d).select("project_id", "rel_path", X.exports_something(F.col("content")).alias("exports_something"))


# Comment forms, as in functions/text.py.
CLEAN_SQL = r""", clean AS (SELECT project_id, rel_path, regexp_replace(regexp_replace(content, '/\*.*?\*/', '', 'gs'), '(^|[^:"''`])//[^\n]*', '\1', 'g') AS c FROM sources)"""


@query("strip_comments", A.DOCUMENT_SOURCES_SQL + CLEAN_SQL + " SELECT project_id, rel_path, sha256(c) AS clean_sha256 FROM clean")
def strip_comments(spark, d):
    return A.document_sources(spark, d).select("project_id", "rel_path", F.sha2(X.strip_comments(F.col("content")), 256).alias("clean_sha256"))


# Import forms, as in functions/text.py.
IMPORTS_SQL = CLEAN_SQL + r""", listed AS (SELECT project_id, rel_path, list_concat(
    regexp_extract_all(c, '(?:import|export)\s[^''"`]*?\sfrom\s*[''"`]([^''"`]+)[''"`]', 1), regexp_extract_all(c, 'import\s*[''"`]([^''"`]+)[''"`]', 1),
    regexp_extract_all(c, '(?:import|require)\s*\(\s*[''"`]([^''"`]+)[''"`]\s*\)', 1)) AS specs FROM clean),
placed AS (SELECT project_id, rel_path, unnest(specs) AS spec, unnest(range(len(specs))) AS place FROM listed),
ordered AS (SELECT project_id, rel_path, spec, min(place) AS place FROM placed GROUP BY ALL)"""


@query("extract_imports", A.DOCUMENT_SOURCES_SQL + IMPORTS_SQL + r""" SELECT project_id, rel_path AS from_path, spec, CAST(row_number() OVER (PARTITION BY project_id, rel_path ORDER BY place) - 1 AS BIGINT) AS spec_ord,
  CAST(length(regexp_extract(spec, '^((?:\.\./)+)', 1)) / 3 AS BIGINT) AS deep FROM ordered""")
def extract_imports(spark, d):
    return G.extract_imports(A.document_sources(spark, d)).select("project_id", "from_path", "spec", F.col("spec_ord").cast("long").alias("spec_ord"), F.col("deep").cast("long").alias("deep"))


# --- structural rules ------------------------------------------------------------------------------


@query("deep_nesting", DEEP + " " + _flat_sql("deep-nesting", "rel_path", "CAST(depth AS VARCHAR)", "rel_path", "entries WHERE kind = 'dir' AND depth > 5"))
def deep_nesting(spark, d):
    return flat(S.deep_nesting(deep_entries(spark, d)))


FOLDER_SQL = "(CASE WHEN {0} = '' THEN '.' ELSE {0} END) || '/'"


@query("fat_folder", PAGES + KIDS_SQL + " " + _flat_sql("fat-folder", FOLDER_SQL.format("parent"), "CAST(files AS VARCHAR)", "files || ' files in one directory'", "kids WHERE files > CASE WHEN parent = '' THEN 20 ELSE 5 END"))
def fat_folder(spark, d):
    return flat(S.fat_folder(page_entries(spark, d), Limits(fat_folder=5)))


FOLDER_NAMES_SQL = """, by_style AS (SELECT project_id, parent, style, count(*) AS n, style || ': ' || array_to_string(list_sort(list(name))[1:3], ', ') AS shown FROM styled WHERE kind = 'dir' AND parent IS NOT NULL AND style NOT IN ('special', 'dotted', 'upper') GROUP BY project_id, parent, style),
  gn AS (SELECT project_id, parent, sum(n) AS n, list_sort(list(style)) AS styles, array_to_string(list(shown ORDER BY style), '  |  ') AS snippet FROM by_style GROUP BY ALL)"""
FOLDER_NAMES_ROWS = _flat_sql("naming-mismatch", FOLDER_SQL.format("parent"), "array_to_string(styles, ',')", "snippet", "gn WHERE n >= 3 AND len(styles) > 1")
FILE_NAMES_SQL = r""", gf AS (SELECT project_id, parent, count(*) AS n, bool_or(style = 'pascal') AS p, bool_or(style IN ('kebab', 'camel')) AS o,
  'PascalCase: ' || array_to_string(list_sort(list(name) FILTER (WHERE style = 'pascal'))[1:2], ', ') || '  |  other: ' || array_to_string(list_sort(list(name) FILTER (WHERE style NOT IN ('pascal', 'special', 'dotted')))[1:2], ', ') AS snippet
  FROM styled WHERE kind <> 'dir' AND regexp_matches(name, '\.[tj]sx?$') GROUP BY ALL)"""
FILE_NAMES_ROWS = _flat_sql("naming-mismatch", FOLDER_SQL.format("parent"), "''", "snippet", "gf WHERE n >= 3 AND p AND o")


@query("naming_mismatch_dirs", DOCS + STYLED + FOLDER_NAMES_SQL + " " + FOLDER_NAMES_ROWS)
def naming_mismatch_dirs(spark, d):
    return flat(S.naming_folders(doc_entries(spark, d)))


@query("naming_mismatch_files", DOCS + STYLED + FILE_NAMES_SQL + " " + FILE_NAMES_ROWS)
def naming_mismatch_files(spark, d):
    return flat(S.naming_files(doc_entries(spark, d)))


# Patterns and targets of misplaced files, as in operators/structure.py.
MISPLACED_SQL = r""", m AS (SELECT *, CASE
  WHEN regexp_matches(name, '\.(tsx|jsx)$') AND regexp_matches('/' || rel_path || '/', '(?i)/(utils|helpers|lib|hooks|services)/') THEN 'components/'
  WHEN regexp_matches(name, '\.(test|spec)\.(ts|tsx|js|jsx)$') AND regexp_matches('/' || rel_path || '/', '^/(src|app|components|pages)/') THEN 'a dedicated tests/ or __tests__/ directory'
  WHEN regexp_matches(name, '\.(config|rc)\.(ts|js|mjs|cjs)$|^(jest|vitest|playwright|eslint|prettier|tailwind|postcss|next)\.config') AND regexp_matches('/' || rel_path || '/', '/(src|components|lib|utils)/') THEN 'correct directory'
  WHEN regexp_matches(name, '\.prisma$') AND regexp_matches('/' || rel_path || '/', '/(src|app|components)/') THEN 'prisma/' END AS target FROM entries WHERE kind <> 'dir') """


@query("misplaced_files", DOCS + MISPLACED_SQL + _flat_sql("misplaced-file", "rel_path", "target", "name", "m WHERE target IS NOT NULL"))
def misplaced_files(spark, d):
    return flat(S.misplaced_files(doc_entries(spark, d)))


BARREL_SQL = r""", g AS (SELECT project_id, parent, count(*) AS n, bool_or(regexp_matches(name, '^index\.[tj]sx?$')) AS i FROM entries WHERE kind <> 'dir' AND regexp_matches(name, '\.[tj]sx?$') GROUP BY ALL),
b AS (SELECT e.project_id, e.rel_path, n FROM entries e JOIN g ON e.project_id = g.project_id AND e.rel_path = g.parent WHERE e.kind = 'dir' AND lower(e.name) IN """ + _names(BARREL_DIRS) + " AND n >= 3 AND NOT i) "


@query("missing_barrel", DOCS + BARREL_SQL + _flat_sql("missing-barrel", "rel_path || '/'", "CAST(n AS VARCHAR)", "n || ' files, no index.ts'", "b"))
def missing_barrel(spark, d):
    return flat(S.missing_barrel(doc_entries(spark, d)))


CONCEPT_SQL = ", concepts(g, low) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, group in enumerate(CONCEPTS) for n in group) + "), dup AS (SELECT project_id, parent, g, list_sort(list(low)) AS l FROM entries JOIN concepts ON lower(name) = low WHERE kind = 'dir' AND parent IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) "


@query("duplicate_concept", DOCS + CONCEPT_SQL + _flat_sql("duplicate-concept", FOLDER_SQL.format("parent"), "array_to_string(l, ',')", "array_to_string(l, ', ')", "dup"))
def duplicate_concept(spark, d):
    return flat(S.duplicate_concept(doc_entries(spark, d)))


CUSTOMERS_SQL = """dirs AS (SELECT 'n' || c_nationkey AS project_id, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL))"""


@query("empty_dirs", CUSTOMERS_SQL + " " + _flat_sql("empty-dir", "'c' || c_custkey || '/'", "''", "'(empty)'", "dirs"))
def empty_dirs(spark, d):
    return flat(S.empty_dirs(A.customer_entries(spark, d)))


# Names that may lie at the root, as there.
CHAOS_SQL = r""", g AS (SELECT project_id, count(*) AS n, array_to_string(list_sort(list(name))[1:5], ', ') AS snippet FROM entries WHERE parent = '' AND kind = 'file' AND regexp_matches(name, '\.[tj]sx?$') AND NOT regexp_matches(name, '^(index|app|main|server|entry)\.[tj]sx?$') GROUP BY ALL) """


@query("root_chaos", DOCS + CHAOS_SQL + _flat_sql("root-chaos", "'.'", "CAST(n AS VARCHAR)", "snippet", "g WHERE n > 1"))
def root_chaos(spark, d):
    return flat(S.root_chaos(doc_entries(spark, d), Limits(root_files=1)))


# Names of configuration files, as there.
SCATTERED_SQL = r"entries WHERE kind <> 'dir' AND depth >= 1 AND regexp_matches(name, '\.(config|rc)\.(ts|js|mjs|cjs|json)$|^\.eslintrc|^\.prettierrc|^jest\.config|^vitest\.config')"


@query("scattered_config", DOCS + " " + _flat_sql("scattered-config", "rel_path", "name", "name", SCATTERED_SQL))
def scattered_config(spark, d):
    return flat(S.scattered_config(doc_entries(spark, d), Limits(mode="intended")))


# --- import graph -----------------------------------------------------------------------------------


DEEP_SPECS_SQL = "specs AS (SELECT DISTINCT 'p' AS project_id, 'o' || l_orderkey || '.ts' AS from_path, CAST(l_linenumber AS BIGINT) AS deep, l_partkey AS k FROM lineitem WHERE l_linenumber >= 3), worst AS (SELECT project_id, from_path, deep, repeat('../', deep) || 'part' || k AS spec FROM specs QUALIFY row_number() OVER (PARTITION BY from_path ORDER BY deep DESC, k) = 1)"
DEEP_ROWS = _flat_sql("deep-relative-import", "from_path", "CAST(deep AS VARCHAR)", "spec", "worst")


@query("deep_relative_import", DEEP_SPECS_SQL + " " + DEEP_ROWS)
def deep_relative_import(spark, d):
    rows = A.deep_specs(spark, d).withColumn("deep", X.deep_segments(F.col("spec")))
    return flat(G.deep_relative_imports(rows))


FILES_SQL = """files AS (SELECT 'lib/part' || p_partkey || CASE p_size % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.js' END AS path FROM part),
imports AS (SELECT DISTINCT 'p' AS project_id, 'src/a/b/m' || l_linenumber || '.ts' AS from_path, l_linenumber % 3 AS form, l_partkey AS k FROM lineitem),
bases AS (
  SELECT *, '../.././../lib//part' || k AS spec, 0 AS stage, 'lib/part' || k AS base FROM imports WHERE form = 0
  UNION ALL SELECT *, '@lib/part' || k, 1, 'missing/part' || k FROM imports WHERE form = 1
  UNION ALL SELECT *, '@lib/part' || k, 2, 'lib/part' || k FROM imports WHERE form = 1
  UNION ALL SELECT *, '@lib/part' || k, 3, '@lib/part' || k FROM imports WHERE form = 1
  UNION ALL SELECT *, 'lib/part' || k, 3, 'lib/part' || k FROM imports WHERE form = 2),
candidates AS (
  SELECT project_id, from_path, spec, stage, base || e AS path, o
  FROM bases, (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.d.ts', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs', '/index.d.ts']) AS e, unnest(range(15)) AS o)),
resolved AS (
  SELECT project_id, from_path, spec, path AS to_path FROM candidates JOIN files USING (path)
  QUALIFY row_number() OVER (PARTITION BY from_path, spec ORDER BY stage, o) = 1)"""


def _resolved(spark, d):
    aliases = spark.createDataFrame(A.PROJECT_ALIASES, ALIASES)
    return G.resolve_imports(A.line_imports(spark, d), A.part_files(spark, d), aliases)


@query("resolve_imports", FILES_SQL + " SELECT * FROM resolved")
def resolve_imports(spark, d):
    return _resolved(spark, d)


@query("import_graph_edges", FILES_SQL + " SELECT project_id, from_path, to_path, count(*) AS specs FROM resolved GROUP BY ALL")
def import_graph_edges(spark, d):
    return _resolved(spark, d).groupBy("project_id", "from_path", "to_path").agg(F.count(F.lit(1)).alias("specs"))


DEGREE_SQL = A.LINE_EDGES_SQL + "," + A.SUPPLIER_NODES_SQL + """, degree AS (SELECT n.*, (SELECT count(*) FROM edges e WHERE e.project_id = n.project_id AND e.from_path = n.rel_path) AS import_count,
  (SELECT count(*) FROM edges e WHERE e.project_id = n.project_id AND e.to_path = n.rel_path) AS fan_in FROM nodes n)"""


@query("fan_in_out", DEGREE_SQL + " SELECT project_id, rel_path, import_count, fan_in FROM degree")
def fan_in_out(spark, d):
    return G.with_degrees(A.supplier_nodes(spark, d), A.line_edges(spark, d)).select("project_id", "rel_path", "import_count", "fan_in")


def _line_graph(spark, d):
    edges = Tables(spark, "lines").keep(A.line_edges(spark, d))  # several rules ask for them
    nodes = G.with_degrees(A.supplier_nodes(spark, d), edges)
    imports = A.deep_specs(spark, d).withColumn("deep", X.deep_segments(F.col("spec")))
    return G.ImportGraph(nodes, edges, edges.withColumn("spec", F.col("to_path")), imports, spark.createDataFrame([], ALIASES))


@query("graph_stats", DEGREE_SQL + """ SELECT d.project_id, coalesce(max(e.n), 0) AS edges, CAST(sum(import_count) AS BIGINT) AS total_imports, count(*) AS file_count, max(fan_in) AS max_fan_in,
  CASE WHEN max(fan_in) > 0 THEN arg_min(rel_path, {'a': -fan_in, 'b': rel_path}) END AS max_fan_in_file
  FROM degree d LEFT JOIN (SELECT project_id, count(*) AS n FROM edges GROUP BY ALL) e ON d.project_id = e.project_id GROUP BY d.project_id""")
def graph_stats(spark, d):
    return G.graph_stats(_line_graph(spark, d)).select("project_id", "edges", "total_imports", "file_count", "max_fan_in", "max_fan_in_file")


REACH_SQL = A.LINE_EDGES_SQL + """,
reach AS (SELECT project_id, from_path AS a, to_path AS b FROM edges UNION SELECT r.project_id, r.a, e.to_path FROM reach r JOIN edges e ON r.project_id = e.project_id AND r.b = e.from_path),
scc AS (SELECT x.project_id, x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.project_id = y.project_id AND x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY ALL),
named AS (SELECT project_id, node, least(node, component) AS component FROM scc)"""


@query("scc", REACH_SQL + " SELECT project_id, component, node FROM named")
def scc(spark, d):
    return strong_components(A.line_edges(spark, d))


@query("scc_sizes", A.ORDER_CIRCLES_SQL + """ SELECT project_id, component, node FROM round
 UNION ALL SELECT project_id, folder || format('{:09d}', k), folder || format('{:09d}', k) FROM spaced WHERE k % 10 = 0 AND k NOT IN (SELECT k FROM pairs)""")
def scc_sizes(spark, d):
    """Components of many sizes, files that import themselves included."""
    return strong_components(A.order_circles(spark, d), self_loops=True)


@query("scc_blocks", A.ORDER_CIRCLES_SQL + " SELECT 'all' AS project_id, component, node FROM round")
def scc_blocks(spark, d):
    """All orders as one project that is too large for a task."""
    return strong_components(A.order_circles(spark, d).withColumn("project_id", F.lit("all")), local_edges=4096)


CYCLES_SQL = REACH_SQL + """, groups AS (SELECT project_id, component, list_sort(list(node)) AS members FROM named GROUP BY ALL),
kept AS (SELECT * FROM groups QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY len(members), component) <= 12)"""


CYCLE_ROWS = _flat_sql("circular-dependency", "component", "array_to_string(members, ',')", "array_to_string(CASE WHEN len(members) > 4 THEN list_append(members[1:4], '+' || (len(members) - 4) || ' more') ELSE members END, ' → ') || ' → ' || component", "kept")


@query("circular_dependency", CYCLES_SQL + " " + CYCLE_ROWS)
def circular_dependency(spark, d):
    return flat(G.circular_dependencies(A.line_edges(spark, d)))


ORPHAN_ROWS = _flat_sql("orphan-file", "rel_path", "''", "loc || ' lines, 0 importers'", "degree WHERE fan_in = 0 AND exports_something")
GOD_ROWS = _flat_sql("god-file", "rel_path", "loc || '|' || import_count", "concat_ws(', ', CASE WHEN loc >= 400 THEN loc || ' lines' END, CASE WHEN import_count >= 3 THEN import_count || ' imports' END)", "degree WHERE loc >= 400 OR import_count >= 3")


@query("orphan_nodes", A.ORDER_GRAPH_SQL + ORPHAN_ROWS)
def orphan_nodes(spark, d):
    return flat(G.orphan_files(*A.order_graph(spark, d)))


@query("god_nodes", DEGREE_SQL + " " + GOD_ROWS)
def god_nodes(spark, d):
    return flat(G.god_files(_line_graph(spark, d).nodes, Limits(god_imports=3)))


@query("graph_issues", CYCLES_SQL + "," + DEGREE_SQL.partition("WHERE a.l_suppkey <> b.l_suppkey),")[2] + ", " + DEEP_SPECS_SQL + " " + " UNION ALL ".join([CYCLE_ROWS, ORPHAN_ROWS, GOD_ROWS, DEEP_ROWS]))
def graph_issues(spark, d):
    """All graph rules over one graph."""
    return flat(G.graph_issues(_line_graph(spark, d), Limits(god_imports=3)))


# Paths of files that need no importer, as in operators/graph.py.
ENTRY_SQL = DOCS + r""" SELECT project_id, rel_path, regexp_replace(regexp_replace(name, '\.[tj]sx?$', ''), '\.d$', '') IN """ + _names(ENTRY_NAMES) + r"""
  OR regexp_matches(rel_path, '\.config\.[mc]?[jt]s$|(^|/)(next|tailwind|postcss|jest|vitest|playwright|eslint|prettier|vite|drizzle)\.config\.')
  OR regexp_matches(rel_path, '\.(test|spec|stories|story)\.[tj]sx?$') OR regexp_matches('/' || rel_path, '/app/|/pages/|(^|/)scripts/') AS entry FROM entries WHERE kind = 'file'"""


@query("entry_points", ENTRY_SQL)
def entry_points(spark, d):
    return doc_entries(spark, d).where("kind = 'file'").select("project_id", "rel_path", G.is_entry_point(F.col("rel_path")).alias("entry"))


# --- scores, reports, plans -----------------------------------------------------------------------

DOC_LIMITS = Limits(root_files=1, mode="intended")
ISSUES_SQL = DOCS + STYLED + (
    MISPLACED_SQL.rstrip() + BARREL_SQL.replace("g AS", "gb AS").replace("JOIN g ON", "JOIN gb ON").replace("g.project_id", "gb.project_id").replace("g.parent", "gb.parent").rstrip() + CONCEPT_SQL.rstrip()
    + CHAOS_SQL.replace("g AS", "gc AS").rstrip() + FOLDER_NAMES_SQL + FILE_NAMES_SQL
    + KIDS_SQL + ", issues AS (" + " UNION ALL ".join([
        _flat_sql("root-chaos", "'.'", "CAST(n AS VARCHAR)", "snippet", "gc WHERE n > 1"), _flat_sql("duplicate-concept", FOLDER_SQL.format("parent"), "array_to_string(l, ',')", "array_to_string(l, ', ')", "dup"),
        _flat_sql("deep-nesting", "rel_path", "CAST(depth AS VARCHAR)", "rel_path", "entries WHERE kind = 'dir' AND depth > 5"),
        _flat_sql("fat-folder", FOLDER_SQL.format("parent"), "CAST(files AS VARCHAR)", "files || ' files in one directory'", "kids WHERE files > CASE WHEN parent = '' THEN 20 ELSE 18 END"),
        _flat_sql("misplaced-file", "rel_path", "target", "name", "m WHERE target IS NOT NULL"), FOLDER_NAMES_ROWS, FILE_NAMES_ROWS,
        _flat_sql("missing-barrel", "rel_path || '/'", "CAST(n AS VARCHAR)", "n || ' files, no index.ts'", "b"), _flat_sql("scattered-config", "rel_path", "name", "name", SCATTERED_SQL),
    ]) + ")"
)


def doc_issues(spark, d):
    return S.structural_issues(doc_entries(spark, d), DOC_LIMITS)


@query("issues_union", ISSUES_SQL + " SELECT * FROM issues")
def issues_union(spark, d):
    return flat(doc_issues(spark, d))


@query("score_grade", ISSUES_SQL + """, s AS (SELECT p.project_id, count(i.rule) AS issue_count, CAST(coalesce(sum(i.penalty), 0) AS BIGINT) AS total_penalty FROM (SELECT DISTINCT project_id FROM entries) p LEFT JOIN issues i ON p.project_id = i.project_id GROUP BY ALL)
 SELECT *, greatest(0, 100 - total_penalty) AS score, CASE WHEN greatest(0, 100 - total_penalty) >= 90 THEN 'A' WHEN greatest(0, 100 - total_penalty) >= 80 THEN 'B' WHEN greatest(0, 100 - total_penalty) >= 65 THEN 'C' WHEN greatest(0, 100 - total_penalty) >= 50 THEN 'D' ELSE 'F' END AS grade FROM s""")
def score_grade(spark, d):
    entries = doc_entries(spark, d)
    return report.scores(entries, S.structural_issues(entries, DOC_LIMITS))


RULES_SQL = ", facts(rule, badge, label, sort_ord, migration_ord) AS (VALUES " + ", ".join(f"('{r[0]}', '{r[1]}', '{r[3]}', {r[6]}, {r[7] if r[7] else 'NULL'})" for r in RULES) + ")"


@query("issue_summary_topk", ISSUES_SQL + RULES_SQL + """, ranked AS (SELECT i.*, row_number() OVER (PARTITION BY project_id, i.rule ORDER BY file, snippet) AS place, count(*) OVER (PARTITION BY project_id, i.rule) AS total FROM issues i)
 SELECT r.project_id, r.rule, badge, label, CAST(sort_ord AS BIGINT) AS sort_ord, place, file, snippet, total, greatest(total - 3, 0) AS hidden FROM ranked r JOIN facts f ON r.rule = f.rule WHERE place <= 3""")
def issue_summary_topk(spark, d):
    rows = report.issue_summary(doc_issues(spark, d))
    return rows.select("project_id", "rule", "badge", "label", F.col("sort_ord").cast("long").alias("sort_ord"), F.col("place").cast("long").alias("place"), "file", "snippet", "total", "hidden")


GRAPH_SUMMARY_SQL = CYCLES_SQL + "," + DEGREE_SQL.partition("WHERE a.l_suppkey <> b.l_suppkey),")[2] + ", " + DEEP_SPECS_SQL + ", issues AS (" + " UNION ALL ".join([CYCLE_ROWS, ORPHAN_ROWS, GOD_ROWS, DEEP_ROWS]) + ")"


@query("graph_summary_topk", GRAPH_SUMMARY_SQL + """, weighed AS (SELECT *, CASE rule WHEN 'circular-dependency' THEN len(string_split(detail, ',')) WHEN 'god-file' THEN -(CAST(split_part(detail, '|', 1) AS BIGINT) + 10 * CAST(split_part(detail, '|', 2) AS BIGINT)) WHEN 'deep-relative-import' THEN -CAST(detail AS BIGINT) ELSE 0 END AS w FROM issues),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id, rule ORDER BY w, file, snippet) AS place, count(*) OVER (PARTITION BY project_id, rule) AS total FROM weighed)
SELECT project_id, rule, place, file, snippet, total FROM ranked WHERE place <= 3""")
def graph_summary_topk(spark, d):
    """The worst findings of each graph rule, worst first."""
    rows = report.issue_summary(G.graph_issues(_line_graph(spark, d), Limits(god_imports=3)))
    return rows.select("project_id", "rule", F.col("place").cast("long").alias("place"), "file", "snippet", "total")


@query("issue_map", ISSUES_SQL + " SELECT project_id, regexp_replace(file, '/$', '') AS path, array_to_string(list_sort(list(rule)), ',') AS tags, array_to_string(list(tag ORDER BY rule), ',') AS marks FROM issues JOIN (VALUES " + ", ".join(f"('{r}', '{tag}')" for r, (_, tag) in ISSUE_TYPES.items()) + ") AS t(r, tag) ON rule = r GROUP BY ALL")
def issue_map(spark, d):
    return report.issue_map(doc_issues(spark, d)).withColumns({"tags": F.array_join("tags", ","), "marks": F.array_join("marks", ",")})


TREE_SQL = PAGES + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id, parent, kind = 'dir' ORDER BY name) AS place, count(*) FILTER (WHERE kind <> 'dir') OVER (PARTITION BY project_id, parent) AS n_files FROM entries WHERE parent IS NOT NULL)
 SELECT project_id, rel_path, kind, place, CASE WHEN kind <> 'dir' AND place = 6 THEN greatest(n_files - 6, 0) ELSE 0 END AS hidden,
   CASE WHEN kind = 'dir' THEN (SELECT count(*) FILTER (WHERE e.kind = 'file') || 'f ' || count(*) FILTER (WHERE e.kind = 'dir') || 'd' FROM entries e WHERE e.project_id = ranked.project_id AND e.parent = ranked.rel_path) END AS hint FROM ranked WHERE kind = 'dir' OR place <= 6"""


@query("tree_topk", TREE_SQL)
def tree_topk(spark, d):
    none = spark.createDataFrame([], "project_id string, path string, tags array<string>")
    return render.tree_rows(page_entries(spark, d), none).select("project_id", "rel_path", "kind", F.col("place").cast("long").alias("place"), F.col("hidden").cast("long").alias("hidden"), "hint")


TREE_TEXT_SQL = TREE_SQL.replace(" SELECT project_id, rel_path, kind,", ", shown AS (SELECT project_id, rel_path, parent, name, kind,", 1) + """), tree AS (SELECT *, row_number() OVER kids AS n, lead(kind) OVER kids IS NULL AND hidden = 0 AS last FROM shown WINDOW kids AS (PARTITION BY project_id, parent ORDER BY kind <> 'dir', place)),
 walk AS (SELECT project_id, rel_path, kind, name, hidden, hint, last, [n] AS key, '' AS stem FROM tree WHERE parent = ''
  UNION ALL SELECT t.project_id, t.rel_path, t.kind, t.name, t.hidden, t.hint, t.last, list_append(w.key, t.n), w.stem || CASE WHEN w.last THEN '    ' ELSE '│   ' END FROM tree t JOIN walk w ON t.project_id = w.project_id AND t.parent = w.rel_path AND w.kind = 'dir'),
 lines AS (SELECT project_id, key, stem || CASE WHEN last THEN '└── ' ELSE '├── ' END || name || CASE WHEN kind = 'dir' THEN '/' ELSE '' END || coalesce('  ' || hint, '') AS line FROM walk
  UNION ALL SELECT project_id, list_append(key, 1), stem || '└── … ' || hidden || ' more files' FROM walk WHERE hidden > 0)
 SELECT project_id, project_id || '/' || chr(10) || string_agg(line, chr(10) ORDER BY key) AS tree FROM lines GROUP BY project_id"""


@query("tree_text", TREE_TEXT_SQL)
def tree_text(spark, d):
    none = spark.createDataFrame([], "project_id string, path string, tags array<string>")
    return render.tree_text(render.tree_rows(page_entries(spark, d), none))


# Names that stay at the root, as in plans/migration.py.
MOVES_SQL = r""", moves AS (SELECT project_id, name AS from_path, 'src/' || name AS to_path, 1 AS o FROM entries WHERE parent = '' AND kind = 'file' AND regexp_matches(name, '\.[tj]sx?$') AND NOT regexp_matches(name, '\.d\.ts$')
  AND NOT regexp_matches(name, '^(next|tailwind|postcss|jest|vitest|playwright|eslint|prettier|vite|drizzle)\.config\.|\.config\.[mc]?[jt]s$|^middleware\.[tj]s$|^instrumentation\.[tj]s$') AND project_id IN (SELECT project_id FROM issues WHERE rule = 'root-chaos')
  UNION ALL SELECT project_id, file, regexp_replace(file, '^.*/', ''), 2 FROM issues WHERE rule = 'scattered-config'), moved AS (SELECT project_id, from_path, arg_min(to_path, o) AS to_path FROM moves GROUP BY ALL)"""


@query("fix_moves", ISSUES_SQL + MOVES_SQL + " SELECT * FROM moved")
def fix_moves(spark, d):
    entries = doc_entries(spark, d)
    return migration.plan_moves(entries, S.structural_issues(entries, DOC_LIMITS))


@query("fix_removes", CUSTOMERS_SQL + " SELECT project_id, 'c' || c_custkey AS path FROM dirs")
def fix_removes(spark, d):
    return migration.plan_removes(S.empty_dirs(A.customer_entries(spark, d)))


GUIDANCE_SQL = """, guided AS (SELECT project_id, rule, file,
    CASE rule WHEN 'duplicate-concept' THEN 0 WHEN 'fat-folder' THEN 1 WHEN 'misplaced-file' THEN 2 WHEN 'missing-barrel' THEN 3 WHEN 'naming-mismatch' THEN 4 END AS o,
    CASE rule WHEN 'duplicate-concept' THEN 'Same purpose twice: ' WHEN 'fat-folder' THEN 'Crowded: ' WHEN 'misplaced-file' THEN 'Out of place: ' WHEN 'missing-barrel' THEN 'No single address: ' ELSE 'Names disagree: ' END || file AS title,
    CASE rule WHEN 'duplicate-concept' THEN snippet || ' could all be ' || split_part(detail, ',', 1) || '/.' WHEN 'fat-folder' THEN detail || ' files side by side; a subfolder for each topic makes them findable.'
      WHEN 'misplaced-file' THEN 'Its kind is kept under ' || detail || '.' WHEN 'missing-barrel' THEN detail || ' sources are imported one by one for want of an index file.'
      ELSE snippet || '; settle on one style for each kind of entry.' END AS detail FROM issues),
 numbered AS (SELECT project_id, rule, title, detail, row_number() OVER (PARTITION BY project_id ORDER BY o, file, title, detail) AS n FROM guided WHERE o IS NOT NULL)"""


@query("guidance", ISSUES_SQL + GUIDANCE_SQL + " SELECT * FROM numbered")
def guidance(spark, d):
    return migration.plan_guidance(doc_issues(spark, d)).withColumn("n", F.col("n").cast("long"))


# Written out, so that a wrong constant on one side shows.
WHY_SQL = """CASE i.rule
  WHEN 'root-chaos' THEN 'More than 3 script files sit directly in the project folder, next to settings and lock files.'
  WHEN 'duplicate-concept' THEN 'One folder holds at least 2 subfolders out of the same group of synonyms, so new code has no single home.'
  WHEN 'deep-nesting' THEN 'The folder lies more than 5 levels below the project, and each level adds a segment to every path through it.'
  WHEN 'fat-folder' THEN 'The folder lists over 18 files of its own (over 20 at the top), none of them grouped.'
  WHEN 'naming-mismatch' THEN 'Of 3 or more neighbours some are written in one case style and some in another.'
  WHEN 'missing-barrel' THEN 'At least 3 scripts share a folder that others import from, and it has no index script.'
  WHEN 'scattered-config' THEN 'A settings file was found 1 or more levels below the folder in which its tool starts.'
  WHEN 'empty-dir' THEN 'The listing shows 0 entries in this folder once skipped names are left out.'
  ELSE CASE detail WHEN 'components/' THEN 'a component belongs with the components.' WHEN 'a dedicated tests/ or __tests__/ directory' THEN 'a test belongs apart from the sources.'
    WHEN 'correct directory' THEN 'configuration belongs at the project root.' WHEN 'prisma/' THEN 'a schema belongs in prisma/.' END END"""

@query("migration_plan", ISSUES_SQL + RULES_SQL + f""", ranked AS (SELECT i.project_id, i.rule, file, {WHY_SQL} AS why, row_number() OVER (PARTITION BY i.project_id ORDER BY migration_ord, file, detail) AS n, count(*) OVER (PARTITION BY i.project_id) AS total
  FROM issues i JOIN facts f ON i.rule = f.rule WHERE migration_ord IS NOT NULL) SELECT project_id, n, rule, why, greatest(total - 12, 0) AS remaining FROM ranked WHERE n <= 12""")
def migration_plan(spark, d):
    return migration.migration_plan(doc_issues(spark, d)).select("project_id", F.col("n").cast("long").alias("n"), "rule", "why", "remaining")


ACTIONS_SQL = """, acted AS (SELECT i.project_id, i.rule, file, migration_ord,
    CASE i.rule WHEN 'root-chaos' THEN snippet || ' (in the root)' WHEN 'duplicate-concept' THEN array_to_string(list_transform(string_split(detail, ','), lambda x: file || x || '/'), ' + ')
      WHEN 'deep-nesting' THEN file || ' (' || detail || ' levels)' WHEN 'fat-folder' THEN file || ' (' || detail || ' files)'
      WHEN 'naming-mismatch' THEN file || ' (' || CASE WHEN detail = '' THEN 'inconsistent' ELSE replace(detail, ',', ' + ') END || ')' ELSE file END AS source,
    CASE i.rule WHEN 'root-chaos' THEN 'src/' WHEN 'duplicate-concept' THEN file || split_part(detail, ',', 1) || '/' WHEN 'misplaced-file' THEN detail WHEN 'deep-nesting' THEN 'one or two levels less, or a path alias'
      WHEN 'fat-folder' THEN file || '<concern>/' WHEN 'naming-mismatch' THEN 'one style' WHEN 'missing-barrel' THEN file || 'index.ts' WHEN 'scattered-config' THEN regexp_replace(file, '^.*/', '') ELSE '(delete)' END AS target
  FROM issues i JOIN facts f ON i.rule = f.rule WHERE migration_ord IS NOT NULL)
 SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY migration_ord, file, source) AS n, rule, source, target FROM acted"""


@query("migration_actions", ISSUES_SQL + RULES_SQL + ACTIONS_SQL)
def migration_actions(spark, d):
    """Every action of the plan, with what it moves and where to."""
    return migration.migration_plan(doc_issues(spark, d), top=1 << 30).select("project_id", F.col("n").cast("long").alias("n"), "rule", "source", "target")


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"
STACK_SQL = f"""k AS (SELECT 'e' || event_id AS project_id, {_K} AS k FROM events)
SELECT project_id, project_id AS name, concat_ws('|', CASE WHEN k % 2 = 0 THEN 'Next.js 14' ELSE 'React ' || (k % 20) END, CASE WHEN k % 3 = 0 THEN 'TypeScript' END, CASE WHEN k % 5 = 0 THEN 'App Router' WHEN k % 7 = 0 THEN 'Pages Router' END,
  CASE WHEN k % 7 = 0 THEN 'Prisma' END, 'Tailwind', CASE WHEN k % 11 = 0 THEN 'Monorepo' END) AS labels, CASE WHEN k % 2 = 0 THEN 'pnpm' WHEN k % 3 = 0 THEN 'yarn' ELSE 'npm' END AS pm, k % 5 = 0 AS app_router, k % 7 = 0 AS pages_router,
  k % 11 = 0 AS is_monorepo, k % 5 = 0 AS has_src, k % 7 = 0 AS has_prisma, k % 4 = 0 AS has_tests FROM k"""


@query("detect_stack", STACK_SQL)
def stack(spark, d):
    return detect_stack(*A.event_projects(spark, d)).withColumn("labels", F.array_join("labels", "|"))


SCRIPTS_SQL = ISSUES_SQL + MOVES_SQL + GUIDANCE_SQL + """, every AS (SELECT DISTINCT project_id FROM entries),
 dirs AS (SELECT DISTINCT project_id, CASE WHEN contains(to_path, '/') THEN regexp_replace(to_path, '/[^/]*$', '') ELSE '' END AS dir FROM moved),
 said AS (SELECT project_id, n, '# ' || n || '. ' || title || ': ' || detail AS line FROM numbered)"""
_SCRIPT_END = " SELECT project_id, string_agg(line, chr(10) ORDER BY section, o, line) AS script FROM lines GROUP BY project_id"
BASH_SQL = SCRIPTS_SQL + """, lines AS (SELECT project_id, 0 AS section, '' AS o, '#!/usr/bin/env bash' || chr(10) || '# Review before running; commit first.' || chr(10) || 'set -euo pipefail' AS line FROM every
 UNION ALL SELECT project_id, 1, dir, 'mkdir -p -- ' || chr(39) || dir || chr(39) FROM dirs WHERE dir <> '' UNION ALL SELECT project_id, 2, from_path, 'git mv -- ' || chr(39) || from_path || chr(39) || ' ' || chr(39) || to_path || chr(39) FROM moved
 UNION ALL SELECT project_id, 4, lpad(CAST(n AS VARCHAR), 6, '0'), line FROM said)""" + _SCRIPT_END
POWERSHELL_SQL = SCRIPTS_SQL + """, lines AS (SELECT project_id, 0 AS section, '' AS o, '# Review before running; commit first.' || chr(10) || '$ErrorActionPreference = ' || chr(39) || 'Stop' || chr(39) AS line FROM every
 UNION ALL SELECT project_id, 1, dir, 'New-Item -ItemType Directory -Force -Path ' || chr(39) || dir || chr(39) || ' | Out-Null' FROM dirs WHERE dir <> '' UNION ALL SELECT project_id, 2, from_path, 'git mv -- ' || chr(39) || from_path || chr(39) || ' ' || chr(39) || to_path || chr(39) FROM moved
 UNION ALL SELECT project_id, 4, lpad(CAST(n AS VARCHAR), 6, '0'), line FROM said)""" + _SCRIPT_END
STATS_SQL = """, stats AS (SELECT project_id, count(*) FILTER (WHERE kind <> 'dir') || ' files, ' || count(*) FILTER (WHERE kind = 'dir' AND rel_path <> '') || ' directories, depth ' || max(depth) FILTER (WHERE kind = 'dir') AS counts FROM entries GROUP BY project_id)"""
MARKDOWN_SQL = SCRIPTS_SQL + STATS_SQL + """, lines AS (SELECT project_id, 0 AS section, '' AS o, '# Migration plan' || chr(10) || chr(10) || counts || chr(10) || chr(10) || '## Moves' || chr(10) AS line FROM stats
 UNION ALL SELECT project_id, 1, '', 'None.' FROM every WHERE project_id NOT IN (SELECT project_id FROM moved) UNION ALL SELECT DISTINCT project_id, 1, '', '| From | To |' || chr(10) || '|-|-|' FROM moved
 UNION ALL SELECT project_id, 2, from_path, '| `' || from_path || '` | `' || to_path || '` |' FROM moved UNION ALL SELECT project_id, 3, '', chr(10) || '## Removals' || chr(10) FROM every
 UNION ALL SELECT project_id, 5, '', chr(10) || '## Guidance' || chr(10) FROM every UNION ALL SELECT project_id, 6, lpad(CAST(n AS VARCHAR), 6, '0'), '### ' || n || '. ' || title || chr(10) || chr(10) || detail FROM numbered
 UNION ALL SELECT project_id, 7, '', chr(10) || '## Verify' || chr(10) || chr(10) || 'Run the scan and the type checker again.' FROM every)""" + _SCRIPT_END


def _plans(spark, d):
    entries = doc_entries(spark, d)
    issues = S.structural_issues(entries, DOC_LIMITS)
    return entries, migration.plan_moves(entries, issues), migration.plan_removes(issues), migration.plan_guidance(issues)


@query("render_script", BASH_SQL)
def render_script(spark, d):
    return render.bash_script(*_plans(spark, d))


@query("render_powershell", POWERSHELL_SQL)
def render_powershell(spark, d):
    return render.powershell_script(*_plans(spark, d))


@query("render_markdown", MARKDOWN_SQL)
def render_markdown(spark, d):
    entries, *plans = _plans(spark, d)
    return render.markdown_plan(S.project_stats(entries), *plans)


# Written out, as above.
FACTS_OF_RULES_SQL = """, r(rule, badge, category, label, severity, penalty, sort_ord, migration_ord, explanation, example) AS (VALUES
  ('circular-dependency', 'CRIT', 'architecture', 'Circular dependency', 'critical', 10, 1, NULL, 'Two or more files reach each other through imports; whichever loads first sees the others half initialised.', 'a.ts imports b.ts, which imports a.ts'),
  ('root-chaos', 'CRIT', 'structure', 'Loose root files', 'warning', 6, 2, 1, 'More than 3 script files sit directly in the project folder, next to settings and lock files.', 'utils.ts beside package.json'),
  ('duplicate-concept', 'WARN', 'structure', 'Duplicate concept', 'warning', 8, 3, 2, 'One folder holds at least 2 subfolders out of the same group of synonyms, so new code has no single home.', 'utils/ and helpers/'),
  ('god-file', 'WARN', 'architecture', 'God file', 'warning', 5, 4, NULL, 'The file counts 400 lines or resolves 30 imports, or more of either.', 'service.ts with 900 lines'),
  ('deep-nesting', 'WARN', 'structure', 'Deep nesting', 'warning', 4, 5, 4, 'The folder lies more than 5 levels below the project, and each level adds a segment to every path through it.', 'a/b/c/d/e/f'),
  ('fat-folder', 'WARN', 'structure', 'Fat folder', 'warning', 6, 6, 5, 'The folder lists over 18 files of its own (over 20 at the top), none of them grouped.', 'components/ with 40 files'),
  ('orphan-file', 'WARN', 'architecture', 'Orphan file', 'warning', 5, 7, NULL, 'The file exports something, no other file resolves an import to it, and its name marks no entry point.', 'old-helper.ts'),
  ('misplaced-file', 'WARN', 'structure', 'Misplaced file', 'warning', 4, 8, 3, 'The name of the file says one kind, the folder above it another.', 'utils/Card.tsx'),
  ('naming-mismatch', 'INFO', 'naming', 'Mixed naming', 'info', 5, 9, 6, 'Of 3 or more neighbours some are written in one case style and some in another.', 'userCard/ beside user-list/'),
  ('missing-barrel', 'INFO', 'structure', 'Missing barrel', 'info', 3, 10, 7, 'At least 3 scripts share a folder that others import from, and it has no index script.', 'hooks/ without index.ts'),
  ('deep-relative-import', 'INFO', 'architecture', 'Deep relative import', 'info', 2, 11, NULL, 'The import goes up 3 folders or more before it comes down again.', '../../../lib/x'),
  ('scattered-config', 'INFO', 'structure', 'Scattered config', 'info', 3, 12, 8, 'A settings file was found 1 or more levels below the folder in which its tool starts.', 'src/jest.config.js'),
  ('empty-dir', 'INFO', 'structure', 'Empty directory', 'info', 2, 13, 9, 'The listing shows 0 entries in this folder once skipped names are left out.', 'old/'))"""


@query("rules_dimension", ISSUES_SQL + FACTS_OF_RULES_SQL + """, n AS (SELECT rule, count(*) AS found, count(DISTINCT project_id) AS projects FROM issues GROUP BY rule)
 SELECT r.rule, badge, category, label, severity, CAST(penalty AS BIGINT) AS penalty, CAST(sort_ord AS BIGINT) AS sort_ord, CAST(coalesce(migration_ord, 0) AS BIGINT) AS migration_ord, explanation, example, coalesce(found, 0) AS found, coalesce(projects, 0) AS projects FROM r LEFT JOIN n ON r.rule = n.rule""")
def rules_dimension(spark, d):
    """What is known of each rule, and how often it fires."""
    found = doc_issues(spark, d).groupBy("rule").agg(F.count(F.lit(1)).alias("found"), F.countDistinct("project_id").alias("projects"))
    rows = rules(spark).join(found, "rule", "left").withColumns({"found": F.coalesce("found", F.lit(0)), "projects": F.coalesce("projects", F.lit(0))})
    return rows.withColumns({"penalty": F.col("penalty").cast("long"), "sort_ord": F.col("sort_ord").cast("long"), "migration_ord": F.coalesce("migration_ord", F.lit(0)).cast("long")})


HOSTILE_SQL = """dirs AS (SELECT 'n' || c_nationkey AS project_id, 'it''s $(c' || c_custkey || ') `x`' AS path FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)),
 every AS (SELECT DISTINCT 'n' || c_nationkey AS project_id FROM customer),"""


@query("render_removals", HOSTILE_SQL + """ quoted AS (SELECT project_id, path, chr(39) || replace(path, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) AS bash, chr(39) || replace(path, chr(39), chr(39) || chr(39)) || chr(39) AS shell FROM dirs),
 lines AS (SELECT project_id, 0 AS section, '' AS o, '#!/usr/bin/env bash' || chr(10) || '# Review before running; commit first.' || chr(10) || 'set -euo pipefail' AS bash, '# Review before running; commit first.' || chr(10) || '$ErrorActionPreference = ' || chr(39) || 'Stop' || chr(39) AS shell FROM every
 UNION ALL SELECT project_id, 3, path, 'rmdir -- ' || bash || ' 2>/dev/null || echo ' || chr(39) || 'kept (not empty): ' || bash[2:], 'if (-not (Get-ChildItem -LiteralPath ' || shell || ' -Force)) { Remove-Item -LiteralPath ' || shell || ' }' FROM quoted)
 SELECT project_id, string_agg(bash, chr(10) ORDER BY section, o) AS bash, string_agg(shell, chr(10) ORDER BY section, o) AS shell FROM lines GROUP BY project_id""")
def render_removals(spark, d):
    """Removals of empty folders whose names hold quotes, substitutions and blanks."""
    custom = F.regexp_replace("rel_path", "^c([0-9]+)", "it's \\$(c$1) `x`")
    entries = A.customer_entries(spark, d).withColumns({"rel_path": custom, "parent": F.regexp_replace("parent", "^c([0-9]+)", "it's \\$(c$1) `x`")})
    entries = entries.withColumn("name", F.element_at(F.split("rel_path", "/"), -1))
    issues = S.empty_dirs(entries)
    plans = entries, migration.plan_moves(entries, issues), migration.plan_removes(issues), migration.plan_guidance(issues)
    bash = render.bash_script(*plans).withColumnRenamed("script", "bash")
    return bash.join(render.powershell_script(*plans).withColumnRenamed("script", "shell"), "project_id")


@query("score_bar", "s AS (SELECT p_partkey, p_partkey % 101 AS score FROM part) SELECT p_partkey, repeat('█', CAST(floor(score / 100.0 * 30 + 0.5) AS BIGINT)) || repeat('░', 30 - CAST(floor(score / 100.0 * 30 + 0.5) AS BIGINT)) AS bar FROM s")
def score_bar(spark, d):
    return A.table(spark, d, "part").select("p_partkey", render.progress_bar(F.col("p_partkey") % 101).alias("bar"))


ALIAS_SQL = """e AS (SELECT event_id AS i FROM events)
SELECT 'e' || i AS project_id, CASE WHEN i % 5 = 0 THEN 'jsconfig.json' ELSE 'tsconfig.json' END AS config_file, CASE WHEN i % 5 = 0 THEN '' ELSE 'src' END AS base_url,
  CASE WHEN i % 5 = 0 THEN '' ELSE '@k/ src/k' || (i % 10) || '/*|@k/ lib/*' END AS aliases FROM e WHERE i % 5 <> 0 OR i % 10 = 0"""


@query("load_aliases", ALIAS_SQL)
def alias_files(spark, d):
    rows = load_aliases(A.event_configs(spark, d))
    return rows.select("project_id", "config_file", "base_url", F.array_join(F.transform("paths", lambda p: F.concat_ws(" ", p.prefix, p.target)), "|").alias("aliases"))


_WORK = ", ".join(r[0] for r in sorted((r for r in RULES if r[7]), key=lambda r: r[7]))
BRIEF_SQL = ISSUES_SQL + RULES_SQL + STATS_SQL + f""", lines AS (SELECT project_id, 0 AS section, '' AS o, 'Project: ' || counts || chr(10) || 'Conventions: sources in src/, folders in kebab-case, components in PascalCase, configuration at the root.' || chr(10) AS line FROM stats
 UNION ALL SELECT project_id, 2, lpad(CAST(sort_ord AS VARCHAR), 3, '0') || file, '- [' || i.rule || '] ' || file || ': ' || snippet FROM issues i JOIN facts f ON i.rule = f.rule
 UNION ALL SELECT project_id, 3, '', chr(10) || 'Order of work: {_WORK}.' || chr(10) || 'Update every import of what you move, and scan again after each kind of issue.' FROM stats)
 SELECT project_id, string_agg(line, chr(10) ORDER BY section, o, line) AS brief FROM lines GROUP BY project_id"""


@query("agent_brief", BRIEF_SQL)
def agent_brief(spark, d):
    entries = doc_entries(spark, d)
    return render.agent_brief(S.structural_issues(entries, DOC_LIMITS), S.project_stats(entries))


LAYOUT_SQL = f"""k AS (SELECT 'e' || event_id AS project_id, {_K} AS k FROM events),
f AS (SELECT project_id, k % 2 = 0 OR k % 17 = 0 AS has_app, k % 3 = 0 AS has_pages, k % 5 = 0 AS has_prisma, k % 2 = 0 OR k % 19 = 0 AS has_src, k % 7 = 0 AS has_public, k % 11 = 0 AS has_tests, k % 13 = 0 AS has_actions FROM k)
SELECT project_id, concat_ws(chr(10), """ + ", ".join(f"CASE WHEN {when} THEN '{path}  {note}' END" for path, when, note in render.LAYOUT) + ") AS layout FROM f"


@query("recommended_structure", LAYOUT_SQL)
def recommended_structure(spark, d):
    return render.recommended_structure(render.layout_flags(A.layout_projects(spark, d)))


FACTS_SQL = ISSUES_SQL.replace(")  SELECT", ") SELECT") + ", " + A.DOCUMENT_SOURCES_SQL.strip() + r""", docfiles AS (SELECT project_id, rel_path, len(string_split(content, chr(10))) AS loc, regexp_matches(content, '(?:^|[\n;])\s*export\b') AS exported FROM sources),
 graphed AS (SELECT project_id, rule, penalty FROM issues UNION ALL SELECT project_id, 'orphan-file', 5 FROM docfiles WHERE exported UNION ALL SELECT project_id, 'god-file', 5 FROM docfiles WHERE loc >= 400),
 per AS (SELECT project_id, count(*) AS issue_count, count(DISTINCT rule) AS n_rules, CAST(sum(penalty) AS BIGINT) AS total_penalty FROM graphed GROUP BY project_id),
 sized AS (SELECT project_id, count(*) FILTER (WHERE kind <> 'dir') AS total_files, bool_or(rel_path IN ('pages', 'src/pages')) AS pages FROM entries GROUP BY project_id),
 counted AS (SELECT project_id, count(*) AS file_count FROM docfiles GROUP BY project_id)
 SELECT s.project_id, greatest(0, 100 - total_penalty) AS score, issue_count, n_rules, total_files, file_count, CAST(0 AS BIGINT) AS edges, 'tsconfig.json' AS alias_config, 'pkg-' || s.project_id AS name, 'Next.js 14' || CASE WHEN pages THEN '|Pages Router' ELSE '' END || '|Tailwind' AS labels
 FROM sized s JOIN per USING (project_id) JOIN counted USING (project_id)"""


def _doc_report(spark, d):
    return report.report(doc_entries(spark, d), A.document_sources(spark, d), A.document_configs(spark, d), DOC_LIMITS)


@query("report_facts", FACTS_SQL)
def report_facts(spark, d):
    """The combined report with graph, aliases and stack, in figures."""
    rules_ = F.size(F.array_distinct(F.transform("issues", lambda i: i.rule))).cast("long")
    return _doc_report(spark, d).select(
        "project_id", "score", "issue_count", rules_.alias("n_rules"), "stats.total_files", "graph_stats.file_count", F.col("graph_stats.edges").alias("edges"), "graph_stats.alias_config", "framework.name", F.array_join("framework.labels", "|").alias("labels"),
    )


LINKED_SQL = """docs AS (SELECT source AS project_id, 'doc_' || doc_id || '.ts' AS rel_path, doc_id, text, lead(doc_id) OVER w AS next, first_value(doc_id) OVER w AS first FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 linked AS (SELECT project_id, rel_path, len(string_split(text, chr(10))) + 3 AS loc, regexp_matches(text, '(?:^|[\\n;])\\s*export\\b') AS exported, (CASE WHEN next IS NULL THEN 0 ELSE 1 END) + (CASE WHEN doc_id = first THEN 0 ELSE 1 END) AS n FROM docs),
 per AS (SELECT project_id, count(*) AS files, CAST(sum(n) AS BIGINT) AS edges, 'doc_' || min(doc_id) || '.ts' AS first, list_sort(list(rel_path)) AS members FROM linked JOIN docs USING (project_id, rel_path) GROUP BY project_id),
 found AS (SELECT project_id, 0 AS o, CAST(0 AS BIGINT) AS w, members[1] AS file, 'circular-dependency ' || members[1] || ' ' || len(members) AS line FROM per WHERE files > 1
  UNION ALL SELECT l.project_id, 1, 0, rel_path, 'orphan-file ' || rel_path || ' 0' FROM linked l JOIN per USING (project_id) WHERE exported AND files = 1
  UNION ALL SELECT project_id, 2, -(loc + 10 * n), rel_path, 'god-file ' || rel_path || ' ' || loc FROM linked WHERE loc >= 400)
 SELECT p.project_id, edges, edges AS total_imports, files AS file_count, files - 1 AS max_fan_in, CASE WHEN files > 1 THEN first END AS max_fan_in_file, 'tsconfig.json' AS alias_config, CAST(1 AS BIGINT) AS alias_count, coalesce(string_agg(line, chr(10) ORDER BY o, w, file), '') AS issues
 FROM per p LEFT JOIN found f ON p.project_id = f.project_id GROUP BY ALL"""


@query("report_graph", LINKED_SQL)
def report_graph(spark, d):
    """Reports whose graph has edges, by name and by alias: figures, and the graph issues in the report's order."""
    made = report.report(doc_entries(spark, d), A.linked_sources(spark, d), A.linked_configs(spark, d), DOC_LIMITS)
    of_graph = F.filter("issues", lambda i: i.rule.isin("circular-dependency", "orphan-file", "god-file", "deep-relative-import"))
    size = lambda i: F.coalesce(F.when(i.rule == "circular-dependency", F.size(i.cycle)), i["loc"], F.lit(0))
    lines = F.array_join(F.transform(of_graph, lambda i: F.concat_ws(" ", i.rule, i.file, size(i).cast("string"))), "\n")
    g = [F.col(f"graph_stats.{c}").alias(c) for c in ("edges", "total_imports", "file_count", "max_fan_in", "max_fan_in_file", "alias_config")]
    return made.select("project_id", *g, F.col("graph_stats.alias_count").cast("long").alias("alias_count"), lines.alias("issues"))


@query("project_report")
def project_report(spark, d):
    return report.report_json(_doc_report(spark, d).drop("generated_at"))


@query("folder_listing", """lines AS (SELECT 'n=' || c_nationkey AS n, 's=' || c_mktsegment AS s, octet_length(encode(c_custkey || ' ' || c_name)) + 1 AS size FROM customer),
 f AS (SELECT n, s, n || '/' || s AS path, CAST(sum(size) AS BIGINT) AS size FROM lines GROUP BY n, s)
 SELECT DISTINCT '' AS rel_path, NULL AS parent, CAST(0 AS BIGINT) AS depth, 'dir' AS kind, CAST(-1 AS BIGINT) AS size, true AS readable FROM f UNION ALL SELECT DISTINCT n, '', CAST(1 AS BIGINT), 'dir', CAST(-1 AS BIGINT), true FROM f UNION ALL SELECT path, n, CAST(2 AS BIGINT), 'dir', CAST(-1 AS BIGINT), true FROM f
 UNION ALL SELECT path || '/file', path, CAST(2 AS BIGINT), 'file', size, true FROM f""")
def folder_listing(spark, d):
    """A nested tree of files, written from customers (a folder for each nation and segment), through the data source."""
    root = f"{shared_dir(spark)}/listing-{uuid.uuid4().hex}"
    line = F.concat_ws(" ", F.col("c_custkey").cast("string"), "c_name").alias("value")
    rows = A.table(spark, d, "customer").select(line, F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"))
    rows.repartition("n", "s").write.option("maxRecordsPerFile", 0).partitionBy("n", "s").text(root)
    found = read_entries(spark, {"tree": root.removeprefix("file://").replace("file:", "")}).where(F.col("name").startswith("part-") | (F.col("kind") == "dir"))
    path = F.regexp_replace("rel_path", "/part-[^/]*$", "/file")
    return found.select(path.alias("rel_path"), "parent", F.col("depth").cast("long").alias("depth"), "kind", F.coalesce("size", F.lit(-1)).alias("size"), "readable")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and grade of every host's url tree."""
    entries = page_entries(spark, sf_dir)
    return report.scores(entries, S.structural_issues(entries))
