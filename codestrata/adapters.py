"""Shared Parquet tables as project relations, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import spread

PROJECT_ALIASES = [("p", "tsconfig.json", "", [(0, "@lib/", "", True, 0, "missing/*"), (0, "@lib/", "", True, 1, "lib/*"), (1, "only", "", False, 0, "lib/part1")], 2)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries_from_paths(paths: DataFrame) -> DataFrame:
    """``entries`` of files given as (project_id, path, size), with every folder above them."""
    own = paths.select("project_id", F.split("path", "/").alias("s"), "size")
    n = F.size("s")
    files = own.groupBy("project_id", "s").agg(F.max("size").alias("size")).select(
        "project_id", F.array_join("s", "/").alias("rel_path"), F.element_at("s", -1).alias("name"), F.array_join(F.slice("s", F.lit(1), n - 1), "/").alias("parent"),
        (n - 1).alias("depth"), F.lit("file").alias("kind"), F.col("size").cast("long").alias("size"),
    )
    ends = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    folders = own.select("project_id", "s", F.explode(ends).alias("i")).select("project_id", F.slice("s", F.lit(1), F.col("i")).alias("s"), "i").distinct()
    folders = folders.select("project_id", F.array_join("s", "/").alias("rel_path"), F.element_at("s", -1).alias("name"), F.array_join(F.slice("s", F.lit(1), F.col("i") - 1), "/").alias("parent"), F.col("i").alias("depth"), F.lit("dir").alias("kind"), F.lit(None).cast("long").alias("size"))
    roots = paths.select("project_id").distinct().select("project_id", F.lit("").alias("rel_path"), F.col("project_id").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit("dir").alias("kind"), F.lit(None).cast("long").alias("size"))
    return files.unionByName(folders).unionByName(roots).withColumn("readable", F.lit(True))


ENTRIES_SQL = """
own AS (SELECT project_id, string_split(path, '/') AS s, size FROM paths),
files AS (
  SELECT project_id, array_to_string(s, '/') AS rel_path, s[len(s)] AS name, array_to_string(s[1:len(s)-1], '/') AS parent,
         len(s) - 1 AS depth, 'file' AS kind, max(size) AS size
  FROM own GROUP BY project_id, s),
folders AS (
  SELECT DISTINCT project_id, array_to_string(s[1:i], '/') AS rel_path, s[i] AS name, array_to_string(s[1:i-1], '/') AS parent,
         i AS depth, 'dir' AS kind, NULL AS size
  FROM (SELECT *, unnest(range(1, len(s))) AS i FROM own)),
entries AS (
  SELECT * FROM files UNION ALL SELECT * FROM folders
  UNION ALL SELECT DISTINCT project_id, '', project_id, NULL, 0, 'dir', NULL FROM paths)"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: each host is a project, url paths are its files."""
    at = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-zA-Z]+://", ""), "[?#].*$", ""), "/$", "")
    pages = table(spark, sf_dir, "pages").select(at.alias("at"), F.octet_length("html").alias("size"))
    return pages.select(F.substring_index("at", "/", 1).alias("project_id"), F.regexp_replace("at", "^[^/]*/", "").alias("path"), "size")


PAGE_PATHS_SQL = """
pageat AS (SELECT regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', ''), '/$', '') AS place, strlen(html) AS size FROM pages),
paths AS (SELECT split_part(place, '/', 1) AS project_id, regexp_replace(place, '^[^/]*/', '') AS path, size FROM pageat),"""

FOLDERS = ("utils", "components", "src", "hooks", "lib", "types", "models", "pages", "Helpers", "API", "my_store")
FILES = (".tsx", ".test.ts", ".config.js", ".prisma", ".ts")


def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: each source is a project, documents are files with synthetic names."""
    folders, ends = F.array(*[F.lit(x) for x in FOLDERS]), F.array(*[F.lit(x) for x in FILES])
    i = F.col("doc_id")
    name = F.concat(F.when(i % 3 == 0, F.concat(F.lit("Card"), i.cast("string"))).when(i % 3 == 1, F.concat(F.lit("card-"), i.cast("string"))).otherwise(F.concat(F.lit("cardOf"), i.cast("string"))), F.element_at(ends, (i % 5 + 1).cast("int")))
    folder = F.element_at(folders, (i % 11 + 1).cast("int"))
    path = F.when(i % 13 == 0, name).when(i % 7 == 0, F.concat(folder, F.lit("/"), F.element_at(folders, (i % 4 + 1).cast("int")), F.lit("/"), name)).otherwise(F.concat(folder, F.lit("/"), name))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), path.alias("path"), F.col("n_chars").alias("size"))


DOCUMENT_PATHS_SQL = f"""
named AS (
  SELECT source AS project_id, doc_id AS i, n_chars AS size,
         (CASE WHEN doc_id % 3 = 0 THEN 'Card' WHEN doc_id % 3 = 1 THEN 'card-' ELSE 'cardOf' END) || doc_id || ({list(FILES)})[doc_id % 5 + 1] AS name,
         ({list(FOLDERS)})[doc_id % 11 + 1] AS folder, ({list(FOLDERS)})[doc_id % 4 + 1] AS inner_folder
  FROM documents),
paths AS (
  SELECT project_id, CASE WHEN i % 13 = 0 THEN name WHEN i % 7 = 0 THEN folder || '/' || inner_folder || '/' || name ELSE folder || '/' || name END AS path, size
  FROM named),"""


def deep_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: each supplier is a project; parts lie as deep as their line number."""
    path = F.concat(F.expr("repeat('d/', cast(l_linenumber as int))"), F.lit("part"), F.col("l_partkey").cast("string"), F.lit(".ts"))
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("project_id"), path.alias("path"), F.lit(1).cast("long").alias("size"))


DEEP_PATHS_SQL = """
paths AS (SELECT 's' || l_suppkey AS project_id, repeat('d/', CAST(l_linenumber AS BIGINT)) || 'part' || l_partkey || '.ts' AS path, CAST(1 AS BIGINT) AS size FROM lineitem),"""


def customer_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are projects, customers folders, the events of the user with the customer's number files."""
    customer, events = table(spark, sf_dir, "customer"), table(spark, sf_dir, "events")
    folder = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    project = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    dirs = customer.select(project.alias("project_id"), folder.alias("rel_path"), folder.alias("name"), F.lit("").alias("parent"), F.lit(1).alias("depth"), F.lit("dir").alias("kind"), F.lit(None).cast("long").alias("size"))
    name = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    kept = events.join(customer, F.col("user_id") == F.col("c_custkey"))
    files = kept.select(project.alias("project_id"), F.concat(folder, F.lit("/"), name).alias("rel_path"), name.alias("name"), folder.alias("parent"), F.lit(1).alias("depth"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("size"))
    return dirs.unionByName(files).withColumn("readable", F.lit(True))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: part names in five styles, with the brand as project."""
    words = F.split("p_name", " ")
    joined = F.array_join(F.transform(words, F.initcap), "")
    i = F.col("p_size") % 5
    name = (
        F.when(i == 0, F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).when(i == 1, F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
        .when(i == 2, F.concat(words[0], F.initcap(words[1]))).when(i == 3, joined).otherwise(F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))))
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_brand", "#", "").alias("project_id"), name.alias("name"))


PART_NAMES_SQL = """
parts AS (
  SELECT p_partkey, regexp_replace(p_brand, '#', '') AS project_id, p_size % 5 AS i, p_name, string_split(p_name, ' ') AS w FROM part),
names AS (
  SELECT p_partkey, project_id, CASE i WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN replace(p_name, ' ', '_')
    WHEN 2 THEN w[1] || upper(w[2][1]) || w[2][2:] WHEN 3 THEN array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), '')
    ELSE upper(replace(p_name, ' ', '_')) END AS name
  FROM parts)"""

# Naming styles, as in functions/text.py.
STYLE_SQL = """CASE WHEN regexp_matches(name, '^[\\[(]') THEN 'special' WHEN regexp_matches(name, '^\\.[a-z]') THEN 'dotted'
    WHEN regexp_matches(base, '^[A-Z][A-Z0-9_]*$') THEN 'upper' WHEN regexp_matches(base, '^[A-Z][a-zA-Z0-9]*$') THEN 'pascal'
    WHEN regexp_matches(base, '^[a-z][a-z0-9]*(-[a-z0-9]+)*$') THEN 'kebab' WHEN regexp_matches(base, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') THEN 'snake'
    WHEN regexp_matches(base, '^[a-z][a-zA-Z0-9]*$') THEN 'camel' ELSE 'mixed' END"""
BASE_SQL = "regexp_replace(regexp_replace(name, '\\.[^.]+$', ''), '\\.[^.]+$', '')"


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: a supplier imports the supplier of the next line of an order; one project a year."""
    line = table(spark, sf_dir, "lineitem")
    a = line.select("l_orderkey", F.col("l_linenumber").alias("n"), F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("a"))
    b = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_suppkey").alias("b"))
    ends = a.join(b, ["l_orderkey", "n"]).where("a <> b").select("year", "a", "b").distinct()  # names are made of what is left
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    return ends.select(F.col("year").cast("string").alias("project_id"), name("a").alias("from_path"), name("b").alias("to_path"))


LINE_EDGES_SQL = """
edges AS (
  SELECT DISTINCT CAST(year(a.l_shipdate) AS VARCHAR) AS project_id, 's' || a.l_suppkey AS from_path, 's' || b.l_suppkey AS to_path
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_suppkey <> b.l_suppkey)"""


def supplier_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each year: its suppliers, with a line count and an export flag."""
    line = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("string").alias("project_id"), F.col("l_suppkey").alias("k")).distinct()
    return line.select("project_id", F.concat(F.lit("s"), F.col("k").cast("string")).alias("rel_path"), (F.col("k") * 7 % 500).cast("int").alias("loc"), (F.col("k") % 3 != 0).alias("exports_something"))


SUPPLIER_NODES_SQL = """
nodes AS (
  SELECT DISTINCT CAST(year(l_shipdate) AS VARCHAR) AS project_id, 's' || l_suppkey AS rel_path, CAST(l_suppkey * 7 % 500 AS INTEGER) AS loc,
         l_suppkey % 3 <> 0 AS exports_something
  FROM lineitem)"""


def order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): an order imports its customer's next order, so only first orders have no importer."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 25).cast("string")).alias("project_id"), "o_custkey", F.col("o_orderkey").alias("k"))
    name = lambda c: F.concat(F.lit("o"), c.cast("string"))
    nodes = orders.select("project_id", name(F.col("k")).alias("rel_path"), (F.col("k") * 7 % 500).cast("int").alias("loc"), (F.col("k") % 3 != 0).alias("exports_something"))
    after = F.lead("k").over(W.partitionBy("o_custkey").orderBy("k"))
    edges = orders.withColumn("after", after).where("after IS NOT NULL").select("project_id", name(F.col("k")).alias("from_path"), name(F.col("after")).alias("to_path"))
    return nodes, edges


ORDER_GRAPH_SQL = """
o AS (SELECT 'c' || (o_custkey % 25) AS project_id, o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders),
degree AS (SELECT project_id, 'o' || k AS rel_path, CAST(k * 7 % 500 AS INTEGER) AS loc, k % 3 <> 0 AS exports_something, CASE WHEN before IS NULL THEN 0 ELSE 1 END AS fan_in FROM o) """


def order_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order imports its customer's next order, a dear one (over 150,000) the one before, and one in ten itself: components of many sizes."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), "o_totalprice")
    each = W.partitionBy("o_custkey").orderBy("k")
    rows = orders.select("o_custkey", "k", F.lead("k").over(each).alias("next"), F.when(F.col("o_totalprice") > 150000, F.lag("k").over(each)).alias("back"), F.when(F.col("k") % 10 == 0, F.col("k")).alias("own"))
    name = lambda c: F.format_string("c%06d/o%09d", "o_custkey", c)
    ends = rows.select(F.concat(F.lit("c"), (F.col("o_custkey") % 25).cast("string")).alias("project_id"), "o_custkey", name("k").alias("from_path"), F.explode(F.array_compact(F.array("next", "back", "own"))).alias("to"))
    return ends.select("project_id", "from_path", name("to").alias("to_path"))


ORDER_CIRCLES_SQL = """
spaced AS (SELECT 'c' || (o_custkey % 25) AS project_id, format('c{:06d}/o', o_custkey) AS folder, o_orderkey AS k, o_totalprice AS price, lead(o_orderkey) OVER c AS next, lag(o_orderkey) OVER c AS before FROM orders WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
ties AS (SELECT project_id, k, next AS other FROM spaced WHERE next IS NOT NULL UNION ALL SELECT project_id, k, before FROM spaced WHERE price > 150000 AND before IS NOT NULL),
reach AS (SELECT project_id, k AS a, other AS b FROM ties UNION SELECT r.project_id, r.a, t.other FROM reach r JOIN ties t ON r.b = t.k),
pairs AS (SELECT x.a AS k, least(x.a, min(x.b)) AS low FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a),
round AS (SELECT project_id, folder || format('{:09d}', low) AS component, folder || format('{:09d}', k) AS node FROM pairs JOIN spaced USING (k))"""


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    end = F.when(F.col("p_size") % 3 == 0, ".ts").when(F.col("p_size") % 3 == 1, ".tsx").otherwise("/index.js")
    return table(spark, sf_dir, "part").select(F.lit("p").alias("project_id"), F.concat(F.lit("lib/part"), k, end).alias("rel_path"))


def line_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: import specifiers of three forms, relative, aliased and below the base."""
    lines = spread(table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber"), "l_partkey", "l_linenumber").distinct()
    k, n = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    spec = F.when(n % 3 == 0, F.concat(F.lit("../.././../lib//part"), k)).when(n % 3 == 1, F.concat(F.lit("@lib/part"), k)).otherwise(F.concat(F.lit("lib/part"), k))
    return lines.select(F.lit("p").alias("project_id"), F.concat(F.lit("src/a/b/m"), n.cast("string"), F.lit(".ts")).alias("from_path"), spec.alias("spec"))


def deep_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = ["l_orderkey", "l_partkey", "l_linenumber"]
    line = spread(table(spark, sf_dir, "lineitem").select(*ends), *ends).distinct()
    spec = F.concat(F.expr("repeat('../', cast(l_linenumber as int))"), F.lit("part"), F.col("l_partkey").cast("string"))
    rows = line.select(F.lit("p").alias("project_id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit(".ts")).alias("from_path"), spec.alias("spec"), F.col("l_partkey").cast("int").alias("spec_ord"), F.col("l_linenumber").cast("int").alias("line_no"))
    return rows


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: documents as source files, with import statements appended."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    tail = F.concat(
        F.lit("\nimport x from \"./"), "source", F.lit("\";\n// import y from \"./no\"\n/* import z\n from './never' */ require('../"), "lang", F.lit("/z');\nexport * from './e"), i, F.lit("'; import './side'; import('./side')\n"),
    )
    return docs.select("source", F.concat(F.lit("doc_"), i, F.lit(".ts")).alias("rel_path"), F.concat("text", tail).alias("content")).select(F.col("source").alias("project_id"), "rel_path", "content")


DOCUMENT_SOURCES_SQL = """
sources AS (
  SELECT source AS project_id, 'doc_' || doc_id || '.ts' AS rel_path, text || chr(10) || 'import x from "./' || source || '";' || chr(10)
    || '// import y from "./no"' || chr(10) || '/* import z' || chr(10) || ' from ''./never'' */ require(''../' || lang || '/z'');' || chr(10)
    || 'export * from ''./e' || doc_id || '''; import ''./side''; import(''./side'')' || chr(10) AS content
  FROM documents)"""


def event_projects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """V6: event groups as projects: (entries, configs)."""
    events = spread(table(spark, sf_dir, "events").select("event_id", "props"), "event_id").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("project_id"), F.from_json("props", "k int").getField("k").alias("k"))
    choose = F.array(*[F.when(F.col("k") % m == 0, p) for m, p in STACK_PATHS])
    paths = events.select("project_id", F.explode(F.array_compact(F.array_append(choose, F.lit("README.md")))).alias("path"), F.lit(1).cast("long").alias("size"))
    package = F.concat(F.lit('{"name": "'), "project_id", F.lit('", "dependencies": {"react": "^'), (F.col("k") % 20).cast("string"), F.lit('.1.0"'), F.when(F.col("k") % 2 == 0, F.lit(', "next": "14.2"')).otherwise(""), F.lit('}, "devDependencies": {"tailwindcss": "3"'), F.when(F.col("k") % 7 == 0, F.lit(', "prisma": "5"')).otherwise(""), F.lit("}}"))
    configs = events.select("project_id", F.lit("package.json").alias("name"), package.alias("content"))
    return entries_from_paths(paths), configs


STACK_PATHS = ((2, "pnpm-lock.yaml"), (3, "yarn.lock"), (5, "src/app/page.tsx"), (7, "pages/index.tsx"), (3, "tsconfig.json"), (11, "turbo.json"), (4, "tests/a.test.ts"))


def document_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package.json and an alias file for each source."""
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id")).distinct()
    package = F.concat(F.lit('{"name": "pkg-'), "project_id", F.lit('", "dependencies": {"next": "^14.2", "tailwindcss": "3"}}'))
    files = F.array(F.struct(F.lit("package.json").alias("name"), package.alias("content")), F.struct(F.lit("tsconfig.json").alias("name"), F.lit('{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}').alias("content")))
    return sources.select("project_id", F.explode(files).alias("f")).select("project_id", "f.*")


def layout_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as projects with the folders that decide on a layout, by their number k."""
    events = spread(table(spark, sf_dir, "events").select("event_id", "props"), "event_id").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("project_id"), F.from_json("props", "k int").getField("k").alias("k"))
    choose = F.array(*[F.when(F.col("k") % m == 0, p) for m, p in LAYOUT_PATHS])
    return entries_from_paths(events.select("project_id", F.explode(F.array_compact(F.array_append(choose, F.lit("README.md")))).alias("path"), F.lit(1).cast("long").alias("size")))


LAYOUT_PATHS = ((2, "src/app/page.tsx"), (3, "pages/index.tsx"), (5, "prisma/schema.prisma"), (7, "public/a.svg"), (11, "tests/a.test.ts"), (13, "actions/a.ts"), (17, "app/page.tsx"), (19, "src/index.ts"))


def event_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a project with an alias file; one in five is broken and has a fallback."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("project_id"))
    body = F.concat(F.lit('{ // paths\n"compilerOptions": {"baseUrl": "./src", "paths": {"@k/*": ["k'), (F.col("i") % 10).cast("string"), F.lit('/*", "../lib/*"],}}}'))
    first = events.select("project_id", F.lit("tsconfig.json").alias("name"), F.when(F.col("i") % 5 == 0, F.concat(F.lit("{"), body)).otherwise(body).alias("content"))
    second = events.where("i % 10 = 0").select("project_id", F.lit("jsconfig.json").alias("name"), F.lit("{}").alias("content"))
    return first.unionByName(second)


def linked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files that import the source's next document by name and its first by an alias."""
    whole = W.partitionBy("s").orderBy("i")
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    # only numbers go through the window of a source; rows that repeat an id are one file
    ids = docs.select(F.col("source").alias("s"), F.col("doc_id").alias("i")).distinct()
    ids = ids.select("s", "i", F.lead("i").over(whole).alias("next"), F.min("i").over(W.partitionBy("s")).alias("first"))
    docs = docs.join(ids, F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("i")))
    name = lambda c: F.concat(F.lit("doc_"), F.col(c).cast("string"))
    after = F.when(F.col("next").isNotNull(), F.concat(F.lit("import n from './"), name("next"), F.lit("';"))).otherwise(";")
    content = F.concat("text", F.lit("\n"), after, F.lit("\nimport f from '@/"), name("first"), F.lit("';\n"))
    return docs.select(F.col("source").alias("project_id"), F.concat(name("doc_id"), F.lit(".ts")).alias("rel_path"), content.alias("content"))


def linked_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alias for the project folder, for each source."""
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id")).distinct()
    return sources.select("project_id", F.lit("tsconfig.json").alias("name"), F.lit('{"compilerOptions": {"paths": {"@/*": ["./*"]}}}').alias("content"))
