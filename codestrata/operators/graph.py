"""Import graph: extraction, resolution, nodes and edges, graph rules.

Resolution is one equi-join: each specifier gives the paths that it may mean
without an extension, these meet what each source file can be imported as, and the
best rank wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import basename, deep_segments, dirname, exports_something, import_specs, line_count, normalize_path, strip_comments, stripped_specs
from ..schema import ALIASES, ENTRY_NAMES, RESOLVE_EXTENSIONS, Limits
from ..scratch import Tables, spread
from .components import strong_components
from .structure import issue

# Paths of files that need no importer.
ENTRY_CONFIG = r"\.config\.[mc]?[jt]s\z|(^|/)(next|tailwind|postcss|jest|vitest|playwright|eslint|prettier|vite|drizzle)\.config\."
ENTRY_TEST = r"\.(test|spec|stories|story)\.[tj]sx?\z"
ENTRY_PLACE = r"/app/|/pages/|(^|/)scripts/"
#: Stands for the project root, so that a path that leaves it meets no file.
_ROOT = "\u0001"


@dataclass(frozen=True)
class ImportGraph:
    nodes: DataFrame  # project_id, rel_path, loc, exports_something, import_count, fan_in
    edges: DataFrame  # project_id, from_path, to_path; distinct
    resolved: DataFrame  # project_id, from_path, spec, to_path; one row per resolved specifier
    imports: DataFrame  # project_id, from_path, spec_ord, spec, deep
    aliases: DataFrame


def extract_imports(sources: DataFrame) -> DataFrame:
    return spec_rows(sources, import_specs(F.col("content")))


def spec_rows(files: DataFrame, specs: Column) -> DataFrame:
    rows = files.select("project_id", F.col("rel_path").alias("from_path"), F.posexplode(specs).alias("spec_ord", "spec"))
    return rows.withColumn("deep", deep_segments(F.col("spec")))


def file_keys(path: Column) -> Column:
    """What a file can be imported as, each with its place in the order of preference:
    itself, without an extension, or as the folder whose index it is."""
    keys = [F.struct(path.alias("base"), F.lit(0).alias("cand"))]
    for i, x in enumerate(RESOLVE_EXTENSIONS, 1):
        stem = F.substr(path, F.lit(1), F.length(path) - len(x))
        keys.append(F.when(path.endswith(x), F.struct(stem.alias("base"), F.lit(i).alias("cand"))))
        keys.append(F.when(path.endswith(x) & (basename(stem) == "index"), F.struct(dirname(stem).alias("base"), F.lit(i + len(RESOLVE_EXTENSIONS)).alias("cand"))))
    return F.array_compact(F.array(*keys))


def _below_root(path: Column) -> Column:
    """Folded path if it stays below the project root, else null."""
    folded = normalize_path(F.concat(F.lit(_ROOT + "/"), path))
    return F.when(folded == _ROOT, "").when(folded.startswith(_ROOT + "/"), F.substr(folded, F.lit(3)))


def import_bases(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """(project_id, from_path, spec, rank, base): what each specifier may mean.

    Relative specifiers mean one path.  Others: aliases as declared (rank 1,
    alias, target), then a path below the base folder (rank 2)."""
    spec = F.col("spec")
    key = ["project_id", "from_path", "spec"]
    rank = lambda stage, a, t: F.struct(F.lit(stage).alias("stage"), a.cast("int").alias("alias"), t.cast("int").alias("target")).alias("rank")
    near = imports.where(spec.startswith(".")).select(*key, rank(0, F.lit(0), F.lit(0)), _below_root(F.concat(dirname(F.col("from_path")), F.lit("/"), spec)).alias("base"))
    lengths = F.array_distinct(F.transform("paths", lambda p: F.struct(p.has_star.alias("has_star"), F.length(p.prefix).alias("head"), F.length(p.suffix).alias("tail"))))
    rows = imports.where(~spec.startswith(".")).join(aliases.select("project_id", "base_url", lengths.alias("forms")), "project_id", "left")
    below = rows.where(~spec.startswith("/")).select(*key, rank(2, F.lit(0), F.lit(0)), _below_root(F.concat(F.coalesce("base_url", F.lit("")), F.lit("/"), spec)).alias("base"))
    return near.unionByName(_aliased(rows, aliases, rank)).unionByName(below)


def _aliased(rows: DataFrame, aliases: DataFrame, rank) -> DataFrame:
    """Bases of specifiers (with the ``forms`` of their project's aliases) that fit an alias.

    An alias is met by its beginning and end as keys of a join: a specifier is cut
    at each pair of lengths that the project's aliases have, so the work grows with
    the lengths in use, and not with the number of aliases."""
    spec, key = F.col("spec"), ["project_id", "from_path", "spec"]
    declared = aliases.select("project_id", F.explode("paths").alias("p")).select("project_id", "p.*")
    fits = lambda f: (f["head"] <= F.length(spec)) & (f["tail"] <= F.length(spec)) & (f["has_star"] | (f["head"] == F.length(spec)))
    cut = rows.select(*key, F.explode(F.filter("forms", fits)).alias("f"))
    cut = cut.select(*key, F.col("f.has_star").alias("has_star"), F.substr(spec, F.lit(1), F.col("f.head")).alias("prefix"), F.right(spec, F.col("f.tail")).alias("suffix"))
    taken = cut.join(declared, ["project_id", "has_star", "prefix", "suffix"])
    middle = F.substr(spec, F.length("prefix") + 1, F.greatest(F.length("spec") - F.length("prefix") - F.length("suffix"), F.lit(0)))
    star = F.locate("*", F.col("target"))
    base = F.when(F.col("has_star") & (star > 0), F.concat(F.substr("target", F.lit(1), star - 1), middle, F.substr("target", star + 1))).otherwise(F.col("target"))
    return taken.select(*key, rank(1, F.col("alias_ord"), F.col("target_ord")), base.alias("base"))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(project_id, from_path, spec, to_path) of each specifier that means a file of its project.

    A base is one key, a file a few (``file_keys``); the order is decided on the hits."""
    bases = import_bases(imports, aliases)
    # a generator computes a base once; a filter on it would be pushed down and fold the path again
    bases = bases.select("project_id", "from_path", "spec", "rank", F.explode(F.array_compact(F.array("base"))).alias("base"))
    bases = Tables(imports.sparkSession, "bases").keep(bases)
    known = files.select("project_id", F.col("rel_path").alias("to_path"), F.explode(file_keys(F.col("rel_path"))).alias("k")).select("project_id", "to_path", "k.*")
    return spread(bases, "project_id", "base").join(known, ["project_id", "base"]).groupBy("project_id", "from_path", "spec").agg(F.min_by("to_path", F.struct("rank", "cand")).alias("to_path"))


def no_aliases(sources: DataFrame) -> DataFrame:
    return sources.sparkSession.createDataFrame([], ALIASES)


def build_graph(sources: DataFrame, aliases: DataFrame | None = None, self_imports: bool = False) -> ImportGraph:
    aliases = no_aliases(sources) if aliases is None else aliases
    tables = Tables(sources.sparkSession, "graph")
    # texts are read once: what the rules ask of them is kept
    facts = sources.select("project_id", "rel_path", line_count(F.col("content")).alias("loc"), exports_something(F.col("content")).alias("exports_something"), strip_comments(F.col("content")).alias("clean"))
    facts = tables.keep(facts.select("project_id", "rel_path", "loc", "exports_something", stripped_specs(F.col("clean")).alias("specs")))
    imports = spec_rows(facts, F.col("specs"))
    resolved = resolve_imports(imports, facts, aliases)
    resolved = tables.keep(resolved if self_imports else resolved.where("from_path <> to_path"))
    edges = tables.keep(resolved.select("project_id", "from_path", "to_path").distinct())
    facts = facts.drop("specs")
    return ImportGraph(with_degrees(facts, edges), edges, resolved, imports, aliases)


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct targets and importers of each node, in one aggregation of the edges' ends."""
    ends = edges.select("project_id", F.explode(F.array(F.struct(F.col("from_path").alias("rel_path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_path").alias("rel_path"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    degree = ends.groupBy("project_id", F.col("e.rel_path").alias("rel_path")).agg(F.sum("e.o").alias("import_count"), F.sum("e.i").alias("fan_in"))
    joined = nodes.join(degree, ["project_id", "rel_path"], "left")
    return joined.withColumns({"import_count": F.coalesce("import_count", F.lit(0)), "fan_in": F.coalesce("fan_in", F.lit(0))})


def cycles(edges: DataFrame, self_imports: bool = False) -> DataFrame:
    """(project_id, file, size, members): strongly connected groups of two or more, and files that import themselves if asked for."""
    groups = strong_components(edges, self_loops=self_imports).groupBy("project_id", "component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    return groups.select("project_id", F.col("members")[0].alias("file"), F.size("members").alias("size"), "members")


def circular_dependencies(edges: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """At most ``max_cycles`` per project, the smallest first.  Files that import
    themselves are reported with ``limits.self_imports``, from edges that hold them."""
    order = W.partitionBy("project_id").orderBy("size", "file")
    rows = cycles(edges, limits.self_imports).withColumn("n", F.row_number().over(order)).where(F.col("n") <= limits.max_cycles)
    shown = F.slice("members", 1, 4)
    chain = F.array_join(F.when(F.col("size") > 4, F.concat(shown, F.array(F.format_string("+%d more", F.col("size") - 4)))).otherwise(shown), " → ")
    text = F.when(F.col("size") == 1, "A file imports itself.").otherwise(F.format_string("%d files import one another in a circle. Move what they share into a module of its own.", "size"))
    return issue(rows, "circular-dependency", F.col("file"), F.concat(chain, F.lit(" → "), F.col("file")), text, cycle=F.col("members"))


def is_entry_point(path: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(basename(path), r"\.[tj]sx?\z", ""), r"\.d\z", "")
    return base.isin(*ENTRY_NAMES) | path.rlike(ENTRY_CONFIG) | path.rlike(ENTRY_TEST) | F.concat(F.lit("/"), path).rlike(ENTRY_PLACE)


def orphan_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    imported = edges.select("project_id", F.col("to_path").alias("rel_path"))
    rows = nodes.where(F.col("exports_something") & ~is_entry_point(F.col("rel_path"))).join(imported, ["project_id", "rel_path"], "left_anti")
    text = F.format_string("%s exports code that nothing imports, and it is no entry point. Delete it if it is unused.", "rel_path")
    return issue(rows, "orphan-file", F.col("rel_path"), F.format_string("%d lines, 0 importers", "loc"), text)


def god_files(nodes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    long, many = F.col("loc") >= limits.god_loc, F.col("import_count") >= limits.god_imports
    why = F.concat_ws(", ", F.when(long, F.format_string("%d lines", "loc")), F.when(many, F.format_string("%d imports", "import_count")))
    text = F.concat(F.col("rel_path"), F.lit(" does too much ("), why, F.lit("). Split it by responsibility."))
    return issue(nodes.where(long | many), "god-file", F.col("rel_path"), why, text, loc=F.col("loc"), import_count=F.col("import_count"))


def deep_relative_imports(imports: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One issue per file, for its deepest specifier, the first of equals."""
    worst = imports.where(F.col("deep") >= limits.deep_segments).groupBy("project_id", "from_path").agg(F.max_by(F.struct("spec", "deep"), F.struct("deep", -F.col("spec_ord"))).alias("w"))
    text = F.format_string("%s climbs %d folders with %s. A path alias survives moves.", "from_path", "w.deep", "w.spec")
    return issue(worst, "deep-relative-import", F.col("from_path"), F.col("w.spec"), text, deep=F.col("w.deep"))


def graph_issues(graph: ImportGraph, limits: Limits = Limits()) -> DataFrame:
    nodes = Tables(graph.nodes.sparkSession, "nodes").keep(graph.nodes)
    found = circular_dependencies(graph.edges, limits)
    for part in (orphan_files(nodes, graph.edges), god_files(nodes, limits), deep_relative_imports(graph.imports, limits)):
        found = found.unionByName(part)
    return found


def graph_stats(graph: ImportGraph) -> DataFrame:
    """Per project: resolved specifiers, distinct imports and files (whose ratio
    ``average_imports`` rounds), and the most imported file, the first by path."""
    per = graph.nodes.groupBy("project_id").agg(
        F.sum("import_count").alias("total_imports"), F.count(F.lit(1)).alias("file_count"), F.max("fan_in").alias("max_fan_in"),
        F.min_by("rel_path", F.struct(-F.col("fan_in"), "rel_path")).alias("file"),
    )
    edges = graph.resolved.groupBy("project_id").agg(F.count(F.lit(1)).alias("edges"))
    joined = per.join(edges, "project_id", "left").join(graph.aliases.select("project_id", "config_file", "alias_count"), "project_id", "left")
    return joined.select(
        "project_id", F.coalesce("edges", F.lit(0)).alias("edges"), "total_imports", "file_count", average_imports(F.col("total_imports"), F.col("file_count")).alias("avg_imports"), "max_fan_in",
        F.when(F.col("max_fan_in") > 0, F.col("file")).alias("max_fan_in_file"), F.col("config_file").alias("alias_config"), F.coalesce("alias_count", F.lit(0)).alias("alias_count"),
    )


def average_imports(total: Column, files: Column) -> Column:
    """total / files at one decimal, rounded by the exact binary value of the
    double (7 / 20 lies just below 0.35 and gives 0.3).

    The double is taken apart into a whole number over a power of two, so the
    tenths and what remains are exact."""
    ratio = total.cast("double") / files.cast("double")
    shift = F.lit(52) - F.floor(F.log2(ratio))
    tenfold = (ratio * F.pow(F.lit(2.0), shift)).cast("long") * 10
    whole = F.pow(F.lit(2.0), shift).cast("long")
    rest = tenfold % whole
    tenths = (tenfold - rest).cast("double") / whole.cast("double") + F.when(rest * 2 >= whole, 1).otherwise(0)
    return F.when((files == 0) | (total * 25 < files), 0.0).otherwise(F.round(tenths) / 10)
