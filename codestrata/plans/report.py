"""Issues to scores, summaries and report documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import grade
from ..operators.graph import ImportGraph, build_graph, graph_issues, graph_stats
from ..operators.profile import detect_stack
from ..operators.structure import project_stats, structural_issues
from ..schema import ISSUE_TYPES, Limits, rules
from ..scratch import Tables
from ..sources.fstree import load_aliases


def scores(projects: DataFrame, issues: DataFrame) -> DataFrame:
    """project_id, issue_count, total_penalty, score (0 to 100) and grade of every project."""
    per = issues.groupBy("project_id").agg(F.count(F.lit(1)).alias("issue_count"), F.sum("penalty").alias("total_penalty"))
    rows = projects.select("project_id").distinct().join(per, "project_id", "left")
    rows = rows.select("project_id", F.coalesce("issue_count", F.lit(0)).alias("issue_count"), F.coalesce("total_penalty", F.lit(0)).alias("total_penalty"))
    return rows.withColumn("score", F.greatest(F.lit(0), 100 - F.col("total_penalty"))).withColumn("grade", grade(F.col("score")))


def worst_first() -> list[Column]:
    """Order among issues of one rule: small circles, long files with many imports and deep imports first, then by path."""
    weight = (
        F.when(F.col("rule") == "circular-dependency", F.size("cycle"))
        .when(F.col("rule") == "god-file", -(F.col("loc") + 10 * F.col("import_count")))
        .when(F.col("rule") == "deep-relative-import", -F.col("deep"))
        .otherwise(0)
    )
    return [weight.cast("long"), F.col("file"), F.col("snippet")]


def scan_order(rule: Column) -> Column:
    """Place of a rule in a report's list of issues; unknown rules come last."""
    place = F.create_map(*[x for i, r in enumerate(ISSUE_TYPES) for x in (F.lit(r), F.lit(i))])
    return F.coalesce(F.try_element_at(place, rule), F.lit(len(ISSUE_TYPES)))


def rule_tag(rule: Column) -> Column:
    """Short mark of a rule in a tree."""
    tags = F.create_map(*[x for r, (_, tag) in ISSUE_TYPES.items() for x in (F.lit(r), F.lit(tag))])
    return F.coalesce(F.try_element_at(tags, rule), rule)


def issue_summary(issues: DataFrame, top: int = 3) -> DataFrame:
    """The first ``top`` issues of each rule and project, with the rule's badge
    and label and the number of issues not shown; unknown rules come last."""
    order = W.partitionBy("project_id", "rule").orderBy(*worst_first())
    every = issues.groupBy("project_id", "rule").agg(F.count(F.lit(1)).alias("total"))
    first = issues.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    facts = F.broadcast(rules(issues.sparkSession).select("rule", "badge", "label", "sort_ord"))  # 13 fixed rows
    rows = first.join(every, ["project_id", "rule"]).join(facts, "rule", "left")
    return rows.select("project_id", "rule", F.coalesce("badge", F.lit("INFO")).alias("badge"), F.coalesce("label", "rule").alias("label"), F.coalesce("sort_ord", F.lit(99)).alias("sort_ord"), "place", "file", "snippet", "message", "total", F.greatest(F.col("total") - top, F.lit(0)).alias("hidden"))


def issue_map(issues: DataFrame) -> DataFrame:
    """Rule names per path, a trailing slash left out, and their short marks."""
    path = F.regexp_replace("file", r"/\z", "")
    rows = issues.groupBy("project_id", path.alias("path")).agg(F.array_sort(F.collect_list("rule")).alias("tags"))
    return rows.withColumn("marks", F.transform("tags", rule_tag))


def all_issues(entries: DataFrame, graph: ImportGraph | None = None, limits: Limits = Limits()) -> DataFrame:
    found = structural_issues(entries, limits)
    return found if graph is None else found.unionByName(graph_issues(graph, limits))


def report(entries: DataFrame, sources: DataFrame | None = None, configs: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """One row per project: score, stats, graph stats, stack and the issues as
    an array of structs.  Without sources: structure only."""
    graph, tables = None, Tables(entries.sparkSession, "report")
    entries = tables.keep(entries)  # entries and issues are read for the score, the statistics and the list
    if sources is not None:
        graph = build_graph(sources, load_aliases(configs, limits.mode) if configs is not None else None, limits.self_imports)
    issues = tables.keep(all_issues(entries, graph, limits))
    body = [c for c in issues.columns if c != "project_id"]
    weight, file, snippet = worst_first()
    row = F.struct(scan_order(F.col("rule")).alias("o"), weight.alias("w"), file.alias("f"), snippet.alias("s"), F.struct(*body).alias("issue"))
    packed = issues.groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["issue"]).alias("issues"))
    rows = scores(entries, issues).join(project_stats(entries).select("project_id", F.struct("total_files", "total_dirs", "max_depth", "total_kb").alias("stats")), "project_id", "left")
    if graph is not None:
        facts = graph_stats(graph)
        rows = rows.join(facts.select("project_id", F.struct(*[c for c in facts.columns if c != "project_id"]).alias("graph_stats")), "project_id", "left")
    if configs is not None:
        stack = detect_stack(entries, configs)
        rows = rows.join(stack.select("project_id", F.struct(*[c for c in stack.columns if c != "project_id"]).alias("framework")), "project_id", "left")
    rows = rows.join(packed, "project_id", "left").withColumn("issues", F.coalesce("issues", F.array().cast(packed.schema["issues"].dataType)))
    return rows.withColumn("generated_at", F.current_timestamp())


def report_json(reports: DataFrame, pretty: bool = True) -> DataFrame:
    """project_id and the report as one JSON document; null fields left out."""
    body = F.struct(*[c for c in reports.columns if c != "project_id"], F.col("project_id").alias("project_path"))
    return reports.select("project_id", F.to_json(body, {"pretty": str(pretty).lower()}).alias("json"))


def write_report(reports: DataFrame, path: str) -> None:
    """One JSON document per line and project.  Nothing is written unless asked for."""
    reports.write.mode("overwrite").json(path)
