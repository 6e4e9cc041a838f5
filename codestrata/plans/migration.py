"""What to do about the issues: moves, removals, guidance, ranked actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import basename
from ..schema import rules

# Fixed values.
STAYS_AT_ROOT = r"^(next|tailwind|postcss|jest|vitest|playwright|eslint|prettier|vite|drizzle)\.config\.|\.config\.[mc]?[jt]s\z|^middleware\.[tj]s\z|^instrumentation\.[tj]s\z"
GUIDANCE_ORDER = ("duplicate-concept", "fat-folder", "misplaced-file", "missing-barrel", "naming-mismatch", "circular-dependency", "god-file", "deep-relative-import", "orphan-file")


def plan_moves(entries: DataFrame, issues: DataFrame) -> DataFrame:
    """(project_id, from_path, to_path): loose root sources of projects with root
    chaos go to src/, nested configuration to the root; one move per file."""
    loose = entries.where("parent = '' AND kind = 'file'").where(F.col("name").rlike(r"\.[tj]sx?\z") & ~F.col("name").rlike(r"\.d\.ts\z") & ~F.col("name").rlike(STAYS_AT_ROOT))
    chaos = issues.where("rule = 'root-chaos'").select("project_id").distinct()
    root = loose.join(chaos, "project_id", "left_semi").select("project_id", F.col("name").alias("from_path"), F.concat(F.lit("src/"), "name").alias("to_path"), F.lit(1).alias("o"))
    nested = issues.where("rule = 'scattered-config'").select("project_id", F.col("file").alias("from_path"), basename(F.col("file")).alias("to_path"), F.lit(2).alias("o"))
    return root.unionByName(nested).groupBy("project_id", "from_path").agg(F.min_by("to_path", "o").alias("to_path"))


def plan_removes(issues: DataFrame) -> DataFrame:
    return issues.where("rule = 'empty-dir'").select("project_id", F.regexp_replace("file", r"/\z", "").alias("path")).distinct()


def plan_guidance(issues: DataFrame) -> DataFrame:
    """(project_id, n, rule, title, detail), numbered in order; deep nesting has none."""
    keep, c = F.coalesce(F.get("duplicates", F.lit(0)), F.lit("lib")), F.concat
    say = {
        "duplicate-concept": (c(F.lit("Same purpose twice: "), "file"), c(F.array_join("duplicates", ", "), F.lit(" could all be "), keep, F.lit("/."))),
        "fat-folder": (c(F.lit("Crowded: "), "file"), c(F.col("file_count").cast("string"), F.lit(" files side by side; a subfolder for each topic makes them findable."))),
        "misplaced-file": (c(F.lit("Out of place: "), "file"), c(F.lit("Its kind is kept under "), F.coalesce("target_dir", F.lit("another folder")), F.lit("."))),
        "missing-barrel": (c(F.lit("No single address: "), "file"), c(F.col("source_file_count").cast("string"), F.lit(" sources are imported one by one for want of an index file."))),
        "naming-mismatch": (c(F.lit("Names disagree: "), "file"), c("snippet", F.lit("; settle on one style for each kind of entry."))),
        "circular-dependency": (c(F.lit("Import circle: "), "file"), c(F.array_join("cycle", ", "), F.lit("; cut one edge by moving what both sides use below them."))),
        "god-file": (c(F.lit("Overloaded: "), "file"), c("snippet", F.lit("; what changes for different reasons can live apart."))),
        "deep-relative-import": (c(F.lit("Import by distance: "), "file"), c("snippet", F.lit(" breaks when either end moves; an alias names the place itself."))),
        "orphan-file": (c(F.lit("Unreferenced: "), "file"), c("snippet", F.lit("; remove it, or write down what loads it."))),
    }
    order = title = detail = None
    for i, rule in enumerate(GUIDANCE_ORDER):
        hit = F.col("rule") == rule
        order = F.when(hit, i) if order is None else order.when(hit, i)
        title = F.when(hit, say[rule][0]) if title is None else title.when(hit, say[rule][0])
        detail = F.when(hit, say[rule][1]) if detail is None else detail.when(hit, say[rule][1])
    rows = issues.withColumns({"o": order, "title": title, "detail": detail}).where("o IS NOT NULL")
    number = F.row_number().over(W.partitionBy("project_id").orderBy("o", "file", "title", "detail"))
    return rows.select("project_id", number.alias("n"), "rule", "title", "detail")


def migration_plan(issues: DataFrame, top: int = 12) -> DataFrame:
    """(project_id, n, rule, source, target, why, remaining): the first ``top``
    structural actions by priority; ``remaining`` counts those not shown."""
    facts = F.broadcast(rules(issues.sparkSession).where("migration_ord IS NOT NULL").select("rule", "migration_ord", "explanation"))  # 9 fixed rows
    rows = issues.join(facts, "rule")
    joined = F.array_join(F.transform("duplicates", lambda d: F.concat(F.col("file"), d, F.lit("/"))), " + ")
    source = (
        F.when(F.col("rule") == "root-chaos", F.concat("snippet", F.lit(" (in the root)")))
        .when(F.col("rule") == "duplicate-concept", joined)
        .when(F.col("rule") == "deep-nesting", F.format_string("%s (%d levels)", "file", "depth"))
        .when(F.col("rule") == "fat-folder", F.format_string("%s (%d files)", "file", "file_count"))
        .when(F.col("rule") == "naming-mismatch", F.concat("file", F.lit(" ("), F.coalesce(F.array_join("styles", " + "), F.lit("inconsistent")), F.lit(")")))
        .otherwise(F.col("file"))
    )
    target = (
        F.when(F.col("rule") == "root-chaos", "src/")
        .when(F.col("rule") == "duplicate-concept", F.concat("file", F.coalesce(F.get("duplicates", F.lit(0)), F.lit("lib")), F.lit("/")))
        .when(F.col("rule") == "misplaced-file", F.coalesce("target_dir", F.lit("correct directory")))
        .when(F.col("rule") == "deep-nesting", "one or two levels less, or a path alias")
        .when(F.col("rule") == "fat-folder", F.concat("file", F.lit("<concern>/")))
        .when(F.col("rule") == "naming-mismatch", "one style")
        .when(F.col("rule") == "missing-barrel", F.concat("file", F.lit("index.ts")))
        .when(F.col("rule") == "scattered-config", basename(F.col("file")))
        .otherwise("(delete)")
    )
    why = F.when(F.col("rule") == "misplaced-file", F.regexp_replace("message", r"(?s)\A.*: ", "")).otherwise(F.col("explanation"))
    rows = rows.withColumns({"source": source, "target": target, "why": why})
    number = F.row_number().over(W.partitionBy("project_id").orderBy("migration_ord", "file", "source"))
    total = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"))
    first = rows.withColumn("n", number).where(F.col("n") <= top).join(total, "project_id")
    return first.select("project_id", "n", "rule", "source", "target", "why", F.greatest(F.col("total") - top, F.lit(0)).alias("remaining"))
