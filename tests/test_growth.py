"""Steps whose time or memory grew faster than their input, or with the size of one task's share."""

import os
import time

import pandas as pd
import pytest
from codestrata import adapters as A
from codestrata import queries as Q
from codestrata.operators import components as C
from codestrata.operators import graph as G
from codestrata.scratch import TASK_ROWS, Tables, spread
from codestrata.schema import ALIASES
from pyspark.sql import functions as F

from .helpers import sources

SF = "/root/testdata/sf0.001"
shared = pytest.mark.skipif(not os.path.isdir(SF), reason="no shared tables")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_large_components_are_named_in_linear_time():
    n = 30_000
    names = [f"f{i:07}" for i in range(n)]
    began = time.process_time()
    found = C._local(("p",), pd.DataFrame({"from_path": names, "to_path": [*names[1:], names[0]]}))
    assert len(found) == n and set(found.component) == {names[0]}
    assert time.process_time() - began < 5


def test_blocks_are_no_tasks(spark):
    nodes = Tables(spark, "t").keep(spark.range(5000).select(F.lit("p").alias("project_id"), F.format_string("n%05d", "id").alias("node")))
    placed = C._placed(Tables(spark, "t"), nodes, 500)
    sizes = [r["count"] for r in placed.groupBy("block").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 10 and 500 <= len(sizes) <= 504
    assert len(placed.inputFiles()) <= 4
    spans = placed.groupBy("block").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).sort("lo").collect()
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


def test_texts_are_read_once(spark):
    graph = G.build_graph(sources(spark, {"a.ts": "import './b'", "b.ts": "/* import './c' */ export const x = 1"}))
    for frame in (graph.nodes, graph.edges, graph.imports, graph.resolved, G.graph_stats(graph)):
        assert "regexp_extract_all" not in plan(frame)
    assert [(r.from_path, r.to_path) for r in graph.edges.collect()] == [("a.ts", "b.ts")]


def test_rows_of_a_task_are_bounded(spark):
    rows = spark.range(4 * TASK_ROWS + 1)
    assert spread(rows, "id").rdd.getNumPartitions() == 5
    assert spread(rows, "id", n=1).rdd.getNumPartitions() == 4


@shared
def test_unique_keys_are_dealt_before_they_are_combined(spark):
    for frame in (A.layout_projects(spark, SF), A.line_imports(spark, SF), A.deep_specs(spark, SF)):
        # the first aggregation above a scan is behind a deal by number
        assert "REPARTITION_BY_NUM" in plan(frame)
    resolved = G.resolve_imports(A.line_imports(spark, SF), A.part_files(spark, SF), spark.createDataFrame(A.PROJECT_ALIASES, ALIASES))
    assert "REPARTITION_BY_NUM" in plan(resolved)


@shared
def test_only_numbers_go_through_a_source_window(spark):
    made = A.linked_sources(spark, SF)
    lines = plan(made).split("\n")
    at = next(i for i, line in enumerate(lines) if "Window" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789"))
    below = [x for x in lines[at + 1 :] if len(x) - len(x.lstrip(" :+-*()0123456789")) > depth]
    assert below and not any("text#" in x for x in below)
    assert made.count() == A.table(spark, SF, "documents").count()


@shared
def test_edges_of_lines_are_joined_once(spark):
    assert "l_orderkey" not in plan(Q._line_graph(spark, SF).edges)
