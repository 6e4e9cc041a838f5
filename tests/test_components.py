"""Components of graphs too large for a task: blocks, chains, colouring."""

import random

import pytest
from codestrata.operators import components as C
from codestrata.operators import graph as G
from codestrata.schema import Limits
from codestrata.scratch import Tables
from pyspark.sql import functions as F

from .helpers import sources

EDGES = "project_id string, from_path string, to_path string"


def graphs(n, seed, kinds=(0, 1, 2)):
    """Edges of random graphs, of rings with chords, and of broken rings whose names are in no order."""
    rng, rows, want = random.Random(seed), [], []
    for p in range(n):
        size, kind = rng.choice([2, 5, 12, 30, 60]), rng.choice(kinds)
        name = "n{:03}".format
        order = list(range(size))
        if kind == 0:
            pairs = [(rng.randrange(size), rng.randrange(size)) for _ in range(int(size * rng.choice([0.8, 1.1, 1.5, 3])))]
        else:
            if kind == 2:
                rng.shuffle(order)
            pairs = [(order[i], order[(i + 1) % size]) for i in range(size) if rng.random() < 0.97] + [(rng.randrange(size), rng.randrange(size)) for _ in range(rng.randrange(4))]
        pairs = [(name(a), name(b)) for a, b in pairs]
        rows += [(f"p{p:03}", a, b) for a, b in pairs]
        want += [(f"p{p:03}", sorted(g)) for g in C.tarjan([x for x in pairs if x[0] != x[1]])]
    return rows, sorted(want)


def grouped(found):
    groups = {}
    for r in found.collect():
        groups.setdefault((r.project_id, r.component), set()).add(r.node)
    return sorted((p, sorted(g)) for (p, _), g in groups.items() if len(g) > 1)


def stored(spark, rows):
    frame = spark.createDataFrame(rows, EDGES).where("from_path <> to_path").select("project_id", F.col("from_path").alias("a"), F.col("to_path").alias("b")).distinct()
    tables = Tables(spark, "t")
    return tables, tables.keep(frame)


def test_blocks_equal_tarjan_on_200_graphs(spark):
    rows, want = graphs(200, 0)
    tables, edges = stored(spark, rows)
    assert grouped(C._solve(tables, edges, 1200)) == want and len(want) > 100


def test_chains_equal_tarjan(spark):
    rows, want = graphs(40, 1, kinds=(1, 2))
    tables, edges = stored(spark, rows)
    assert grouped(C._chains(tables, edges, 400)) == want and len(want) > 10


def test_thin_keeps_ways_between_fixed_nodes():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(2, 14)
        edges = [(f"{rng.randrange(n)}", f"{rng.randrange(n)}") for _ in range(rng.randrange(1, 3 * n))]
        edges = [e for e in edges if e[0] != e[1]]
        fixed = {f"{i}" for i in range(n) if rng.random() < 0.4}

        def reach(pairs):
            out = {}
            for a, b in pairs:
                out.setdefault(a, set()).add(b)
            found = set()
            for a in fixed:
                todo, seen = [a], set()
                while todo:
                    for b in out.get(todo.pop(), ()):
                        if b not in seen:
                            seen.add(b)
                            todo.append(b)
                found |= {(a, b) for b in seen & fixed if a != b}
            return found

        small = C.thin(edges, fixed)
        assert reach(small) == reach(edges)


@pytest.mark.parametrize("name", ["format_string('src/f%07d', {})", "concat('f', {})"])
def test_ring_of_a_million_files_in_few_jobs(spark, name):
    n = 1_000_000
    ring = spark.range(n).select(F.lit("p").alias("project_id"), F.expr(name.format("id")).alias("from_path"), F.expr(name.format(f"(id + 1) % {n}")).alias("to_path"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    found = C.strong_components(ring, local_edges=100_000).agg(F.count("node").alias("n"), F.countDistinct("component").alias("c"), F.min("component").alias("m")).first()
    assert (found.n, found.c) == (n, 1) and found.m in ("src/f0000000", "f0")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 40


def test_nothing_and_loops(spark):
    none = spark.createDataFrame([], EDGES)
    assert C.strong_components(none).count() == 0
    rows = [("p", "a", "a"), ("p", "b", "c"), ("p", "c", "b"), ("p", "b", "b"), ("q", "a", "b"), ("q", "b", "b"), ("q", "b", "b")]
    frame = spark.createDataFrame(rows, EDGES)
    for limit in (1_000_000, 1):
        assert grouped(C.strong_components(frame, local_edges=limit)) == [("p", ["b", "c"])]
        found = C.strong_components(frame, local_edges=limit, self_loops=True)
        assert sorted(map(tuple, found.collect())) == [("p", "a", "a"), ("p", "b", "b"), ("p", "b", "c"), ("q", "b", "b")]


def test_self_imports_are_circles_of_one_on_request(spark):
    files = {"a.ts": "import './a'", "b.ts": "import './c'", "c.ts": "import './b'; import './c'"}
    plain = G.build_graph(sources(spark, files))
    assert [r.file for r in G.circular_dependencies(plain.edges).collect()] == ["b.ts"]
    flagged = G.build_graph(sources(spark, files), self_imports=True)
    found = G.circular_dependencies(flagged.edges, Limits(self_imports=True)).collect()
    assert sorted((r.file, r.cycle) for r in found) == [("a.ts", ["a.ts"]), ("b.ts", ["b.ts", "c.ts"])]
