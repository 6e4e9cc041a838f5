"""Connected components over an edge table by alternating large and small stars.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.)  Every
round is two joins of edges with per-node minima; a hub's edges are split by
the skew-join rule, since both join sides are plain shuffles.  Edges never
reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow
from .session import Scratch


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable from each) of the graph with edges a-b."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contract(batches):
    """Edges of a partition to stars, a window of edges at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        nodes, roots = local_roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        keep = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep], pa.int64()), pa.array(roots[keep], pa.int64())], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > 1_000_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def contract(edges: DataFrame) -> DataFrame:
    """Same components, at most one edge per node and partition; columns u > v."""
    return map_arrow(edges, _contract, "u long, v long")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns), where
    component is the smallest node reachable.  Self-loops and repeats are
    harmless; an empty edge table gives an empty result."""
    a, b = edges.columns
    edges = contract(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"))
    edges = scratch.keep(edges.distinct(), "cc_0")
    seen = None
    for i in range(1, 200):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"cc_m{i}")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = scratch.keep(large.distinct(), f"cc_l{i}")
        low2 = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"cc_n{i}")
        moved = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.keep(moved.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), f"cc_{i}")
        now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for name in (f"cc_{i - 1}", f"cc_m{i}", f"cc_l{i}", f"cc_n{i}"):
            scratch.drop(name)
        edges = small
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge in 200 rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def brute_components(pairs: pd.DataFrame) -> dict[int, int]:
    """Single-process union-find, for tests."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in pairs.itertuples(index=False):
        p, q = find(x), find(y)
        parent[max(p, q)] = min(p, q)
    return {x: find(x) for x in list(parent)}
