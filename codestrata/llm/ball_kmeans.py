"""Centroid clustering by ball k-means, in exact integer arithmetic.

Vectors of ``dim`` components become integers floor(scale * x).  A cluster is a
ball: its centroid and a radius that no member exceeds.  In a round

* centroid j is a neighbour of cluster i if the half distance of the two is within
  i's radius; all other centroids are further from every member than its own;
* a member nearer to its own centroid than half the distance to the nearest
  neighbour is in the stable core and stays without a comparison;
* other members lie in annuli between half distances: one beyond the half distances
  of the m nearest neighbours is compared exactly with these m only.

Half distances are compared as 4 * d(x, c)^2 against d(c, c')^2, all integers, so a
tie is seen as a tie and goes to the smaller number.  A radius after a round is the
largest own distance found, plus the way that the centroid moved since: an upper
bound, which can only add neighbours.

Vectors are kept in blocks (ids, components and clusters as bytes); a round is one
pass that reads a table of blocks and writes the next.  A task adds one row
with its counts and sums for each cluster; these are added up by Spark, and the
driver sees k * dim sums a round.  Every round starts from a written table, so a
lost executor costs its running tasks only.

Cases: vectors that are null, have another number of components, or hold null or
non-finite ones take no part and give no row.  Repeated rows and ids are vectors of
their own, a null id stays and comes last where ids order vectors.  Of vectors that
tie for a first centroid (a repeated id) the one with smaller components is taken.
With fewer vectors than centroids each vector starts one.  Components beyond
+-2^24 after scaling (16,384 for a scale of 1024) are taken as +-2^24, so that
distances fit a long.  An empty table gives an empty result.  Columns other than
the id and vector are not carried, so none can clash.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow
from .session import Scratch

BLOCK_ROWS = 4096
LARGEST = 1 << 24
_BLOCK = "ids binary, known binary, comps binary, cluster binary, near binary, stats binary"
_NAMES = ["ids", "known", "comps", "cluster", "near", "stats"]


def usable(vector: Column, dim: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine, F.lit(False))


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(x.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int32)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid."""
    off = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", off, off)


def between(centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all pairs of centroids."""
    return np.stack([squared(centroids, c) for c in centroids])


def neighbours(apart: np.ndarray, i: int, radius: int) -> np.ndarray:
    """Centroids whose half distance to i is within its radius, nearest first, ties by number."""
    others = np.flatnonzero((apart[i] <= 4 * radius * radius) & (np.arange(len(apart)) != i))
    return others[np.argsort(apart[i, others], kind="stable")]


def reassign(x: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, apart: np.ndarray, radii: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """New clusters, squared distances, and the number of exact comparisons with neighbours."""
    cluster, near, compared = cluster.copy(), np.empty(len(x), np.int64), 0
    order = np.argsort(cluster, kind="stable")
    cuts = np.searchsorted(cluster[order], np.arange(len(centroids) + 1))
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        if lo == hi:
            continue
        own = order[lo:hi]
        base = squared(x[own], centroids[i])
        best, who = base.copy(), np.full(len(own), i, np.int32)
        for j in neighbours(apart, i, radii[i]).tolist():  # in order of distance, so the annuli shrink
            ring = np.flatnonzero(4 * base >= apart[i, j])
            if not len(ring):
                break
            compared += len(ring)
            d = squared(x[own[ring]], centroids[j])
            better = (d < best[ring]) | ((d == best[ring]) & (j < who[ring]))
            best[ring[better]], who[ring[better]] = d[better], j
        cluster[own], near[own] = who, best
    return cluster, near, compared


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first assignment, with no members known yet: all centroids."""
    best, who = squared(x, centroids[0]), np.zeros(len(x), np.int32)
    for j in range(1, len(centroids)):
        d = squared(x, centroids[j])
        better = d < best
        best[better], who[better] = d[better], j
    return who, best


class Totals:
    """Counts, sums, summed and largest distances of the clusters that a task has seen."""

    def __init__(self, k: int, dim: int):
        self.k, self.kept = k, np.zeros((k, dim + 3), np.int64)

    def add(self, x: np.ndarray, cluster: np.ndarray, near: np.ndarray) -> None:
        for i in np.unique(cluster).tolist():
            at = cluster == i
            self.kept[i, 0] += int(at.sum())
            self.kept[i, 1] += int(near[at].sum())
            self.kept[i, 2] = max(self.kept[i, 2], int(near[at].max()))
            self.kept[i, 3:] += x[at].sum(axis=0, dtype=np.int64)

    def row(self) -> pa.RecordBatch:
        none = pa.array([None], pa.binary())
        return pa.RecordBatch.from_arrays([none] * 5 + [pa.array([self.kept.tobytes()], pa.binary())], _NAMES)


def _block(ids: bytes, known: bytes, x: np.ndarray, cluster: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    cells = (ids, known, x.tobytes(), cluster.astype(np.int32).tobytes(), near.tobytes(), None)
    return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], _NAMES)


def _first(dim: int, scale: int, centroids: np.ndarray):
    def run(batches):
        totals = Totals(len(centroids), dim)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = quantised(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
                ids = part.column("id")
                cluster, near = nearest(x, centroids)
                totals.add(x, cluster, near)
                yield _block(ids.fill_null(0).to_numpy().tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), x, cluster, near)
        yield totals.row()

    return run


def _next(dim: int, centroids: np.ndarray, radii: list[int]):
    def run(batches):
        totals, apart = Totals(len(centroids), dim), between(centroids)
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["comps"], np.int32).reshape(-1, dim)
                cluster, near, _ = reassign(x, np.frombuffer(r["cluster"], np.int32), centroids, apart, radii)
                totals.add(x, cluster, near)
                yield _block(r["ids"], r["known"], x, cluster, near)
        yield totals.row()

    return run


def _added(blocks: DataFrame, k: int, dim: int) -> np.ndarray:
    """A table's totals: counts, summed and largest distances, sums; k * (dim + 3) numbers reach the driver."""

    def run(batches):
        made = np.zeros((k, dim + 3), np.int64)
        for batch in batches:
            for cell in batch.column("stats").to_pylist():
                one = np.frombuffer(cell, np.int64).reshape(k, dim + 3)
                largest = np.maximum(made[:, 2], one[:, 2])
                made += one
                made[:, 2] = largest
        at = np.flatnonzero(made.any(axis=1).repeat(dim + 3))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(made.ravel()[at], pa.int64())], ["place", "value"])

    rows = map_arrow(blocks.where("stats IS NOT NULL").select("stats"), run, "place long, value long")
    value = F.when(F.first("place") % (dim + 3) == 2, F.max("value")).otherwise(F.sum("value"))
    found = np.zeros(k * (dim + 3), np.int64)
    for place, v in rows.groupBy("place").agg(value).collect():
        found[place] = v
    return found.reshape(k, dim + 3)


def _moved(centroids: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Centroids floor(sum / count), empty clusters keep theirs, and bounds of the radii around them."""
    counts = totals[:, :1]
    new = np.where(counts > 0, totals[:, 3:] // np.maximum(counts, 1), centroids)
    up = lambda d: isqrt(int(d) - 1) + 1 if d > 0 else 0
    radii = [up(far) + up(way) for far, way in zip(totals[:, 2].tolist(), ((new - centroids) ** 2).sum(axis=1).tolist())]
    return new, radii


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024) -> DataFrame:
    """One row per vector kept: key, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    First centroids: the ``k`` vectors with smallest sha256 of ``<seed>:<key>``."""
    scratch = Scratch(vectors.sparkSession, "clusters")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where(usable(F.col("vector"), dim))
    named = rows.select("id", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "vector")
    chosen = named.orderBy(F.asc_nulls_last("h"), "vector").limit(k).collect()
    centroids = np.array([quantised(np.array(r.vector), scale) for r in chosen], np.int64).reshape(len(chosen), dim)
    if not chosen:
        none = rows.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.withColumns({"cluster_inertia": F.col("distance"), "inertia": F.col("distance"), "centroid_sha256": F.lit("")}).limit(0)
    blocks = scratch.keep(map_arrow(rows, _first(dim, scale, centroids), _BLOCK), "round_0")
    totals = _added(blocks, len(centroids), dim)
    for i in range(1, rounds + 1):
        centroids, radii = _moved(centroids, totals)
        blocks = scratch.keep(map_arrow(blocks.where("ids IS NOT NULL"), _next(dim, centroids, radii), _BLOCK), f"round_{i}")
        totals = _added(blocks, len(centroids), dim)
        scratch.drop(f"round_{i - 1}")
    inertia, whole = totals[:, 1].tolist(), int(totals[:, 1].sum())
    names = [digest(c) for c in centroids]

    def unpack(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, known = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool)
                cluster, near = np.frombuffer(r["cluster"], np.int32), np.frombuffer(r["near"], np.int64)
                own = [pa.array(ids, pa.int64(), mask=~known), pa.array(cluster, pa.int32()), pa.array(near, pa.int64())]
                own += [pa.array(np.array(inertia, np.int64)[cluster]), pa.array(np.full(len(ids), whole, np.int64)), pa.array(names, pa.string()).take(pa.array(cluster))]
                yield pa.RecordBatch.from_arrays(own, [key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    columns = blocks.where("ids IS NOT NULL").select("ids", "known", "cluster", "near")
    return map_arrow(columns, unpack, f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
