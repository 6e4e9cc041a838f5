"""Embedding near-dedup by a forest of random-projection trees.

Vectors of one label (and one dimension) link at a cosine of ``threshold`` or
more, in double precision.  Null labels, null ids, and vectors that are null,
zero or hold null or non-finite components link with nothing.

* Equal vectors of a label are folded into one class with a count, so a group
  of copies costs one row.
* Each class goes down some trees of recursive random splits.  A level of a
  tree has one random direction, each node its own threshold: the median of a
  bounded sample at that node.  A vector near a threshold goes both ways: two
  vectors at the limit of similarity differ by about sqrt(2 - 2*threshold) /
  sqrt(dimension) along a random direction, and the overlap is ``spill`` of
  these on each side.  A label is split until a leaf has about ``leaf_rows``
  rows; the fewer levels, the fewer rows the overlap makes.
* A level parts a pair at the limit with a chance of about 0.019 times the ratio
  of that difference to the vectors' spread in their label, which the sample
  gives.  A label gets as many trees as keep the chance that all part it below
  ``miss`` (one tree where it is a single leaf).
* A leaf's row carries the vector as it was given (single precision if so) and
  its leaves of all trees.  Leaves are compared with matrix products in double
  precision.  A leaf that stays large, as all its vectors are alike, is dealt in
  blocks of about ``BLOCK_BYTES`` to several tasks.
* A pair that meets in several leaves is counted in the first of them only,
  which each side knows from both lists of leaves, so pairs are never emitted:
  a leaf sends on, for each vector, the number of its links and the smallest
  vector it reaches there.

Cases: repeated rows (and ids) are vectors of their own; a null id names no
component and is its own row; vectors of different dimension never link, and one
of any width is taken whole; ties need no rule, as the smallest id names a
component; an empty table gives an empty result; columns other than the id,
vector and label are not carried, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_arrow, runs, whole_groups
from .components import components, local_roots
from .session import Scratch, partitions, split_hot

LEAF_ROWS = 2048
BLOCK_ROWS, BLOCK_BYTES = 8192, 16 << 20
SAMPLE_ROWS = 4096
SAMPLE_NUMBERS = 1 << 21
DEPTH = 40
#: Levels whose nodes have thresholds of their own; deeper ones share the level's median.
OWN_LEVELS = 8


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """Random splits for vectors of one dimension, thresholds from a sample of unit rows."""

    def __init__(self, number: int, sample: np.ndarray, dim: int, margin: float, seed: int = 11):
        rng = np.random.default_rng([seed, number, dim])
        self.number, self.margin = number, margin
        directions = rng.standard_normal((dim, DEPTH))
        self.directions = directions / np.linalg.norm(directions, axis=0)
        along = sample @ self.directions
        self.level = np.median(along, axis=0) if len(sample) else np.zeros(DEPTH)
        self.nodes = []
        node = np.zeros(len(sample), np.int64)
        for d in range(OWN_LEVELS):
            cut = np.full(1 << d, self.level[d])
            for i in range(1 << d):
                own = along[node == i, d]
                if len(own) >= 16:
                    cut[i] = np.median(own)
            self.nodes.append(cut)
            node = 2 * node + (along[:, d] > cut[node])

    def leaves(self, x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each leaf of each row; row i goes ``depth[i]`` levels down."""
        along = x @ self.directions[:, : max(1, int(depth.max(initial=0)))]
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        done_row, done_leaf = [], []
        for d in range(int(depth.max(initial=0)) + 1):
            over = depth[row] == d
            done_row.append(row[over])
            done_leaf.append((np.int64(self.number) << 50) | (np.int64(1) << d) | node[over])
            row, node = row[~over], node[~over]
            if not len(row):
                break
            off = along[row, d] - (self.nodes[d][node] if d < OWN_LEVELS else self.level[d])
            left, right = off <= self.margin, off >= -self.margin
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return np.concatenate(done_row), np.concatenate(done_leaf)


def trees_for(depth: np.ndarray, ratio: float, miss: float) -> np.ndarray:
    """Trees that keep the chance of parting a pair at the limit in all of them below ``miss``."""
    parted = 1 - (1 - np.minimum(0.5, 0.0186 * ratio)) ** np.asarray(depth, float)
    return np.maximum(1, np.ceil(np.log(miss) / np.log(np.clip(parted, 1e-300, 0.999)))).astype(np.int64)


def _entries(forest, miss: float):
    """A row for each leaf of each class.  ``forest``: of a dimension the trees'
    maker and the ratio of a limit pair's difference to the spread."""

    def run(batches):
        grown: dict[int, list[Tree]] = {}
        for batch in batches:
            dims = np.diff(batch.column("vector").offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                make, ratio = forest(dim)
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                raw = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = unit_rows(raw.astype(np.float64))
                depth = np.minimum(part.column("depth").to_numpy(), DEPTH)
                trees = trees_for(depth, ratio, miss)
                own = grown.setdefault(dim, [])
                own += [make(t) for t in range(len(own), int(trees.max()))]
                rows, leaves = [], []
                for t in range(int(trees.max())):
                    at = np.flatnonzero(trees > t)
                    row, leaf = own[t].leaves(x[at], depth[at])
                    rows.append(at[row])
                    leaves.append(leaf)
                rows, leaves = np.concatenate(rows), np.concatenate(leaves)
                order = np.lexsort((leaves, rows))
                rows, leaves = rows[order], leaves[order]
                ends = np.searchsorted(rows, np.arange(len(x) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(leaves))
                step = max(1, (4 << 20) // (dim * raw.itemsize))
                for lo in range(0, len(rows), step):
                    at = rows[lo : lo + step]
                    some = part.take(pa.array(at))
                    bytes_ = np.ascontiguousarray(raw[at]).view(np.uint8).reshape(len(at), -1)
                    vectors = pa.array([v.tobytes() for v in bytes_], pa.binary())
                    yield pa.RecordBatch.from_arrays([some.column("label_hash"), pa.array(leaves[lo : lo + step]), some.column("cid"), some.column("copies"), vectors, lists.take(pa.array(at))], ["label_hash", "leaf", "cid", "copies", "raw", "leaves"])

    return run


def _verify(threshold: float, kind: str, tile: int = 512):
    """Links inside each (key, bi, bj) group: per class its count of links first
    met here, weighted by copies, and the smallest class reached here."""

    def run(batches):
        for batch in whole_groups(batches, ["key", "bi", "bj"]):
            cuts = runs(batch, ["key", "bi", "bj"])
            out = []
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
                if hi - lo > 1:
                    out += _group(batch.slice(lo, hi - lo), threshold, kind, tile)
            cid, root, links = (np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(root, pa.int64()), pa.array(links, pa.int64())], ["cid", "root", "links"])

    return run


def _group(part: pa.RecordBatch, threshold: float, kind: str, tile: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    cid, copies, leaf = (part.column(c).to_numpy() for c in ("cid", "copies", "leaf"))
    b, bi, bj = (part.column(c).to_numpy() for c in ("b", "bi", "bj"))
    x = unit_rows(np.frombuffer(b"".join(part.column("raw").to_pylist()), kind).reshape(len(part), -1).astype(np.float64))
    n = len(part)
    # rows with the same earlier leaves go together; two of them met before if they share one
    before: dict[bytes, int] = {}
    combo = np.empty(n, np.int64)
    ids, ends = part.column("leaves").flatten().to_numpy(), np.concatenate(([0], np.cumsum(part.column("leaves").value_lengths().to_numpy())))
    for i in range(n):
        own = ids[ends[i] : ends[i + 1]]
        combo[i] = before.setdefault(own[: np.searchsorted(own, leaf[0])].tobytes(), len(before))
    lists = [np.frombuffer(k, np.int64) for k in before]
    seen, column = np.unique(np.concatenate(lists), return_inverse=True)
    member = np.zeros((len(lists), len(seen)), np.float32)
    member[np.repeat(np.arange(len(lists)), [len(k) for k in lists]), column] = 1
    links, found = np.zeros(n, np.int64), []
    for lo in range(0, n, tile):
        near = x[lo : lo + tile] @ x.T >= threshold
        near[np.arange(len(near)), lo + np.arange(len(near))] = False
        if bi[0] != bj[0]:
            near &= b[lo : lo + tile, None] != b[None, :]
        if not near.any():
            continue
        i, j = np.nonzero(near)
        keep = lo + i < j
        found.append(local_roots(cid[lo + i[keep]], cid[j[keep]]))
        if len(seen):
            met = member[combo[lo : lo + tile]] @ member.T > 0
            near &= ~met[:, combo]
        links[lo : lo + tile] += near @ copies
    if not found:
        return []
    nodes, roots = local_roots(np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found]))
    order = np.argsort(nodes)
    place = np.searchsorted(nodes[order], cid)
    hit = np.flatnonzero((place < len(nodes)) & (nodes[order][np.minimum(place, len(nodes) - 1)] == cid))
    return [(cid[hit], roots[order][place[hit]], links[hit])]


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, miss: float = 3e-5, spill: float = 0.8, leaf_rows: int = LEAF_ROWS, block: int | None = None) -> DataFrame:
    """One row per vector: key, n_links, component_id (smallest key reachable) and kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    given = vectors.schema[vector].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vector"), F.col(label).alias("label"))
    able = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = rows.withColumn("h1", F.when(able, F.xxhash64("label", "vector"))).withColumn("h2", F.when(able, F.xxhash64("vector", "label", F.lit(1))))
    members = rows.select("id", "h1", "h2")
    classes = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"), F.xxhash64(F.first("label")).alias("label_hash"))
    classes = scratch.keep(classes, "classes")
    big = classes.groupBy("label_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_rows)
    big = scratch.keep(big.select("label_hash", F.ceil(F.log2(F.col("n") / leaf_rows)).cast("int").alias("depth")), "labels")
    deep = classes.join(big, "label_hash", "left").select("label_hash", "cid", "copies", "vector", F.coalesce("depth", F.lit(0)).alias("depth"))

    total, widest = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    sample: dict[int, list] = {}
    if total:
        expect = max(64, min(SAMPLE_ROWS, SAMPLE_NUMBERS // widest))
        chosen = classes.where(F.pmod(F.xxhash64("cid", F.lit("sample")), F.lit(1 << 40)) < F.lit(min(1 << 40, (1 << 40) * expect // total)))
        for r in chosen.select("cid", "vector", "label_hash").sort("cid").limit(2 * expect).collect():  # about half that
            sample.setdefault(len(r.vector), []).append((r.vector, r.label_hash))
    reach = np.sqrt(max(0.0, 2 - 2 * threshold))
    held = {}
    for dim, own in sample.items():
        x = unit_rows(np.array([v for v, _ in own], np.float64))
        _, of = np.unique([h for _, h in own], return_inverse=True)
        mean = np.zeros((of.max() + 1, dim))
        np.add.at(mean, of, x)
        rest = ((x - (mean / np.bincount(of)[:, None])[of]) ** 2).sum() / max(1, len(x) - len(mean))
        held[dim] = (x, reach / max(np.sqrt(rest), reach / 10))

    def forest(dim: int):
        x, ratio = held.get(dim, (np.zeros((0, dim)), 1.0))
        return lambda t: Tree(t, x, dim, spill * reach / np.sqrt(dim)), ratio

    size = 4 if single else 8
    block = block or max(256, min(BLOCK_ROWS, BLOCK_BYTES // (8 * (widest or 1))))
    entries = map_arrow(deep, _entries(forest, miss), "label_hash long, leaf long, cid long, copies long, raw binary, leaves array<long>")
    entries = scratch.keep(entries.withColumn("key", F.xxhash64("label_hash", "leaf", F.length("raw"))).drop("label_hash"), "entries")
    dealt = split_hot(scratch, entries, "key", "cid", block).select("key", "bi", "bj", "b", "leaf", "cid", "copies", "raw", "leaves")
    dealt = dealt.repartition(partitions(spark), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    links = scratch.keep(map_arrow(dealt, _verify(threshold, f"f{size}"), "cid long, root long, links long"), "links")
    scratch.drop("entries")
    found = components(scratch, links.where("cid <> root").select("cid", "root"))
    named = classes.select("h1", "h2", "cid", "copies").join(links.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
    named = named.join(found.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    named = scratch.keep(named, "named")
    for name in ("classes", "labels", "links"):
        scratch.drop(name)
    done = members.join(named, ["h1", "h2"], "left")
    done = done.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return done.withColumn("kept", F.col(key) == F.col("component_id"))
