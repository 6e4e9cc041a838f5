"""Line dedup: sharded cuckoo filters over exact reference-count tables.

State (both tables are Parquet, so it survives lost executors and can be kept):

* ``counts(h1, h2, n_docs)``: for each distinct line key, its 128-bit XXH3 and
  the exact number of documents that hold it.  Two keys among 10^12 share a
  digest with a chance of about 10^-15.
* ``filters(shard, slots)``: for each shard a cuckoo filter of the keys that are
  in at least ``min_docs`` documents.

``insert`` and ``delete`` add or take back documents: reference counts change
exactly, and the keys that cross the threshold are inserted into or deleted
from their shard's filter, so deleting what was inserted restores the index.

``apply`` drops lines.  Filters are probed where the documents are read.  A
filter alone may err, but every line of an indexed document is in ``counts``,
so the keys on which a filter errs are found exactly by probing it with the
keys below the threshold; they are passed along as exceptions.  If filters and
exceptions exceed ``broadcast_bytes``, the documents' line keys are sent to
their shard's filter instead, and the few it lets through are verified by the
counts, with the same result.

Cases: a null or empty text is one empty line; empty keys never drop; a line
repeated within one document counts once; rows that repeat an id are documents
of their own, or with ``repeated_ids`` (``key``) one document, a null id always a
document of its own; a very long text is split like any other; an empty table
gives an empty result with the same columns; input columns named like an output
column are replaced, others are carried whatever their names.  Documents that
the index has not seen are judged by the routed way.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import KEY, TEXT, column, map_arrow, map_docs, packed, rest_of, runs, text_slices, texts, unpacked
from .session import Scratch, partitions

BLANK = b" \t\n\x0b\x0c\r"
SLOTS = 4
MADE = ("n_lines", "n_dropped")


def line_key(line: bytes) -> bytes:
    """A line without blanks at its ends and with A-Z lower-cased."""
    return line.strip(BLANK).lower()


class CuckooFilter:
    """32-bit fingerprints in buckets of four, changed in bulk with numpy.

    A key is a pair of 64-bit integers: h1 gives the bucket, h2 the
    fingerprint.  The filter is a multiset, so a deletion takes back exactly
    one insertion.  It doubles from its keys' own buckets only on a rebuild, so
    ``insert`` returns False when it is too full and must be rebuilt.
    """

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint32))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
        size = max(1, len(h1))
        while True:
            made = cls.sized(size)
            if made.insert(h1, h2):
                return made
            size *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint32).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        mark = (h2.astype(np.uint64) >> np.uint64(32)).astype(np.uint32)
        mark[mark == 0] = 1
        first = h1.astype(np.uint64) & mask
        return mark, first.astype(np.int64), self._other(first, mark)

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.slots) - 1)
        step = (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return ((at.astype(np.uint64) ^ step) & mask).astype(np.int64)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        mark, at, other = self._places(h1, h2)
        rng = np.random.default_rng(0)
        for kick in range(500):
            if not len(mark):
                return True
            if kick == 1:
                at = other
            left = np.ones(len(mark), bool)
            for slot in range(SLOTS):
                todo = np.flatnonzero(left & (self.slots[at, slot] == 0))
                if len(todo):
                    _, first = np.unique(at[todo], return_index=True)
                    take = todo[first]
                    self.slots[at[take], slot] = mark[take]
                    left[take] = False
            mark, at, other = mark[left], at[left], other[left]
            if kick == 0 or not len(mark):
                continue
            _, first = np.unique(at, return_index=True)  # one eviction a bucket and round
            slot = rng.integers(0, SLOTS, len(first))
            out = self.slots[at[first], slot].copy()
            self.slots[at[first], slot] = mark[first]
            mark[first] = out
            at[first] = self._other(at[first], out)
        return not len(mark)

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Keys must have been inserted."""
        mark, first, other = self._places(h1, h2)
        for m, a, b in zip(mark.tolist(), first.tolist(), other.tolist()):
            for bucket in (a, b):
                hit = np.flatnonzero(self.slots[bucket] == m)
                if len(hit):
                    self.slots[bucket, hit[0]] = 0
                    break
            else:
                raise KeyError("deleted a key that was never inserted")

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, first, other = self._places(h1, h2)
        return (self.slots[first] == mark[:, None]).any(1) | (self.slots[other] == mark[:, None]).any(1)


def _digests(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _line_keys(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, h1, h2): the distinct non-empty line keys of each row."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text):
                at, found = [], []
                for i, body in enumerate(texts(part.column(text))):
                    own = set(map(line_key, body.split(b"\n"))) - {b""}
                    found += own
                    at += [i] * len(own)
                h1, h2 = _digests(found)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(at, pa.int64())), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["id", "h1", "h2"])

    return map_arrow(docs.select(key, text), run, T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))


def line_counts(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """(h1, h2, n_docs): documents that hold each non-empty line key.

    Every row is a document; with ``key`` rows that repeat an id are one (a null
    id is a document of its own), and only their lines are shuffled by id."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text):
                seen: Counter[bytes] = Counter()
                for body in texts(part.column(text)):
                    seen.update(set(map(line_key, body.split(b"\n"))))
                seen.pop(b"", None)
                h1, h2 = _digests(list(seen))
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(list(seen.values()), pa.int64())], ["h1", "h2", "n"])

    each = map_arrow(docs.select(text), run, "h1 long, h2 long, n long")
    if key is not None:
        docs = docs.select(column(key).alias(KEY), column(text).alias(TEXT))
        again = docs.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(KEY)
        if not again.isEmpty():
            own = _line_keys(docs.join(again, KEY, "left_semi"), TEXT, KEY)
            extra = own.groupBy("id", "h1", "h2").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
            each = each.unionByName(extra.select("h1", "h2", (1 - F.col("rows")).alias("n")))
    return each.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"))


def _by_shard(shards: dict[int, CuckooFilter], n_shards: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    found = np.zeros(len(h1), bool)
    shard = h2 % np.uint64(n_shards)
    for s, cuckoo in shards.items():
        at = np.flatnonzero(shard == np.uint64(s)) if n_shards > 1 else np.arange(len(h1))
        if len(at):
            found[at] = cuckoo.contains(h1[at], h2[at])
    return found


@dataclass(frozen=True)
class LineDedupIndex:
    spark: SparkSession
    scratch: Scratch
    counts: DataFrame
    filters: DataFrame
    n_shards: int
    min_docs: int
    broadcast_bytes: int
    version: int = 0

    @classmethod
    def build(cls, docs: DataFrame, text: str = "text", min_docs: int = 10, keys_per_shard: int = 250_000, broadcast_bytes: int = 64 << 20, key: str | None = None) -> LineDedupIndex:
        """Index a corpus.  Shards are as many as give each about
        ``keys_per_shard`` keys, so one filter fits a task at any size.  With
        ``key`` rows that repeat an id are one document."""
        spark = docs.sparkSession
        scratch = Scratch(spark, "lines")
        counts = scratch.keep(line_counts(docs, text, key), "counts_0")
        frequent = counts.where(F.col("n_docs") >= min_docs)
        n_shards = max(1, -(-frequent.count() // keys_per_shard))

        def fill(key, pdf):
            cuckoo = CuckooFilter.build(pdf.h1.to_numpy().view(np.uint64), pdf.h2.to_numpy().view(np.uint64))
            return pd.DataFrame({"shard": [key[0]], "slots": [cuckoo.dump()]})

        filters = frequent.withColumn("shard", _shard(n_shards)).groupBy("shard").applyInPandas(fill, "shard long, slots binary")
        return cls(spark, scratch, counts, scratch.keep(filters, "filters_0"), n_shards, min_docs, broadcast_bytes)

    def insert(self, docs: DataFrame, text: str = "text", key: str | None = None) -> LineDedupIndex:
        """Add documents that the index does not hold."""
        return self._change(docs, text, key, 1)

    def delete(self, docs: DataFrame, text: str = "text", key: str | None = None) -> LineDedupIndex:
        """Take back documents that were inserted, with the texts they had."""
        return self._change(docs, text, key, -1)

    def _change(self, docs: DataFrame, text: str, key: str | None, sign: int) -> LineDedupIndex:
        v, least = self.version + 1, self.min_docs
        delta = line_counts(docs, text, key).select("h1", "h2", (F.col("n_docs") * sign).alias("d"))
        both = self.counts.join(delta, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("n_docs", F.lit(0)).alias("old"), F.coalesce("d", F.lit(0)).alias("d"))
        both = self.scratch.keep(both.withColumn("n_docs", F.col("old") + F.col("d")), f"change_{v}")
        if not both.where("n_docs < 0").isEmpty():
            raise ValueError("deleted documents that the index does not hold")
        counts = self.scratch.keep(both.where("n_docs > 0").select("h1", "h2", "n_docs"), f"counts_{v}")
        crossed = both.where(((F.col("old") >= least) != (F.col("n_docs") >= least)))
        crossed = crossed.select(_shard(self.n_shards).alias("shard"), "h1", "h2", (F.col("n_docs") >= least).alias("rises"))
        kept = counts.where(F.col("n_docs") >= least).select(_shard(self.n_shards).alias("shard"), "h1", "h2")

        def update(key, old, crossing, every):
            if not len(every):
                return pd.DataFrame({"shard": [], "slots": []}).astype({"shard": "int64", "slots": "object"})
            up = lambda p: (p.h1.to_numpy().view(np.uint64), p.h2.to_numpy().view(np.uint64))
            cuckoo = CuckooFilter.load(old.slots.iloc[0]) if len(old) else CuckooFilter.sized(1)
            rises = crossing.rises.to_numpy(bool)
            cuckoo.delete(*up(crossing[~rises]))
            full = cuckoo.slots.size * 0.85 < len(every)
            if full or not cuckoo.insert(*up(crossing[rises])):
                cuckoo = CuckooFilter.build(*up(every))
            return pd.DataFrame({"shard": [key[0]], "slots": [cuckoo.dump()]})

        # cogroup takes two sides: the old filter travels as one more row of the crossing side
        left = crossed.select("shard", "h1", "h2", "rises", F.lit(None).cast("binary").alias("slots")).unionByName(
            self.filters.select("shard", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(False).alias("rises"), "slots")
        )

        def fill(key, left, every):
            held = left.slots.notna()
            return update(key, left[held], left[~held], every)

        filters = left.groupBy("shard").cogroup(kept.groupBy("shard")).applyInPandas(fill, "shard long, slots binary")
        filters = self.scratch.keep(filters, f"filters_{v}")
        self.scratch.drop(f"change_{v}")
        return replace(self, counts=counts, filters=filters, version=v)

    def _exceptions(self, shards: dict[int, CuckooFilter]) -> DataFrame:
        n_shards = self.n_shards

        def run(batches):
            for batch in batches:
                h1, h2 = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
                hit = _by_shard(shards, n_shards, h1, h2)
                yield pa.RecordBatch.from_arrays([pa.array(h1[hit].view(np.int64)), pa.array(h2[hit].view(np.int64))], ["h1", "h2"])

        rare = self.counts.where(F.col("n_docs") < self.min_docs).select("h1", "h2")
        return map_arrow(rare, run, "h1 long, h2 long")

    def apply(self, docs: DataFrame, text: str = "text", key: str = "doc_id", indexed: bool = True) -> DataFrame:
        """``docs`` with the dropped lines gone from ``text``, and n_lines (before
        dropping) and n_dropped.  ``indexed``: the index holds all of ``docs``."""
        docs = rest_of(docs, *MADE)
        total = self.filters.agg(F.sum(F.length("slots"))).first()[0] or 0
        if indexed and total <= self.broadcast_bytes:
            shards = {r.shard: CuckooFilter.load(r.slots) for r in self.filters.collect()}  # within broadcast_bytes
            most = self.broadcast_bytes // 128
            wrong = self._exceptions(shards).limit(most + 1).collect() if shards else []  # all of them, or one too many
            if len(wrong) <= most:
                return self._probe(docs, text, shards, {(r.h1, r.h2) for r in wrong})
        return self._routed(docs, text, key)

    def _probe(self, docs: DataFrame, text: str, shards: dict[int, CuckooFilter], wrong: set[tuple[int, int]]) -> DataFrame:
        n_shards = self.n_shards

        def drops(keys: list[bytes]) -> np.ndarray:
            h1, h2 = _digests(keys)
            hit = _by_shard(shards, n_shards, h1, h2)
            for i in np.flatnonzero(hit) if wrong else ():
                hit[i] = (int(h1[i].astype(np.int64)), int(h2[i].astype(np.int64))) not in wrong
            return hit

        return map_docs(docs, text, [T.StructField(c, T.LongType()) for c in MADE], lambda part: _drop_lines(texts(part.column(text)), drops), replace_text=True)

    def _routed(self, docs: DataFrame, text: str, key: str) -> DataFrame:
        """For filters of any size: line keys go to their shard's filter, what it
        lets through is verified by the counts, and documents get their hits.

        A shard's keys are dealt to as many tasks as give every task a part; each
        of them gets the shard's filter first and then its keys, a batch at a time."""
        spread = max(1, -(-partitions(self.spark) // self.n_shards))
        rows = packed(docs, text, key)
        own = _line_keys(rows, TEXT, KEY).select(_shard(self.n_shards).alias("shard"), F.pmod("h1", F.lit(spread)).cast("int").alias("part"), "id", "h1", "h2", F.lit(None).cast("binary").alias("slots"))
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"), F.lit(None).cast(own.schema["id"].dataType).alias("id"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), "slots")
        both = filters.unionByName(own).withColumn("order", F.col("slots").isNull())
        both = both.repartition(max(partitions(self.spark), self.n_shards * spread), "shard", "part").sortWithinPartitions("shard", "part", "order").drop("order")

        def run(batches):
            shard = cuckoo = None
            for batch in batches:
                shards, h1, h2 = (pc.fill_null(batch.column(c), 0).to_numpy() for c in ("shard", "h1", "h2"))
                slots = batch.column("slots")
                hit = np.zeros(len(batch), bool)
                cuts = runs(batch, ["shard", "part"])
                for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
                    if slots[lo].is_valid:
                        shard, cuckoo = shards[lo], CuckooFilter.load(slots[lo].as_py())
                        lo += 1
                    if hi > lo and shard == shards[lo]:  # a shard without a filter has no frequent key
                        hit[lo:hi] = cuckoo.contains(h1[lo:hi].view(np.uint64), h2[lo:hi].view(np.uint64))
                kept = batch.filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("id", "h1", "h2")], ["id", "h1", "h2"])

        maybe = map_arrow(both, run, T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))
        frequent = self.counts.where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
        hits = maybe.join(frequent, ["h1", "h2"]).groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("hits"))  # lines of one document
        with_hits = rows.join(hits, F.col("id").eqNullSafe(F.col(KEY)), "left").drop("id")

        def work(part):
            out: list[list] = [[], [], []]
            for body, hits in zip(texts(part.column(TEXT)), part.column("hits").to_pylist()):
                bad = {(h["h1"], h["h2"]) for h in hits or ()}

                def drops(found, bad=bad):
                    h1, h2 = _digests(found)
                    return np.array([(a, b) in bad for a, b in zip(h1.view(np.int64).tolist(), h2.view(np.int64).tolist())], bool)

                for all_rows, one in zip(out, _drop_lines([body], drops)):
                    all_rows += one.to_pylist()
            return [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())]

        done = map_docs(with_hits, TEXT, [T.StructField(c, T.LongType()) for c in MADE], work, replace_text=True)
        return unpacked(done, docs.columns, text, *MADE)


def _shard(n_shards: int):
    """Of h2 as an unsigned number, as ``_by_shard`` takes it."""
    low = F.pmod(F.col("h2"), F.lit(n_shards))
    carry = pow(2, 64, n_shards)
    return F.when(F.col("h2") < 0, F.pmod(low + carry, F.lit(n_shards))).otherwise(low).cast("long")


def _drop_lines(bodies: list[bytes], drops) -> list[pa.Array]:
    """Kept text, line count and dropped count of each text."""
    lines = [body.split(b"\n") for body in bodies]
    known = list({line_key(x) for own in lines for x in own} - {b""})
    bad = set(np.array(known, object)[drops(known)].tolist()) if known else set()
    kept, n_dropped = [], []
    for body, own in zip(bodies, lines):
        left = [x for x in own if line_key(x) not in bad] if bad else own
        n_dropped.append(len(own) - len(left))
        kept.append(body if len(left) == len(own) else b"\n".join(left))
    return [pa.array(kept, pa.binary()).cast(pa.string()), pa.array([len(x) for x in lines], pa.int64()), pa.array(n_dropped, pa.int64())]


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = 10, repeated_ids: bool = False, **options) -> DataFrame:
    """Drop from every document the lines whose key is in at least ``min_docs``
    documents: an index over ``docs``, applied to ``docs``.  Every row is a
    document; with ``repeated_ids`` rows that repeat an id are one."""
    return LineDedupIndex.build(docs, text, min_docs, key=key if repeated_ids else None, **options).apply(docs, text, key)
