"""Near copies by a wide SimHash radius, confirmed by exact shingle similarity.

``near_copies``: texts link if the Jaccard similarity of their sets of ``WORDS``
word shingles is at least ``least`` (words and hashes as in ``simhash``; a
shorter text is one shingle of all its words, a text without words has the empty
set).  Texts with equal sets are first folded into one class, so copies cost
nothing.  A class has a fingerprint of ``BITS`` bits; keys are some of its bits
at a time, in several orders of all the bits, and classes that share a key and
differ in at most ``radius`` bits are candidates, found by ``simhash``'s Gray
index.  The bits of a key grow with the logarithm of the number of classes, so
that spread fingerprints give a key ``KEY_ROWS`` rows at most, and the number of
keys grows with them (as the 0.24th power of the classes), so that a pair is
missed as seldom at every size (``key_plan``).

Candidates' components are confirmed exactly: every member is first compared
with its component's smallest, which settles a group of alike texts in one pass;
those not linked so are then compared with all members of the component, in
groups of at most twice ``pair_rows`` rows.  Tasks send on spanning forests,
never the pairs.

Only the search is approximate: a link holds exactly, but a pair near ``least``
may share no key (see README).

Cases: as in ``simhash``; ids that repeat are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_arrow, map_docs, runs, texts, whole_groups
from .components import components
from .session import BLOCK_ROWS, Scratch, partitions
from .simhash import _BITS, SEED, deal, indexed_links, shingle_digests

WORDS, BITS, RADIUS = 5, 128, 32
#: Least bits of a key, keys of so many bits, and rows of a key beyond which keys get more bits.
KEY_BITS, KEYS, KEY_ROWS = 12, 64, 256
#: Share of bits in which texts of similarity 0.8 agree: 1 - acos(0.8 / 0.9) / pi.
_AGREE = 0.849
#: Rows of one component that are compared in one task.
PAIR_ROWS = 1024
_PLACE = np.arange(BITS // 8, dtype=np.int64) * 256


def key_plan(classes: int) -> np.ndarray:
    """(keys, bits of a key) numbers of the bits that make each key."""
    bits = max(KEY_BITS, int(np.ceil(np.log2(max(1, classes) / KEY_ROWS))))
    keys = int(np.ceil(KEYS * _AGREE ** (KEY_BITS - bits)))
    pieces = BITS // bits
    orders = [np.random.default_rng(SEED + r).permutation(BITS)[: pieces * bits].reshape(pieces, bits) for r in range(-(-keys // pieces))]
    return np.concatenate(orders)[:keys]


def shingle_set(body: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    parts = [np.unique(np.frombuffer(d, ">u8")) for d in shingle_digests(body, size)]
    return np.unique(np.concatenate(parts)).astype(np.uint64) if parts else np.empty(0, np.uint64)


def wide_print(own: np.ndarray) -> np.ndarray:
    """Two words of 64 bits; a bit is set if set in over half of the hashes."""
    if not len(own):
        return np.zeros(2, np.uint64)
    more = own + np.uint64(0x9E3779B97F4A7C15)  # a second hash of each shingle (splitmix)
    more = (more ^ (more >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    more = (more ^ (more >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    both = np.stack([own, more ^ (more >> np.uint64(31))], 1).view(np.uint8)
    count = np.bincount((both + _PLACE).ravel(), minlength=BITS // 8 * 256).reshape(-1, 256) @ _BITS
    return np.packbits((count * 2 > len(own)).astype(np.uint8).ravel()).view(np.uint64)


def prints(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` without the text, and each text's fingerprint and the digest of its set."""

    def work(part):
        sets = [shingle_set(body) for body in texts(part.column(text))]
        code = np.array([wide_print(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
        digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        return [pa.nulls(len(part), pa.string()), pa.array(code[:, 0]), pa.array(code[:, 1]), pa.array(digest, pa.binary())]

    fields = [T.StructField("_a", T.LongType()), T.StructField("_b", T.LongType()), T.StructField("_set", T.BinaryType())]
    return map_docs(docs, text, fields, work, replace_text=True).drop(text)


def _keys(plan: np.ndarray):
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                rep, a, b = (batch.column(c).to_numpy() for c in ("rep", "_a", "_b"))
                bits = np.unpackbits(np.stack([a, b], 1).view(np.uint8), axis=1)
                n = len(plan)
                value = np.zeros((len(bits), n, 8), np.uint8)
                held = np.packbits(bits[:, plan], axis=2)
                value[:, :, 8 - held.shape[2] :] = held
                keys = value.view(">i8")[:, :, 0] + (np.arange(n, dtype=np.int64) << 48)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64).ravel()), pa.array(np.repeat(rep, n)), pa.array(np.repeat(a, n)), pa.array(np.repeat(b, n))], ["key", "rep", "_a", "_b"])

    return run


def links(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set the first one reachable over pairs of Jaccard ``least`` or more."""
    root = np.arange(len(sets))
    size = np.array([len(s) for s in sets], np.int64)
    own = np.unique(np.concatenate(sets), return_inverse=True)[1] if size.sum() else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    ends = np.cumsum(size)
    mark = np.zeros(int(own.max(initial=0)) + 1, bool)
    for i in range(len(sets) - 1):
        if (root[i + 1 :] == root[i]).all():
            continue
        mine = own[ends[i] - size[i] : ends[i]]
        mark[mine] = True
        shared = np.bincount(row[ends[i] :][mark[own[ends[i] :]]] - i - 1, minlength=len(sets) - i - 1)
        mark[mine] = False
        either = size[i] + size[i + 1 :] - shared
        near = np.flatnonzero(shared >= least * either) + i + 1  # two empty sets are equal
        if len(near):
            joined = np.append(root[near], root[i])
            root[np.isin(root, joined)] = joined.min()
    return root


def _near_smallest(least: float):
    """Whether each member links to the smallest of its component."""

    def run(batches):
        for batch in batches:
            near = []
            for own, first in zip(batch.column("_words"), batch.column("_first")):
                x, y = np.frombuffer(own.as_py(), np.uint64), np.frombuffer(first.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(shared >= least * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("node"), pa.array(near, pa.bool_())], ["component", "node", "near"])

    return run


def _confirmed(least: float):
    """Spanning forests of the links inside each (component, bi, bj) group."""

    def run(batches):
        for batch in whole_groups(batches, ["component", "bi", "bj"]):
            node = batch.column("node").to_numpy()
            body = batch.column("_words")
            cuts = runs(batch, ["component", "bi", "bj"])
            u, v = [node[:0]], [node[:0]]
            for lo, hi in zip(cuts, cuts[1:]):
                root = links([np.frombuffer(x.as_py(), np.uint64) for x in body[lo:hi]], least)
                u.append(node[lo:hi])
                v.append(node[lo + root])
            u, v = np.concatenate(u), np.concatenate(v)
            yield pa.RecordBatch.from_arrays([pa.array(u[u != v], pa.int64()), pa.array(v[u != v], pa.int64())], ["u", "v"])

    return run


def confirm(scratch: Scratch, members: DataFrame, least: float, pair_rows: int) -> DataFrame:
    """Edges (u, v) that span the links among the members (component, node, _words) of each component."""
    first = members.where("node = component").groupBy("component").agg(F.min("_words").alias("_first"))
    told = scratch.keep(map_arrow(members.join(first, "component"), _near_smallest(least), "component long, node long, near boolean"), "told")
    stars = told.where("near AND node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    far = told.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("near")).alias("n_far")).where("n_far > 0")
    parts = lambda n: F.ceil(F.col(n) / pair_rows).cast("int")
    far = scratch.keep(far.select("component", parts("n").alias("s"), parts("n_far").alias("t")), "far")
    rows = members.join(far, "component")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = rows.select("component", mine("s").alias("bi"), every("t").alias("bj"), "node", "_words")
    lost = rows.join(told.where(~F.col("near")).select("component", "node").distinct(), ["component", "node"], "left_semi")
    sent = sent.unionByName(lost.select("component", every("s").alias("bi"), mine("t").alias("bj"), "node", "_words"))
    sent = sent.repartition(partitions(scratch.spark), "component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")
    return stars.unionByName(map_arrow(sent, _confirmed(least), "u long, v long"))


def _with_sets(text: str):
    def work(part):
        return [pa.array([shingle_set(body).tobytes() for body in texts(part.column(text))], pa.binary())]

    return work


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.8, radius: int = RADIUS, block: int = BLOCK_ROWS, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """(key, component_id) of each row: the smallest ``key`` (an integer) reachable over links."""
    spark = docs.sparkSession
    first, second = Scratch(spark, "near_copies"), Scratch(spark, "near_copies")
    docs = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    made = first.keep(prints(docs, "_text"), "prints")
    classes = first.keep(made.groupBy("_set").agg(F.min("_id").alias("rep"), F.first("_a").alias("_a"), F.first("_b").alias("_b")), "classes")
    classes_found = classes.where("rep IS NOT NULL")
    entries = map_arrow(classes_found.select("rep", "_a", "_b"), _keys(key_plan(classes_found.count())), "key long, rep long, _a long, _b long")
    dealt = deal(first, first.keep(entries, "entries"), ["_a", "_b"], radius, block)
    dealt = dealt.repartition(partitions(spark), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    maybe = first.keep(components(first, map_arrow(dealt, indexed_links(["_a", "_b"], radius), "u long, v long")), "maybe")
    for name in ("entries", "hot", "cuts", "ranked", "nodes"):
        first.drop(name)
    members = docs.join(maybe, F.col("_id") == F.col("node")).select("component", "node", "_text")
    members = second.keep(map_docs(members, "_text", [T.StructField("_words", T.BinaryType())], _with_sets("_text")).drop("_text"), "members")
    found = components(second, confirm(second, members, least, pair_rows))
    for name in ("members", "told", "far"):
        second.drop(name)
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("_set", F.coalesce("component", "rep").alias("component_id"))
    named = second.keep(named, "named")
    return made.join(named, "_set", "left").select(F.col("_id").alias(key), "component_id")
