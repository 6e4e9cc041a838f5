"""SimHash near-dedup with a Gray-order hierarchical index.

``fingerprints``: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``size`` words joined by a space (repeats included; a shorter text is one
shingle of all its words), XXH64 with seed 42 of each; a bit is set if set in
over half of the hashes.  A text without words (null too) has fingerprint zero
and links like any other.

``near_duplicates``: fingerprints link at ``radius`` or fewer differing bits.
Equal fingerprints are first folded into one class, so copies cost nothing.

All links are found by ``GrayIndex``, at every size: codes sorted by Gray rank,
groups of neighbours in that order factored into (mask, shared bits) nodes, a
parent holding the bits its children share; the differences found on the way
down add up, and a whole group is dropped once they exceed the radius.

One index over all codes would have to send a code to every part of the Gray
order within the radius of its first bits (470 of 16,384 parts).  By the
pigeonhole principle two linked codes agree in at least two of ``radius + 2``
blocks of bits, so each code is entered once for every pair of blocks with these
blocks as the index's first word, in which no difference is allowed; the order
is then cut between such words, and every code goes to ten parts at any size.  A
word with more than ``block`` codes is cut further into ranges of Gray rank
(``deal``): a code goes only to ranges whose shared bits are within the radius.
Each task sends on a spanning forest of its links, never the pairs.

Cases: repeated rows and ids keep every row; ties need no rule, as the smallest
id names a component; a null id is carried with its fingerprint and never names
a component while a class has another id; a text of any length is one
fingerprint, its shingles hashed a megabyte at a time; an empty table gives an
empty result; input columns named like an output column are replaced, others
are carried whatever their names.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import KEY, TEXT, map_arrow, map_docs, packed, rest_of, texts, unpacked, whole_groups
from .components import components, local_roots
from .session import BLOCK_ROWS, Scratch, partitions

SEED = 42
LEAF, FAN = 8, 8
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = np.arange(8, dtype=np.int64) * 256
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def word_pieces(body: bytes, step: int = 1 << 20):
    """The words of a text, those of about ``step`` bytes at a time."""
    at = 0
    while at < len(body):
        blank = _BLANK.search(body, min(at + step, len(body)))
        end = blank.start() if blank else len(body)
        yield body[at:end].split()
        at = end


def shingle_digests(body: bytes, size: int):
    """XXH64 digests (seed 42, eight bytes each) of a text's shingles, a piece at a time."""
    words, some = [], False
    for piece in word_pieces(body.lower()):
        words += piece
        if len(words) >= size:
            some = True
            yield _digests(words, size)
            words = words[len(words) - size + 1 :]
    if words and not some:
        yield _digests(words, len(words))


def _digests(words: list[bytes], size: int) -> bytes:
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())])


def simhash_text(body: bytes, size: int = 3) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    count, n = np.zeros(2048, np.int64), 0
    for digests in shingle_digests(body, size):
        hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
        count += np.bincount((hashes + _PLACE).ravel(), minlength=2048)
        n += len(hashes)
    return int.from_bytes(np.packbits((count.reshape(8, 256) @ _BITS * 2 > n).astype(np.uint8).ravel()).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, column: str = "simhash") -> DataFrame:
    """``docs`` without the text, and its fingerprint as a (signed) long."""

    def work(part):
        made = np.array([simhash_text(body, size) for body in texts(part.column(text))], np.uint64)
        return [pa.nulls(len(part), pa.string()), pa.array(made.view(np.int64))]

    docs = rest_of(docs, column)
    return map_docs(docs, text, [T.StructField(column, T.LongType())], work, replace_text=True).drop(text)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of a code in the reflected Gray sequence; of codes (n, words),
    highest word first, the position as as many words."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    if rank.ndim == 2:  # the parity of the words before runs on into a word
        odd = np.bitwise_xor.accumulate(rank & np.uint64(1), axis=1)
        rank[:, 1:] ^= np.zeros_like(odd[:, 1:]) - odd[:, :-1]
    return rank


class GrayIndex:
    """Static index of codes (uint64, one word or (n, words)) for Hamming range search.

    ``levels`` run from the leaves' groups up to one root; node i of a level
    has children FAN*i .. FAN*i+FAN-1 of the level below.  ``masks`` leave out
    the bits that an ancestor has fixed already, so differences add up.  In the
    first ``exact`` words no difference is allowed."""

    def __init__(self, codes: np.ndarray, exact: int = 0):
        codes = codes if codes.ndim == 2 else codes[:, None]
        self.order = np.lexsort(gray_rank(codes).T[::-1])
        self.codes = [np.ascontiguousarray(codes[self.order, w]) for w in range(codes.shape[1])]
        self.size, self.exact = len(codes), exact
        self.levels: list[list[tuple[np.ndarray, np.ndarray]]] = []  # for each level and word: mask, bits
        if not self.size:
            return
        ones, zeros = list(self.codes), list(self.codes)
        step = LEAF
        while True:
            at = np.arange(0, len(ones[0]), step)
            ones, zeros = [np.bitwise_and.reduceat(x, at) for x in ones], [np.bitwise_or.reduceat(x, at) for x in zeros]
            self.levels.append([(x | ~z, x) for x, z in zip(ones, zeros)])  # bits that all share, and their values
            if len(ones[0]) == 1:
                break
            step = FAN
        for k in range(len(self.levels) - 1):
            above = np.arange(len(self.levels[k][0][0])) // FAN
            self.levels[k] = [(mask & ~up[above], bits) for (mask, bits), (up, _) in zip(self.levels[k], self.levels[k + 1])]

    def search(self, queries: np.ndarray, radius: int, batch: int = 2048):
        """Yield (query position, code position) pairs within ``radius``, in pieces."""
        queries = queries if queries.ndim == 2 else queries[:, None]
        for lo in range(0, len(queries) if self.size else 0, batch):
            own = [np.ascontiguousarray(queries[lo : lo + batch, w]) for w in range(queries.shape[1])]
            q = np.arange(len(own[0]))
            node = np.zeros(len(q), np.int64)
            gone = np.zeros(len(q), np.int64)
            for k in range(len(self.levels) - 1, -1, -1):
                near = np.ones(len(q), bool)
                for w, (mask, bits) in enumerate(self.levels[k]):
                    off = (own[w][q] ^ bits[node]) & mask[node]
                    if w < self.exact:
                        near &= off == 0
                    else:
                        gone = gone + np.bitwise_count(off)
                near &= gone <= radius
                q, node, gone = q[near], node[near], gone[near]
                if k:
                    q, gone = np.repeat(q, FAN), np.repeat(gone, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    real = node < len(self.levels[k - 1][0][0])
                    q, node, gone = q[real], node[real], gone[real]
            for at in range(0, len(q), 100_000):
                qq = np.repeat(q[at : at + 100_000], LEAF)
                entry = (node[at : at + 100_000, None] * LEAF + np.arange(LEAF)).ravel()
                real = entry < self.size
                qq, entry = qq[real], entry[real]
                near, gone = np.ones(len(qq), bool), np.zeros(len(qq), np.int64)
                for w, codes in enumerate(self.codes):
                    off = own[w][qq] ^ codes[entry]
                    if w < self.exact:
                        near &= off == 0
                    else:
                        gone += np.bitwise_count(off)
                near &= gone <= radius
                yield lo + qq[near], self.order[entry[near]]


def block_keys(code: Column, radius: int) -> Column:
    """Array of keys: a code's bits in each pair of the radius + 2 blocks."""
    blocks = radius + 2
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    keys = []
    for n, (i, j) in enumerate(combinations(range(blocks), 2)):
        mask = masks[i] | masks[j]
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(n), code.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def deal(scratch: Scratch, rows: DataFrame, words: list[str], radius: int, block: int) -> DataFrame:
    """``rows`` (stored, with ``key`` and the words of a code) with bi and bj: all
    links of a key meet in some (key, bi, bj).

    A key of up to ``block`` rows is one group.  A larger one is cut into
    ranges of Gray rank; a row goes to each pair of its own range and a range
    whose node (the bits all its codes share) is within ``radius`` of its code."""
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = scratch.keep(hot.select("key", F.ceil(F.col("n") / block).cast("int").alias("s")), "hot")
    most = hot.agg(F.max("s")).first()[0]
    if not most:
        return rows.withColumns({"bi": F.lit(0), "bj": F.lit(0)})
    share = 64 // len(words)  # a rank over the first bits of every word
    mixed = F.lit(0).cast("long")
    for k, w in enumerate(words):
        mixed = mixed.bitwiseOR(F.shiftleft(F.shiftrightunsigned(w, 64 - share), 64 - share * (k + 1)) if share < 64 else F.col(w))
    ranked = rows.join(hot, "key").withColumn("_code", mixed)
    ranked = ranked.withColumn("_rank", F.expr("shiftrightunsigned(aggregate(array(1, 2, 4, 8, 16, 32), _code, (x, d) -> x ^ shiftrightunsigned(x, d)), 1)"))
    cuts = ranked.groupBy("key").agg(F.percentile_approx("_rank", [i / most for i in range(1, most)], max(10_000, 10 * most)).alias("_cuts"))
    ranked = ranked.join(scratch.keep(cuts, "cuts"), "key")
    ranked = ranked.withColumn("_r", F.floor(F.expr("size(filter(_cuts, c -> c <= _rank))") * F.col("s") / most).cast("int")).select(*rows.columns, "_r")
    ranked = scratch.keep(ranked, "ranked")
    shared = [x for w in words for x in (F.expr(f"bit_and({w}) | ~bit_or({w})").alias(f"m_{w}"), F.expr(f"bit_and({w})").alias(f"b_{w}"))]
    nodes = ranked.groupBy("key", "_r").agg(*shared)
    nodes = nodes.groupBy("key").agg(F.collect_list(F.struct("_r", *[f"{p}_{w}" for w in words for p in "mb"])).alias("_nodes"))  # rows of the key / block
    gone = " + ".join(f"bit_count(({w} ^ x.b_{w}) & x.m_{w})" for w in words)
    sent = ranked.join(scratch.keep(nodes, "nodes"), "key").withColumn("_o", F.expr(f"explode(transform(filter(_nodes, x -> {gone} <= {radius}), x -> x._r))"))
    sent = sent.select(*rows.columns, F.least("_r", "_o").alias("bi"), F.greatest("_r", "_o").alias("bj"))
    rest = rows.join(hot, "key", "left_anti").select(*rows.columns, F.lit(0).alias("bi"), F.lit(0).alias("bj"))
    return rest.unionByName(sent)


def indexed_links(words: list[str], radius: int):
    """Spanning forests of the links inside each (key, bi, bj) group, all found by ``GrayIndex``."""

    def run(batches):
        for batch in whole_groups(batches, ["key", "bi", "bj"]):
            rep = batch.column("rep").to_numpy()
            group = batch.column("key").to_numpy().astype(np.int64).view(np.uint64)
            for c in ("bi", "bj"):
                group = (group ^ group >> np.uint64(29)) * _MIX + batch.column(c).to_numpy().astype(np.uint64)
            codes = np.stack([group, *(batch.column(w).to_numpy().view(np.uint64) for w in words)], 1)
            found, held = [(rep[:0], rep[:0])], 0
            for x, y in GrayIndex(codes, exact=1).search(codes, radius):
                keep = x < y
                found.append((rep[x[keep]], rep[y[keep]]))
                held += len(found[-1][0])
                if held > 1_000_000:
                    found = [local_roots(*(np.concatenate(p) for p in zip(*found)))]
                    held = len(found[0][0])
            u, v = local_roots(*(np.concatenate(p) for p in zip(*found)))
            keep = u != v
            yield pa.RecordBatch.from_arrays([pa.array(u[keep], pa.int64()), pa.array(v[keep], pa.int64())], ["u", "v"])

    return run


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 3, size: int = 3, block: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` without the text, with simhash (long) and component_id: the
    smallest ``key`` (an integer) reachable over links, itself included."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    docs = rest_of(docs, "simhash", "component_id")
    columns = [c for c in docs.columns if c != text]
    prints = scratch.keep(fingerprints(packed(docs, text, key), TEXT, size), "prints")
    classes = scratch.keep(prints.groupBy("simhash").agg(F.min(F.col(KEY).cast("long")).alias("rep")), "classes")
    entries = classes.where("rep IS NOT NULL").select(F.explode(block_keys(F.col("simhash"), radius)).alias("key"), F.col("simhash").alias("code"), "rep")
    dealt = deal(scratch, scratch.keep(entries, "entries"), ["code"], radius, block)
    dealt = dealt.repartition(partitions(spark), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    found = components(scratch, map_arrow(dealt, indexed_links(["code"], radius), "u long, v long"))
    for name in ("entries", "hot", "cuts", "ranked", "nodes"):
        scratch.drop(name)
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("simhash").alias("_print"), F.coalesce("component", "rep").alias("component_id"))
    named = scratch.keep(named, "named")
    scratch.drop("classes")
    return unpacked(prints.join(named, F.col("simhash") == F.col("_print"), "left"), columns, None, "simhash", "component_id")
