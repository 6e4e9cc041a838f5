"""Benchmark decontamination: SimHash of item-sized windows.

Words are runs of letters and digits (ASCII letters and Latin-1 capitals
lower-cased, other bytes of UTF-8 as they are), shingles are five words (a
shorter item is one shingle of all its words).  For an item of m words, every
window of m words of a document (or the whole of a shorter document) that could
be as similar as ``similarity`` gets a SimHash of 256 bits.  A multi-index over
the items' fingerprints finds all items of the window's size within ``radius``
bits: with 16 blocks of 16 bits, a fingerprint within 63 bits differs by at most
three bits in some block, so items are listed under every block value within one
bit of theirs and windows look up every value within two.  The weighted Jaccard
similarity of the shingles' words then decides exactly.

A window of w shingles can only reach the similarity s with an item of n if at
least s * (n + w) / (1 + s) of its shingles are the item's, so windows with fewer
such shingles of items of its size get no fingerprint; this loses nothing.  A pair at
similarity 0.8 differs in about 39 of 256 bits with a standard deviation of 5.7,
so the radius is more than four of these away; of random pairs the blocks let
16 % pass, the radius none.

Documents are not shuffled while the benchmark fits one pass (``pass_bytes`` of
text and ``pass_items`` items, which bounds what an executor holds).  A larger
benchmark first drops all documents without enough benchmark shingles by one
filter of fixed size, and then goes over the rest in one job a pass, each
writing its matches to the shared folder; matches find their documents by the
text's digest, behind a filter, so that texts without a match are not shuffled.

Cases: null and empty texts and items match nothing; repeated items are each
reported; of several windows that match one item the most similar, then the
first, is reported; a very long text is hashed, fingerprinted and verified a
piece at a time, its windows slide by one shingle; an empty benchmark or table
gives no match; input columns named like the output column are replaced, others
are carried whatever their names.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import KEY, TEXT, map_arrow, map_docs, packed, rest_of, texts, unpacked
from .session import Scratch, filtered

SHINGLE = 5
BITS, BLOCKS = 256, 16
RADIUS = 63
#: Bits within which items are listed and windows look up; together at least the radius' share of a block.
LISTED, LOOKED_UP = 1, 2
#: Windows whose votes are counted in one go, and bytes of words hashed in one go.
CHUNK, HASH_BYTES, LONG_WORD = 4096, 1 << 20, 4096
#: Bits of the filter of a benchmark of several passes.
FILTER_BITS = 27
MATCH = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("distance", T.IntegerType()),
    T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType()),
])
_ARROW_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("distance", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64())]))

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INK = np.zeros(256, np.int8)
_INK[48:58] = _INK[65:91] = _INK[97:123] = _INK[128:] = 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(np.ceil(np.log2(n)))
        for i, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(size, np.uint64(base))
            grown[0] = 1
            _powers[i] = np.multiply.accumulate(grown)
    return _powers


def folded_bytes(flat: np.ndarray) -> np.ndarray:
    out = _FOLD[flat]
    accented = np.flatnonzero((flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E)) + 1
    out[accented] += 0x20
    return out


def word_spans(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; the first and last byte must be separators."""
    edge = np.diff(_INK[flat])
    return np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1


def word_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word by prefix sums of a polynomial, a piece of the text at a time."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + HASH_BYTES, side="right")))
        a, b = int(starts[lo]) - 1, int(ends[hi - 1])
        if b - a <= 2 * HASH_BYTES:
            powers, inverse = _power_tables(b - a)
            sums = (folded[a:b].astype(np.uint64) + np.uint64(1)) * powers[: b - a]
            np.cumsum(sums, out=sums)
            out[lo:hi] = (sums[ends[lo:hi] - a - 1] - sums[starts[lo:hi] - a - 1]) * inverse[starts[lo:hi] - a]
        lo = hi
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(folded[starts[i] : ends[i]].tobytes())
    return (out ^ out >> np.uint64(29)) * _MIX


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, size):
        h = (h ^ h >> np.uint64(31)) * _MIX + words[j : j + n]
    h = (h ^ h >> np.uint64(32)) * _MIX
    return h ^ h >> np.uint64(29)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """(n, BITS) bits of four hashes that follow from each."""
    made = np.empty((len(hashes), BITS // 64), np.uint64)
    for k in range(BITS // 64):
        h = hashes + np.uint64((k * _BASE) % (1 << 64))
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        made[:, k] = h ^ h >> np.uint64(31)
    return np.unpackbits(made.view(np.uint8).reshape(len(hashes), BITS // 8), axis=1)


def votes_of(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), CHUNK):
        total += bits_of(hashes[lo : lo + CHUNK]).sum(0, dtype=np.int64)
    return total


def pack(votes: np.ndarray, n: int) -> np.ndarray:
    """(rows, BLOCKS) uint16 fingerprints of vote counts over n shingles."""
    return np.packbits(votes * 2 > n, axis=1).view(np.uint16)


def ball(radius: int) -> np.ndarray:
    """All 16-bit numbers of at most ``radius`` bits."""
    return np.array([sum(1 << b for b in own) for n in range(radius + 1) for own in combinations(range(16), n)], np.uint64)


def least_shared(similarity: float, item: int, window: int) -> int:
    """Shingles that a window must share with an item of so many to be as similar."""
    return max(1, int(np.ceil(similarity * (item + window) / (1 + similarity) - 1e-9)))


def words_of(text: bytes) -> list[bytes]:
    flat = np.frombuffer(b"\n" + text + b"\n", np.uint8)
    starts, ends = word_spans(flat)
    folded = folded_bytes(flat).tobytes()
    return [folded[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def shingles_of(words: list[bytes]) -> Counter[tuple[bytes, ...]]:
    k = min(SHINGLE, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def windows_with(hits: np.ndarray, need: int, own: int, n: int) -> np.ndarray:
    """Starts of all windows of ``own`` of n places that hold at least ``need`` of the places ``hits`` (sorted)."""
    if len(hits) < need:
        return hits[:0]
    first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
    near = last - first < own
    lo, hi = np.maximum(last[near] - own + 1, 0), np.minimum(first[near], n - own)
    lo = np.maximum(lo, np.concatenate(([0], hi[:-1] + 1)))  # both ends only grow, so intervals overlap with the one before at most
    size = np.maximum(hi - lo + 1, 0)
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())


class ItemIndex:
    def __init__(self, items: list[tuple[int, bytes]], similarity: float, radius: int):
        self.similarity, self.radius = similarity, radius
        self.items: list[int] = []
        self.texts: list[bytes] = []  # words joined by a blank
        self.sizes: dict[int, int] = {}  # words of an item: number of the size
        self.counted: dict[int, Counter] = {}
        size_of, prints = [], []
        hashes: dict[int, list[np.ndarray]] = {}
        of: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            flat = np.frombuffer(b"\n" + text + b"\n", np.uint8)
            k = min(SHINGLE, len(words))
            h = shingle_hashes(word_hashes(folded_bytes(flat), *word_spans(flat)), k)
            hashes.setdefault(k, []).append(h)
            size_of.append(self.sizes.setdefault(len(words), len(self.sizes)))
            of.setdefault(k, []).append(np.full(len(h), len(words)))
            self.items.append(item)
            self.texts.append(b" ".join(words))
            prints.append(pack(votes_of(h)[None], len(h)))
        self.prints = np.concatenate(prints or [np.empty((0, BLOCKS), np.uint16)])
        listed = (np.array(size_of, np.uint64) * np.uint64(BLOCKS))[:, None] + np.arange(BLOCKS, dtype=np.uint64)
        listed = (listed << np.uint64(16) | self.prints.astype(np.uint64))[:, :, None] ^ ball(LISTED)
        order = np.argsort(listed.ravel(), kind="stable")
        self.lists = listed.ravel()[order]
        self.listed = (order // (BLOCKS * len(ball(LISTED)))).astype(np.int32)
        self.present = np.zeros(1 << 22, bool)  # a first look at which lists exist
        self.present[self._slot(self.lists)] = True
        self.near = ball(LOOKED_UP)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.held_by: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # sorted hashes, and the words of an item that holds each
        for k, parts in hashes.items():
            pairs = np.unique(np.rec.fromarrays([np.concatenate(parts), np.concatenate(of[k])], names="hash,words"))
            self.held_by[k] = (np.ascontiguousarray(pairs["hash"]), np.ascontiguousarray(pairs["words"]))
            every = np.unique(self.held_by[k][0])
            mark = np.zeros(1 << 20, bool)
            mark[(every >> np.uint64(44)).astype(np.int64)] = True
            self.known[k] = (mark, every)

    @staticmethod
    def _slot(lists: np.ndarray) -> np.ndarray:
        return (lists * _MIX >> np.uint64(42)).astype(np.int64)

    def shingles(self, item: int) -> Counter:
        """Made when an item is first verified; the last ones are kept."""
        if item not in self.counted:
            if len(self.counted) >= 256:
                self.counted.clear()
            self.counted[item] = shingles_of(self.texts[item].split(b" "))
        return self.counted[item]

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) for all fingerprints of a size within the radius, by item and window."""
        found = []
        for lo in range(0, len(prints), 256):
            own = prints[lo : lo + 256]
            lists = ((np.uint64(self.sizes[size] * BLOCKS) + np.arange(BLOCKS, dtype=np.uint64)) << np.uint64(16) | own.astype(np.uint64))[:, :, None] ^ self.near
            at = np.flatnonzero(self.present[self._slot(lists.ravel())])
            wanted = lists.ravel()[at]
            first, last = np.searchsorted(self.lists, wanted), np.searchsorted(self.lists, wanted, side="right")
            n = last - first
            entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            pairs = np.unique(np.repeat(at // (lists.shape[1] * lists.shape[2]), n) * len(self.items) + self.listed[entry])
            window, item = np.divmod(pairs, max(1, len(self.items)))
            distance = np.bitwise_count(own[window] ^ self.prints[item]).sum(1, dtype=np.int64)
            keep = distance <= self.radius
            found.append((lo + window[keep], item[keep], distance[keep]))
        window, item, distance = (np.concatenate(p) for p in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        order = np.lexsort((window, item))
        return window[order], item[order], distance[order]

    def search(self, bodies: list[bytes]) -> list[list[dict]]:
        found: list[list[dict]] = [[] for _ in bodies]
        if not self.sizes or not bodies:
            return found
        for doc, k, h, own, n_words, folded, starts, ends, offset in _benchmark_hits(bodies, self.known):
            found[doc] += self._in_document(k, h, own, n_words, folded, starts, ends, offset)
        return found

    def _in_document(self, k, h, hits, n_words, folded, starts, ends, offset) -> list[dict]:
        out = []
        held, words_of_item = self.held_by[k]
        first = np.searchsorted(held, h[hits])
        n = np.searchsorted(held, h[hits], side="right") - first
        hits, sizes = np.repeat(hits, n), words_of_item[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.argsort(sizes, kind="stable")
        hits, sizes = hits[order], sizes[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(sizes)) + 1, [len(sizes)]))
        for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            m = int(sizes[at])
            n = m - k + 1  # shingles of the item
            own = min(n, len(h))  # and of the window
            every = windows_with(hits[at:end], least_shared(self.similarity, n, own), own, len(h))
            best: dict[int, dict] = {}
            lo = 0
            while lo < len(every):
                hi = int(np.searchsorted(every, every[lo] + CHUNK))
                window = every[lo:hi]
                a, z = int(window[0]), int(window[-1])
                votes = np.empty((z - a + 1, BITS), np.int32)
                votes[0] = votes_of(h[a : a + own])
                votes[1:] = bits_of(h[a + own : z + own])
                votes[1:] -= bits_of(h[a:z])
                np.cumsum(votes, axis=0, out=votes)
                at, item, distance = self.candidates(m, pack(votes[window - a], own))
                cuts = np.flatnonzero(np.diff(item)) + 1
                for i, places, gone in zip(item[np.concatenate(([0], cuts))].tolist() if len(item) else (), np.split(window[at], cuts), np.split(distance, cuts)):
                    self._verify(i, m, places.tolist(), gone.tolist(), n_words, folded, starts, ends, offset, best)
                lo = hi
            out += best.values()
        return out

    def _verify(self, item, m, places, distances, n_words, folded, starts, ends, offset, best) -> None:
        """Exact similarity of the windows at ``places``, which slide on by single shingles."""
        k, target = min(SHINGLE, m), self.shingles(item)
        n = m - k + 1
        first, end = places[0], min(places[-1] + m, n_words)
        words = [folded[s:e].tobytes() for s, e in zip(starts[first:end].tolist(), ends[first:end].tolist())]
        count: Counter = Counter()
        shared, held = 0, (0, 0)  # shingles counted, from and up to

        def step(at: int, by: int) -> int:
            own = tuple(words[at : at + k])
            want, have = target.get(own, 0), count[own]
            count[own] = have + by
            return min(have + by, want) - min(have, want)

        for a, distance in zip(places, distances):
            lo = a - first
            hi = min(lo + n, len(words) - k + 1)
            if lo >= held[1]:
                count.clear()
                shared, held = 0, (lo, lo)
            for at in range(held[1], hi):
                shared += step(at, 1)
            for at in range(held[0], lo):
                shared += step(at, -1)
            held = (lo, hi)
            value = shared / max(1, n + hi - lo - shared)
            if value >= self.similarity and (item not in best or value > best[item]["similarity"]):
                b = min(a + m, n_words)
                best[item] = {"item_id": self.items[item], "similarity": value, "distance": distance, "start_byte": int(starts[a]) - offset, "end_byte": int(ends[b - 1]) - offset}


def _benchmark_hits(bodies: list[bytes], known):
    """For each text and shingle size with known shingles: the text's number, the
    size, its shingles' hashes, the places of the known ones, and its words.
    ``known``: (first look by the top 20 bits, sorted hashes) of each size, or a
    filter's packed bits and None."""
    flat = np.frombuffer(b"\n" + b"\n".join(bodies) + b"\n", np.uint8)
    at = np.cumsum([0] + [len(b) + 1 for b in bodies]) + 1  # start of each body in flat
    starts, ends = word_spans(flat)
    if not len(starts):
        return
    folded = folded_bytes(flat)
    words = word_hashes(folded, starts, ends)
    first = np.searchsorted(starts, at)  # first word of each body
    owner = np.repeat(np.arange(len(bodies), dtype=np.int32), np.diff(first))
    for k, (mark, every) in known.items():
        h = shingle_hashes(words, k)
        if every is None:
            bit = h >> np.uint64(64 - FILTER_BITS)
            maybe = np.flatnonzero(mark[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
        else:
            maybe = np.flatnonzero(mark[(h >> np.uint64(64 - len(mark).bit_length() + 1)).astype(np.int64)])
        maybe = maybe[owner[maybe] == owner[maybe + k - 1]]
        if every is not None:
            place = np.minimum(np.searchsorted(every, h[maybe]), len(every) - 1)
            maybe = maybe[every[place] == h[maybe]]
        for doc in np.unique(owner[maybe]).tolist():
            lo, hi = int(first[doc]), int(first[doc + 1])
            own = maybe[slice(*np.searchsorted(maybe, (lo, hi)))] - lo
            yield doc, k, h[lo : hi - k + 1], own, hi - lo, folded, starts[lo:hi], ends[lo:hi], int(at[doc])


def _benchmark_filter(items: DataFrame, similarity: float) -> dict[int, tuple[np.ndarray, int]]:
    """For each shingle size the filter of all the benchmark's shingles, FILTER_BITS
    wide at any size, and the fewest shingles that a window must share."""

    def shingles(batches):
        for batch in batches:
            for body in texts(batch.column("t")):
                flat = np.frombuffer(b"\n" + body + b"\n", np.uint8)
                words = word_hashes(folded_bytes(flat), *word_spans(flat))
                k = min(SHINGLE, len(words))
                bits = np.unique(shingle_hashes(words, k) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) if k else np.empty(0, np.int64)
                n = len(bits)
                need = least_shared(similarity, len(words) - k + 1, 0) if k else 0  # of the shortest window
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(bits >> 6), pa.array(np.int64(1) << (bits & 63)), pa.array(np.full(n, need, np.int64))], ["k", "word", "bits", "need"])

    held = map_arrow(items.select("t"), shingles, "k int, word long, bits long, need long").groupBy("k", "word").agg(F.bit_or("bits").alias("bits"), F.min("need").alias("need"))
    made: dict[int, tuple[np.ndarray, int]] = {}
    for k in [r.k for r in held.select("k").distinct().sort("k").collect()]:  # five at most
        part = held.where(F.col("k") == k).select("word", "bits", "need").toPandas()  # 2^21 rows at most
        words = np.zeros(1 << FILTER_BITS - 6, np.uint64)
        words[part.word.to_numpy()] = part.bits.to_numpy().view(np.uint64)
        made[k] = (words, int(part.need.min()))  # 16 MB, and so on every worker
    return made


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = 0.8, radius: int = RADIUS, column: str = "passages", pass_bytes: int = 8 << 20, pass_items: int = 20_000) -> DataFrame:
    """``docs`` with an array of the benchmark items found in each text:
    item_id, similarity, distance (bits), start_byte and end_byte."""
    if not 0 <= radius < BLOCKS * (LISTED + LOOKED_UP + 1):
        raise ValueError(f"the block index covers radii up to {BLOCKS * (LISTED + LOOKED_UP + 1) - 1}")
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    total, n = items.agg(F.sum(F.octet_length("t").cast("long")), F.count("t")).first()
    passes = max(1, -(-(total or 0) // pass_bytes), -(-n // pass_items))
    docs = rest_of(docs, column)
    rows = packed(docs, text)
    found = T.StructField(column, T.ArrayType(MATCH))

    def matches(rows: DataFrame, p: int) -> DataFrame:
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == p)
        index = ItemIndex([(r.i, r.t.encode("utf-8", "replace")) for r in part.sort("i", "t").collect()], similarity, radius)  # about pass_bytes

        def work(batch):
            return [pa.array(index.search(texts(batch.column(TEXT))), _ARROW_MATCH)]

        return map_docs(rows, TEXT, [found], work, limit=1 << 20)

    if passes == 1:
        return unpacked(matches(rows, 0), docs.columns, text, column)
    scratch = Scratch(docs.sparkSession, "passages")
    known = _benchmark_filter(items, similarity)

    def enough(batch):
        marks = {k: (mark, None) for k, (mark, _) in known.items()}
        hit = np.zeros(len(batch), bool)
        for doc, k, _, own, *_ in _benchmark_hits(texts(batch.column(TEXT)), marks) if marks else ():
            hit[doc] |= len(own) >= known[k][1]
        return [pa.array(hit)]

    maybe = map_docs(rows.select(TEXT), TEXT, [T.StructField("_enough", T.BooleanType())], enough, limit=1 << 20).where("_enough").select(TEXT)
    maybe = scratch.keep(maybe.select(TEXT, F.md5(TEXT).alias(KEY)).dropDuplicates([KEY]), "maybe")
    parts = None
    for p in range(passes):  # a job for each, so one pass is held at a time
        part = scratch.keep(matches(maybe, p).where(F.size(column) > 0).select(KEY, column), f"pass_{p}")
        parts = part if parts is None else parts.unionByName(part)
    parts = parts.groupBy(KEY).agg(F.flatten(F.collect_list(column)).alias(column))
    parts = scratch.keep(parts, "parts")
    rows = filtered(scratch, rows.drop(KEY).withColumn(KEY, F.md5(TEXT)), KEY, parts)  # only texts that may have a match are shuffled
    hit = rows.where("_maybe").drop("_maybe").join(parts, KEY, "left")
    none = rows.where(F.coalesce(~F.col("_maybe"), F.lit(True))).drop("_maybe").withColumn(column, F.lit(None).cast(found.dataType))
    done = none.unionByName(hit.select(*none.columns))
    return unpacked(done.withColumn(column, F.coalesce(column, F.array().cast(found.dataType))), docs.columns, text, column)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    done = find_passages(packed(docs, text), benchmark, TEXT, column="_passages", **options)
    return unpacked(done.where(F.size("_passages") == 0), docs.columns, text)
