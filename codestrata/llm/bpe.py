"""BPE encoding and decoding by a pair occurrence index.

The words of a batch that were not met before are laid out as one row of
symbols.  Every adjacent pair that has a merge rank is indexed: rank -> all its
positions.  Active ranks are applied in ascending order; each merge rewrites
two symbols and adds the pairs it makes with its neighbours to their ranks'
lists.  Every distinct word is merged once for a batch, whatever its frequency.

Results equal those of the tokenizers library for a lower-casing, byte-level
vocabulary with word ends (special tokens found in a text are kept as such; no
special tokens are added, nothing is cut or padded).  The decoded text is the
tokens joined by a space, as the vocabulary file states no decoder.

Cases: a null or empty text has no token and decodes to the empty text; very
long words cost n log n; repeated rows are encoded alike; an empty table gives
an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import map_arrow, map_docs, rest_of, texts

#: Words kept between the batches of a task; beyond it the store starts anew.
STORE_WORDS = 200_000
#: Words merged at once: their pairs' lists are the largest thing in a worker's memory.
MERGE_WORDS = 16_000
#: A pair with more places than this is rewritten with numpy.
VECTOR_PLACES = 24
#: Bytes of text taken at once: the more words, the longer the lists of a pair, and the more memory.
TAKE_BYTES = 1 << 20
#: Unicode white space, as in the vocabulary's own pattern.
_SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NARROW = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")
_WIDE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class PairMerger:
    """A vocabulary file, and words merged with it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"]
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.inner = np.array([vocab[s] for s in byte_symbols()], np.int32)
        self.last = np.array([vocab[s + end] for s in byte_symbols()], np.int32)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.made = {rank: (pair, new) for pair, (rank, new) in self.merges.items()}
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.store: dict[str, bytes] = {}
        self.spelled = [self.tokens.get(i, "").encode() for i in range(max(self.tokens) + 1)]

    def pieces(self, text: str) -> list[str]:
        """Special tokens and words of a text, in order."""
        if self.split is not None and "<|" in text:
            found: list[str] = []
            for part in self.split.split(text):
                found += [part] if part in self.special else self._words(part)
            return found
        return self._words(text)

    @staticmethod
    def _words(text: str) -> list[str]:
        if text.isascii():
            return _NARROW.findall(text.lower())
        # lower-cased character by character: no final sigma
        return _WIDE.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, -1 where there is none."""
        want = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.pair_keys, want), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == want, self.pair_ranks[at], -1)

    def merge(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word, all words merged together."""
        return [array("i", ids).tolist() for ids in self.merge_packed(words)]

    def merge_packed(self, words: list[str]) -> list[bytes]:
        """``merge`` with each word's ids as 32-bit integers.

        Frequent pairs are rewritten with numpy, rare ones one by one; both act
        on the same memory."""
        if not words:
            return []
        raw = [w.encode("utf-8") for w in words]
        ends = np.cumsum([len(w) + 1 for w in raw]) - 1
        codes = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        symbols = self.inner[codes]
        symbols[ends - 1] = self.last[codes[ends - 1]]
        symbols[ends] = -1  # no pair spans two words
        n = len(symbols)
        sym, after, before = array("i", symbols.tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        vsym, vafter, vbefore = (np.frombuffer(x, np.int32) for x in (sym, after, before))
        merges = self.merges
        index: dict[int, list] = {}  # rank -> positions, and arrays of positions
        active: list[int] = []

        def add_all(ranks: np.ndarray, places: np.ndarray) -> None:
            real = np.flatnonzero(ranks >= 0)
            if not len(real):
                return
            order = real[np.argsort(ranks[real], kind="stable")]
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, own in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts)):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(own)

        def add(pair: tuple[int, int], place: int) -> None:
            hit = merges.get(pair)
            if hit is not None:
                if hit[0] not in index:
                    index[hit[0]] = []
                    heapq.heappush(active, hit[0])
                index[hit[0]].append(place)

        add_all(self._ranks(vsym[:-1], vsym[1:]), np.arange(n - 1))
        while active:
            rank = heapq.heappop(active)
            (a, b), new = self.made[rank]
            held = index.pop(rank)
            single = [x for x in held if type(x) is int]
            arrays = [x for x in held if type(x) is not int]
            if a != b and len(single) + sum(map(len, arrays)) > VECTOR_PLACES:
                places = np.unique(np.concatenate([*arrays, np.array(single, np.int64)]))
                places = places[vsym[places] == a]
                follow = vafter[places]
                hit = vsym[follow] == b
                places, follow = places[hit], follow[hit]
                beyond = vafter[follow]
                vsym[places], vsym[follow] = new, -2
                vafter[places], vbefore[beyond] = beyond, places
                add_all(self._ranks(vsym[places], vsym[beyond]), places)
                ahead = vbefore[places]
                ahead, places = ahead[ahead >= 0], places[ahead >= 0]
                add_all(self._ranks(vsym[ahead], vsym[places]), ahead)
                continue
            for x in arrays:
                single += x.tolist()
            single.sort()
            for i in single:
                if sym[i] != a:
                    continue
                j = after[i]
                if sym[j] != b:
                    continue
                k = after[j]
                sym[i], sym[j] = new, -2
                after[i] = k
                before[k] = i
                add((new, sym[k]), i)
                h = before[i]
                if h >= 0:
                    add((sym[h], new), h)
        whole = vsym[vsym != -2]
        cuts = (np.flatnonzero(whole == -1) * 4).tolist()
        packed = whole.tobytes()
        return [packed[lo:hi] for lo, hi in zip([0, *(c + 4 for c in cuts)], cuts)]

    def decode(self, ids) -> str:
        """Tokens joined by a space; ids outside the vocabulary are left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def learn(self, words: set[str]) -> None:
        """Store the packed ids of words not yet stored."""
        new = [w for w in words if w not in self.store]
        if len(self.store) + len(new) > STORE_WORDS:
            self.store.clear()
            new = list(words)
        for w in [w for w in new if w in self.special]:
            self.store[w] = array("I", [self.special[w]]).tobytes()
        new = [w for w in new if w not in self.special]
        for lo in range(0, len(new), MERGE_WORDS):
            part = new[lo : lo + MERGE_WORDS]
            self.store.update(zip(part, self.merge_packed(part)))

    def encode_packed(self, bodies: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        one: dict[str, str] = {}  # one object for each distinct word
        split = [[one.setdefault(w, w) for w in self.pieces(t)] for t in bodies]
        self.learn(set(one))
        found = []
        for words in split:
            ids = b"".join(map(self.store.__getitem__, words))
            found.append((ids, b" ".join(map(self.spelled.__getitem__, array("I", ids)))))
        return found


@lru_cache(2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", packed: bool = False) -> DataFrame:
    """``docs`` with n_tokens (long), ``ids`` (array of int; binary, little-endian
    unsigned 32-bit, if ``packed``) and, unless None, ``decoded`` (string).

    ``path``: the vocabulary file, which every executor must have."""
    docs = rest_of(docs, "n_tokens", ids, *([decoded] if decoded else []))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField(ids, T.BinaryType() if packed else T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(decoded, T.StringType())] if decoded else []

    def work(part):
        done = merger(path).encode_packed([b.decode("utf-8", "replace") for b in texts(part.column(text))])
        made = [pa.array([len(i) // 4 for i, _ in done], pa.int64())]
        if packed:
            made.append(pa.array([i for i, _ in done], pa.binary()))
        else:
            made.append(pa.array([array("I", i).tolist() for i, _ in done], pa.list_(pa.int32())))
        if decoded:
            made.append(pa.array([d for _, d in done], pa.binary()).cast(pa.string()))
        return made

    return map_docs(docs, text, fields, work, limit=TAKE_BYTES, done=merger.cache_clear)  # workers wait between tasks: two for each core, where a stage has two Python steps


def decode(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with the text of an id array; a null array decodes to the empty text."""
    rows = rest_of(rows, decoded)
    schema = T.StructType([*rows.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches):
        for batch in batches:
            made = [merger(path).decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=schema.names)

    return map_arrow(rows, run, schema)
