"""Token counts by overlap resynchronisation, for SentencePiece BPE models.

A text of up to ``chunk_bytes`` is encoded in one call.  A longer one is cut into
chunks that overlap by ``overlap_bytes`` on each side of every cut; the chunks are
spread over the cluster and encoded apart, with the offsets of their tokens, and
neighbours are spliced at a position that is proven to be a boundary of the whole
text's encoding.  Where a cut has none, its text is cut again with a wider overlap
(and longer chunks), at last into a single chunk.

Why a splice is exact.  BPE merges the best pair of neighbours, by score and then
from the left, until none can be merged.

* Where an encoding has a boundary, no merge ever crossed it, so each side is the
  encoding of its own text.
* Let x end the encoding of a left text and y begin that of a right text.  Up to
  the first merge across, the steps inside x and y come in the same order whether
  x and y stand alone or in the longer text, as that order depends on scores and
  places only.  So the two encodings joined are the encoding of the joined text
  if, and only if, x and y alone encode to x, y.
* If two overlapping chunks have the same token at the same place, the one before
  it in the left chunk stands beside it in a valid encoding.  So the left chunk up
  to there and the right chunk from there on make up the encoding of both.

Cuts are further apart than two overlaps, so splices follow one another.

Offsets are bytes of the normalised text: the model's own rule (white space
escaped, a space put before) is applied to a whole text once, and chunks are
encoded by the same model with that rule left out.

Results of long texts are named by two hashes of the text, so copies are counted
by the same rows; texts themselves are shuffled only as chunks, and never written.

Cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and ids are
rows of their own, a null id stays; a text of any length is counted whole; an
empty table gives an empty result; the result's own columns replace columns of the
same name, in any case, all others are carried untouched.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_arrow, map_docs, rest_of, texts
from .session import Scratch, partitions

CHUNK_BYTES, OVERLAP_BYTES = 16 << 10, 256
#: An overlap that fails grows by this factor.
WIDEN = 8
#: Place and id of a token in one long: ids below 2^20, texts below 2^43 bytes.
ID_BITS = 20
BATCH_BYTES = 1 << 20


class BpeModel:
    """A SentencePiece BPE model: whole texts, and pieces of normalised text with offsets."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        if model.trainer_spec.model_type != model.trainer_spec.BPE:
            raise ValueError("splices are proven for BPE models only")
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces) or len(model.pieces) > 1 << ID_BITS:
            raise ValueError("splices are proven only for models without user-defined or unused pieces, of up to 2^20 pieces")
        if not all(b in {p.piece for p in model.pieces} for b in ("<0x00>", "<0xFF>")):
            raise ValueError("offsets need a model with byte fallback")
        self.whole = SentencePieceProcessor(model_file=path)
        self.width = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        rule = model.normalizer_spec
        rule.add_dummy_prefix = rule.remove_extra_whitespaces = rule.escape_whitespaces = False
        rule.precompiled_charsmap = b""
        self.part = SentencePieceProcessor(model_proto=model.SerializeToString())

    def count(self, bodies: list[str]) -> list[int]:
        return [len(ids) for ids in self.whole.encode(bodies, num_threads=1)] if bodies else []

    def normal(self, body: str) -> bytes:
        return self.whole.normalize(body).encode()

    def tokens(self, part: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and id of each token of a piece of normalised text."""
        ids = np.array(self.part.encode(part.decode(), num_threads=1), np.int64)
        ends = np.cumsum(self.width[ids])
        if (ends[-1] if len(ids) else 0) != len(part):
            raise ValueError("tokens do not spell the text")
        return ends - self.width[ids], ids


@lru_cache(2)
def bpe_model(path: str) -> BpeModel:
    return BpeModel(path)


def char_start(text: bytes, at: int) -> int:
    """The last place up to ``at`` where a character begins."""
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunks_of(text: bytes, chunk: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(from, to, cut before, cut after) of each chunk, bytes; the first and last have no cut outside (-1)."""
    cuts = [char_start(text, at) for at in range(chunk, len(text) - chunk // 2, chunk)]
    bounds = [-1, *cuts, -1]
    return [
        (0 if a < 0 else char_start(text, a - overlap), len(text) if b < 0 else char_start(text, b + overlap), a, b)
        for a, b in zip(bounds, bounds[1:])
    ]


def encode_chunk(model: BpeModel, part: bytes, start: int, before: int, after: int, overlap: int) -> tuple[int, list[int], list[int]]:
    """Number of tokens, and those (place and id in one number) that begin in the
    overlap of the cut before and of the cut after, in order."""
    begin, ids = model.tokens(part)
    named = (begin + start) << ID_BITS | ids
    head = named[begin + start < before + overlap].tolist() if before >= 0 else []
    tail = named[begin + start >= after - overlap].tolist() if after >= 0 else []
    return len(ids), head, tail


def splice(pieces: list[tuple[int, list[int], list[int]]]) -> int | None:
    """Tokens of a text from its chunks; None if a cut has no common token."""
    total = sum(n for n, _, _ in pieces)
    for (_, _, tail), (_, head, _) in zip(pieces, pieces[1:]):
        common = set(tail) & set(head)
        if not common:
            return None
        at = min(common)
        total -= len(tail) - tail.index(at) + head.index(at)
    return total


def _cut(path: str, chunk: int, overlap: int):
    """Chunks of normalised text, a row each, in batches of bounded size."""
    names = ["h1", "h2", "no", "start", "before", "after", "part"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        model = bpe_model(path)
        for batch in batches:
            for h1, h2, body in zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), texts(batch.column("text"))):
                text = model.normal(body.decode("utf-8", "replace"))
                held, size = [], 0
                for no, (lo, hi, before, after) in enumerate(chunks_of(text, chunk, overlap)):
                    held.append((h1, h2, no, lo, before, after, text[lo:hi]))
                    size += hi - lo
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return run


def _encode(path: str, overlap: int):
    def run(batches):
        model = bpe_model(path)
        for batch in batches:
            made = [
                encode_chunk(model, r["part"], r["start"], r["before"], r["after"], overlap)
                for some in (batch.slice(at, 64) for at in range(0, batch.num_rows, 64)) for r in some.select(["part", "start", "before", "after"]).to_pylist()
            ]
            n, head, tail = zip(*made) if made else ((), (), ())
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), batch.column("no"), pa.array(n, pa.int64()), pa.array(head, lists), pa.array(tail, lists)], ["h1", "h2", "no", "n", "head", "tail"])

    return run


def _long_counts(scratch: Scratch, long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """h1, h2 and n_tokens of each long text (h1, h2, text)."""
    spark, found, step = scratch.spark, [], 0
    while True:
        cut = map_arrow(long, _cut(path, chunk, overlap), "h1 long, h2 long, no long, start long, before long, after long, part binary")
        cut = cut.repartition(partitions(spark), "h1", "h2", "no")
        pieces = scratch.keep(map_arrow(cut, _encode(path, overlap), "h1 long, h2 long, no long, n long, head array<long>, tail array<long>"), f"pieces_{step}")
        # a copy of a text repeats its rows, so each fact is taken once
        none = F.lit(None).cast("array<long>")
        sides = pieces.select("h1", "h2", "no", "n", "tail", none.alias("head")).unionByName(pieces.where("no > 0").select("h1", "h2", (F.col("no") - 1).alias("no"), F.lit(None).cast("long").alias("n"), none.alias("tail"), "head"))
        cuts = sides.groupBy("h1", "h2", "no").agg(F.max("n").alias("n"), F.max("tail").alias("tail"), F.max("head").alias("head"))
        at = F.array_min(F.array_intersect("tail", "head"))
        cuts = cuts.withColumn("at", at)
        dropped = F.size("tail") - F.array_position("tail", F.col("at")) + 1 + F.array_position("head", F.col("at")) - 1
        last = F.col("head").isNull()
        done = cuts.groupBy("h1", "h2").agg(
            F.sum(F.col("n") - F.when(last, 0).otherwise(F.coalesce(dropped, F.lit(0)))).cast("long").alias("n_tokens"),
            F.bool_or(~last & F.col("at").isNull()).alias("torn"),
        )
        done = scratch.keep(done, f"counts_{step}")
        scratch.drop(f"pieces_{step}")
        found.append(done.where("NOT torn").select("h1", "h2", "n_tokens"))
        torn = done.where("torn").select("h1", "h2")
        if torn.isEmpty():
            break
        long = long.join(torn, ["h1", "h2"], "left_semi").select("h1", "h2", "text")
        overlap *= WIDEN
        chunk, step = max(chunk, 4 * overlap), step + 1
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 4096, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> DataFrame:
    """``docs`` without the text, with n_bytes and n_tokens (long) and over_limit (n_tokens > limit).

    ``path``: the model file, which every executor must have."""
    if chunk_bytes < 4 * overlap_bytes or overlap_bytes < 8:
        raise ValueError("a chunk needs four overlaps, an overlap 8 bytes")
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    docs = rest_of(docs, "n_bytes", "n_tokens", "over_limit")
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_none")).alias("_row"))
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    short, long = rows.where(F.col("n_bytes") <= chunk_bytes), rows.where(F.col("n_bytes") > chunk_bytes)
    named = long.select("_row", "n_bytes", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), "text")

    def work(part):
        return [pa.array(bpe_model(path).count([b.decode("utf-8", "replace") for b in texts(part.column("text"))]), pa.int64())]

    few = map_docs(short, "text", [T.StructField("n_tokens", T.LongType())], work).select("_row", "n_bytes", "n_tokens")
    counts = _long_counts(scratch, named.select("h1", "h2", "text"), path, chunk_bytes, overlap_bytes)
    many = named.select("_row", "n_bytes", "h1", "h2").join(counts, ["h1", "h2"]).select("_row", "n_bytes", "n_tokens")
    own = [F.col("_row").getField(c).alias(c) for c in rest]
    return few.unionByName(many).select(*own, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
