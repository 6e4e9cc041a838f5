"""Corpus pipeline over ``documents``: language ID, line dedup, near-dedup,
benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a frame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.

Cases, for every stage: other columns are carried untouched, whatever their
names; rows with nulls stay unless the stage's decision is about the null (a
null text has no letter, so language ID drops it); rows that repeat an id are
one document and stay or go together; a null id is never a copy of another
document; a text of any length is one text, taken whole; of copies that tie the
smallest id stays; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import bpe, decontaminate, langid, line_dedup, near_copies, queries
from codestrata.llm.session import Scratch, table, without


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the rest as one column that no operator's names can clash with."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: no letter, or far from every centroid."""
    train = F.coalesce(langid.fold_of("doc_id", 4) != 2, F.lit(False))
    found = langid.identify(_packed(docs), langid.fit(docs, train))
    return _unpacked(found.where(~F.col("rejected")), docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go; every document stays."""
    done = _unpacked(line_dedup.dedup_lines(_packed(docs), repeated_ids=True), docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word similarity of 0.8 or more) the document with the smallest id stays."""
    scratch = Scratch(spark, "copies")
    groups = near_copies.near_copies(docs.select("doc_id", "text"))
    copies = scratch.keep(groups.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return _unpacked(without(scratch, _packed(docs), "doc_id", copies), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return _unpacked(decontaminate.decontaminate(_packed(docs), table(spark, sf_dir, "benchmark")), docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, little-endian unsigned 32-bit) and digests of ids and decoded text."""
    done = bpe.encode(docs.select("doc_id", "text"), queries.tokenizer_file(), packed=True)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode_tokens),
]

#: Centroids, fingerprints and merges are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
