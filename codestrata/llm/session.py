"""Session helpers: shared scratch tables, hot-key splitting, table reads.

Nothing here keeps rows on the driver or on an executor's local disk.  Lineage
is cut by writing Parquet below ``spark.checkpoint.dir``, which every executor
of a cluster can read, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that one task may be given; larger keys are dealt in blocks.
BLOCK_ROWS = 4096
#: Least and most longs of a filter, as powers of two: 32 KB to 32 MB.
FILTER_WORDS = 12, 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and
    driver and tasks are one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(context, "_codestrata_shared", None) or "file://" + tempfile.mkdtemp(prefix="codestrata-")
        context._codestrata_shared = found
    return found.rstrip("/")


class Scratch:
    """Intermediate tables of one operator call, written below the shared folder.

    ``keep`` writes and rereads a frame; ``drop`` removes one that no lazy frame
    needs any more.  What is left goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._fs_path(self.root, on_exit=True)

    def _fs_path(self, path: str, on_exit: bool = False):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if on_exit:
            fs.mkdirs(at)
            fs.deleteOnExit(at)
        return fs, at

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, name: str) -> None:
        fs, at = self._fs_path(f"{self.root}/{name}")
        fs.delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_hot(scratch: Scratch, rows: DataFrame, key: str, salt: str, block: int = BLOCK_ROWS) -> DataFrame:
    """Deal the rows of each key into blocks, so that every pair of rows of a
    key meets in exactly one (key, bi, bj) group of at most about 2*block rows.

    A key of n <= block rows stays one group (bi = bj = 0).  A larger one gets
    s = ceil(n / block) blocks by the hash of ``salt``; a row of block b goes to
    the s groups that pair b with every block.  Adds bi, bj and b.  ``rows``
    should be a stored table, as it is read twice.
    """
    hot = scratch.keep(
        rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
        .select(key, F.ceil(F.col("n") / block).cast("int").alias("s")),
        "hot_" + key,
    )
    if hot.isEmpty():
        return rows.withColumns({"b": F.lit(0), "bi": F.lit(0), "bj": F.lit(0)})
    b = F.pmod(F.xxhash64(salt), F.col("s")).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("b", F.coalesce(b, F.lit(0)))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("s"), F.lit(1)) - 1)))
    return dealt.withColumns({"bi": F.least("b", "o"), "bj": F.greatest("b", "o")}).drop("s", "o")


def without(scratch: Scratch, rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone`` (a stored table of that one column)."""
    marked = filtered(scratch, rows, key, gone)
    kept = marked.where(~F.col("_maybe")).select(*rows.columns)
    return kept.unionByName(marked.where("_maybe").select(*rows.columns).join(gone, key, "left_anti").select(*rows.columns))


def filter_words(held: int) -> int:
    """Longs of a filter, as a power of two: eight bits or more a key, within FILTER_WORDS."""
    least, most = FILTER_WORDS
    return min(most, max(least, (held // 8).bit_length()))


def filtered(scratch: Scratch, rows: DataFrame, key: str, held: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: false only where ``key`` is not in ``held`` (a stored table).

    A filter that grows with ``held`` up to 2^28 bits is broadcast, so that only rows
    it lets through need to be shuffled: up to 30 million keys at most 12 % of the others, 31 % at
    100 million."""
    size = filter_words(held.count())
    word, bit = F.shiftrightunsigned(F.xxhash64(key), 64 - size), F.expr(f"shiftleft(1L, cast(xxhash64(`{key}`) & 63 as int))")
    words = scratch.keep(held.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits")), "filter")
    return rows.join(F.broadcast(words), word == F.col("_word"), "left").withColumn("_maybe", F.coalesce("_bits", F.lit(0)).bitwiseAND(bit) != 0).drop("_word", "_bits")
