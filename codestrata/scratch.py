"""Tables that cut lineage, below the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and
    driver and tasks are one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(context, "_codestrata_shared", None) or "file://" + tempfile.mkdtemp(prefix="codestrata-")
        context._codestrata_shared = found
    return found.rstrip("/")


#: Rows of one task, about, where a step keeps them in memory.
TASK_ROWS = 250_000


def spread(rows: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """``rows`` (of a stored table, or ``n`` of them) dealt by ``keys`` into as many tasks as they need.

    Splits of a file, and with them the hash tables of the tasks that read it, grow with the file."""
    n = rows.count() if n is None else n
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
    return rows.repartition(tasks, *keys)


class Tables:
    """Writes frames as Parquet and reads them again; ``drop`` removes one that no
    lazy frame needs any more, the rest goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def keep(self, frame: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for frame in frames:
            for file in {f.rpartition("/")[0] for f in frame.inputFiles()}:
                if file.startswith(self.root) or self.root.partition("://")[2] in file:
                    at = jvm.org.apache.hadoop.fs.Path(file)
                    at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
