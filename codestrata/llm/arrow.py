"""Arrow batches in Python workers: bounded slices, text bytes, regrouping."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship

#: Bytes of text looked at in one go.  A longer text is still taken whole.
SLICE_BYTES = 2 << 20
#: Bytes of a batch handed to Python, about; Spark's own bound is rows only.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _release() -> None:
    """Hand freed memory back to the system: workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run):
    """Wraps a function of batches to release memory at the end of a task."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def texts(column: pa.Array) -> list[bytes]:
    """Each row's UTF-8 bytes; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Regroup sorted batches so that no run of equal ``keys`` is cut in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if held:
                change[0] |= held[-1].column(k)[-1].as_py() != v[0]
        starts = np.flatnonzero(change)
        if not len(starts):
            held.append(batch)
            continue
        last = int(starts[-1])
        if held or last:
            yield _one([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    parts = [p for p in parts if p.num_rows] or parts[:1]
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def runs(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Start of each run of equal keys, and the end."""
    change = np.ones(batch.num_rows, bool)
    change[1:] = False
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), batch.num_rows)


def rest_of(docs: DataFrame, *made: str) -> DataFrame:
    """``docs`` without columns that the operator makes itself: its own win."""
    return docs.drop(*[c for c in docs.columns if c.lower() in {m.lower() for m in made}])


#: Columns of a packed frame.
TEXT, KEY, ROW = "_text", "_key", "_row"


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def packed(docs: DataFrame, text: str, key: str | None = None) -> DataFrame:
    """Text, key and all other columns as one, so that none can clash with an operator's own names."""
    rest = [column(c) for c in docs.columns if c != text] or [F.lit(0).alias("_none")]
    return docs.select(column(text).alias(TEXT), (column(key) if key else F.lit(None)).alias(KEY), F.struct(*rest).alias(ROW))


def unpacked(rows: DataFrame, columns: list[str], text: str | None, *made: str) -> DataFrame:
    """The columns of a packed frame in their old order, and ``made`` after them."""
    own = [F.col(TEXT).alias(c) if c == text else F.col(ROW).getField(c).alias(c) for c in columns]
    return rows.select(*own, *made)


def map_arrow(frame: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` of a function that workers can load, tidying up after itself.

    Batches are bounded in bytes, by a setting of the session unless it has its own."""
    spark = frame.sparkSession
    ship(spark)
    if not spark.sparkContext.getConf().contains(_BATCH_SETTING):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return frame.mapInArrow(tidy(run), schema)


def map_docs(docs: DataFrame, text: str, fields: list[T.StructField], work, replace_text: bool = False, limit: int = SLICE_BYTES, done=None) -> DataFrame:
    """Run ``work(slice) -> list of arrow arrays`` on slices of a table's text.

    The result has the table's other columns untouched and ``fields`` after
    them; with ``replace_text`` the first array replaces the text column.
    ``done()`` is called at the end of a task.
    """
    at = docs.columns.index(text)
    docs = docs.select("*")
    schema = T.StructType([*docs.schema.fields, *fields])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text, limit):
                made = work(part)
                columns = list(part.columns)
                if replace_text:
                    columns[at] = made[0].cast(columns[at].type)
                    made = made[1:]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*part.schema.names, *(f.name for f in fields)])
                del part, made, columns
        if done is not None:
            done()

    return map_arrow(docs, run, schema)
