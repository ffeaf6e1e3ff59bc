"""Shared pieces: table reading, lineage cuts in the shared folder, Arrow helpers."""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.lineage import shared_path

#: Rows that a Python kernel decodes at a time; texts of a slice are held as Python objects.
SLICE_ROWS = 256
#: Bytes of text after which a slice is cut short of SLICE_ROWS.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return shared_path(spark, tag)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later jobs depend on
    files that every executor sees, not on this one's lineage."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


#: Paths of the tables that this module wrote, by the DataFrame that reads them.
_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def forget(*written: DataFrame) -> None:
    """Deletes written tables that nothing reads any more. Others in the argument list are left alone."""
    for df in written:
        path = _WRITTEN.pop(df, None)
        if path is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterable[pa.RecordBatch], text: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most SLICE_ROWS rows and, where a text column is named, about SLICE_BYTES."""
    for batch in batches:
        n, at = batch.num_rows, 0
        mean = 0 if text is None or not n else batch.column(text).nbytes / n
        step = SLICE_ROWS if mean * SLICE_ROWS <= SLICE_BYTES else max(1, int(SLICE_BYTES / mean))
        while at < n:
            yield batch.slice(at, step)
            at += step


def sampled(h: Column, wanted: int, total: int) -> Column:
    """Whether a row with the 64-bit hash h is among about `wanted` of `total`. The share is held in 63 bits, so it is right for
    tables of any size."""
    most = (1 << 63) - 1
    return h.bitwiseAND(F.lit(most)) <= F.lit(most if wanted >= total else most * wanted // total)


def per_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch], text: str | None = None) -> Callable:
    """A mapInArrow function out of one from slice to batch."""

    def run(batches):
        for part in slices(batches, text):
            yield fn(part)

    return run


_KEPT: dict = {}


def kept(key: str, make: Callable):
    """What a kernel has learned in this worker, from task to task. A worker keeps that of one kernel at a time, so
    the memory of a worker that serves several stages is that of the largest."""
    if key not in _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None where null."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()
