"""Shared folders, written tables and small helpers of the operators in this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import workspace

TEXT_BYTES = 8 << 20     # text handled at once in a task
SMALL_ROWS = 100_000     # rows a side may have to be broadcast


class Folder:
    """A fresh folder below the shared folder of the cluster, for tables and files."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, workspace(spark, name)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and reads it back: later jobs need none of its lineage."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def files(self, name: str) -> str:
        """A place for files that tasks write themselves. Its path names its file system,
        as a task cannot tell which one Spark takes for a path without a scheme."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(path).toString()

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more.

        The shuffle files behind them go when the driver's JVM finds their plans unused;
        it is asked to look now, since a large heap may not for a long time.
        """
        gc.collect()
        self.spark._jvm.System.gc()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        for name in names:
            path = jvm.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder or file in the shared store, and the path within it."""
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


def attempt_name() -> str:
    """Names a task's files: two attempts never share one, the manifest lists the winner's."""
    from pyspark import TaskContext
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


def small_or_shuffled(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Marks a written table for broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= rows else df


def spread(files: DataFrame, name: str = "path") -> DataFrame:
    """A list of files dealt out so that tasks get few each, however small the list is."""
    most = 4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(max(1, min(files.count(), most)), name)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column with nulls as empty texts, in one buffer that starts at offset 0."""
    found = column(batch, name)
    if found.null_count:
        found = found.fill_null("")
    return pa.concat_arrays([found.cast(pa.string())])


def slices(batches: Iterator[pa.RecordBatch], name: str = "text",
           limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not len(batch):
            continue
        sizes = np.nan_to_num(np.asarray(
            pa.compute.binary_length(column(batch, name)).to_numpy(zero_copy_only=False),
            dtype=float))
        group = (np.cumsum(sizes) - sizes) // limit
        starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; memory that is free after the last one goes back to the system.

    A Python worker outlives its tasks, and would keep the most that one of them ever took
    beside those of the next stages.
    """
    yield from batches
    release()


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text array made by ``texts``."""
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many ranges, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, starts.max(initial=0)) < 2**31 - 1 else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out
