"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (tests), a new temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named or current:
        if not current:
            spark.sparkContext.setCheckpointDir(named)
        return (named or current).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a few dozen bytes that are broadcast at most, in place of shuffling all texts.
BROADCAST_ROWS = 300_000


def bounded(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpointed side, for broadcast if it has up to ``rows`` rows; else the join shuffles."""
    return F.broadcast(side) if side.count() <= rows else side


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, lengthened where a column has them, however it is written."""
    taken = {c.lower() for c in columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        made.append(name)
    return made


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the offsets of the texts (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at.size == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int):
    """Consecutive parts of a batch with about ``max_bytes`` of text; a longer text stands alone."""
    _, at = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(at, at[start] + max_bytes, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Return free memory to the system: workers outlive stages, and would keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]):
    """An Arrow function that gives memory back after each of its input batches and at its end."""

    def each(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            yield batch
            del batch
            give_back()

    def wrapped(batches: Iterable[pa.RecordBatch]):
        yield from run(each(batches))
        gc.collect()
        give_back()

    return wrapped


def string_array(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Texts over adjacent ranges of ``data``: ``starts`` holds one more offset than texts."""
    offsets = np.ascontiguousarray(starts, np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
