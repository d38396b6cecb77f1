"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlark.sinks.scratch import scratch_directory


SHELF = "rasterlark_shelf"
Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """`frame`, written once to the shared scratch folder and reread: lost
    executors cost no recomputation and what follows plans with its real size."""
    path = scratch_directory(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def fold(key: Column, folds: int) -> Column:
    """Fold number of a row by the CRC-32 of its key's text; null counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def trim(drop_shelf: bool) -> None:
    """Gives memory that this worker process does not use back to the system."""
    if drop_shelf:
        sys.modules.pop(SHELF, None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def tidy(task: Task, drop_shelf: bool = True) -> Task:
    """The task, with memory returned before and after it. Spark keeps worker
    processes, idle ones too, and they share an executor's memory with its JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim(drop_shelf)
        try:
            yield from task(batches)
        finally:
            trim(drop_shelf)

    return run


def shelf() -> dict:
    """What tasks keep in the worker process for later tasks of the same kind."""
    return vars(sys.modules.setdefault(SHELF, types.ModuleType(SHELF)))
