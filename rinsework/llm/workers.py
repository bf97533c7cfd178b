"""Python workers outlive their tasks: most of what a task has gathered goes when it ends, so that idle workers leave the
executor's memory to the stages that follow."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession


def release() -> None:
    """Freed memory back to the system, as far as the allocators do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shorten(table: dict, keep: int) -> None:
    """All but the first `keep` entries go: those came first because they are frequent."""
    for key in list(islice(table, keep, None)):
        del table[key]


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffles behind tables that are written go from the executors' disks now. Spark removes them when the driver's JVM finds that nothing
    refers to them, which for a driver with little to do may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(spark: SparkSession, path: str) -> None:
    """A table in the shared folder that nothing will read again goes before the application ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(run: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """run, with forget() and release() once its task ends, however it ends."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            release()

    return whole
