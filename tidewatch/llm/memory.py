"""Bounds for what Python workers hold, in jobs of several stages that share them."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession


def small_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Arrow batches of at most so many megabytes for the rest of the session, whatever the number of rows; each task holds a few of them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def release() -> None:
    """Gives memory that is free again back to the machine; a worker lives on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_CACHES: list[dict] = []


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, until a task of another operator starts in it."""
    _CACHES.append({})
    return _CACHES[-1]


def drop_caches() -> None:
    for cache in _CACHES:
        cache.clear()


def releasing(fn: Callable[[Iterator], Iterator], keep: bool = False) -> Callable[[Iterator], Iterator]:
    """The function over batches, with ``release`` at the end of each task; unless ``keep``, the worker's caches are dropped first."""
    @wraps(fn)
    def run(batches):
        if not keep:
            drop_caches()
        try:
            yield from fn(batches)
        finally:
            release()
    return run
