"""Shared pieces of the operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import materialise, release, shared_dir, small_batches

__all__ = ["WORD", "lean", "materialise", "release", "shared_dir", "small_batches", "spread", "width", "without"]

#: White space between words in all of these operators: space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def without(df: DataFrame, names: list[str], needed: list[str]) -> DataFrame:
    """``df`` without the columns that a result brings anew; those that are needed have to have other names."""
    if clash := set(names) & set(needed):
        raise ValueError(f"the result has columns of these names itself: {', '.join(sorted(clash))}")
    return df.drop(*names)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, at whose end the worker returns the memory that it keeps unused.

    Workers live on for later tasks, also while others or the executor itself
    need the memory.
    """

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return task


def width(spark: SparkSession) -> int:
    """Tasks of a shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt out for work that is heavy per row; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)
