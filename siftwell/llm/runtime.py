"""Sizes of block partitions, bounded samples, and clean-up of scratch tables."""

from __future__ import annotations

import ctypes
import math
import sys

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.scratch import materialize, scratch_dir  # noqa: F401

BLOCK_INPUT_BYTES = 12 << 20


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that no later plan reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def block_count(df: DataFrame, per_block: int = BLOCK_INPUT_BYTES) -> int:
    """Number of hash blocks for a table: in proportion to its size, so that one block stays small."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = df.rdd.getNumPartitions() if size > 1 << 50 else 0
    return parts * 4 if parts else max(4, min(100_000, math.ceil(size / per_block)))


def hash_sample(df: DataFrame, id_col: str, rows: int, seed: int = 0) -> DataFrame:
    """The `rows` rows of smallest id hash (ties by id), the same on every run.

    Rows are first cut to the hash range that holds about twice as many, so that what meets in one place is bounded
    by `rows` and not by the number of tasks.
    """
    n = max(df.count(), 1)
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 31))
    near = df.where(place < F.lit(min(1 << 31, (2 * rows + 100) * (1 << 31) // n)))
    return near.orderBy(place, id_col).limit(rows)


def release_memory() -> None:
    """Give freed memory back to the system: a worker stays for later tasks, and what it holds counts for its executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
