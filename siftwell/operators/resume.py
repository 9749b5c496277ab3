"""Runs over many rows that are committed slice by slice, so that a dead run starts again where it stopped.

A slice is a hash range of the rows' key.  What a slice gives (its results and the keys that it has done) is written into one folder
beside its place, and the folder is renamed into place when all of it is there: results and stamps of a slice appear together or
not at all.  The number of slices is noted with the first one, so a later start deals the rows alike.  The rename is atomic on
file systems; on object stores use a committer or a table format that makes it so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.scratch import put_line, read_line

DONE = "done"


class SlicedRun:
    """folder: slices (their number), under-way/N and committed/N, each with one table a name."""

    def __init__(self, spark: SparkSession, folder: str, slices: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        noted = read_line(spark, f"{self.folder}/slices")
        self.slices = int(noted) if noted else slices
        if not noted:
            put_line(spark, f"{self.folder}/slices", str(slices))

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self) -> list[int]:
        fs, p = self._path("committed")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p)) if fs.exists(p) else []

    def run(self, todo: DataFrame, key: str, work: Callable[[DataFrame], dict[str, DataFrame]], at_most: int | None = None) -> int:
        """Do the slices that are not committed (at_most of them); returns how many were done.  work takes a slice's rows and gives its
        tables by name; the keys of the rows are written with them as done."""
        before, count = set(self.committed()), 0
        place = F.pmod(F.xxhash64(F.col(key)), F.lit(self.slices))
        for n in range(self.slices):
            if n in before:
                continue
            if at_most is not None and count >= at_most:
                break
            rows = todo.where(place == n)
            for name, df in {**work(rows), DONE: rows.select(key).distinct()}.items():
                df.write.mode("overwrite").parquet(f"{self.folder}/under-way/{n}/{name}")
            fs, ready = self._path(f"under-way/{n}")
            fs.mkdirs(self._path("committed")[1])
            if not fs.rename(ready, self._path(f"committed/{n}")[1]):
                raise OSError(f"slice {n} could not be committed")
            count += 1
        return count

    def read(self, name: str) -> DataFrame:
        """A table of all committed slices."""
        return self.spark.read.parquet(*[f"{self.folder}/committed/{n}/{name}" for n in self.committed()])
