"""A table that grows by batches, kept in folders by a hash of its key, of which a batch rewrites those it touches.

A batch reads the touched buckets (partition pruning), writes their new content beside the table and then puts it over the old
one by Spark's dynamic partition overwrite.  The content beside the table is complete before the table is touched and stays until
the batch is noted as applied, so a job that dies in between puts it there again: a batch takes effect once, whole.  The number of
buckets bounds what the driver learns of a batch (its bucket numbers) and is fixed for a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.scratch import put_line, read_line


class Buckets:
    """folder: rows/bucket=N/..., staged/batch=M (while a batch is under way) and applied (the last batch's number)."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, buckets: int = 4096):
        self.spark, self.folder, self.key, self.schema, self.buckets = spark, folder.rstrip("/"), key, schema, buckets

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _has(self, name: str) -> bool:
        fs, p = self._path(name)
        return fs.exists(p)

    def applied(self) -> int:
        return int(read_line(self.spark, f"{self.folder}/applied") or -1)

    def with_bucket(self, rows: DataFrame, key: str | None = None) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(key or self.key)), F.lit(self.buckets)).cast("int"))

    def touched(self, rows: DataFrame, key: str | None = None) -> list[int]:
        """Buckets of the rows' keys; at most as many as the table has."""
        return sorted(r["bucket"] for r in self.with_bucket(rows, key).select("bucket").distinct().collect())

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The table, or its listed buckets."""
        if not self._has("rows") or only == []:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder}/rows")
        return (rows if only is None else rows.where(F.col("bucket").isin(only))).drop("bucket")

    def _apply(self, batch: int) -> None:
        staged = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder}/staged/batch={batch}")
        staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/rows")
        put_line(self.spark, f"{self.folder}/applied", str(batch))
        fs, p = self._path("staged")
        fs.delete(p, True)

    def recover(self) -> None:
        """End a batch that a dead job left complete beside the table; drop one that it left incomplete."""
        fs, p = self._path("staged")
        if not fs.exists(p):
            return
        for found in fs.listStatus(p):
            batch = int(found.getPath().getName().split("=")[1])
            if batch > self.applied() and self._has(f"staged/batch={batch}/_SUCCESS"):
                self._apply(batch)
        fs.delete(p, True)

    def merge(self, batch: int, updates: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Apply a batch of updates (a fixed table: it is read more than once).  fold takes the present content of the buckets that
        their keys fall into, and the updates, and gives the new content.  Returns these buckets; none for a batch that took
        effect before."""
        self.recover()
        if batch <= self.applied():
            return []
        only = self.touched(updates)
        if only:
            new = self.with_bucket(fold(self.read(only), updates))
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/staged/batch={batch}")
            self._apply(batch)
        else:
            put_line(self.spark, f"{self.folder}/applied", str(batch))
        return only
