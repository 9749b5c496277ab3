"""Tables with upserts, kept as versioned Parquet snapshots.

Updates carry `provided`, the names of the columns that they set; other columns keep their old value, and a
provided '' overwrites.  Several updates of one key fold in `seq` order.  Every change is a plan over the old
snapshot and the updates: one aggregate on the key, one full join.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.scratch import put_line, read_line


def fold_updates(updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key: the last provided value of each column, and which were provided.  Blank keys go."""
    given = lambda c: F.array_contains("provided", c)
    return updates.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(
        *[F.max_by(F.struct(F.col(c).alias("v")), F.when(given(c), F.col("seq"))).alias(c) for c in columns],
        *[F.max(given(c)).alias(f"_set_{c}") for c in columns],
    )


def upsert(table: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with the updates applied; new keys appear with the provided columns.  May demote a status."""
    u = fold_updates(updates, key, columns).withColumn("_hit", F.lit(True))
    t = table.select(key, *columns).alias("t")
    j = t.join(u.alias("u"), F.col(f"t.{key}") == F.col(f"u.{key}"), "full")
    return j.select(F.coalesce(f"t.{key}", f"u.{key}").alias(key), *[F.when(F.col(f"u._set_{c}"), F.col(f"u.{c}.v")).otherwise(F.col(f"t.{c}")).alias(c) for c in columns])


def without_demotions(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Batch rule: an update that sets another status than 'qualified' goes, whole, if its key is qualified in the
    table or by an earlier update of the batch; updates without a status stay."""
    sets = F.array_contains("provided", "status")
    earlier = F.max((sets & (F.col("status") == "qualified")).cast("int")).over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    q = table.where("status = 'qualified'").select(F.col(key).alias("_k")).distinct()
    marked = updates.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_earlier", F.coalesce(earlier, F.lit(0))).join(q, F.col(key) == F.col("_k"), "left")
    return marked.where(~sets | (F.col("status") == "qualified") | (F.col("_k").isNull() & (F.col("_earlier") == 0))).drop("_k", "_earlier")


def merge_keeping_best(old: Column, new: Column, kind: str) -> Column:
    """The other merge policy: 'status' never leaves qualified, 'score' is the greater, 'text' the new unless empty."""
    return {
        "status": F.when(old == "qualified", old).otherwise(F.coalesce(F.nullif(new, F.lit("")), old)),
        "score": F.greatest(old, new),
        "text": F.coalesce(F.nullif(new, F.lit("")), old),
    }[kind]


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append: the first of each key that the table does not hold.  Keys compare with case."""
    from siftwell.operators.dedupe import first_wins

    return first_wins(rows, keys, order).join(table.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)


def demote(table: DataFrame, mark: str = "geo_fail:") -> DataFrame:
    """Qualified rows with a reason that holds the mark become rejected; column demoted tells which."""
    hit = (F.col("status") == "qualified") & F.coalesce(F.exists("score_reasons", lambda r: F.contains(r, F.lit(mark))), F.lit(False))
    return table.withColumn("demoted", hit).withColumn("status", F.when(hit, "rejected").otherwise(F.col("status")))


def stamp(table: DataFrame, done: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """Set a column of the rows whose key is in done."""
    d = done.select(F.col(key).alias("_k")).distinct()
    return table.join(d, F.col(key) == F.col("_k"), "left").withColumn(column, F.when(F.col("_k").isNotNull(), value).otherwise(F.col(column))).drop("_k")


def reset_stamp(table: DataFrame, column: str, scope: Column) -> DataFrame:
    """NULL the stamp of the rows in scope; column was_set tells which had one."""
    return table.withColumn("was_set", scope & F.col(column).isNotNull()).withColumn(column, F.when(~F.coalesce(scope, F.lit(False)), F.col(column)))


def wiped(table: DataFrame) -> DataFrame:
    return table.limit(0)


def evolve(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of two schema versions in one table: missing text columns are '', others NULL."""
    out = table.unionByName(rows, allowMissingColumns=True)
    return out.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes])


class Snapshots:
    """A folder of whole versions, v=N, and a pointer file that names the current one.

    A version is written in full before the pointer moves, so a reader or a job that dies meanwhile sees the old
    one.  The pointer keeps the last stream batch, which makes foreachBatch writes idempotent.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def pointer(self) -> dict:
        line = read_line(self.spark, f"{self.folder}/current")
        return json.loads(line) if line else {"version": -1, "batch": -1}

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v={self.pointer()['version']}")

    def write(self, df: DataFrame, batch: int | None = None, partition_by: list[str] | None = None) -> bool:
        """Write the next version; False if a stream batch was written before."""
        at = self.pointer()
        if batch is not None and batch <= at["batch"]:
            return False
        version = at["version"] + 1
        w = df.write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.folder}/v={version}")
        put_line(self.spark, f"{self.folder}/current", json.dumps({"version": version, "batch": at["batch"] if batch is None else batch}))
        return True

    def forget(self, keep: int) -> None:
        """Remove versions before the last `keep`; a reader of one of those has had that many writes to end in."""
        fs, path = self._fs()
        for old in fs.listStatus(path(self.folder)):
            name = old.getPath().getName()
            if name.startswith("v=") and int(name[2:]) <= self.pointer()["version"] - keep:
                fs.delete(old.getPath(), True)
