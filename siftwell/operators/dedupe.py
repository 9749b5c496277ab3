"""Order-preserving distinct and top-n per key.

Lists in the source data are ordered, so the survivor of a group is always the first by an explicit order.
first_wins() is an aggregate with a partial step before the shuffle: a key with very many rows arrives as one
row per task.  first_n() is a rank filter, which Spark turns into a limit per group before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.scratch import materialize


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by order.  Null keys are a key."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)) if rest else None
    out = df.groupBy(*keys).agg(best.alias("_row")) if rest else df.select(*keys).distinct()
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]) if rest else out


def first_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each key by order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def numbered(df: DataFrame, order: list[Column | str], name: str = "row_no") -> DataFrame:
    """Rows numbered from 1 in a global order, without one task that sorts all of them: ranges are sorted apart,
    numbered within, and shifted by the sizes of the ranges before (one row per range)."""
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    # written once: ranges come from a sample, and two reads of the plan could draw different ones
    local = materialize(ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order))), "ranges")
    sizes = local.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(before.select("_range", "_before"), "_range").withColumn(name, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def merge_people(people: DataFrame) -> DataFrame:
    """First person per profile URL (any case, no last slash), people without one per (domain, name in lower case)."""
    url = F.rtrim(F.lower(F.coalesce("linkedin_url", F.lit(""))), F.lit("/"))
    key = F.when(url != "", F.concat(F.lit("u:"), url)).otherwise(F.concat(F.lit("n:"), F.coalesce("domain", F.lit("")), F.lit("|"), F.lower(F.coalesce("full_name", F.lit("")))))
    return first_wins(people.withColumn("_key", key), ["_key"], ["source_rank", "seq"]).drop("_key")
