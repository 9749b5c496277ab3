"""Continuous harvest: landed hits through the screens, qualified, into the table of domains.

The set of known domains is the table itself, not stream state: it would grow without bound.  A batch reads and rewrites the
buckets of its own domains only (see buckets): it leaves out the known ones, lets the first hit of each new domain decide,
qualifies, notes blocked hosts, and upserts without demotions.  A batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.web import domain_of
from siftwell.operators.buckets import Buckets
from siftwell.operators.qualify import Market, decide_hits, qualify_decided
from siftwell.operators.state import upsert, without_demotions
from siftwell.scratch import materialize

HITS = "run_id string, pos int, link string, title string, snippet string, source string, ts timestamp"
STATE = "domain string, status string, score int, tier string, reason string"
#: a landed response, one result page, has one time
PAGE_ORDER, ORDER = ["ts", "run_id"], ["pos", "link"]


def read_hits(spark: SparkSession, folder: str, fmt: str = "json", files_per_trigger: int = 50) -> DataFrame:
    return spark.readStream.schema(HITS).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)


def domains_table(spark: SparkSession, folder: str, buckets: int = 4096) -> Buckets:
    return Buckets(spark, folder, "domain", STATE, buckets)


def new_rows(hits: DataFrame, pages: DataFrame | None, known: DataFrame, m: Market, page_order: list[str] = PAGE_ORDER, order: list[str] = ORDER) -> DataFrame:
    """STATE rows of the hits' new domains: qualified, rejected, failed or unreachable, discovered where there are no pages, blocked."""
    decided = materialize(decide_hits(hits, known, m, page_order, order), "decided")
    q = qualify_decided(decided, pages, m)
    return q.select("domain", "status", "score", "tier", F.nullif(F.array_join("reasons", ", "), F.lit("")).alias("reason"))


def with_rows(known: DataFrame, rows: DataFrame) -> DataFrame:
    """known (STATE) with a batch's rows (STATE); qualified domains stay so."""
    columns = ["status", "score", "tier", "reason"]
    updates = rows.withColumn("seq", F.lit(0)).withColumn("provided", F.array(*map(F.lit, columns)))
    return upsert(known, without_demotions(known, updates, "domain"), "domain", columns)


def apply_batch(hits: DataFrame, number: int, table: Buckets, m: Market, pages: DataFrame | None = None, page_order: list[str] = PAGE_ORDER, order: list[str] = ORDER) -> list[int]:
    """Take one batch of hits (a fixed table) into the table of domains; returns the buckets rewritten."""
    table.recover()
    if number <= table.applied():
        return []
    asked = hits.select(domain_of(F.col("link")).alias("domain")).where("domain <> ''")
    known = table.read(table.touched(asked))
    return table.merge(number, materialize(new_rows(hits, pages, known, m, page_order, order), "new-domains"), with_rows)


def harvest(hits: DataFrame, folder: str, m: Market, checkpoint: str, pages: DataFrame | None = None, buckets: int = 4096):
    """Start the stream; returns the query.  Takes what has landed and stops (availableNow)."""

    def batch(df: DataFrame, number: int) -> None:
        apply_batch(materialize(df, "hits"), number, domains_table(df.sparkSession, folder, buckets), m, pages)

    return hits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", every: str = "15 minutes", slide: str = "1 minute") -> DataFrame:
    """Counts per run and kind in sliding windows of event time, for monitoring; the exact trailing form is batch."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", every, slide), "run_id", "kind").agg(F.count("*").alias("n")).select("window.start", "window.end", "run_id", "kind", "n")
