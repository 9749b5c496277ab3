"""Yield of runs over time: trailing rates, running totals and the reason a run stops.

A run may hold a large share of all events, so no window spans a run: time is cut into buckets, an event is
copied into the bucket after its own where the trailing range reaches back, and totals of earlier buckets are
added as one number per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.dedupe import numbered

WINDOW_S = 900


def trailing_count(events: DataFrame, run: str, ts: str, counted: str, out: str, seconds: int = WINDOW_S) -> DataFrame:
    """events with the number of counted rows (boolean column) of the run in the last `seconds`, both ends included."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    width = seconds * 1_000_000
    rows = events.withColumn("_us", us).withColumn("_own", F.lit(True)).withColumn("_bucket", F.floor(F.col("_us") / width))
    halo = rows.where(F.col(counted)).withColumn("_own", F.lit(False)).withColumn("_bucket", F.col("_bucket") + 1)
    w = Window.partitionBy(run, "_bucket").orderBy("_us").rangeBetween(-width, 0)
    return rows.unionByName(halo).withColumn(out, F.sum(F.col(counted).cast("int")).over(w)).where("_own").drop("_us", "_own", "_bucket")


def ranked(rows: DataFrame, run: str, order: list[str], out: str = "rank") -> DataFrame:
    """rows with their place from 1 within their run.  Ranges of all rows are numbered apart (see numbered); a run's first
    number is one row a run, so a run of any size is never in one task."""
    n = numbered(rows, [run, *order], "_no")
    first = n.groupBy(F.col(run).alias("_run")).agg(F.min("_no").alias("_first"))
    return n.join(first, F.equal_null(n[run], first["_run"])).withColumn(out, F.col("_no") - F.col("_first") + 1).drop("_no", "_run", "_first")


def running_total(events: DataFrame, run: str, order: list[str], ts: str, counted: str, out: str, bucket_s: int = 86_400) -> DataFrame:
    """events with the running number of counted rows of the run, in order (which begins with ts)."""
    rows = events.withColumn("_bucket", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (bucket_s * 1_000_000)))
    sums = rows.groupBy(run, "_bucket").agg(F.sum(F.col(counted).cast("long")).alias("_n"))
    before = sums.select(run, "_bucket", F.coalesce(F.sum("_n").over(Window.partitionBy(run).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(F.col(counted).cast("long")).over(Window.partitionBy(run, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = before.withColumnsRenamed({run: "_run", "_bucket": "_b"})
    same = F.equal_null(rows[run], before["_run"]) & F.equal_null(rows["_bucket"], before["_b"])
    return rows.withColumn("_in", inside).join(before, same).drop("_run", "_b").withColumn(out, F.col("_in") + F.col("_before")).drop("_bucket", "_in", "_before")


def stop_rows(events: DataFrame, targets: DataFrame, floor_per_hour: float = 12, least_terms: int = 3, small_target: int = 50) -> DataFrame:
    """First row of each run that ends it, with its reason.

    events: run_id, seq, ts, kept, checked (booleans), term_end (boolean) and, where there is such a column, signal: 'stop'
    (the user ended the run), 'error' or 'down' (no engine answers).  targets: run_id, target, budget.
    Reasons in order of precedence: error, serp_unavailable, stopped, target_met, check_budget, diminishing_returns (under floor_per_hour in the
    trailing window with least_terms terms in it, for targets above small_target).  Runs that meet none give
    their last row with search_exhausted.
    """
    e = trailing_count(events, "run_id", "ts", "kept", "recent_kept")
    e = trailing_count(e, "run_id", "ts", "term_end", "recent_terms")
    e = running_total(e, "run_id", ["ts", "seq"], "ts", "kept", "total_kept")
    e = running_total(e, "run_id", ["ts", "seq"], "ts", "checked", "total_checked")
    begin = events.groupBy("run_id").agg(F.min("ts").alias("begin"))
    e = e.join(begin, "run_id").join(targets, "run_id")
    elapsed = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("begin").cast("timestamp"))) / 1e6
    rate = F.col("recent_kept") * 3600 / F.least(F.lit(float(WINDOW_S)), F.greatest(F.lit(1.0), elapsed))
    slow = F.col("term_end") & (F.col("target") > small_target) & (F.col("recent_terms") >= least_terms) & (rate < floor_per_hour)
    signal = F.col("signal") if "signal" in events.columns else F.lit(None).cast("string")
    reason = F.when(signal == "error", "error").when(signal == "down", "serp_unavailable").when(signal == "stop", "stopped").when(F.col("total_kept") >= F.col("target"), "target_met").when(F.col("total_checked") >= F.col("budget"), "check_budget").when(slow, "diminishing_returns")
    e = e.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("ts", "seq", "reason", "total_kept", "total_checked")))
    last = F.max(F.struct("ts", "seq", F.lit("search_exhausted").alias("reason"), "total_kept", "total_checked"))
    return e.groupBy("run_id").agg(F.coalesce(first, last).alias("s")).select("run_id", "s.seq", "s.reason", "s.total_kept", "s.total_checked")
