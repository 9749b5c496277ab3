"""The stop decision of running searches, as their events arrive.

State per run: events that the watermark has not passed, and of those it has passed the running totals and the events of
the trailing window.  A timer at each waiting event's time wakes the run when the watermark has passed it; events are then taken in
order of time and number, so their order of arrival does not matter.  The first event that ends the run is given out with its
reason, as runs.stop_rows finds it on the whole history, and later ones are passed by.  A run without an event for `idle` after its
last one ends as search_exhausted.  Events later than the watermark's delay are lost to the stream; the batch form counts them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from siftwell.operators.runs import WINDOW_S
from siftwell.scratch import scratch_dir

OUT = "run_id long, seq long, reason string, total_kept long, total_checked long"
_WAITING = "us long, seq long, kept boolean, checked boolean, term_end boolean, signal string"
_TOTALS = "begin long, kept long, checked long, target long, budget long, last_us long, last_seq long, over boolean, kept_at array<long>, terms_at array<long>"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def reason_of(signal: str | None, kept: int, checked: int, target: int, budget: int, term_end: bool, recent_kept: int, recent_terms: int, elapsed_s: float, floor_per_hour: float, least_terms: int, small_target: int) -> str | None:
    """Why a run ends at an event; None where it goes on."""
    by_signal = {"error": "error", "down": "serp_unavailable", "stop": "stopped"}.get(signal or "")
    if by_signal:
        return by_signal
    if kept >= target:
        return "target_met"
    if checked >= budget:
        return "check_budget"
    rate = recent_kept * 3600 / min(float(WINDOW_S), max(1.0, elapsed_s))
    return "diminishing_returns" if term_end and target > small_target and recent_terms >= least_terms and rate < floor_per_hour else None


class _Run(StatefulProcessor):
    def __init__(self, idle_s: int, floor_per_hour: float, least_terms: int, small_target: int):
        self.idle_ms, self.rule = idle_s * 1000, (floor_per_hour, least_terms, small_target)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.totals = handle.getValueState("totals", _TOTALS)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = self.totals.get() if self.totals.exists() else None
        if found is not None and found[7]:
            return
        add, target, budget = [], 0, 0
        for df in rows:
            for r in df.itertuples(index=False):
                target, budget = int(r.target), int(r.budget)
                add.append((int(r.us), int(r.seq), bool(r.kept), bool(r.checked), bool(r.term_end), None if pd.isna(r.signal) else r.signal))
        if not add:
            return
        self.waiting.appendList(add)
        if found is None:
            self.totals.update((-1, 0, 0, target, budget, -1, -1, False, [], []))
        for ms in {a[0] // 1000 + 1 for a in add}:
            self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        begin, kept, checked, target, budget, last_us, last_seq, over, kept_at, terms_at = self.totals.get()
        if over:
            return
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(w) for w in self.waiting.get())
        ready, later = [r for r in rows if r[0] // 1000 < passed], [r for r in rows if r[0] // 1000 >= passed]
        kept_at, terms_at, reason = list(kept_at), list(terms_at), None
        if ready and begin < 0:
            begin = ready[0][0]
        if ready:
            kept_at += [r[0] for r in ready if r[2]]
            terms_at += [r[0] for r in ready if r[4]]
        for us, seq, is_kept, is_checked, term_end, signal in ready:
            kept, checked = kept + is_kept, checked + is_checked
            recent = [sum(us - WINDOW_S * 1_000_000 <= t <= us for t in at) for at in (kept_at, terms_at)]
            last_us, last_seq = us, seq
            reason = reason_of(signal, kept, checked, target, budget, term_end, *recent, (us - begin) / 1e6, *self.rule)
            if reason:
                break
        if not reason and not ready and not later and last_us >= 0 and passed > last_us // 1000 + self.idle_ms:
            reason = "search_exhausted"
        if reason:
            self.waiting.clear()
            self.totals.update((begin, kept, checked, target, budget, last_us, last_seq, True, [], []))
            yield pd.DataFrame([(key[0], last_seq, reason, kept, checked)], columns=["run_id", "seq", "reason", "total_kept", "total_checked"])
            return
        if ready:
            reach = last_us - WINDOW_S * 1_000_000
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            self.totals.update((begin, kept, checked, target, budget, last_us, last_seq, False, [t for t in kept_at if t >= reach], [t for t in terms_at if t >= reach]))
            self.handle.registerTimer(last_us // 1000 + self.idle_ms + 1)


def live_stops(events: DataFrame, targets: DataFrame, late: str = "10 minutes", idle_s: int = 3600, floor_per_hour: float = 12, least_terms: int = 3, small_target: int = 50) -> DataFrame:
    """run_id, seq, reason, total_kept, total_checked of each run's end.  events (a stream): run_id long, seq, ts, kept, checked, term_end,
    signal; targets (a table): run_id, target, budget; see runs.stop_rows.  The session needs the state store STATE_STORE."""
    signal = F.col("signal") if "signal" in events.columns else F.lit(None).cast("string")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).join(targets.select("run_id", "target", "budget"), "run_id")
    e = e.select(F.col("run_id").cast("long").alias("run_id"), "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), flag("kept"), flag("checked"), flag("term_end"), signal.alias("signal"), F.col("target").cast("long").alias("target"), F.col("budget").cast("long").alias("budget"))
    return e.groupBy("run_id").transformWithStateInPandas(_Run(idle_s, floor_per_hour, least_terms, small_target), OUT, "Append", "EventTime")


def ends_of(spark: SparkSession, folder: str, schema: StructType, ahead: DataFrame, targets: DataFrame, **rule) -> DataFrame:
    """live_stops over the events that lie in a folder, taken file by file, then over the events of `ahead`, whose times let the
    watermark pass; the ends found, from a folder of the shared scratch space."""
    place = f"{scratch_dir(spark)}/stops-{uuid.uuid4().hex}"
    key, store = STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, store)
    try:
        for step in range(2):
            if step:
                ahead.write.mode("append").parquet(folder)
            found = live_stops(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder), targets, **rule)
            q = found.writeStream.format("parquet").option("path", f"{place}/ends").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(OUT).parquet(f"{place}/ends")
