"""The harvest stream against the batch form on the same hits."""

import json

from pyspark.sql import functions as F

from siftwell.operators.qualify import Market
from siftwell.streaming import harvest

ROWS = [
    ("r", 0, "https://a.com/1", "A", "translation agency", "web"), ("r", 1, "https://www.a.com/2", "A2", "x", "ai_overview"), ("r", 2, "https://b.com", "Login", "x", "web"),
    ("r", 3, "https://linkedin.com/in/x", "L", "x", "web"), ("r", 4, "", "E", "x", "web"), ("r", 5, "https://c.org", "C", None, None),
]


def write(folder, name, rows, day):
    folder.mkdir(exist_ok=True)
    keys = ("run_id", "pos", "link", "title", "snippet", "source")
    (folder / name).write_text("\n".join(json.dumps(dict(zip(keys, r, strict=True)) | {"ts": f"2025-01-0{day}T00:00:00"}) for r in rows))


def test_stream_equals_batch_and_reruns_change_nothing(spark, tmp_path):
    m, folder = Market(), tmp_path / "hits"
    write(folder, "1.json", ROWS[:3], 1)

    def run():
        harvest.harvest(harvest.read_hits(spark, str(folder)), str(tmp_path / "state"), m, str(tmp_path / "cp"), buckets=8).awaitTermination()
        return sorted((r["domain"], r["status"], r["reason"]) for r in harvest.domains_table(spark, str(tmp_path / "state"), 8).read().collect())

    # the panel's hit on a.com comes before the page's normal ones
    assert run() == [("a.com", "qualified", "ai_overview_verified"), ("b.com", "failed", "junk_title")]
    write(folder, "2.json", ROWS, 2)
    got = run()
    assert ("linkedin.com", "blocked", "blocked") in got and ("c.org", "discovered", None) in got
    assert run() == got
    hits = spark.read.schema(harvest.HITS).json(str(folder))
    none = spark.createDataFrame([], harvest.STATE)
    assert got == sorted((r["domain"], r["status"], r["reason"]) for r in harvest.new_rows(hits, None, none, m).collect())


def test_event_counts_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "e"))
    live = harvest.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), every="15 minutes", slide="15 minutes")
    q = live.writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("live").agg(F.sum("n")).first()[0] == events.count()


def test_harvest_qualifies_and_does_not_demote(spark, tmp_path):
    m, folder = Market(keywords=["translation", "language", "interpreter"]), tmp_path / "hits"
    page = "<title>A</title>" + "translation and interpreter services in every language, since long ago. " * 3
    pages = spark.createDataFrame([("https://a.com/1", page)], "url string, html string")
    write(folder, "1.json", [("r", 0, "https://a.com/1", "A", "translation agency", "web"), ("r", 1, "https://d.com", "D", "x", "local_pack"), ("r", 2, "https://e.com", "E", "x", "web")], 1)

    def run():
        harvest.harvest(harvest.read_hits(spark, str(folder)), str(tmp_path / "state"), m, str(tmp_path / "cp"), pages, buckets=8).awaitTermination()
        return {r["domain"]: (r["status"], r["score"]) for r in harvest.domains_table(spark, str(tmp_path / "state"), 8).read().collect()}

    first = run()
    assert first["d.com"] == ("qualified", 70) and first["a.com"][0] == "qualified" and first["e.com"] == ("unreachable", 0)
    write(folder, "2.json", [("r", 0, "https://a.com/1", "Login", "x", "web"), ("r", 1, "https://f.com", "F", "x", "ai_overview")], 2)
    assert run() == first | {"f.com": ("qualified", 70)}
