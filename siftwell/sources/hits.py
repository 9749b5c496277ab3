"""Search results from landed responses, and run logs, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.web import contains_any, text
from siftwell.operators.dedupe import first_n

HIT = "link string, title string, snippet string, pos int"
_RESULTS = "struct<results: array<struct<url: string, title: string, content: string, type: string>>>"


def metasearch(rows: DataFrame, key: str, body: str, num: int) -> DataFrame:
    """key, pos, link, title, snippet: the first num results of a JSON response, then without empty URLs."""
    r = rows.select(key, F.posexplode(F.from_json(text(F.col(body)), _RESULTS)["results"]).alias("pos", "r")).where(F.col("pos") < num)
    return r.where(text(F.col("r.url")) != "").select(key, "pos", F.col("r.url").alias("link"), text(F.col("r.title")).alias("title"), text(F.col("r.content")).alias("snippet"))


def typed_results(rows: DataFrame, key: str, body: str, num: int) -> DataFrame:
    """The second response form: organic and web results with an http URL, the first num of those."""
    r = rows.select(key, F.posexplode(F.from_json(text(F.col(body)), _RESULTS)["results"]).alias("pos", "r"))
    good = r.where(F.startswith(text(F.col("r.url")), F.lit("http")) & F.lower(F.coalesce(F.nullif(F.col("r.type"), F.lit("")), F.lit("organic"))).isin("organic", "web"))
    return first_n(good, [key], ["pos"], num).select(key, "pos", F.col("r.url").alias("link"), text(F.col("r.title")).alias("title"), text(F.col("r.content")).alias("snippet"))


def result_page(rows: DataFrame, key: str, html: str, num: int, mark: str = "result__a") -> DataFrame:
    """Anchors of a result page: redirects unwrapped, tags dropped from titles, the first num with an http URL."""
    pat = rf"(?s)<a[^>]+class=\"[^\"]*{mark}[^\"]*\"[^>]+href=\"([^\"]*)\"[^>]*>(.*?)</a>"
    z = F.arrays_zip(*[F.regexp_extract_all(text(F.col(html)), F.lit(pat), F.lit(i)).alias(n) for i, n in ((1, "u"), (2, "t"))])
    r = rows.select(key, F.posexplode(z).alias("pos", "a"))
    wrapped = F.when(F.contains("a.u", F.lit("uddg=")), F.regexp_extract("a.u", r"uddg=([^&]+)", 1))
    r = r.select(key, "pos", F.coalesce(F.try_url_decode(wrapped), F.col("a.u")).alias("link"), F.trim(F.regexp_replace("a.t", r"<[^>]+>", "")).alias("title"))
    return first_n(r.where(F.startswith("link", F.lit("http"))), [key], ["pos"], num)


def response_status(http: Column, n_results: Column, engine_notes: Column) -> Column:
    """ok, empty, blocked, down or error."""
    refused = contains_any(engine_notes, ["captcha", "suspended", "denied", "too many", "429", "timeout"])
    return F.when(http.isNull(), "down").when(http.isin(429, 503), "blocked").when(http >= 400, "error").when(n_results > 0, "ok").when(refused, "blocked").otherwise("empty")


def parse_run_log(lines: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """kind (TERM, RATE, RUN START, RUN STOP), query, raw and kept of log lines; others go."""
    c = F.col(column)
    kind = F.regexp_extract(c, r"\b(TERM|RATE|RUN START|RUN STOP)\b", 1)
    num = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).cast("long")
    return lines.select(*(keep or []), kind.alias("kind"), F.regexp_extract(c, r"TERM '([^']*)'", 1).alias("query"), num(r"(\d+) results").alias("raw"), num(r"(\d+) kept").alias("kept")).where("kind <> ''")


def recent(logs: DataFrame, ts: str, now: Column, days: int = 7) -> DataFrame:
    return logs.where(F.col(ts) >= now - F.make_interval(days=F.lit(days)))
