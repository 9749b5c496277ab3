"""Counts, funnels, browsing and exports.  All are lazy plans; aggregates combine before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell import dims
from siftwell.functions.web import text
from siftwell.operators.dedupe import numbered


def status_counts(table: DataFrame, status: str, names: list[str]) -> DataFrame:
    """status, n with a row for each listed status and for each that occurs."""
    seen = table.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    want = table.sparkSession.createDataFrame([(s, 0) for s in names], "status string, zero int")
    return seen.join(want, "status", "full").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def counts_by(table: DataFrame, column: str, blank: str = "(all)") -> DataFrame:
    """Counts by a column, greatest first, then by key; blank values under one name."""
    key = F.coalesce(F.nullif(F.trim(text(F.col(column))), F.lit("")), F.lit(blank)).alias(column)
    return table.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()])


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, half to even; 0 of nothing."""
    return F.when(whole > 0, F.bround(100 * part / whole, 0)).otherwise(0).cast("int")


def distinct_values(table: DataFrame, column: str) -> DataFrame:
    return table.where(F.trim(text(F.col(column))) != "").select(column).distinct().orderBy(column)


def browse(table: DataFrame, equal: dict[str, str] | None = None, query: str = "", columns: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """Rows by equality filters and a literal substring, in any case, of some column; equality reaches the scan."""
    out = table
    for c, v in (equal or {}).items():
        if v not in ("", "All"):
            out = out.where(F.col(c) == v)
    if query:
        q = F.lit(query.lower())
        out = out.where(F.exists(F.array(*[F.lower(text(F.col(c).cast("string"))) for c in columns or table.columns]), lambda c: F.contains(c, q)))
    return out.orderBy(*order) if order else out


def pretty(ts: Column) -> Column:
    """2025-01-02T03:04:05 as '2025-01-02  03:04'."""
    return F.regexp_replace(F.substring(text(ts), 1, 16), "T", "  ")


def dash(c: Column) -> Column:
    return F.coalesce(F.nullif(text(c), F.lit("")), F.lit("—"))


def with_scheme(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("http")), c).otherwise(F.concat(F.lit("https://"), c))


def export(sheets: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One folder per sheet; 'domains' sheets are partitioned by status."""
    for name, df in sheets.items():
        w = df.write.mode("overwrite").format(fmt)
        (w.partitionBy("status") if "status" in df.columns and name == "domains" else w).save(f"{folder}/{name}")


def sheets(domains: DataFrame, people: DataFrame, leads: DataFrame, blocked: DataFrame, drop_empty: bool = True) -> dict[str, DataFrame]:
    """The full export: a sheet per status, people with company type, leads, blocked hosts and the summary.  Sheets
    without rows are left out but for qualified; their counts are the summary's few rows."""
    kinds = domains.select("domain", F.col("company_type").alias("_type"))
    out = {s: domains.where(F.col("status") == s).orderBy(F.desc("score"), F.desc("seq")) for s in dims.STATUSES}
    out["people"] = people.join(kinds, "domain", "left").withColumn("company_type", F.upper(text(F.col("_type")))).drop("_type")
    out["leads"], out["blocked"] = leads, blocked
    summary = table_counts({s: domains.where(F.col("status") == s) for s in dims.STATUSES} | {"people": people, "leads": leads, "blocked": blocked})
    if drop_empty:
        n = dict(summary.collect())
        out = {name: df for name, df in out.items() if name == "qualified" or n[name]}
    return out | {"summary": summary}


def run_sheets(qualified: DataFrame, not_kept: DataFrame, people: DataFrame, leads: DataFrame) -> dict[str, DataFrame]:
    """Sheets of one run: kept companies by score, what was not kept and why, people and leads, numbered in their order.

    qualified: seq, domain, company_name, tier, score, linkedin_url, country, reasons (array).  not_kept: seq, domain, reason,
    detail, message.  people and leads: seq and the columns that they show.
    """
    blank = lambda *names: [text(F.col(n)).alias(n) for n in names]
    best = numbered(qualified, [F.desc("score"), "seq"], "row_no")
    kept = best.select("row_no", *blank("domain", "company_name", "tier"), F.coalesce("score", F.lit(0)).alias("score"), *blank("linkedin_url", "country"), F.array_join(F.coalesce("reasons", F.array().cast("array<string>")), ", ").alias("signals"))
    gone = numbered(not_kept, ["seq"], "row_no").select("row_no", *blank("domain", "reason"), F.coalesce(F.nullif(text(F.col("detail")), F.lit("")), text(F.col("message"))).alias("detail"))
    who = numbered(people, ["seq"], "row_no").select("row_no", *blank("full_name", "title", "company_name", "domain"), dash(F.upper("company_type")).alias("type"), *blank("linkedin_url"))
    mail = numbered(leads, ["seq"], "row_no").select("row_no", *blank("full_name", "title", "company", "email", "email_source", "domain", "linkedin_url"))
    return {"qualified": kept, "not_kept": gone, "people": who, "leads": mail}
