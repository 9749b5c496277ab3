"""People of companies from any number of sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell import dims
from siftwell.functions.contacts import title_passes
from siftwell.functions.web import text
from siftwell.operators import extract, state
from siftwell.operators.dedupe import first_n, merge_people
from siftwell.operators.qualify import classify_companies

Source = Callable[[DataFrame], DataFrame]


def find_people(companies: DataFrame, sources: list[tuple[str, Source]], roles: list[str] = dims.KEPT_ROLES, most: int = 10) -> DataFrame:
    """The first `most` people with a kept role of each company, in the order of the sources.

    A source takes companies (domain, ...) and gives domain, full_name, title, linkedin_url, seq.  All sources are
    asked; the same person counts once, by profile URL or else by name.  Column people_source names the source.
    """
    parts = [s(companies).select("domain", "full_name", "title", "linkedin_url", "seq").withColumn("source_rank", F.lit(i)).withColumn("people_source", F.lit(name)) for i, (name, s) in enumerate(sources)]
    merged = merge_people(reduce(DataFrame.unionByName, parts))
    return first_n(merged.where(title_passes(F.col("title"), roles)), ["domain"], ["source_rank", "seq"], most)


def enough(found: DataFrame, least: int = 5) -> DataFrame:
    """Domains with `least` people or more."""
    return found.groupBy("domain").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("domain")


def people_run(
    companies: DataFrame, homepages: DataFrame, verdicts: DataFrame, hits: DataFrame, cards: DataFrame, pages: DataFrame, paths: DataFrame, table: DataFrame, now: Column,
    roles: list[str] = dims.KEPT_ROLES, titles: list[str] = dims.TARGET_TITLES, most: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """(rows to append to the people table, companies with type and stamp) of a run over companies.

    A company without a type is classified by its homepage (homepages: domain, body).  Sources in order: profile hits,
    profile cards (only where the company has a profile and the hits found fewer than five), the company's own pages; see
    profile_people, card_fragments and page_people for their inputs.  companies: domain, linkedin_url, company_type,
    people_searched_at and, where known, company_name.  table: domain, full_name and more; who is in it already is not appended
    again.  Appended rows hold domain, company_name, first_name (the first word), last_name (the rest), full_name, title,
    linkedin_url, people_source and found_at.
    """
    kinds = classify_companies(companies.where(text(F.col("company_type")) == "").select("domain").join(homepages, "domain", "left"), verdicts).select("domain", F.col("company_type").alias("_kind"))
    own = lambda c: c.select("domain")
    xray = extract.profile_people(hits.join(own(companies), "domain", "left_semi"))
    wanted = companies.where(text(F.col("linkedin_url")) != "").select("domain").join(enough(xray), "domain", "left_anti")
    page = extract.card_fragments(cards.join(wanted, "domain", "left_semi"))
    site = extract.page_people(pages.join(own(companies), "domain", "left_semi"), paths, titles=titles)
    shape = lambda df, url: lambda c: df.select("domain", F.col("name").alias("full_name"), "title", F.col(url).alias("linkedin_url"), F.col("pos").alias("seq"))
    found = find_people(companies, [("xray", shape(xray, "link")), ("LI page", shape(page, "url")), ("Website", shape(site, "linkedin_url"))], roles, most)
    words = F.split(F.trim("full_name"), r"\s+")
    named = {"first_name": F.get(words, F.lit(0)), "last_name": F.array_join(F.slice(words, 2, 1000), " "), "found_at": now}
    company = companies.select("domain", (text(F.col("company_name")) if "company_name" in companies.columns else F.lit("")).alias("company_name"))
    full = found.join(company, "domain").withColumns(named).select("domain", "company_name", "first_name", "last_name", "full_name", "title", "linkedin_url", "people_source", "found_at", "source_rank", "seq")
    rows = state.insert_ignore(table, full, ["domain", "full_name"], ["source_rank", "seq"]).drop("source_rank", "seq")
    typed = companies.join(kinds, "domain", "left").withColumn("company_type", F.coalesce(F.nullif(text(F.col("company_type")), F.lit("")), "_kind")).drop("_kind")
    return rows, state.stamp(typed, companies, "domain", "people_searched_at", now)
