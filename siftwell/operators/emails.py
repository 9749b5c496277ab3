"""A person's address from ordered layers of evidence.

Evidence is taken at the grain of a domain once and joined to people; layers are unioned with a rank and the
least rank wins in one aggregate.  Gates apply after that: an unverified second layer hides the third.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell import dims
from siftwell.functions.contacts import candidate_of, email_candidate, first_name, is_confirmed, is_generic, last_name, norm_name, token_named, worded
from siftwell.functions.web import text
from siftwell.operators import state
from siftwell.operators.dedupe import first_wins
from siftwell.operators.extract import search_address, site_addresses
from siftwell.operators.resume import SlicedRun
from siftwell.operators.substrings import fragments
from siftwell.scratch import materialize


def name_index(site: DataFrame, names: DataFrame) -> DataFrame:
    """domain, name, first: for each name (domain, name) that a local part at its domain holds, the first such address by priority and
    pos.  An inverted index: local parts are short, so all their fragments are laid out once and met by name."""
    local = F.lower(F.substring_index("email", "@", 1))
    pieces = site.select("domain", F.struct("priority", "pos", "email").alias("_at"), F.explode(fragments(local)).alias("name"))
    return pieces.join(names.select("domain", "name").distinct(), ["domain", "name"]).groupBy("domain", "name").agg(F.min("_at").alias("first"))


def from_site(people: DataFrame, site: DataFrame) -> DataFrame:
    """person, email, label: a person's site address whose local part holds the first or last name in lower case (first in page order),
    else the only one; none where several fit nobody.  Role addresses count for nothing.  people: person, domain, first_name, last_name.
    Names meet an index of their domain's addresses, so a domain with very many of both costs their sum and not their product."""
    own = site.where(~is_generic(F.col("email"))).select("domain", "priority", "pos", "email")
    names = F.array_distinct(F.filter(F.array(F.lower(text(F.col("first_name"))), F.lower(text(F.col("last_name")))), lambda n: n != ""))
    each = people.select("person", "domain", F.explode(names).alias("name"))
    named = each.join(name_index(own, each), ["domain", "name"]).groupBy("person").agg(F.min("first")["email"].alias("_named"))
    only = own.groupBy("domain").agg(F.count("*").alias("_n"), F.min("email").alias("_only")).where("_n = 1").drop("_n")
    p = people.select("person", "domain").join(named, "person", "left").join(only, "domain", "left").where("_named is not null or _only is not null")
    return p.select("person", F.coalesce("_named", "_only").alias("email"), F.when(F.col("_named").isNotNull(), "Site ✓").otherwise("Site").alias("label"))


def from_pattern(people: DataFrame, patterns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """person, email, label, verified: address by the domain's pattern, with its verdict; bad and role addresses go."""
    p = people.select("person", "domain", norm_name(F.col("first_name")).alias("_f"), norm_name(F.col("last_name")).alias("_l"))
    c = p.join(patterns, "domain").withColumn("email", candidate_of(F.col("_f"), F.col("_l"), F.col("domain"), F.col("pattern"))).where("email is not null")
    c = c.where(~is_generic(F.col("email"))).join(verdicts, "email", "left").where(F.coalesce("verdict", F.lit("")) != "bad")
    label = F.when(F.col("verdict") == "good", "EFmt ✓").when(F.col("verdict") == "risky", "EFmt ~").otherwise("EFmt ?")
    return c.select("person", "email", label.alias("label"), F.coalesce(F.col("verdict") == "good", F.lit(False)).alias("verified"))


def page_patterns(pages: DataFrame, key: str, body: str, domain: str) -> DataFrame:
    """key, pattern of a page about a domain's addresses: from its tokens ({first}.{last}), else from its first example
    address with an invented name, else from its wording.  Pages that show none are left out."""
    low = F.lower(text(F.col(body)))
    p = pages.select(key, low.alias("_low"), token_named(low).alias("_token"), worded(low).alias("_worded"), F.col(domain).alias("_domain"))
    local = F.regexp_extract_all("_low", F.concat(F.lit(r"([\w.+%\-]+)@\Q"), F.lower("_domain"), F.lit(r"\E")), F.lit(1))
    seen = p.where("_token is null").select(key, F.posexplode(local).alias("_at", "local_part")).join(example_patterns(pages.sparkSession), "local_part")
    example = seen.groupBy(key).agg(F.min_by("pattern", "_at").alias("_example"))
    out = p.join(example, key, "left").select(key, F.coalesce("_token", "_example", "_worded").alias("pattern"))
    return out.where("pattern is not null")


def example_patterns(spark) -> DataFrame:
    """local_part, pattern of invented example people, first pattern of each local part (built from the name lists)."""
    names = spark.createDataFrame([(f, l) for f in dims.EXAMPLE_FIRST for l in dims.EXAMPLE_LAST], "f string, l string")  # noqa: E741
    kinds = spark.createDataFrame(list(enumerate(dims.EMAIL_PATTERNS)), "rank int, pattern string")
    rows = names.join(kinds, F.lit(True)).withColumn("local_part", F.substring_index(email_candidate(F.col("f"), F.col("l"), F.lit("x.y"), F.col("pattern")), "@", 1))
    return first_wins(rows.select("local_part", "pattern", "rank"), ["local_part"], ["rank"]).select("local_part", "pattern")


def first_layer(layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """person, email, layer, verified, label of the first layer with an address."""
    parts = []
    for rank, (name, df) in enumerate(layers):
        verified = F.col("verified") if "verified" in df.columns else F.lit(True)
        label = F.col("label") if "label" in df.columns else F.lit("")
        parts.append(df.select("person", F.struct(F.lit(rank).alias("rank"), "email", F.lit(name).alias("layer"), verified.alias("verified"), label.alias("label")).alias("e")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("person").agg(F.min("e").alias("e")).select("person", "e.email", "e.layer", "e.verified", "e.label")


def leads(people: DataFrame, layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """Confirmed addresses of people, role addresses left out."""
    found = first_layer(layers)
    return people.join(found.where(is_confirmed(F.col("email"), F.col("layer"), F.col("verified")) & ~is_generic(F.col("email"))), "person")


_LEAD = ["email", "email_source", "full_name", "first_name", "last_name", "title", "company", "domain", "country", "linkedin_url", "source_url"]


def domain_evidence(people: DataFrame, pages: DataFrame, paths: DataFrame, pattern_pages: DataFrame, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(addresses of the sites, patterns by domain) of people's domains: see site_addresses and page_patterns."""
    mine = people.select("domain").distinct()
    linked = None if documents is None else documents.join(mine, "domain", "left_semi")
    return site_addresses(pages.join(mine, "domain", "left_semi"), paths, documents=linked), page_patterns(pattern_pages.withColumn("_own", F.col("domain")), "domain", "body", "_own")


def find_leads(people: DataFrame, evidence: tuple[DataFrame, DataFrame], verdicts: DataFrame, hits: DataFrame) -> DataFrame:
    """person, layer and a lead's columns for people with a confirmed address; evidence: see domain_evidence, else as for mail_run."""
    full = (F.col("full_name"), F.col("first_name"), F.col("last_name"))
    p = people.withColumns({"_f": first_name(*full), "_l": last_name(*full)}).withColumns({"first_name": F.col("_f"), "last_name": F.col("_l")}).drop("_f", "_l")
    addresses, patterns = evidence
    site, pattern = from_site(p, addresses), from_pattern(p, patterns, verdicts)
    searched = search_address(hits.join(p.where((F.col("first_name") != "") & (F.col("last_name") != "")).select("person"), "person", "left_semi")).withColumn("label", F.lit("Search ✓"))
    found = leads(p, [("L1-Site", site), ("L2-EFmt", pattern), ("L4-Search", searched)])
    given = lambda c: text(F.col(c)) if c in people.columns else F.lit("")
    named = F.coalesce(F.nullif(text(F.col("full_name")), F.lit("")), F.concat("first_name", F.lit(" "), "last_name"))
    return found.select(
        "person", "layer", "email", F.col("label").alias("email_source"), named.alias("full_name"), "first_name", "last_name", given("title").alias("title"), given("company_name").alias("company"), text(F.col("domain")).alias("domain"),
        F.lit("").alias("country"), given("linkedin_url").alias("linkedin_url"), F.lit("").alias("source_url"),
    )


def mail_run(people: DataFrame, pages: DataFrame, paths: DataFrame, pattern_pages: DataFrame, verdicts: DataFrame, hits: DataFrame, table: DataFrame, now: Column, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(leads to append, people with their stamp) of a run over people.

    people: person, domain, full_name, first_name, last_name, email_searched_at and, where known, title, company_name, linkedin_url.
    pages, paths, documents: see site_addresses.  pattern_pages: domain, body.  verdicts: email, verdict.  hits: person, pos, domain,
    snippet, title, link.  table: email and more; an address that it holds is not appended again.
    """
    rows = find_leads(people, domain_evidence(people, pages, paths, pattern_pages, documents), verdicts, hits)
    return state.insert_ignore(table, rows, ["email"], ["person"]), state.stamp(people, people, "person", "email_searched_at", now)


def mail_run_in_slices(run: SlicedRun, people: DataFrame, pages: DataFrame, paths: DataFrame, pattern_pages: DataFrame, verdicts: DataFrame, hits: DataFrame, table: DataFrame, now: Column, documents: DataFrame | None = None, at_most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """mail_run by slices of the people without a stamp, each committed with its people's stamps: a run that dies starts again at
    the slice where it stopped.  Evidence is at the grain of a domain and the same for all slices, so a start takes it once.
    Of the slices committed so far: (leads to append, people with their stamp)."""
    todo = people.where(F.col("email_searched_at").isNull())
    if len(run.committed()) < run.slices:
        addresses, patterns = domain_evidence(todo, pages, paths, pattern_pages, documents)
        evidence, checked = (materialize(addresses, "site-addresses"), materialize(patterns, "page-patterns")), materialize(verdicts, "verdicts")

        def work(part: DataFrame) -> dict[str, DataFrame]:
            who = part.select("person").distinct()
            return {"leads": find_leads(part, evidence, checked, hits.join(who, "person", "left_semi"))}

        run.run(todo, "person", work, at_most)
    return state.insert_ignore(table, run.read("leads"), ["email"], ["person"]), state.stamp(people, run.read("done"), "person", "email_searched_at", now)
