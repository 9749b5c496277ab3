"""Columns for gates: evidence of industry and country, screens, scores and tiers.

Screens return NULL where a row passes and else the first rule that fails.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell import dims
from siftwell.functions.web import any_in, any_link_has, any_token_in, contains_any, country_of, foreign_tld, hits, hits_in, lit_array, suffixes, text, tokens_in


#: words by which a state or school host stays
STATE_EXCEPTIONS = ["translation", "localization"]


def token_in(body: Column, needle: str) -> Column:
    """A phrase as a substring; one word only where no letter or digit touches it.  body is lower-cased."""
    return F.contains(body, F.lit(needle)) if " " in needle else F.rlike(body, F.lit(rf"(?<![a-z0-9]){re.escape(needle)}(?![a-z0-9])"))


def has_local_phone(body: Column, code: str) -> Column:
    return _local_phone(F.lower(text(body)), code)


def _local_phone(low: Column, code: str) -> Column:
    digits = code.lstrip("+").strip()
    return F.rlike(low, F.lit(dims.LOCAL_PHONE.format(digits=digits))) if digits else F.lit(False)


def has_bare_code(body: Column, code: str) -> Column:
    return _bare_code(F.lower(text(body)), code)


def _bare_code(low: Column, code: str) -> Column:
    d = code.lstrip("+").strip()
    return any_in(low, [f"+{d}", f"00{d}", f"({d})", f"( {d} )", f"+ {d}"]) if d else F.lit(False)


def strong_hits(found: Column, strong: list[str]) -> Column:
    return F.array_intersect(found, lit_array(strong))


def industry_evidence_ok(found: Column, strong: list[str]) -> Column:
    """Two strong hits, or one among three."""
    n = F.size(strong_hits(found, strong))
    return (n >= 2) | ((n >= 1) & (F.size(found) >= 3))


def tier(score: Column) -> Column:
    return F.when(score >= 60, "strong").when(score >= 30, "possible").otherwise("weak")


def _score(body: Column, found: Column, contact: Column, about: Column, social: Column, strong: list[str]) -> Column:
    n, ok = F.size(found), industry_evidence_ok(found, strong)
    raw = F.least(F.lit(50), 7 * n) + F.when(contact, 20).otherwise(0) + F.when(about, 10).otherwise(0) + F.when(social, 10).otherwise(0)
    score = F.when(n == 0, 0).when(ok, raw).otherwise(F.least(F.lit(29), raw))
    reasons = F.array_compact(F.array(
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" industry keywords"))), F.when((n > 0) & contact, F.lit("has contact page")), F.when((n > 0) & about, F.lit("has about/team page")),
        F.when((n > 0) & social, F.lit("has LinkedIn")), F.when((n > 0) & ~ok, F.lit("insufficient industry evidence")), F.when((n == 0) & body.isNotNull(), F.lit("missing industry keywords")),
    ))
    return F.struct(score.cast("int").alias("score"), F.when((n > 0) & ok, tier(score)).otherwise("weak").alias("tier"), reasons.alias("reasons"))


def score_page(body: Column, links: Column, profile: Column, keywords: list[str], strong: list[str]) -> Column:
    """struct(score, tier, reasons): keywords up to 50, contact page 20, about page 10, profile 10; weak without evidence.
    A page that was not read has no reasons."""
    return _score(body, hits(body, keywords), any_link_has(links, dims.CONTACT_HINTS), any_link_has(links, dims.ABOUT_HINTS), text(profile) != "", strong)


def with_score(df: DataFrame, out: str, body: str, links: str, profile: Column, keywords: list[str], strong: list[str], found: str | None = None) -> DataFrame:
    """df with score_page's struct; the keywords (unless a column has them) and both kinds of links are sought once, in a projection
    of their own."""
    d = df.withColumns({"_hits": F.col(found) if found else hits(F.col(body), keywords), "_contact": any_link_has(F.col(links), dims.CONTACT_HINTS), "_about": any_link_has(F.col(links), dims.ABOUT_HINTS), "_social": text(profile) != ""})
    return d.withColumn(out, _score(F.col(body), *map(F.col, ("_hits", "_contact", "_about", "_social")), strong)).drop("_hits", "_contact", "_about", "_social")


def is_parked(body: Column, signals: list[str] = dims.PARKING_SIGNALS) -> Column:
    return (F.length(F.trim(text(body))) < 100) | contains_any(body, signals)


def _signals(low: Column, country: str, geo: dict[str, tuple]) -> dict[str, Column]:
    """What a lower-cased text says about a place, each signal one look at the text."""
    if country not in geo:
        return {"_named": F.contains(low, F.lit(country.lower()))}
    code, adj, cities = geo[country]
    return {"_hq": F.get(hits_in(low, list(_hq_phrases(adj))), F.lit(0)), "_tokens": tokens_in(low, list(dict.fromkeys([*cities, country.lower(), *adj]))), "_phone": _local_phone(low, code), "_bare": _bare_code(low, code)}


def _hq_phrases(adj: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for a in adj:
        for p in dims.HQ_PREFIXES:
            out.setdefault(p + a, a)
    return out


def _decision(host: Column, sig: Callable[[str], Column], country: str, tld_country: dict[str, str], geo: dict[str, tuple]) -> Column:
    table = F.create_map(*[x for k, v in tld_country.items() for x in (F.lit(k), F.lit(v))])
    tld = F.get(F.filter(suffixes(host), lambda s: F.map_contains_key(table, s)), F.lit(0))
    home = F.try_element_at(table, tld)
    res = lambda ok, *ev: F.struct(F.lit(ok).alias("ok"), F.array_compact(F.array(*ev)).alias("evidence"))
    own = F.when(home == country, res(True, F.concat(F.lit("ccTLD "), tld))).when(home.isNotNull(), res(False, F.concat(F.lit("foreign ccTLD "), tld, F.lit(" -> "), home)))
    if country not in geo:
        return own.when(sig("_named"), res(True, F.lit(f"name '{country}'"))).otherwise(res(False, F.lit("no location signal")))
    code, adj, cities = geo[country]
    phrases = _hq_phrases(adj)
    hq = F.try_element_at(F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair]), sig("_hq")) if phrases else F.lit(None).cast("string")
    city = F.get(F.array_intersect(lit_array(cities), sig("_tokens")), F.lit(0))
    named, phone, bare = F.arrays_overlap(sig("_tokens"), lit_array([country.lower(), *adj])), sig("_phone"), sig("_bare")
    ok = hq.isNotNull() | (city.isNotNull() & (phone | named))
    found = F.array_compact(F.array(
        F.concat(F.lit("HQ phrase '"), hq, F.lit("'")), F.concat(F.lit("city '"), city, F.lit("'")),
        F.when(phone, F.lit(f"phone {code} number")).when(bare, F.lit(f"phone {code} code-only (ignored)")),
        F.when(~ok & city.isNotNull(), F.lit("city alone without country/HQ (ignored)")),
        F.when(~ok & city.isNull() & bare, F.lit("need city or HQ (phone alone insufficient)")),
    ))
    return own.otherwise(F.struct(ok.alias("ok"), F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("no local address / phone / city"))).alias("evidence")))


def gate_off(country: str) -> bool:
    return country in ("", "All Countries")


def location_gate(host: Column, body: Column, country: str, tld_country: dict[str, str], geo: dict[str, tuple]) -> Column:
    """struct(ok, evidence) for one selected country.  An own TLD passes and a foreign one fails by itself; else the
    evidence lists the headquarters phrase, the first city and the phone, whichever there are, and passes by a phrase, or
    a city with a local phone or with the country's name.  Over a table, with_location_gate looks at the text less often."""
    if gate_off(country):
        return F.struct(F.lit(True).alias("ok"), F.array(F.lit("location gate off")).alias("evidence"))
    return _decision(host, _signals(F.lower(text(body)), country, geo).__getitem__, country, tld_country, geo)


def with_location_gate(df: DataFrame, out: str, host: Column, body: str, country: str, tld_country: dict[str, str], geo: dict[str, tuple]) -> DataFrame:
    """df with location_gate's struct.  The text is lower-cased in one projection and looked at in the next, once a signal; the
    decision reads the signals.  Each projection is used more than once by the next, so Spark does not fold them together."""
    if gate_off(country):
        return df.withColumn(out, location_gate(host, F.col(body), country, tld_country, geo))
    signals = _signals(F.col("_low"), country, geo)
    seen = df.withColumn("_low", F.lower(text(F.col(body)))).withColumns(signals).drop("_low")
    return seen.withColumn(out, _decision(host, F.col, country, tld_country, geo)).drop(*signals)


def summary_suggests_country(title: Column, snippet: Column, host: Column, country: str, tld_country: dict[str, str], geo: dict[str, tuple], require_signal: bool = False) -> Column:
    """A result's title and snippet point to the country; short ones pass unless a signal is required."""
    low = F.lower(F.concat(text(title), F.lit(" "), text(snippet)))
    if country in ("", "All Countries"):
        return F.lit(True)
    _, adj, cities = geo.get(country, ("", [], []))
    extra = dims.SERP_COUNTRY_EXTRA.get(country, [])
    return (country_of(host, tld_country) == country) | F.when(F.length(F.trim(low)) < 20, F.lit(not require_signal)).otherwise(any_token_in(low, [country.lower(), *adj, *cities]) | any_in(low, extra))


def summary_has_industry(title: Column, snippet: Column, keywords: list[str], strong: list[str]) -> Column:
    return F.size(strong_hits(hits(F.concat(text(title), F.lit(" "), text(snippet)), keywords), strong)) >= 1


def summary_suggests_industry(title: Column, snippet: Column, keywords: list[str], strong: list[str]) -> Column:
    both = F.concat(text(title), F.lit(" "), text(snippet))
    return (F.length(F.trim(both)) < 20) | industry_evidence_ok(hits(both, keywords), strong)


def loose_screen(host: Column, title: Column, snippet: Column, blocked: Column, duplicate: Column, country: Column, tld_country: dict[str, str], junk_titles: list[str] = dims.JUNK_TITLES, pure_junk: list[str] = dims.PURE_JUNK) -> Column:
    """Reason why a hit is left out before its page is read; NULL for hits that go on."""
    both = F.concat(text(title), F.lit(" "), text(snippet))
    p = F.split(text(host), r"\.")
    state = ["gov", "edu", "mil"]
    state_host = (F.element_at(p, -1).isin(state) | F.coalesce(F.when(F.size(p) >= 3, F.element_at(p, -2)).isin(state), F.lit(False))) & ~contains_any(both, STATE_EXCEPTIONS)
    return (
        F.when(text(host) == "", "no_domain").when(blocked, "blocked").when(duplicate, "duplicate").when(foreign_tld(host, country, tld_country) != "", "foreign_cctld")
        .when(contains_any(title, junk_titles), "junk_title").when(contains_any(both, pure_junk) | state_host, "serp_junk")
    )


def hygiene_screen(host: Column, blocked: Column, duplicate: Column, country: Column, tld_country: dict[str, str]) -> Column:
    return F.when(text(host) == "", "no_domain").when(blocked, "blocked").when(duplicate, "duplicate").when(foreign_tld(host, country, tld_country) != "", "foreign_cctld")


def candidate_screen(host: Column, title: Column, blocked: Column, duplicate: Column, country: Column, tld_country: dict[str, str], relevant: Column, in_country: Column, junk_titles: list[str] = dims.JUNK_TITLES, listicle: list[str] = dims.LISTICLE) -> Column:
    """The stricter screen: listicles, irrelevant results and results of other countries go as well."""
    return F.coalesce(
        hygiene_screen(host, blocked, duplicate, country, tld_country),
        F.when(contains_any(title, junk_titles), "junk_title").when(contains_any(title, listicle), "listicle").when(~relevant, "serp_irrelevant").when(~in_country, "serp_geo_miss"),
    )


def is_directory(host: Column, title: Column, hosts: list[str] = dims.DIRECTORY_HOSTS, titles: list[str] = dims.DIRECTORY_TITLES) -> Column:
    from siftwell.functions.web import equal_or_below

    by_title = F.when(contains_any(title, titles), contains_any(title, dims.LIST_SIGNALS)).otherwise(contains_any(title, dims.LIST_TITLES))
    return equal_or_below(host, hosts) | by_title


def hit_priority(source: Column, directory: Column, verified: Column) -> Column:
    """0 answer panel, 1 local panel and companies that a directory lists, 2 directory, 3 summary shows industry and country,
    9 others."""
    return F.when(source == "ai_overview", 0).when(source.isin("local_pack", "directory"), 1).when(directory, 2).when(verified, 3).otherwise(9)


def page_status(body: Column, parked: Column, fits: Column) -> Column:
    return F.when(body.isNull(), "unreachable").when(parked, "failed").when(fits, "qualified").otherwise("rejected")


def page_reason(body: Column, parked: Column, industry_ok: Column, geo: Column) -> Column:
    """Why the page did not pass the gates; NULL where it did."""
    return (
        F.when(body.isNull(), "timeout_or_empty").when(parked, "parked_or_empty").when(~industry_ok, "industry_fail")
        .when(~geo["ok"], F.concat(F.lit("geo_fail:"), F.array_join(geo["evidence"], ",")))
    )


def event_reason(status: Column, reason: Column) -> Column:
    """What the run's event says of a page: a weak one counts as of the wrong industry."""
    return F.when(status == "failed", reason).when((status == "rejected") & F.startswith(reason, F.lit("geo_fail")), "location_mismatch").when(status == "rejected", "industry_mismatch")


def verdict(code: Column, has_mx: Column, catch_all: Column, email: Column) -> Column:
    """good, bad or risky from a mailbox check; NULL for malformed addresses."""
    return (
        F.when(~F.coalesce(F.rlike(email, F.lit(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")), F.lit(False)), F.lit(None)).when(~F.coalesce(has_mx, F.lit(False)), "bad").when(F.coalesce(catch_all, F.lit(False)), "risky")
        .when(code == 250, "good").when(code.between(550, 554), "bad").otherwise("risky")
    )


def check_budget(target: Column) -> Column:
    """Sites to check before giving up."""
    return F.when(target <= 25, F.greatest(3 * target, F.lit(60))).when(target <= 50, 4 * target).when(target <= 100, 5 * target).otherwise(F.least(F.lit(8000), 8 * target))


def max_pages(target: Column, page_size: int = 10) -> Column:
    """Result pages to read per search term."""
    return F.least(F.lit(150), F.greatest(F.lit(15), F.ceil(target / page_size) * 8))


def meta_pages(target: Column, least: int = 10) -> Column:
    """Result pages to read per term of a metasearch."""
    return F.least(F.lit(25), F.greatest(F.lit(least), F.floor(target / 8)))


def industry_match(title: Column, snippet: Column, slug: str | None, industries: dict[str, list[str]] = dims.INDUSTRY_KEYWORDS, junk_titles: list[str] = dims.JUNK_TITLES) -> Column:
    """A result shows the industry; all do where none is selected or it is not listed."""
    keywords = industries.get((slug or "").lower(), [])
    return ~contains_any(title, junk_titles) & contains_any(F.concat(text(title), F.lit(" "), text(snippet)), keywords) if keywords else F.lit(True)


def homepage_promising(body: Column, pages: Column, keywords: list[str], relevance: list[str] = dims.RELEVANCE_KEYWORDS, positive: list[str] = dims.POSITIVE_TERMS) -> Column:
    """Not parked, and a relevance, positive or industry term or three internal pages."""
    return body.isNotNull() & ~is_parked(body) & (contains_any(body, [*relevance, *positive, *keywords]) | (pages >= 3))


def quality_site(body: Column, pages: Column, keywords: list[str], relevance: list[str] = dims.RELEVANCE_KEYWORDS, least_pages: int = 4) -> Column:
    """Not parked, four internal pages at least, a relevance term, and an industry term where an industry is selected."""
    industry = contains_any(body, keywords) if keywords else F.lit(True)
    return body.isNotNull() & ~is_parked(body) & (pages >= least_pages) & contains_any(body, relevance) & industry
