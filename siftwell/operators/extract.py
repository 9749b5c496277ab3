"""Rows from text and markup: companies, people, addresses.  One narrow pass each, then first-wins where lists repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell import dims
from siftwell.functions.contacts import clean_name, is_former, is_generic, is_institutional, is_personal, is_profile_name, is_valid_name, profile_name, title_matches
from siftwell.functions.web import absolute, contains_any, domain_of, text, without
from siftwell.operators.dedupe import first_n, first_wins
from siftwell.scratch import materialize

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
SPOKEN_EMAIL = r"([A-Za-z0-9._%+\-]+)\s*[\[\(]?\s*(?:at|AT|@)\s*[\]\)]?\s*([A-Za-z0-9.\-]+\.[A-Za-z]{2,})"


def _strip(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def listed_names(rows: DataFrame, key: str, body: str, most: int = 50) -> DataFrame:
    """key, pos, name: items of a text's numbered lists ('1. A 2. B'), then of its bulleted ones, first of each in any case.

    An item begins with a letter and has 2 to 80 characters; what a list is called ('Top 10 firms in Rome ...', 'Members:')
    is cut off its first item, and items that speak of the page itself go.
    """
    x = F.trim(text(F.col(body)))
    none = F.array().cast("array<string>")
    is_name = lambda s: F.length(s).between(2, 80) & F.rlike(s, F.lit("^[A-Za-z]"))
    unnumbered = lambda s: F.trim(F.regexp_replace(s, r"\s+\d{1,2}\s*$", ""))
    part = F.filter(F.transform(F.split(x, r"\d{1,2}[.)]\s*"), lambda s: _strip(s, " ·•|-–—;,\t")), lambda s: F.rlike(s, F.lit("^[A-Za-z]")))
    numbered = F.filter(F.transform(part, lambda s: unnumbered(F.trim(F.get(F.split(s, r"\s{2,}|\s+[·•]\s+"), F.lit(0))))), lambda s: F.length(s).between(2, 80))
    called = r"(?i)^(?:list of|recommended|top\s+\d+)\s+[\w &/,\-]+?\s+in\s+[\w\s]+\s+"
    after_colon = lambda s: F.when(F.contains(s, F.lit(":")) & (F.length(F.substring_index(s, ":", 1)) < 40), F.trim(F.regexp_extract(s, r"(?s)^[^:]*:(.*)$", 1))).otherwise(s)
    item = F.transform(F.split(x, r"\s*[·•●]\s*"), lambda s: after_colon(_strip(F.regexp_replace(_strip(s, " .-–—|"), called, ""), " .-–—|")))
    bulleted = F.filter(item, lambda s: is_name(s) & ~F.rlike(s, F.lit(dims.CALL_TO_ACTION)))
    found = F.concat(F.when(F.rlike(x, F.lit(r"\d{1,2}[.)]\s*[A-Za-z]")), numbered).otherwise(none), F.when(F.rlike(x, F.lit("[·•●]")), bulleted).otherwise(none))
    one = rows.select(key, F.posexplode(found).alias("pos", "name")).withColumn("name", unnumbered(F.trim(F.regexp_replace("name", r"\s+", " "))))
    one = one.where((F.length("name") >= 2) & ~contains_any(F.col("name"), dims.LISTED_NAME_NOISE))
    firsts = first_wins(one.withColumn("_low", F.lower("name")), [key, "_low"], ["pos"]).drop("_low")
    return first_n(firsts, [key], ["pos"], most)


def anchors(rows: DataFrame, keys: list[str], html: str) -> DataFrame:
    """keys, pos, href, label of every anchor, tags inside labels dropped."""
    pat = r"(?is)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
    z = F.arrays_zip(F.regexp_extract_all(text(F.col(html)), F.lit(pat), F.lit(1)).alias("href"), F.regexp_extract_all(text(F.col(html)), F.lit(pat), F.lit(2)).alias("label"))
    out = rows.select(*keys, F.posexplode(z).alias("pos", "a"))
    return out.select(*keys, "pos", "a.href", F.trim(F.regexp_replace(F.regexp_replace("a.label", r"<[^>]+>", " "), r"\s+", " ")).alias("label"))


def directory_companies(rows: DataFrame, key: str, url: str, html: str, blocks: Callable[[Column], Column], most: int = 50) -> DataFrame:
    """key, pos, name, link of a directory page: its external anchors, then numbered names of its visible text (no link).

    Blocked hosts (other directories too) go; a call to action is named after its host; first of each name in any case.
    """
    page = rows.select(key, domain_of(F.col(url)).alias("_self"), F.col(html).alias("_html"))
    a = anchors(page, [key, "_self"], "_html").where(~F.rlike("href", F.lit(r"^(#|mailto:|tel:|javascript:)")))
    a = a.withColumn("link", absolute(F.col("href"), F.col("_self"))).withColumn("_host", domain_of(F.col("link"))).where((F.col("_host") != "") & (F.col("_host") != F.col("_self")) & ~blocks(F.col("link")))
    label = F.substring_index("_host", ".", 1)
    action = F.rlike("label", F.lit(dims.CALL_TO_ACTION)) | (F.col("label") == "")
    name = F.when(action, F.when(F.length(label) >= 3, F.initcap(F.replace(label, F.lit("-"), F.lit(" "))))).otherwise(F.when(F.length("label").between(2, 100), F.col("label")))
    link = F.when(contains_any(F.col("link"), dims.SOCIAL_LINKS), "").otherwise(F.col("link"))
    linked = a.select(key, F.lit(0).alias("_pass"), "pos", name.alias("name"), link.alias("link"))
    shown = F.regexp_replace(without(text(F.col("_html")), ["script", "style"]), r"<[^>]+>", "\n")
    counted = page.select(key, F.lit(1).alias("_pass"), F.posexplode(F.regexp_extract_all(shown, F.lit(r"(?:^|\n)\s*\d{1,2}[.)]\s+([A-Za-z][^\n]{1,80})"), F.lit(1))).alias("pos", "name"), F.lit("").alias("link"))
    both = linked.unionByName(counted).withColumn("name", F.trim(F.regexp_replace(F.trim(F.regexp_replace("name", r"\s+", " ")), r"^\d+[.)]\s*", "")))
    both = both.where(F.length("name").between(2, 120) & ~F.rlike("name", F.lit(dims.CALL_TO_ACTION)))
    firsts = first_wins(both.withColumn("_low", F.lower("name")), [key, "_low"], ["_pass", "pos"])
    return first_n(firsts.select(key, "_pass", "pos", "name", "link"), [key], ["_pass", "pos"], most, rank="_rank").select(key, (F.col("_rank") - 1).alias("pos"), "name", "link")


def scraped_companies(listed: DataFrame, linked: DataFrame, organic: DataFrame, key: str, market, most: int = 50) -> DataFrame:
    """key, domain, title, link, pos, source of the companies that a directory lists: the names in its snippet (listed), then
    its anchors and numbered names (linked), resolved against its own links and the organic results (see merge_panel_rows).
    Rows without a link of their own or found are left out, as are blocked hosts, the directories among them."""
    from siftwell.operators.qualify import merge_panel_rows

    rows = listed.select(key, "pos", "name", F.lit("").alias("link")).unionByName(linked.select(key, (F.col("pos") + 1000).alias("pos"), "name", "link"))
    rows = materialize(rows.withColumn("snippet", F.lit("")), "listed")  # read as names, as links and as rows
    out = merge_panel_rows(rows, organic.select(key, "link", "title", "pos"), [key], market, source="directory")
    return first_n(out, [key], ["pos"], most)


_PERSON = r"(?is)itemtype=[\"'][^\"']*(?:schema\.org/)?Person[\"'][^>]*>(.*?)</(?:div|article|li|section)[^>]*>"
_CARD = r"(?is)<(?:div|article|li|section)[^>]*(?:class|id)=[\"'][^\"']*(?:team|staff|member|person|employee|card|bio)[^\"']*[\"'][^>]*>(.*?)</(?:div|article|li|section)>"
_PROFILE = r"(?i)href=[\"']([^\"']*linkedin\.com/in/[^\"'? ]+)[\"']"


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def microdata_people(rows: DataFrame, key: str, html: str, titles: list[str] = dims.TARGET_TITLES) -> DataFrame:
    """key, pos, name, title, linkedin_url from schema.org Person items whose title matches."""
    blocks = F.regexp_extract_all(text(F.col(html)), F.lit(_PERSON), F.lit(1))
    prop = lambda p, n: _spaced(F.regexp_extract("b", rf"(?i)itemprop=[\"']{p}[\"'][^>]*>([^<]{{2,{n}}})", 1))
    out = rows.select(key, F.posexplode(blocks).alias("pos", "b"))
    out = out.select(key, "pos", prop("name", 60).alias("name"), prop("jobTitle", 80).alias("title"), F.regexp_extract("b", _PROFILE, 1).alias("linkedin_url"))
    return out.where(is_valid_name(F.col("name")) & title_matches(F.col("title"), titles))


def card_people(rows: DataFrame, key: str, html: str, titles: list[str] = dims.TARGET_TITLES) -> DataFrame:
    """key, pos, name, title, linkedin_url: inside team cards, headings that are names, with the card's first paragraph
    that matches a title; the first of each name on a page."""
    cards = rows.select(key, F.posexplode(F.regexp_extract_all(text(F.col(html)), F.lit(_CARD), F.lit(1))).alias("_card", "b"))
    heads = F.transform(F.regexp_extract_all("b", F.lit(r"(?i)<(?:h[2-4]|strong|b)[^>]*>\s*([^<]{3,60})\s*</(?:h[2-4]|strong|b)>"), F.lit(1)), _spaced)
    roles = F.transform(F.regexp_extract_all("b", F.lit(r"(?i)<(?:p|span|div)[^>]*>\s*([^<]{3,80})\s*</(?:p|span|div)>"), F.lit(1)), _spaced)
    role = F.get(F.filter(roles, lambda s: title_matches(s, titles)), F.lit(0))
    out = cards.select(key, "_card", F.posexplode(heads).alias("_head", "name"), F.substring(role, 1, 80).alias("title"), F.regexp_extract("b", _PROFILE, 1).alias("linkedin_url"))
    out = out.where(F.col("title").isNotNull() & is_valid_name(F.col("name"))).withColumn("pos", F.col("_card") * 100 + F.col("_head"))
    return first_wins(out.select(key, "name", "pos", "title", "linkedin_url"), [key, "name"], ["pos"]).select(key, "pos", "name", "title", "linkedin_url")


_UPPER, _LOWER = "A-ZÁÉÍÓÚÀÂÄÈÊËÎÏÔÙÛÜÆŒÇÑ", "a-záéíóúàâäèêëîïôùûüæœçñ'\\-"
NAME = rf"\b([{_UPPER}][{_LOWER}]+(?:\s+[{_UPPER}][{_LOWER}]+){{1,3}})\b"


def nearby_people(rows: DataFrame, key: str, body: str, titles: list[str], reach: int = 100) -> DataFrame:
    """key, pos, name, title: at each place of a title, the name nearest before it within reach, else the first after it;
    titles in list order, first of each name (off in the live flow, as most of what it finds is wrong)."""
    x = text(F.col(body))
    low = rows.select(key, x.alias("_x"), F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(titles) - 1)).alias("rank"), F.array(*map(F.lit, titles)).alias("kw"))).alias("t")).select(key, "_x", "t.*")
    parts = F.split(F.lower("_x"), F.concat(F.lit("\\Q"), "kw", F.lit("\\E")))
    # where each part of the text between the title's places ends
    ends = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.array().cast("array<int>"), lambda acc, p: F.array_append(acc, F.when(F.size(acc) == 0, F.length(p)).otherwise(F.element_at(acc, -1) + F.length("kw") + F.length(p))))
    at = low.where(F.size(parts) > 1).select(key, "_x", "rank", "kw", F.posexplode(ends).alias("place", "at"))
    names = lambda s: F.filter(F.regexp_extract_all(s, F.lit(NAME), F.lit(1)), lambda n: is_valid_name(n))
    before = names(F.expr("substring(_x, greatest(at - {0}, 0) + 1, least(at, {0}))".format(reach)))
    after = names(F.expr(f"substring(_x, at + length(kw) + 1, {reach})"))
    found = at.select(key, (F.col("rank") * 1_000_000 + F.col("place")).alias("pos"), F.coalesce(F.when(F.size(before) > 0, F.element_at(before, -1)), F.get(after, F.lit(0))).alias("name"), F.initcap("kw").alias("title"))
    return first_wins(found.where("name is not null"), [key, "name"], ["pos"]).select(key, "pos", "name", "title")


def page_people(pages: DataFrame, paths: DataFrame, most: int = 5, titles: list[str] = dims.TARGET_TITLES) -> DataFrame:
    """domain, name, title, linkedin_url, pos: people of each domain's first productive page, in path order.  pages: domain, path, html."""
    p = pages.join(paths, "path").withColumn("_page", F.concat_ws("|", "domain", "path"))
    micro, cards = microdata_people(p, "_page", "html", titles).withColumn("_kind", F.lit(0)), card_people(p, "_page", "html", titles).withColumn("_kind", F.lit(1))
    found = micro.unionByName(cards).join(p.select("_page", "domain", "priority"), "_page")
    best = F.min(F.struct("priority", "_kind")).over(Window.partitionBy("domain"))
    found = found.withColumn("_best", best).where(F.struct("priority", "_kind") == F.col("_best"))
    firsts = first_wins(found.withColumn("_low", F.lower("name")), ["domain", "_low"], ["pos"])
    return first_n(firsts, ["domain"], ["pos"], most).select("domain", "name", F.substring("title", 1, 80).alias("title"), "linkedin_url", "pos")


def profile_people(hits: DataFrame, most: int = 10) -> DataFrame:
    """domain, name, title, link, pos: people in profile hits.  Per domain the first engine that finds anyone counts, and of its
    answers the first search name with anyone.  hits: domain, engine_rank, candidate_rank, pos, link, title, snippet."""
    n = profile_name(F.regexp_replace(text(F.col("title")), r"(?i)\s*\((?:she|he|they|ze|xe)[^)]*\)", ""))
    ok = F.contains(text(F.col("link")), F.lit("linkedin.com/in/")) & ~is_former(F.col("snippet")) & ~is_former(F.col("title"))
    people = hits.where(ok).withColumn("name", clean_name(n["name"])).withColumn("job", F.substring(n["job"], 1, 80)).where(is_profile_name(F.col("name")))
    best = people.groupBy("domain").agg(F.min(F.struct("engine_rank", "candidate_rank")).alias("_best"))
    people = people.join(best, "domain").where(F.struct("engine_rank", "candidate_rank") == F.col("_best")).drop("_best")
    by_url = first_wins(people, ["domain", "link"], ["pos"])
    by_name = first_wins(by_url.withColumn("_low", F.lower("name")), ["domain", "_low"], ["pos"])
    return first_n(by_name, ["domain"], ["pos"], most).select("domain", "name", F.col("job").alias("title"), "link", "pos")


def card_person(fragments: Column) -> Column:
    """struct(name, title) from the fragments of a profile card: the first that is shaped like a person's name and is no
    company's, then the first title-like one, else one of a role's length."""
    clean = lambda s: _strip(F.regexp_replace(F.trim(F.regexp_replace(s, r"\s*\([^)]*\)", "")), r"^\s*[•·∙∘]\s*", ""), " ,;:")
    frags = F.filter(F.transform(fragments, clean), lambda s: (s != "") & ~F.lower(s).isin(dims.CARD_JUNK))
    last = lambda s: F.rtrim(F.lower(F.element_at(F.split(s, r"\s+"), -1)), F.lit(".,"))
    named = lambda s: F.rlike(s, F.lit(rf"^[{_UPPER}][{_LOWER}]+(?:\s+[{_UPPER}][{_LOWER}]+){{1,3}}$")) & ~F.lower(s).isin(dims.NOBODY) & ~last(s).isin(dims.CORPORATE_WORDS)
    name = F.get(F.filter(frags, named), F.lit(0))
    rest = F.filter(frags, lambda s: s != name)
    titled = F.get(F.filter(rest, lambda s: F.rlike(s, F.lit(dims.TITLE_HINT))), F.lit(0))
    return F.struct(name.alias("name"), F.coalesce(titled, F.get(F.filter(rest, lambda s: F.length(s).between(6, 79)), F.lit(0)), F.lit("")).alias("title"))


def card_fragments(cards: DataFrame, most: int = 15) -> DataFrame:
    """domain, name, title, url, pos of the people on profile cards; the first 2 * most cards of a domain are read."""
    c = first_n(cards, ["domain"], ["pos"], 2 * most).withColumn("_p", card_person(F.col("fragments"))).where("_p.name is not null")
    return first_n(first_wins(c, ["domain", "url"], ["pos"]), ["domain"], ["pos"], most).select("domain", "_p.name", "_p.title", "url", "pos")


def plain_at(body: Column, host: Column) -> Column:
    """Plain addresses of a text at a host; the text may go on after it ('x@a.com.eg' holds x@a.com)."""
    return F.regexp_extract_all(text(body), F.concat(F.lit(r"(?i)\b([A-Za-z0-9._%+\-]+@\Q"), host, F.lit(r"\E)\b")), F.lit(1))


def addresses(rows: DataFrame, key: str, body: str, host: str | None = None) -> DataFrame:
    """key, pos, email: plain addresses, then spoken ones ('bob at a.com', 'bob [at] a.com'), first of each; with a host
    column only those at that host."""
    x = text(F.col(body))
    plain = plain_at(x, F.col(host)) if host else F.regexp_extract_all(x, F.lit(EMAIL), F.lit(0))
    a, b = (F.regexp_extract_all(x, F.lit(SPOKEN_EMAIL), F.lit(i)) for i in (1, 2))
    spoken = F.zip_with(a, b, lambda p, q: F.concat(p, F.lit("@"), q))
    spoken = F.filter(spoken, lambda e: F.lower(F.substring_index(e, "@", -1)) == F.col(host)) if host else spoken
    return rows.select(key, F.posexplode(F.array_distinct(F.transform(F.concat(plain, spoken), lambda e: F.lower(e)))).alias("pos", "email"))


def _contact_addresses(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """domain, priority, pos, email of the pages on the paths; free and institutional hosts go."""
    p = pages.join(paths, "path").withColumn("_page", F.concat_ws("|", "domain", "path"))
    found = addresses(p, "_page", "text", "domain").join(p.select("_page", "domain", "priority"), "_page").drop("_page")
    return found.where(~is_personal(F.col("email")) & ~is_institutional(F.col("email")))


def site_addresses(pages: DataFrame, paths: DataFrame, home: str = "/", documents: DataFrame | None = None) -> DataFrame:
    """domain, priority, pos, email: addresses at the domain from its contact pages, up to the first page that has one
    of a person; the homepage only where those have none; linked documents (see document_addresses) only where the homepage has
    none either, behind all pages.  pages: domain, path, text; documents: domain, doc, page, text.

    Each layer reads what earlier ones have left open: anti-joins on the domains that have addresses stand in front of it.
    """
    found = materialize(_contact_addresses(pages.where(F.col("path") != home), paths), "contact-addresses")
    stop = found.where(~is_generic(F.col("email"))).groupBy("domain").agg(F.min("priority").alias("_stop"))
    out = found.join(stop, "domain", "left").where(F.col("_stop").isNull() | (F.col("priority") <= F.col("_stop"))).drop("_stop")
    done = found.select("domain").distinct()
    at_home = _contact_addresses(pages.where(F.col("path") == home).join(done, "domain", "left_anti"), paths)
    if documents is not None:
        at_home = materialize(at_home, "home-addresses")
        done = done.union(at_home.select("domain")).distinct()
        linked = _linked_addresses(documents.join(done, "domain", "left_anti"), "domain", 3, 5)
        at_home = at_home.unionByName(linked.select("domain", (F.lit(1_000_000) + F.col("doc")).cast("int").alias("priority"), (F.col("page") * 1_000_000 + F.col("pos")).cast("int").alias("pos"), "email"))
    both = out.select("domain", "priority", "pos", "email").unionByName(at_home.select("domain", "priority", "pos", "email"))
    return first_wins(both, ["domain", "email"], ["priority", "pos"])


def _linked_addresses(pages: DataFrame, site: str, most_docs: int, most_pages: int) -> DataFrame:
    p = pages.where((F.col("doc") < most_docs) & (F.col("page") < most_pages)).withColumn("_page", F.concat_ws("|", site, "doc", "page"))
    found = addresses(p, "_page", "text", "domain").join(p.select("_page", site, "doc", "page").distinct(), "_page").drop("_page")
    first = found.groupBy(site).agg(F.min("doc").alias("_first"))
    return found.join(first, site).where("doc = _first").drop("_first")


def document_addresses(pages: DataFrame, site: str = "domain", most_docs: int = 3, most_pages: int = 5) -> DataFrame:
    """site, email, doc: addresses at the domain in the first documents that its site links, each one's first pages read,
    of the first document that has any.  pages: site, domain, doc (from 0, in link order), page (from 0), text."""
    return _linked_addresses(pages, site, most_docs, most_pages).select(site, "email", "doc").distinct()


def search_address(hits: DataFrame, first_hits: int = 5) -> DataFrame:
    """person, email: of each of the first hits, the first address at the domain; the first of these that is no role's."""
    found = F.lower(F.get(plain_at(F.concat_ws(" ", "snippet", "title", "link"), F.col("domain")), F.lit(0)))
    h = hits.where(F.col("pos") < first_hits).withColumn("email", found).where(F.col("email").isNotNull() & ~is_generic(F.col("email")))
    return first_wins(h.select("person", "pos", "email"), ["person"], ["pos"]).select("person", "email")


def organic(rows: DataFrame, key: list[str], url: str, title: str, order: list[str]) -> DataFrame:
    """Results once per URL without query and last slash; short titles and junk ones go."""
    k = F.rtrim(F.regexp_replace(text(F.col(url)), r"[?#].*$", ""), F.lit("/"))
    good = rows.withColumn("url_key", k).where((F.length(F.trim(F.col(title))) >= 3) & ~contains_any(F.col(title), dims.JUNK_TITLES))
    return first_wins(good, [*key, "url_key"], order)
