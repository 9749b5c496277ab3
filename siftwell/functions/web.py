"""Columns over URLs, hosts, titles and page markup.

All are built-in expressions over whole columns; lists are parameters.  NULL and '' count alike for text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lit_array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: lists up to this length are sought value by value in one lower-cased text, longer ones by one pattern in one pass
FEW = 16


def alternation(values: list[str]) -> str:
    """A pattern of literal values by their shared beginnings; at a place it takes the longest.  Where many characters may come
    next, they stand in groups behind a look at the group's characters, as the ways of a pattern are tried one after another."""
    trie: dict = {}
    for v in values:
        node = trie
        for ch in v:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [re.escape(ch) + pattern(below) for ch, below in node.items() if ch]
        if not ways:
            return ""
        if len(ways) > 6:
            size = math.isqrt(len(ways)) + 1
            first = [re.escape(ch) for ch in node if ch]
            ways = [f"(?=[{''.join(first[i : i + size])}])(?:{'|'.join(ways[i : i + size])})" for i in range(0, len(ways), size)]
        one = ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
        return one + "?" if "" in node else one

    return pattern(trie)


def _with_beginnings(found: Column, values: list[str], ends: Callable[[str, str], bool]) -> Column:
    """found and the other values that begin one of them: where the longest value stands, so do they."""
    inner = {v: [w for w in values if w != v and v.startswith(w) and ends(v, w)] for v in values}
    table = {v: w for v, w in inner.items() if w}
    if not table:
        return found
    pairs = F.create_map(*[x for v, w in table.items() for x in (F.lit(v), lit_array([v, *w]))])
    return F.flatten(F.transform(found, lambda v: F.coalesce(F.try_element_at(pairs, v), F.array(v))))


def any_in(low: Column, values: list[str]) -> Column:
    """Some value is a substring of a lower-cased text."""
    if not values:
        return F.lit(False)
    if len(values) > FEW:
        return F.rlike(low, F.lit(alternation(values)))
    one = [F.contains(low, F.lit(v)) for v in values]
    return F.greatest(*one) if len(one) > 1 else one[0]  # all are taken, so that Spark lower-cases once


def hits_in(low: Column, values: list[str]) -> Column:
    """The values that are substrings of a lower-cased text, in list order; overlapping ones each count."""
    if len(values) <= FEW:
        return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(v)), F.lit(v)) for v in values])) if values else lit_array([])
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?=({alternation(values)}))"), F.lit(1)))
    return F.array_intersect(lit_array(values), _with_beginnings(found, values, lambda v, w: True))


def tokens_in(low: Column, needles: list[str]) -> Column:
    """The needles that a lower-cased text holds, in list order: phrases as substrings, single words only where no letter
    or digit touches them.  All words are sought in one pass."""
    words, phrases = [n for n in needles if " " not in n], [n for n in needles if " " in n]
    found = hits_in(low, phrases)
    if words:
        held = F.array_distinct(F.regexp_extract_all(low, F.lit(rf"(?<![a-z0-9])(?=({alternation(words)})(?![a-z0-9]))"), F.lit(1)))
        held = _with_beginnings(held, words, lambda v, w: not re.match("[a-z0-9]", v[len(w)]))
        found = F.concat(held, found) if phrases else held
    return F.array_intersect(lit_array(needles), found) if needles else lit_array([])


def any_token_in(low: Column, needles: list[str]) -> Column:
    words, phrases = [n for n in needles if " " not in n], [n for n in needles if " " in n]
    parts = ([rf"(?<![a-z0-9])(?:{alternation(words)})(?![a-z0-9])"] if words else []) + ([alternation(phrases)] if phrases else [])
    return F.rlike(low, F.lit("|".join(parts))) if parts else F.lit(False)


def contains_any(c: Column, values: list[str]) -> Column:
    """Some value is a substring of c, lower-cased."""
    return any_in(F.lower(text(c)), values)


def hits(c: Column, values: list[str]) -> Column:
    """The values that are substrings of c, lower-cased, in list order; overlapping ones each count."""
    return hits_in(F.lower(text(c)), values)


def domain_of(url: Column) -> Column:
    """Host of a URL or e-mail address: what follows the last @ if there is one, else the network part without
    any 'www.', lower-cased last (an upper-case WWW. stays).  Ports stay."""
    u = F.trim(text(url))
    host = F.replace(F.regexp_extract(u, r"^(?:[^:/?#]+://)?([^/?#]*)", 1), F.lit("www."), F.lit(""))
    return F.when(F.contains(u, F.lit("@")), F.lower(F.substring_index(u, "@", -1))).otherwise(F.lower(host))


def suffixes(host: Column) -> Column:
    """Dot suffixes of a host, longest first: a.b.c gives .b.c and .c; none for a bare label."""
    p = F.split(host, r"\.")
    return F.when(F.size(p) >= 2, F.transform(F.sequence(F.lit(2), F.size(p)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(p, i, F.size(p)), ".")))).otherwise(F.array().cast("array<string>"))


def equal_or_below(host: Column, suffix_list: list[str]) -> Column:
    """host equals a listed domain or lies below one."""
    return F.arrays_overlap(F.array_append(suffixes(host), F.concat(F.lit("."), host)), lit_array(["." + s for s in suffix_list]))


def country_of(host: Column, tld_country: dict[str, str]) -> Column:
    """Country of the longest listed TLD, '' if none."""
    table = F.create_map(*[x for k, v in tld_country.items() for x in (F.lit(k), F.lit(v))])
    found = F.filter(F.transform(suffixes(host), lambda s: F.try_element_at(table, s)), lambda v: v.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def foreign_tld(host: Column, country: Column, tld_country: dict[str, str]) -> Column:
    """The longest listed TLD if its country is not the selected one; '' otherwise or with no selection."""
    table = F.create_map(*[x for k, v in tld_country.items() for x in (F.lit(k), F.lit(v))])
    tld = F.get(F.filter(suffixes(host), lambda s: F.map_contains_key(table, s)), F.lit(0))
    open_ = text(country).isin("", "All Countries")
    return F.when(~open_ & tld.isNotNull() & (F.try_element_at(table, tld) != country), tld).otherwise("")


def is_blocked(url: Column, *, social: list[str], junk_subdomains: list[str], junk_names: list[str], blocked: list[str], translate: str = "translate.google") -> Column:
    """Hosts that are never a lead: none, translators of any country, IPv4, social, state and schools, junk subdomains and names, block-listed."""
    d = domain_of(url)
    p = F.split(d, r"\.")
    last, second = F.element_at(p, -1), F.when(F.size(p) >= 3, F.element_at(p, -2))
    starts = F.lit(False)
    for s in junk_subdomains:
        starts = starts | F.startswith(d, F.lit(s))
    return (
        (d == "") | (d == translate) | F.startswith(d, F.lit(translate + ".")) | F.rlike(d, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")) | equal_or_below(d, social)
        | last.isin("mil", "gov", "edu") | F.coalesce(second.isin("gov", "edu"), F.lit(False)) | starts | contains_any(F.get(p, F.lit(0)), junk_names) | equal_or_below(d, blocked)
    )


def without(html: Column, drop: list[str]) -> Column:
    """Markup without the listed elements."""
    for t in drop:
        html = F.regexp_replace(html, rf"(?is)<{t}[^>]*>.*?</{t}>", " ")
    return html


NOT_SHOWN = ["script", "style", "noscript"]


#: the description's attribute and its value, in either order
_NAMED, _VALUED = r"name=[\"']description[\"']", r"content=[\"']([^\"']+)"


def _shown_text(x: Column, limit: int | None) -> Column:
    """Title, description and visible text of markup without the listed elements, joined by a space."""
    body = F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " "))
    body = F.substring(body, 1, limit) if limit else body
    found = lambda pattern: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))
    title = F.get(F.transform(F.slice(F.regexp_extract_all(x, F.lit(r"(?is)<title[^>]*>(.*?)</title>"), F.lit(1)), 1, 1), lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), F.lit(0))
    about = F.trim(F.coalesce(found(rf"(?i)<meta[^>]+{_NAMED}[^>]+{_VALUED}"), found(rf"(?i)<meta[^>]+{_VALUED}[\"'][^>]+{_NAMED}")))
    return F.concat_ws(" ", title, about, body)


def html_to_text(html: Column, drop: list[str] = NOT_SHOWN, limit: int | None = 12_000, least: int = 80) -> Column:
    """Visible text of a page: listed elements and tags go, white space runs become one space, the title and
    the description (its attributes in either order) come first, joined by a space; NULL under `least` characters.
    The limit is the feature's own.  Over a table, with_page takes the markup apart once instead of once a use."""
    whole = _shown_text(without(text(html), drop), limit)
    return F.when(F.length(whole) >= least, whole)


def _links(shown: Column, limit: int) -> Column:
    found = F.regexp_extract_all(shown, F.lit(r"href=[\"']([^\"'#\s]+)[\"']"), F.lit(1))
    keep = F.filter(found, lambda u: F.startswith(u, F.lit("http")) | (F.startswith(u, F.lit("/")) & ~F.startswith(u, F.lit("//"))))
    return F.slice(keep, 1, limit)


def links_of(html: Column, limit: int = 300, drop: list[str] = NOT_SHOWN) -> Column:
    """href values outside the dropped elements: absolute ones and those from the root, in order."""
    return _links(without(text(html), drop), limit)


def with_page(df: DataFrame, html: str, body: str | None = "body", links: str | None = "links", drop: list[str] = NOT_SHOWN, limit: int | None = 12_000, least: int = 80, most_links: int = 300) -> DataFrame:
    """df with the page's text (see html_to_text) and links (see links_of).  Each step is a projection of its own that later ones
    use more than once, so Spark keeps it apart: the markup is cleaned once."""
    out = df.withColumn("_shown", without(text(F.col(html)), drop))
    if body:
        out = out.withColumn("_whole", _shown_text(F.col("_shown"), limit)).withColumn(body, F.when(F.length("_whole") >= least, F.col("_whole"))).drop("_whole")
    if links:
        out = out.withColumn(links, _links(F.col("_shown"), most_links))
    return out.drop("_shown")


def any_link_has(links: Column, hints: list[str]) -> Column:
    def one(u: Column) -> Column:
        out = F.lit(False)
        for h in hints:
            out = out | F.contains(F.lower(u), F.lit(h))
        return out

    return F.coalesce(F.exists(links, one), F.lit(False))


def absolute(link: Column, host: Column) -> Column:
    """A link of a host's page as a URL."""
    return (
        F.when(F.rlike(link, F.lit("(?i)^https?://")), link).when(F.startswith(link, F.lit("//")), F.concat(F.lit("https:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(F.lit("https://"), host, link)).otherwise(F.concat(F.lit("https://"), host, F.lit("/"), link))
    )


def link_host(url: Column) -> Column:
    """Host of an absolute URL, lower-cased, without a first www. and without port."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://([^/]*)", 1))
    return F.substring_index(F.regexp_replace(host, r"^www\.", ""), ":", 1)


def within(url: Column, host: Column) -> Column:
    h = link_host(url)
    return (h == host) | F.endswith(h, F.concat(F.lit("."), host))


def is_page_link(link: Column) -> Column:
    return (link != "") & ~F.rlike(link, F.lit(r"^(#|mailto:|tel:|javascript:)"))


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(text(host)), r"^www\.", "")


def internal_pages(links: Column, host: Column, assets: list[str]) -> Column:
    """Number of different internal paths, the root included; ports, fragments, queries, case and last slashes fold."""
    bare = bare_host(host)
    inside = F.filter(F.transform(F.filter(links, is_page_link), lambda u: absolute(F.trim(u), bare)), lambda u: within(u, bare))
    path = F.transform(inside, lambda u: F.lower(F.regexp_replace(F.regexp_extract(u, r"(?i)^https?://[^/]*(/.*)?$", 1), r"[?#].*$", "")))
    path = F.filter(path, lambda p: ~F.exists(lit_array(assets), lambda a: F.endswith(p, a)))
    path = F.transform(path, lambda p: F.coalesce(F.nullif(F.rtrim(p, F.lit("/")), F.lit("")), F.lit("/")))
    return F.size(F.array_distinct(F.concat(F.array(F.lit("/")), path)))


def high_value_urls(links: Column, host: Column, hints: list[str], limit: int = 3) -> Column:
    """array of struct(score, url): the host's own pages by the place of the first hint in their path (100 less it), first
    of each path, without query and fragment; ties in page order."""
    bare = bare_host(host)

    def one(u: Column, at: Column) -> Column:
        full = absolute(u, bare)
        path = F.lower(F.regexp_extract(full, r"(?i)^https?://[^/?#]*([^?#]*)", 1))
        return F.struct((-high_value_rank(path, hints)).alias("order"), at.alias("at"), F.rtrim(path, F.lit("/")).alias("key"), F.regexp_replace(full, r"[?#].*$", "").alias("url"), within(full, bare).alias("inside"))

    own = F.filter(F.transform(F.filter(links, is_page_link), one), lambda x: x["inside"] & (x["key"] != ""))
    keys = F.transform(own, lambda x: x["key"])
    firsts = F.filter(own, lambda x, i: (F.array_position(keys, x["key"]) == i + 1) & x["order"].isNotNull())
    return F.transform(F.slice(F.array_sort(firsts), 1, limit), lambda x: F.struct((-x["order"]).alias("score"), x["url"].alias("url")))


def profile_url(links: Column, body: Column, mark: str = "linkedin.com/company/") -> Column:
    """First link with the company profile path, cut at '?' and without last slashes; else the first in the text."""
    link = F.get(F.filter(links, lambda u: F.contains(u, F.lit(mark))), F.lit(0))
    in_text = F.regexp_extract(text(body), rf"https?://(?:www\.)?{re.escape(mark)}[^\s\)\]\"'<>]+", 0)
    return F.rtrim(F.coalesce(F.substring_index(link, "?", 1), in_text), F.lit("/"))


def is_seo_title(name: Column, seo_words: list[str]) -> Column:
    words = F.array_distinct(F.split(F.lower(F.trim(text(name))), r"\s+"))
    return (F.size(words) > 5) | (F.size(F.array_intersect(words, lit_array(seo_words))) >= 2)


def company_name(profile: Column, body: Column, title: Column, seo_words: list[str]) -> Column:
    """Title-cased profile slug with a hyphen, else the first '# ' heading, unless these read like a slogan; else
    the first part of the result's title."""
    slug = F.regexp_extract(text(profile), r"/company/([A-Za-z0-9_%-]+)", 1)
    named = F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))
    heading = F.trim(F.regexp_extract(text(body), r"(?m)^# +(.+)$", 1))
    return F.coalesce(
        F.when(F.contains(slug, F.lit("-")) & ~is_seo_title(named, seo_words), named),
        F.when((heading != "") & ~is_seo_title(heading, seo_words), heading),
        F.trim(F.get(F.split(text(title), r"[|\-–]"), F.lit(0))),
    )


def company_slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(text(name)), "[^a-z0-9]", "")


def high_value_rank(url: Column, hints: list[str]) -> Column:
    """100 less the place of the first hint in a lower-cased path; NULL if none."""
    out = F.when(F.lit(False), F.lit(0))
    for i, h in enumerate(hints):
        out = out.when(F.contains(url, F.lit(h)), F.lit(100 - i))
    return out
