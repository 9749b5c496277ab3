"""Queries over URLs, page text, links, screens, gates and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell import dims
from siftwell.functions import gates, web
from siftwell.operators import qualify, suffixes
from siftwell.operators.dedupe import first_n, first_wins
from siftwell.operators.known import without_known
from siftwell.plans.base import (
    GEO, HITS, JUNK, KEYWORDS, LISTS, MARKET, STRONG, TLDS, hits, query, sql_absolute, sql_any, sql_any_token, sql_below, sql_blocked, sql_body, sql_country, sql_domain, sql_foreign, sql_hits, sql_links, sql_list, sql_merged, sql_tld, sql_token, sql_within, scratch_folder, table,
)

H = "domain"
WITH_PAGES = f"with p as (select *, {sql_domain('url')} as domain, {sql_body('html')} as body, {sql_links('html')} as links from pages)"
WITH_HITS = f"with {HITS}, h as (select *, {sql_domain('link')} as domain from hits)"


def pages(spark, sf):
    return web.with_page(table(spark, sf, "pages").withColumn("domain", web.domain_of(F.col("url"))), "html", limit=None)


def with_domain(spark, sf):
    return hits(spark, sf).withColumn("domain", web.domain_of(F.col("link")))


@query("b01_domain_of", f"select page_id, {sql_domain('url')} as domain, {sql_domain("url || '/@Name'")} as handle, {sql_domain("replace(url, '://', '://WWW.')")} as upper from pages")
def _(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", web.domain_of(u).alias("domain"), web.domain_of(F.concat(u, F.lit("/@Name"))).alias("handle"), web.domain_of(F.replace(u, F.lit("://"), F.lit("://WWW."))).alias("upper"))


@query("b02_is_blocked", f"with p as (select page_id, {sql_domain('url')} as domain from pages) select page_id, domain, {sql_blocked(H)} as blocked from p")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.domain_of(F.col("url")).alias("domain"), MARKET.blocks(F.col("url")).alias("blocked"))


@query("b03_country_of_domain", f"with p as (select page_id, {sql_domain('url')} as domain from pages) select page_id, {sql_country(H)} as country from p")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.country_of(web.domain_of(F.col("url")), TLDS).alias("country"))


@query("b04_foreign_cctld", f"with p as (select page_id, {sql_domain('url')} as domain from pages) select page_id, {sql_foreign(H, 'Alpha')} as tld from p")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.foreign_tld(web.domain_of(F.col("url")), F.lit("Alpha"), TLDS).alias("tld"))


@query("b05_is_relevant", f"select doc_id, {sql_any('text', KEYWORDS)} as relevant from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", web.contains_any(F.col("text"), KEYWORDS).alias("relevant"))


@query("b06_is_industry_match", f"with {HITS} select pos, not {sql_any('title', JUNK)} and {sql_any("title || ' ' || snippet", KEYWORDS)} as matches, true as unlisted from hits")
def _(spark, sf):
    t, s = F.col("title"), F.col("snippet")
    return hits(spark, sf).select("pos", gates.industry_match(t, s, "Words", {"words": KEYWORDS}, JUNK).alias("matches"), gates.industry_match(t, s, "none").alias("unlisted"))


@query("b07_keywords_of_slug", f"select doc_id, len({sql_hits('text', dims.INDUSTRY_KEYWORDS['software'])})::int as listed, len({sql_hits('text', dims.RELEVANCE_KEYWORDS)})::int as others from documents")
def _(spark, sf):
    n = lambda slug: F.size(web.hits(F.col("text"), dims.industry_keywords(slug)))
    return table(spark, sf, "documents").select("doc_id", n(" Software ").alias("listed"), n("no such industry").alias("others"))


@query("b07_keyword_hits", f"select doc_id, array_to_string({sql_hits('text', KEYWORDS)}, ',') as found, len({sql_hits('text', KEYWORDS)})::int as n from documents")
def _(spark, sf):
    h = web.hits(F.col("text"), KEYWORDS)
    return table(spark, sf, "documents").select("doc_id", F.array_join(h, ",").alias("found"), F.size(h).alias("n"))


@query("b08_strong_terms", f"with w as (select doc_id, unnest({sql_hits('text', KEYWORDS)}) as term from documents) select term, count(*) as docs, bool_or(term in ('und', 'tion', 'heit', 'que') and term not in ('que')) as strong from w group by 1")
def _(spark, sf):
    terms = [(k, dims.is_strong(k, ["und", "tion", "heit", "que"], ["que"]) and k in STRONG) for k in KEYWORDS]
    dim = spark.createDataFrame(terms, "term string, strong boolean")
    found = table(spark, sf, "documents").select(F.explode(web.hits(F.col("text"), KEYWORDS)).alias("term"))
    return found.join(dim, "term").groupBy("term").agg(F.count("*").alias("docs"), F.max("strong").alias("strong"))


@query("b09_token_in_text", f"select doc_id, {sql_token('lower(text)', 'thon')} as word, {sql_token('lower(text)', 'the thon')} as phrase from documents")
def _(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "documents").select("doc_id", gates.token_in(low, "thon").alias("word"), gates.token_in(low, "the thon").alias("phrase"))


@query("b10_has_local_phone", r"select doc_id, regexp_matches(lower(text), '(^|[^0-9])(\+|00)\s*1[\s\-./()]*(\d[\s\-./()]*){7,}') as phone from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", gates.has_local_phone(F.col("text"), "+1").alias("phone"))


@query("b11_has_bare_phone_code", f"select doc_id, {sql_any('text', ['+1', '001', '(1)', '( 1 )', '+ 1'])} as code from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", gates.has_bare_code(F.col("text"), "+1").alias("code"))


@query("b12_html_to_text", f"select page_id, {sql_body('html')} as body from pages")
def _(spark, sf):
    return web.with_page(table(spark, sf, "pages"), "html", links=None, limit=None).select("page_id", "body")


@query("b13_extract_links", f"select page_id, array_to_string({sql_links('html')}, ' ') as links from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(web.links_of(F.col("html")), " ").alias("links"))


_IN = f"list_filter(list_transform(list_filter(links, lambda u: not regexp_matches(u, '^(#|mailto:|tel:|javascript:)')), lambda u: {sql_absolute('u', 'domain')}), lambda u: {sql_within('u', 'domain')})"
_PATH = "lower(regexp_replace(regexp_extract(u, '(?i)^https?://[^/]*(/.*)?$', 1), '[?#].*$', ''))"
_ASSETS = "|".join(x[1:] for x in dims.ASSET_EXTENSIONS)
_PATHS = f"list_distinct(list_append(list_transform(list_filter(list_transform({_IN}, lambda u: {_PATH}), lambda p: not regexp_matches(p, '\\.({_ASSETS})$')), lambda p: coalesce(nullif(rtrim(p, '/'), ''), '/')), '/'))"


@query("b14_count_internal_pages", f"{WITH_PAGES} select page_id, len({_PATHS})::int as n from p")
def _(spark, sf):
    return pages(spark, sf).select("page_id", web.internal_pages(F.col("links"), F.col("domain"), dims.ASSET_EXTENSIONS).alias("n"))


_HINTS = ["/the", "/and", "/of", "/die", "/le"]


@query("b15_high_value_urls", f"""{WITH_PAGES}, u as (select page_id, domain, unnest({_IN}) as link, unnest(range(1, len({_IN}) + 1)) as pos from p),
k as (select *, lower(regexp_extract(link, '(?i)^https?://[^/?#]*([^?#]*)', 1)) as path from u), d as (select page_id, rtrim(path, '/') as key, arg_min(path, pos) as path, arg_min(regexp_replace(link, '[?#].*$', ''), pos) as url, min(pos) as pos from k group by 1, 2),
r as (select *, 100 - (list_position(list_transform({sql_list(_HINTS)}, lambda h: contains(path, h)), true) - 1) as score from d where key <> '' and {sql_any('path', _HINTS)}),
o as (select *, row_number() over (partition by page_id order by score desc, pos) as rank from r)
select page_id, url, score::int as score, rank::int as rank from o where rank <= 3""")
def _(spark, sf):
    u = pages(spark, sf).select("page_id", F.posexplode(web.high_value_urls(F.col("links"), F.col("domain"), _HINTS)).alias("at", "u"))
    return u.select("page_id", "u.url", "u.score", (F.col("at") + 1).alias("rank"))


@query("b16_merge_site_data", f"""{WITH_PAGES}, t as (select domain, string_agg(body, chr(10) || chr(10) order by page_id) as body, flatten(list(links order by page_id)) as links from p where body is not null group by 1)
select domain, substr(body, 1, 24000) as body, least(len(list_distinct(links)), 500)::int as n_links from t""")
def _(spark, sf):
    return qualify.merge_pages(pages(spark, sf).where("body is not null"), ["domain"], ["page_id"]).select("domain", "body", F.size("links").alias("n_links"))


@query("b17_profile_url", f"{WITH_PAGES} select page_id, rtrim(string_split(list_filter(links, lambda u: contains(u, '/the'))[1], '?')[1], '/') as profile from p")
def _(spark, sf):
    return pages(spark, sf).select("page_id", F.nullif(web.profile_url(F.col("links"), F.lit(""), "/the"), F.lit("")).alias("profile"))


_TITLE = "regexp_extract(html, '<title[^>]*>(.*?)</title>', 1)"


def page_title(spark, sf):
    return table(spark, sf, "pages").withColumn("title", F.regexp_extract("html", r"<title[^>]*>(.*?)</title>", 1))


@query("b18_is_seo_title", f"select page_id, len(list_distinct(regexp_split_to_array(lower(trim({_TITLE})), '\\s+'))) > 5 or len(list_intersect(list_distinct(regexp_split_to_array(lower(trim({_TITLE})), '\\s+')), ['the', 'of', 'and', 'le', 'de'])) >= 2 as seo from pages")
def _(spark, sf):
    return page_title(spark, sf).select("page_id", web.is_seo_title(F.col("title"), ["the", "of", "and", "le", "de"]).alias("seo"))


@query("b19_company_name", f"select page_id, trim(regexp_split_to_array({_TITLE}, '[|\\-–]')[1]) as name from pages")
def _(spark, sf):
    return page_title(spark, sf).select("page_id", web.company_name(F.lit(""), F.lit(""), F.col("title"), dims.SEO_WORDS).alias("name"))


@query("b20_company_slug", f"select page_id, regexp_replace(lower({_TITLE}), '[^a-z0-9]', '', 'g') as slug from pages")
def _(spark, sf):
    return page_title(spark, sf).select("page_id", web.company_slug(F.col("title")).alias("slug"))


@query("b38_tier_from_score", "select doc_id, (n_chars % 101)::int as score, case when n_chars % 101 >= 60 then 'strong' when n_chars % 101 >= 30 then 'possible' else 'weak' end as tier from documents")
def _(spark, sf):
    s = (F.col("n_chars") % 101).cast("int")
    return table(spark, sf, "documents").select("doc_id", s.alias("score"), gates.tier(s).alias("tier"))


@query("b39_check_budget", "with t as (select o_orderkey, (o_orderkey % 1500)::bigint as target from orders) select o_orderkey, target, (case when target <= 25 then greatest(3 * target, 60) when target <= 50 then 4 * target when target <= 100 then 5 * target else least(8000, 8 * target) end)::bigint as budget, least(150, greatest(15, ((target + 9) // 10) * 8))::bigint as pages, least(25, greatest(10, target // 8))::bigint as meta_pages from t")
def _(spark, sf):
    t = F.col("o_orderkey") % 1500
    return table(spark, sf, "orders").select("o_orderkey", t.alias("target"), gates.check_budget(t).cast("long").alias("budget"), gates.max_pages(t).cast("long").alias("pages"), gates.meta_pages(t).cast("long").alias("meta_pages"))


@query("b41_reasons_json", f"select doc_id, to_json({sql_hits('text', KEYWORDS)})::varchar as reasons, len({sql_hits('text', KEYWORDS)})::int as n from documents")
def _(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", F.to_json(web.hits(F.col("text"), KEYWORDS)).alias("reasons"))
    return j.withColumn("n", F.size(F.from_json("reasons", "array<string>")))


_KNOWN = f"known as (select distinct {sql_domain('url')} as domain from pages where url like '%#%')"
_STATE = f"((list_last(string_split(domain, '.')) in ('gov', 'edu', 'mil') or (len(string_split(domain, '.')) >= 3 and string_split(domain, '.')[-2] in ('gov', 'edu', 'mil'))) and not {sql_any("title || ' ' || snippet", ['translation', 'localization'])})"
_HYGIENE = f"when domain = '' then 'no_domain' when {sql_blocked(H)} then 'blocked' when dup then 'duplicate' when {sql_foreign(H, 'Alpha')} <> '' then 'foreign_cctld'"
_S = f"{WITH_HITS}, {_KNOWN}, s as (select h.*, k.domain is not null as dup from h left join known k using (domain))"


def screened(spark, sf):
    known = table(spark, sf, "pages").where(F.contains("url", F.lit("#"))).select(web.domain_of(F.col("url")).alias("k")).distinct()
    return with_domain(spark, sf).join(known, F.col("domain") == F.col("k"), "left").withColumn("dup", F.col("k").isNotNull())


@query("c01_loose_screen", f"{_S} select pos, case {_HYGIENE} when {sql_any('title', JUNK)} then 'junk_title' when {sql_any("title || ' ' || snippet", ['thlyth', 'enreä'])} or {_STATE} then 'serp_junk' end as reason from s")
def _(spark, sf):
    r = gates.loose_screen(F.col("domain"), F.col("title"), F.col("snippet"), MARKET.blocks(F.col("link")), F.col("dup"), F.lit("Alpha"), TLDS, JUNK, ["thlyth", "enreä"])
    return screened(spark, sf).select("pos", r.alias("reason"))


_BOTH = "title || ' ' || snippet"
_EVID = f"(len(list_intersect({sql_hits(_BOTH, KEYWORDS)}, {sql_list(STRONG)})) >= 2 or (len(list_intersect({sql_hits(_BOTH, KEYWORDS)}, {sql_list(STRONG)})) >= 1 and len({sql_hits(_BOTH, KEYWORDS)}) >= 3))"
_REL = f"(length(trim({_BOTH})) < 20 or {_EVID})"
_GEOOK = f"({sql_country(H)} = 'Alpha' or (case when length(trim(lower({_BOTH}))) < 20 then true else {sql_any_token(f'lower({_BOTH})', ['alpha', *GEO['Alpha'][1], *GEO['Alpha'][2]])} end))"


@query("c02_candidate_screen", f"{_S} select pos, case {_HYGIENE} when {sql_any('title', JUNK)} then 'junk_title' when {sql_any('title', LISTS)} then 'listicle' when not {_REL} then 'serp_irrelevant' when not {_GEOOK} then 'serp_geo_miss' end as reason from s")
def _(spark, sf):
    t, s, d = F.col("title"), F.col("snippet"), F.col("domain")
    rel = gates.summary_suggests_industry(t, s, KEYWORDS, STRONG)
    geo = gates.summary_suggests_country(t, s, d, "Alpha", TLDS, GEO)
    r = gates.candidate_screen(d, t, MARKET.blocks(F.col("link")), F.col("dup"), F.lit("Alpha"), TLDS, rel, geo, JUNK, LISTS)
    return screened(spark, sf).select("pos", r.alias("reason"))


@query("c03_hygiene_screen", f"{_S} select pos, case {_HYGIENE} end as reason from s")
def _(spark, sf):
    return screened(spark, sf).select("pos", gates.hygiene_screen(F.col("domain"), MARKET.blocks(F.col("link")), F.col("dup"), F.lit("Alpha"), TLDS).alias("reason"))


@query("c04_summary_suggests_industry", f"{WITH_HITS} select pos, {_REL} as ok from h")
def _(spark, sf):
    return with_domain(spark, sf).select("pos", gates.summary_suggests_industry(F.col("title"), F.col("snippet"), KEYWORDS, STRONG).alias("ok"))


@query("c05_summary_has_industry", f"{WITH_HITS} select pos, len(list_intersect({sql_hits(_BOTH, KEYWORDS)}, {sql_list(STRONG)})) >= 1 as ok from h")
def _(spark, sf):
    return with_domain(spark, sf).select("pos", gates.summary_has_industry(F.col("title"), F.col("snippet"), KEYWORDS, STRONG).alias("ok"))


@query("c06_summary_verified", f"{WITH_HITS} select pos, len(list_intersect({sql_hits(_BOTH, KEYWORDS)}, {sql_list(STRONG)})) >= 1 and {_GEOOK.replace('then true', 'then false')} as ok from h")
def _(spark, sf):
    t, s = F.col("title"), F.col("snippet")
    return with_domain(spark, sf).select("pos", (gates.summary_has_industry(t, s, KEYWORDS, STRONG) & gates.summary_suggests_country(t, s, F.col("domain"), "Alpha", TLDS, GEO, True)).alias("ok"))


@query("c07_industry_evidence_ok", f"select doc_id, {_EVID.replace(_BOTH, 'text')} as ok from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", gates.industry_evidence_ok(web.hits(F.col("text"), KEYWORDS), STRONG).alias("ok"))


_LOW = "lower(coalesce(body, ''))"
_CITY = "coalesce(" + ", ".join(f"case when {sql_token(_LOW, c)} then '{c}' end" for c in GEO["Alpha"][2]) + ")"
_HQ = "coalesce(" + ", ".join(f"case when contains({_LOW}, '{p}{a}') then '{a}' end" for a in GEO["Alpha"][1] for p in dims.HQ_PREFIXES) + ")"
_PHONE = rf"regexp_matches({_LOW}, '(^|[^0-9])(\+|00)\s*1[\s\-./()]*(\d[\s\-./()]*){{7,}}')"
_BARE = sql_any("body", ["+1", "001", "(1)", "( 1 )", "+ 1"])
_NAMED = sql_any_token(_LOW, ["alpha", *GEO["Alpha"][1]])
_TLD = sql_tld(H)


def sql_gated(rows: str) -> str:
    """rows (domain, body and more) with g: 'ok' or 'no' and the evidence, as gate."""
    quoted = lambda name: f"'{name} ''' || {'hq' if name[0] == 'H' else 'city'} || ''''"
    return f"""sig as (select *, {sql_country(H)} as home, {_TLD} as tld, {_HQ} as hq, {_CITY} as city, {_PHONE} as phone, {_BARE} as bare, {_NAMED} as named from {rows}),
 dec as (select *, hq is not null or (city is not null and (phone or named)) as fits from sig),
 evi as (select *, list_filter([{quoted('HQ phrase')}, {quoted('city')}, case when phone then 'phone +1 number' when bare then 'phone +1 code-only (ignored)' end, case when not fits and city is not null then 'city alone without country/HQ (ignored)' end, case when not fits and city is null and bare then 'need city or HQ (phone alone insufficient)' end], lambda x: x is not null) as found from dec),
 gate as (select * exclude (home, tld, hq, city, phone, bare, named, fits, found), case when home = 'Alpha' then ['ok', 'ccTLD ' || tld] when tld is not null then ['no', 'foreign ccTLD ' || tld || ' -> ' || home] else list_prepend(case when fits then 'ok' else 'no' end, case when len(found) > 0 then found else ['no local address / phone / city'] end) end as g from evi)"""


@query("c08_location_gate", f"with p as (select doc_id, 'host.example' as domain, text as body from documents), {sql_gated('p')} select doc_id, g[1] = 'ok' as ok, array_to_string(g[2:], ',') as evidence from gate")
def _(spark, sf):
    d = gates.with_location_gate(table(spark, sf, "documents").select("doc_id", "text"), "g", F.lit("host.example"), "text", "Alpha", TLDS, GEO)
    return d.select("doc_id", "g.ok", F.array_join("g.evidence", ",").alias("evidence"))


@query("c08_location_gate_pages", f"{WITH_PAGES}, {sql_gated('p')} select page_id, g[1] = 'ok' as ok, array_to_string(g[2:], ',') as evidence from gate")
def _(spark, sf):
    d = gates.with_location_gate(pages(spark, sf), "g", F.col("domain"), "body", "Alpha", TLDS, GEO)
    return d.select("page_id", "g.ok", F.array_join("g.evidence", ",").alias("evidence"))


@query("c09_summary_suggests_country", f"{WITH_HITS} select pos, {_GEOOK} as ok, {_GEOOK.replace('then true', 'then false')} as signal from h")
def _(spark, sf):
    t, s, d = F.col("title"), F.col("snippet"), F.col("domain")
    return with_domain(spark, sf).select("pos", gates.summary_suggests_country(t, s, d, "Alpha", TLDS, GEO).alias("ok"), gates.summary_suggests_country(t, s, d, "Alpha", TLDS, GEO, True).alias("signal"))


@query("c10_is_parked", f"select doc_id, length(trim(text)) < 100 or {sql_any('text', dims.PARKING_SIGNALS)} as parked from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", gates.is_parked(F.col("text")).alias("parked"))


_NOT_PARKED = f"not (length(trim(coalesce(body, ''))) < 100 or {sql_any('body', dims.PARKING_SIGNALS)})"


@query("c11_homepage_promising", f"{WITH_PAGES} select page_id, body is not null and {_NOT_PARKED} and ({sql_any('body', ['thor', *dims.POSITIVE_TERMS, *STRONG])} or len({_PATHS}) >= 3) as ok from p")
def _(spark, sf):
    n = web.internal_pages(F.col("links"), F.col("domain"), dims.ASSET_EXTENSIONS)
    return pages(spark, sf).select("page_id", gates.homepage_promising(F.col("body"), n, STRONG, ["thor"]).alias("ok"))


@query("c12_quality_site", f"{WITH_PAGES} select page_id, body is not null and {_NOT_PARKED} and len({_PATHS}) >= 4 and {sql_any('body', KEYWORDS)} and {sql_any('body', STRONG)} as ok from p")
def _(spark, sf):
    n = web.internal_pages(F.col("links"), F.col("domain"), dims.ASSET_EXTENSIONS)
    return pages(spark, sf).select("page_id", gates.quality_site(F.col("body"), n, STRONG, KEYWORDS).alias("ok"))


_DIR = f"({sql_below(H, MARKET.directories)} or case when {sql_any('title', dims.DIRECTORY_TITLES)} then {sql_any('title', dims.LIST_SIGNALS)} else {sql_any('title', dims.LIST_TITLES)} end)"


@query("c13_is_directory", f"{WITH_HITS} select pos, {_DIR} as directory from h")
def _(spark, sf):
    return with_domain(spark, sf).select("pos", gates.is_directory(F.col("domain"), F.col("title"), MARKET.directories).alias("directory"))


_BEVID = _EVID.replace(_BOTH, "coalesce(body, '')")
_GATED = f"{WITH_PAGES}, {sql_gated('p')}, g as (select *, {_BEVID} as ind, {sql_hits('body', KEYWORDS)} as found from gate)"
_PARKED = f"(length(trim(coalesce(body, ''))) < 100 or {sql_any('body', dims.PARKING_SIGNALS)})"
_GATE_STATUS = f"case when body is null then 'unreachable' when {_PARKED} then 'failed' when not ind or g[1] <> 'ok' then 'rejected' else 'qualified' end"
_REASON = f"case when body is null then 'timeout_or_empty' when {_PARKED} then 'parked_or_empty' when not ind then 'industry_fail' when g[1] <> 'ok' then 'geo_fail:' || array_to_string(g[2:], ',') end"


@query("c16_page_gate", f"{_GATED} select page_id, {_GATE_STATUS} as status, {_REASON} as reason from g")
def _(spark, sf):
    return qualify.page_gate(table(spark, sf, "pages"), MARKET).select("page_id", "status", "reason")


_CONTACT, _ABOUT = (f"(len(list_filter(links, lambda u: {sql_any('u', x)})) > 0)" for x in (dims.CONTACT_HINTS, dims.ABOUT_HINTS))
_RAW = f"least(50, 7 * len(found)) + case when {_CONTACT} then 20 else 0 end + case when {_ABOUT} then 10 else 0 end"
_SCORE = f"(case when len(found) = 0 then 0 when ind then {_RAW} else least(29, {_RAW}) end)"
_TIER = f"case when len(found) > 0 and ind then (case when {_SCORE} >= 60 then 'strong' when {_SCORE} >= 30 then 'possible' else 'weak' end) else 'weak' end"
_STATUS = f"case when body is null then 'unreachable' when {_PARKED} then 'failed' when not ind or g[1] <> 'ok' or {_TIER} = 'weak' then 'rejected' else 'qualified' end"
_SCORE_REASONS = f"list_filter([case when len(found) > 0 then len(found) || ' industry keywords' end, case when len(found) > 0 and {_CONTACT} then 'has contact page' end, case when len(found) > 0 and {_ABOUT} then 'has about/team page' end, case when len(found) > 0 and not ind then 'insufficient industry evidence' end, case when len(found) = 0 and body is not null then 'missing industry keywords' end], lambda x: x is not null)"


@query("d01_score_company", f"{_GATED} select page_id, {_SCORE}::int as score, {_TIER} as tier, array_to_string({_SCORE_REASONS}, ';') as reasons from g")
def _(spark, sf):
    return gates.with_score(pages(spark, sf), "s", "body", "links", F.lit(""), KEYWORDS, STRONG).select("page_id", "s.score", "s.tier", F.array_join("s.reasons", ";").alias("reasons"))


_EVENT_REASON = "case when status = 'failed' then reason when status = 'rejected' and starts_with(reason, 'geo_fail') then 'location_mismatch' when status = 'rejected' then 'industry_mismatch' end"
_TAGS = "case when status in ('qualified', 'rejected') then list_concat(why, ['pages:1', 'shallow_scrape'], case when status = 'qualified' then ['shallow_scrape_qualified', 'industry_evidence_ok', 'geo:' || array_to_string(g[2:], ',')] when starts_with(reason, 'geo_fail') then [reason] else [] end) else [reason] end"


@query("d02_qualify_page", f"""{_GATED}, s as (select page_id, domain, g, {_STATUS} as status, {_REASON} as reason, {_SCORE}::int as score, {_TIER} as tier, {_SCORE_REASONS} as why from g)
select page_id, domain, status, case when status = 'rejected' then 'unverified' else status end as event_status, {_EVENT_REASON} as event_reason, reason, array_to_string({_TAGS}, ';') as reasons,
  case when status in ('qualified', 'rejected') then score else 0 end as score, case when status in ('qualified', 'rejected') then tier else 'weak' end as tier from s""")
def _(spark, sf):
    q = qualify.qualify_pages(table(spark, sf, "pages"), MARKET)
    return q.select("page_id", "domain", "status", "event_status", "event_reason", "reason", F.array_join("reasons", ";").alias("reasons"), "score", "tier")


@query("d02_statuses", f"{_GATED}, s as (select {_STATUS} as status, {_REASON} as reason, {_TIER} as tier from g) select status, case when status in ('qualified', 'rejected') then tier else 'weak' end as tier, {_EVENT_REASON} as event_reason, count(*) as pages from s group by 1, 2, 3")
def _(spark, sf):
    """How many pages end in each status, the weak ones that pass both gates among the rejected."""
    p = qualify.qualify_pages(table(spark, sf, "pages"), MARKET)
    return p.groupBy("status", "tier", "event_reason").agg(F.count("*").alias("pages"))


@query("d03_classify_company", f"with p as (select page_id::varchar as domain, {sql_body('html')} as body from pages), v as (select doc_id::varchar as domain, case quality when 1 then 'lsp' else 'client' end as kind from labels) select p.domain, case when len({sql_hits('body', STRONG)}) >= 2 then 'lsp' when trim(coalesce(body, '')) = '' then 'client' else coalesce(kind, 'client') end as company_type, case when len({sql_hits('body', STRONG)}) >= 2 then 'keywords' when trim(coalesce(body, '')) = '' then 'default (no homepage text)' else 'external' end as method, len({sql_hits('body', STRONG)})::int as hits from p left join v using (domain)")
def _(spark, sf):
    p = web.with_page(table(spark, sf, "pages"), "html", links=None, limit=None).select(F.col("page_id").cast("string").alias("domain"), "body")
    v = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("domain"), F.when(F.col("quality") == 1, "lsp").otherwise("client").alias("company_type"))
    return qualify.classify_companies(p, v, keywords=STRONG)


_VER = f"(len(list_intersect({sql_hits(_BOTH, KEYWORDS)}, {sql_list(STRONG)})) >= 1 and {_GEOOK.replace('then true', 'then false')})"
_PRIO = f"(case when source = 'ai_overview' then 0 when source in ('local_pack', 'directory') then 1 when {_DIR} then 2 when {_VER} then 3 else 9 end)"


@query("d04_hit_priority", f"{WITH_HITS} select pos, {_PRIO}::int as priority from h")
def _(spark, sf):
    ver = gates.summary_has_industry(F.col("title"), F.col("snippet"), KEYWORDS, STRONG) & gates.summary_suggests_country(F.col("title"), F.col("snippet"), F.col("domain"), "Alpha", TLDS, GEO, True)
    return with_domain(spark, sf).select("pos", gates.hit_priority(F.col("source"), gates.is_directory(F.col("domain"), F.col("title"), MARKET.directories), ver).alias("priority"))


@query("f05_longest_suffix_join", f"with p as (select page_id, {sql_domain('url')} as domain from pages) select page_id, domain, {sql_country(H).replace('coalesce', '').replace(", '')", ')')} as country from p")
def _(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", web.domain_of(F.col("url")).alias("domain"))
    return suffixes.longest_suffix(rows, "domain", spark.createDataFrame(list(TLDS.items()), "tld string, country string"), "tld", "country", "country").select("page_id", "domain", "country")


_HOST_LIST = "select column1 as host from (values ('thst.example.com'), ('example.org'), ('ththth.example.net')) t(column1)"


@query("f05_listed_hosts", f"with p as (select page_id, {sql_domain('url')} as domain from pages) select page_id, {sql_below(H, ['thst.example.com', 'example.org', 'ththth.example.net'])} as listed from p")
def _(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", web.domain_of(F.col("url")).alias("domain"))
    dim = spark.createDataFrame([(h, h) for h in ("thst.example.com", "example.org", "ththth.example.net")], "host string, name string")
    return suffixes.longest_suffix(rows, "domain", dim, "host", "name", "hit", own_name=True).select("page_id", F.col("hit").isNotNull().alias("listed"))


@query("g01_first_page_per_host", f"with p as (select page_id, url, {sql_domain('url')} as domain from pages) select domain, arg_min(url, page_id) as url, min(page_id) as page_id from p group by 1")
def _(spark, sf):
    return first_wins(table(spark, sf, "pages").select("page_id", "url", web.domain_of(F.col("url")).alias("domain")), ["domain"], ["page_id"]).select("domain", "url", "page_id")


@query("flagship_qualify_pages", f"{_GATED}, s as (select *, {_STATUS} as status, {_SCORE}::int as score, {_REASON} as reason, row_number() over (partition by domain order by page_id) as rn from g) select domain, page_id, status, case when status in ('qualified', 'rejected') then score else 0 end as score, reason from s where rn = 1 and not {sql_blocked(H)}")
def flagship(spark, sf):
    """Which hosts qualify, with what score and why: the first page of every host that is not blocked."""
    p = table(spark, sf, "pages").where(~MARKET.blocks(F.col("url"))).withColumn("_host", web.domain_of(F.col("url")))
    first = first_wins(p, ["_host"], ["page_id"]).drop("_host")
    return qualify.qualify_pages(first, MARKET).select("domain", "page_id", "status", "score", "reason")


def sql_decided(place: str) -> str:
    """CTEs from h (domain, link, title, snippet, source, pos and what place names) and known (domain) to rows (domain, status, score,
    tier): what the first deciding hit says of each new domain; p (domain, html) has the pages."""
    return f"""s as (select h.*, false as dup from h where domain <> '' and domain not in (select domain from known)),
t as (select *, {_PRIO} as priority, case {_HYGIENE} end as hyg, case {_HYGIENE} when {sql_any('title', dims.JUNK_TITLES)} then 'junk_title' when {sql_any(_BOTH, dims.PURE_JUNK)} or {_STATE} then 'serp_junk' end as loose from s),
tr as (select *, case when priority in (0, 1, 3) then hyg else loose end as reason from t),
td as (select *, case when priority = 2 then null when reason is null then (case when priority = 9 then 'page' else 'vouched' end) when reason = 'blocked' then 'blocked' when reason = 'foreign_cctld' or (priority = 9 and reason in ('serp_junk', 'junk_title')) then 'failed' end as dec from tr),
pg as (select domain, {place} as place, min(priority) as least, arg_min({{'dec': dec, 'priority': priority}}, (priority, pos, link)) filter (where dec is not null) as d from td group by 1, 2),
o as (select domain, arg_min(d, place) as d from pg where d is not null and (d.priority < 9 or least = 9) group by 1),
q as (select o.domain, {sql_body('p.html')} as body, {sql_links('p.html')} as links from o left join p using (domain) where o.d.dec = 'page'),
{sql_gated('q')}, g as (select *, {_BEVID} as ind, {sql_hits('body', KEYWORDS)} as found from gate), r as (select domain, {_STATUS} as status, {_SCORE}::int as score, {_TIER} as tier from g),
rows as (select domain, 'qualified' as status, 70 as score, 'strong' as tier from o where d.dec = 'vouched' union all select domain, d.dec, 0, 'weak' from o where d.dec in ('failed', 'blocked') union all
select domain, status, case when status in ('qualified', 'rejected') then score else 0 end, case when status in ('qualified', 'rejected') then tier else 'weak' end from r)"""


_PAGES_BY_DOMAIN = f"p as (select domain, arg_min(html, url) as html from (select *, {sql_domain('url')} as domain from pages) group by 1)"


def known_domains(spark, sf):
    return table(spark, sf, "pages").where(F.contains("url", F.lit("#"))).select(web.domain_of(F.col("url")).alias("domain"))


def paged_hits(spark, sf):
    """Hits dealt over result pages of 20."""
    return hits(spark, sf).withColumn("page_no", F.floor(F.col("pos") / 20))


@query("o01_qualify_hits", f"{WITH_HITS}, {_KNOWN}, {_PAGES_BY_DOMAIN}, {sql_decided('pos // 20')} select * from rows")
def _(spark, sf):
    out = qualify.qualify_hits(paged_hits(spark, sf).drop("html"), table(spark, sf, "pages").select("url", "html"), known_domains(spark, sf), MARKET, ["page_no"], ["pos", "link"])
    return out.select("domain", "status", "score", "tier")


@query("k03_page_decisions", f"{WITH_HITS}, {_KNOWN}, {_PAGES_BY_DOMAIN}, {sql_decided('pos // 20')} select domain, d.dec as decision, d.priority::int as priority from o")
def _(spark, sf):
    """What decides on each new domain: the first result page that has a deciding hit, and its best hit there."""
    d = qualify.decide_hits(paged_hits(spark, sf).drop("html"), known_domains(spark, sf), MARKET, ["page_no"], ["pos", "link"])
    return d.select("domain", "decision", "priority")


@query("k01_k02_k03_harvest_batches", f"{WITH_HITS}, {_KNOWN}, {_PAGES_BY_DOMAIN}, {sql_decided('(pos // 20 % 2, pos // 20)')} select * from rows union all select domain, 'discovered', 0, 'weak' from known")
def _(spark, sf):
    """The table of domains after the known ones and two batches of hits, by buckets: qualified, rejected, failed and blocked."""
    from siftwell.streaming import harvest

    state = harvest.domains_table(spark, scratch_folder(spark, "domains"), buckets=16)
    known = known_domains(spark, sf).distinct().select("domain", F.lit("discovered").alias("status"), F.lit(0).alias("score"), F.lit("weak").alias("tier"), F.lit(None).cast("string").alias("reason"))
    state.merge(0, known, harvest.with_rows)
    h, read = paged_hits(spark, sf).drop("html"), table(spark, sf, "pages").select("url", "html")
    for number, batch in ((1, h.where("page_no % 2 = 0")), (2, h), (2, h)):  # a batch that comes again changes nothing
        harvest.apply_batch(batch, number, state, MARKET, read, ["page_no"], ["pos", "link"])
    return state.read().select("domain", "status", "score", "tier")


@query("f04_new_hits", f"{WITH_HITS}, {_KNOWN} select pos, domain from h where domain not in (select domain from known)")
def _(spark, sf):
    """Hits on hosts that are not known, behind the Bloom filter."""
    return without_known(with_domain(spark, sf).select("pos", "domain"), "domain", known_domains(spark, sf))


_OWN_HITS = HITS.replace("hits as", "hits1 as") + ", hits0 as (select * replace (link || '?p=' || pos as link) from hits1)"
_LISTED_HOST = "'https://' || lower(regexp_replace(split_part(h.title, ' ', n.n + 1), '[^A-Za-z]', '', 'g')) || '-x.example.biz/x'"
_MINED = f"""hp as (select *, {sql_domain('link')} as domain, run || '-' || (pos // 20) as page from hits0), dir as (select * from hp h where {_DIR}),
pan as (select h.pos as dir, (1000 + n.n)::bigint as pos, split_part(h.title, ' ', n.n + 1) as name, {_LISTED_HOST} as link, '' as snippet from dir h, (select unnest([0, 1, 2]) as n) n where length(split_part(h.title, ' ', n.n + 1)) between 2 and 100),
pn as (select dir, arg_min(name, pos) as name, min(pos) as pos, arg_min(link, pos) as link, '' as snippet from pan group by dir, lower(name)),
org as (select d.pos as dir, p.link, p.title, p.pos from dir d join hp p on d.page = p.page), {sql_merged('pn', 'org', 'dir', 'directory')}"""


def own_hits(spark, sf):
    """Hits with a URL of their own."""
    h = hits(spark, sf).withColumn("page", F.concat("run", F.lit("-"), F.floor(F.col("pos") / 20)))
    return h.withColumn("link", F.concat("link", F.lit("?p="), "pos"))


def directory_pages(h):
    """Pages at the hits' links that list three companies each, named after words of the hit's title."""
    word = lambda n: F.coalesce(F.get(F.split("title", " "), F.lit(n)), F.lit(""))
    one = lambda n: F.concat(F.lit('<a href="https://'), F.lower(F.regexp_replace(word(n), "[^A-Za-z]", "")), F.lit('-x.example.biz/x">'), word(n), F.lit("</a>"))
    return h.select(F.col("link").alias("url"), F.concat(one(0), one(1), one(2)).alias("html"))


@query("o01_mined_directories", f"with {_OWN_HITS}, {_MINED} select m.domain, m.link, m.title, m.source, d.page, d.pos from merged m join dir d on d.pos = m.dir")
def _(spark, sf):
    h = own_hits(spark, sf)
    out = qualify.mine_directories(h.drop("html"), directory_pages(h), MARKET, ["page"], listed=None)  # as in the SQL: documents as snippets are prose
    return out.select(web.domain_of(F.col("link")).alias("domain"), "link", "title", "source", "page", "pos")


_ANCHOR = " || ".join(f"""'<a href="https://' || lower(regexp_replace(split_part(title, ' ', {n}), '[^A-Za-z]', '', 'g')) || '-x.example.biz/x">' || split_part(title, ' ', {n}) || '</a>'""" for n in (1, 2, 3))


@query("o01_qualify_run", f"""with {_OWN_HITS}, {_MINED}, hits as (select pos, link, title, snippet, source, page, pos // 20 as page_no from hp union all select d.pos, m.link, m.title, m.snippet, m.source, d.page, d.pos // 20 from merged m join dir d on d.pos = m.dir),
h as (select *, {sql_domain('link')} as domain from hits), {_KNOWN}, pg0 as (select link as url, case when {_DIR} then {_ANCHOR} else html end as html from hp),
p as (select domain, arg_min(html, url) as html from (select *, {sql_domain('url')} as domain from pg0) group by 1), {sql_decided('(page_no, page)')}
select * from rows union all select domain, 'discovered', 0, 'weak' from known""")
def _(spark, sf):
    """The table of domains and the blocked hosts after a run."""
    h = own_hits(spark, sf).withColumn("page_no", F.floor(F.col("pos") / 20))
    lists = directory_pages(h).withColumnRenamed("html", "list")
    is_list = gates.is_directory(web.domain_of(F.col("link")), F.col("title"), MARKET.directories)
    read = h.join(lists.distinct(), h["link"] == lists["url"]).select("url", F.when(is_list, F.col("list")).otherwise(F.col("html")).alias("html"))
    state_now = known_domains(spark, sf).distinct().select("domain", F.lit("discovered").alias("status"), F.lit(0).alias("score"), F.lit("weak").alias("tier"))
    after, blocked = qualify.qualify_run(h.drop("html"), read, state_now, state_now.limit(0).select("domain"), MARKET, ["page"], ["page_no", "page"], listed=None)
    return after.unionByName(blocked.select("domain", F.lit("blocked").alias("status"), F.lit(0).alias("score"), F.lit("weak").alias("tier")))


@query("c17_qualify_verified", f"{WITH_HITS} select pos, domain, 'qualified' as status, 70 as score, 'strong' as tier, case source when 'local_pack' then 'local_pack_verified' else 'ai_overview_verified' end as reasons from h")
def _(spark, sf):
    h = with_domain(spark, sf)
    v = qualify.verified_rows(h.withColumn("domain", F.concat_ws("|", "pos", "domain")))
    return v.select(F.get(F.split("domain", r"\|"), F.lit(0)).cast("long").alias("pos"), F.get(F.split("domain", r"\|"), F.lit(1)).alias("domain"), "status", "score", "tier", F.array_join("reasons", ",").alias("reasons"))


@query("c18_qualify_verified_fast", f"{WITH_HITS} select pos, 75 as score, case when {_GEOOK.replace('then true', 'then false')} then 'geo_snippet_confirmed' end as tag from h where source <> 'web'")
def _(spark, sf):
    ok = gates.summary_suggests_country(F.col("title"), F.col("snippet"), F.col("domain"), "Alpha", TLDS, GEO, True)
    return with_domain(spark, sf).where("source <> 'web'").select("pos", F.lit(75).alias("score"), F.when(ok, "geo_snippet_confirmed").alias("tag"))
