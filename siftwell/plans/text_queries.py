"""Queries over names, addresses, extractors, result sources, runs and terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell import dims
from siftwell.functions import contacts, gates, web
from siftwell.operators import emails, extract, people, qualify, runs, terms
from siftwell.operators.dedupe import first_n, first_wins
from siftwell.operators.resume import SlicedRun
from siftwell.plans.base import HITS, MARKET, hits, query, scratch_folder, sql_absolute, sql_any, sql_blocked, sql_domain, sql_list, sql_merged, sql_resolved, table
from siftwell.sources import hits as sources
from siftwell.streaming import stops

# people named after parts, at hosts named after brands
PARTS = """parts as (select p_partkey as person, lower(replace(p_brand, '#', '')) || '.example.com' as domain, string_split(p_name, ' ')[1] as first_name, string_split(p_name, ' ')[2] as last_name, p_name, p_type, p_size from part)"""
NAMES = "names as (select doc_id, string_split(string_split(text, chr(10))[1], ' ')[1] as first_name, string_split(string_split(text, chr(10))[1], ' ')[2] as last_name, split_part(text, chr(10), 1) as line from documents)"
MAILS = r"mails as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')) as raw from documents)"


def parts(spark, sf):
    n = F.split("p_name", " ")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("person"), F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".example.com")).alias("domain"), F.get(n, F.lit(0)).alias("first_name"), F.get(n, F.lit(1)).alias("last_name"), "p_name", "p_type", "p_size"
    )


def names(spark, sf):
    line = F.get(F.split("text", "\n"), F.lit(0))
    w = F.split(line, " ")
    return table(spark, sf, "documents").select("doc_id", F.get(w, F.lit(0)).alias("first_name"), F.get(w, F.lit(1)).alias("last_name"), line.alias("line"))


def mails(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(extract.EMAIL), F.lit(0))).alias("raw"))


def _norm(c: str) -> str:
    low = f"lower(coalesce({c}, ''))"
    for a, b in contacts.LIGATURES:
        low = f"replace({low}, '{a}', '{b}')"
    return f"regexp_replace(lower(translate({low}, '{contacts.FOLD_FROM}', '{contacts.FOLD_TO}')), '[^a-z]', '', 'g')"


@query("b21_norm_name", f"with {NAMES} select doc_id, {_norm('line')} as name from names")
def _(spark, sf):
    return names(spark, sf).select("doc_id", contacts.norm_name(F.col("line")).alias("name"))


_W = r"list_filter(regexp_split_to_array(trim(line), '[ \t\n\r\f\v]+'), lambda w: w <> '')"


@query("b22_split_name", f"with {NAMES}, s as (select *, case when doc_id % 3 = 0 then '' else 'Ann ' end as f, case when doc_id % 2 = 0 then '' else 'Lee' end as l from names) select doc_id, case when trim(f) = '' and l = '' then coalesce({_W}[1], '') else trim(f) end as first_name, case when trim(f) = '' and l = '' then coalesce(case when len({_W}) > 1 then {_W}[-1] end, '') else l end as last_name from s")
def _(spark, sf):
    n = names(spark, sf).withColumns({"f": F.when(F.col("doc_id") % 3 != 0, "Ann "), "l": F.when(F.col("doc_id") % 2 == 0, "").otherwise("Lee")})
    stored = (F.col("line"), F.col("f"), F.col("l"))
    return n.select("doc_id", contacts.first_name(*stored).alias("first_name"), contacts.last_name(*stored).alias("last_name"))


@query("b23_full_name", f"with {PARTS} select person, first_name || ' ' || last_name as full_name from parts")
def _(spark, sf):
    return parts(spark, sf).select("person", F.concat("first_name", F.lit(" "), "last_name").alias("full_name"))


@query("b24_clean_email", f"with {MAILS} select doc_id, lower(trim(raw)) as email from mails")
def _(spark, sf):
    return mails(spark, sf).select("doc_id", contacts.clean_email(F.col("raw")).alias("email"))


_GEN = f"(len(list_filter({sql_list(dims.GENERIC_PREFIXES + ['hein', 'that'])}, lambda p: starts_with(string_split(lower(raw), '@')[1], p) and length(string_split(lower(raw), '@')[1]) <= length(p) + 3)) > 0)"


@query("b25_b26_b27_email_kinds", f"with {MAILS} select doc_id, raw, lower(string_split(raw, '@')[2]) in ('mail5.example.com', 'gmail.com') as personal, {_GEN} as generic, ends_with(lower(string_split(raw, '@')[2]), '.mil') as institutional from mails")
def _(spark, sf):
    c = F.col("raw")
    return mails(spark, sf).select("doc_id", "raw", contacts.is_personal(c, ["mail5.example.com", "gmail.com"]).alias("personal"), contacts.is_generic(c, dims.GENERIC_PREFIXES + ["hein", "that"]).alias("generic"), contacts.is_institutional(c).alias("institutional"))


@query("b28_search_names", f"with {PARTS}, v as (select person, p_name, p_name || (['', ', Inc.', ' Group', ' corporation', ' Holding'])[p_size % 5 + 1] || case when p_size % 7 = 0 then ' .com' else '' end as name, 'https://www.linkedin.com/company/' || replace(p_name, ' ', '_') || '-x/about?y' as url, replace(domain, 'brand', 'the-brand_') as domain, p_size from parts), l as (select person, list_filter([case when p_size % 7 <> 0 then p_name end, replace(p_name, ' ', ' ') || ' x', replace(replace(string_split(domain, '.')[1], '-', ' '), '_', ' '), domain], lambda s: s is not null) as l from v) select person, array_to_string(l, '|') as names from l")
def _(spark, sf):
    ending = F.element_at(F.array(*map(F.lit, ["", ", Inc.", " Group", " corporation", " Holding"])), (F.col("p_size") % 5 + 1).cast("int"))
    name = F.concat("p_name", ending, F.when(F.col("p_size") % 7 == 0, " .com").otherwise(""))
    url = F.concat(F.lit("https://www.linkedin.com/company/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-x/about?y"))
    s = contacts.search_names(name, url, F.replace("domain", F.lit("brand"), F.lit("the-brand_")))
    return parts(spark, sf).select("person", F.array_join(s, "|").alias("names"))


@query("b29_parse_profile_title", f"with {PARTS} select person, p_name as name, case when p_size % 4 = 3 then '' else lower(p_type) end as job from parts")
def _(spark, sf):
    job, at = F.lower("p_type"), F.concat(F.lit(" at "), "domain")
    forms = [F.concat(F.lit(" - "), job, at, F.lit(" | Profile")), F.concat(F.lit(" – "), job, F.lit(" – Acme | LinkedIn")), F.concat(F.lit(" - "), job, F.lit(" LinkedIn")), F.lit(" | LinkedIn")]
    p = contacts.profile_name(F.concat("p_name", F.element_at(F.array(*forms), (F.col("p_size") % 4 + 1).cast("int"))))
    return parts(spark, sf).select("person", p["name"].alias("name"), p["job"].alias("job"))


@query("b30_clean_name", f"with {PARTS} select person, p_name as name from parts")
def _(spark, sf):
    return parts(spark, sf).select("person", contacts.clean_name(F.concat("p_name", F.lit(" (she/her), PhD x"))).alias("name"))


@query("b31_is_former", "select doc_id, regexp_matches(text, '(?i)\\b(former|previously|ex-|past employee|alumni|alumna|retired|used to work)\\b') as former from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", contacts.is_former(F.col("text")).alias("former"))


@query("b32_is_valid_name", f"with {PARTS}, n as (select person, [upper(first_name[1]) || first_name[2:], upper(last_name[1]) || last_name[2:]] as w from parts) select person, len(list_intersect(list_transform(w, lambda x: lower(x)), ['red', 'ring'])) = 0 and not lower(w[2]) in ('gear') as ok from n")
def _(spark, sf):
    return parts(spark, sf).select("person", contacts.is_valid_name(F.initcap("p_name"), ["red", "ring"], ["gear"]).alias("ok"))


@query("b33_b34_titles", f"with {PARTS} select person, {sql_any('p_type', ['eco', 'promo'])} as matches, {sql_any('p_type', ['standard'])} as passes from parts")
def _(spark, sf):
    return parts(spark, sf).select("person", contacts.title_matches(F.col("p_type"), ["eco", "promo"]).alias("matches"), contacts.title_passes(F.col("p_type"), ["standard"]).alias("passes"))


_PATTERN = f"({sql_list(dims.EMAIL_PATTERNS)})[p_size % 11 + 1]"
_F, _L = _norm("first_name"), _norm("last_name")
_LOCAL = f"""case {_PATTERN} when 'first.last' then {_F} || '.' || {_L} when 'f.last' then {_F}[1] || '.' || {_L} when 'first.l' then {_F} || '.' || {_L}[1] when 'first_last' then {_F} || '_' || {_L} when 'firstlast' then {_F} || {_L}
 when 'flast' then {_F}[1] || {_L} when 'last.first' then {_L} || '.' || {_F} when 'lastfirst' then {_L} || {_F} when 'last_first' then {_L} || '_' || {_F} when 'last' then {_L} else {_F} end"""


def pattern_of():
    return F.element_at(F.array(*map(F.lit, dims.EMAIL_PATTERNS)), (F.col("p_size") % 11 + 1).cast("int"))


@query("b36_email_candidate", f"with {PARTS} select person, {_LOCAL} || '@' || domain as email from parts")
def _(spark, sf):
    return parts(spark, sf).select("person", contacts.email_candidate(F.col("first_name"), F.col("last_name"), F.col("domain"), pattern_of()).alias("email"))


@query("b37_token_pattern", f"select p_partkey, {_PATTERN} as pattern from part")
def _(spark, sf):
    tokens = F.element_at(F.array(*map(F.lit, dims.EMAIL_TOKENS)), (F.col("p_size") % 11 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", contacts.token_pattern(F.concat(F.lit("Format: "), tokens)).alias("pattern"))


@query("c14_confirmed_lead", "select o_orderkey, o_orderstatus = 'F' or (o_orderstatus = 'P' and o_orderkey % 2 = 0) as confirmed from orders")
def _(spark, sf):
    layer = F.when(F.col("o_orderstatus") == "F", "L1-Site").when(F.col("o_orderstatus") == "P", "L2-EFmt").otherwise("L3-Other")
    return table(spark, sf, "orders").select("o_orderkey", contacts.is_confirmed(F.lit("a@b.c"), layer, F.col("o_orderkey") % 2 == 0).alias("confirmed"))


@query("c15_generic_guard", f"with {MAILS} select doc_id, lower(raw) as email from mails where not {_GEN}")
def _(spark, sf):
    return mails(spark, sf).where(~contacts.is_generic(F.col("raw"), dims.GENERIC_PREFIXES + ["hein", "that"])).select("doc_id", F.lower("raw").alias("email"))


@query("d05_verifier_verdict", "select event_id, case when event_type = 'error' then null when event_type = 'view' then 'bad' when event_type = 'click' then 'risky' when floor(value)::bigint % 3 = 0 then 'good' when floor(value)::bigint % 3 = 1 then 'bad' else 'risky' end as verdict from events")
def _(spark, sf):
    code = F.when(F.floor("value") % 3 == 0, 250).when(F.floor("value") % 3 == 1, 551).otherwise(451)
    t = F.col("event_type")
    v = gates.verdict(code, t != "view", t == "click", F.when(t == "error", "nobody").otherwise("a@b.c"))
    return table(spark, sf, "events").select("event_id", v.alias("verdict"))


_X = "trim(replace(text, ', ', ' • '))"
_UN = lambda s: rf"trim(regexp_replace({s}, '\s+\d{{1,2}}\s*$', ''))"
_STRIPS = "' ·•|-–—;,' || chr(9)"


def sql_listed(x: str) -> str:
    """Items of numbered, then of bulleted lists of a text."""
    part = rf"list_filter(list_transform(string_split_regex({x}, '\d{{1,2}}[.)]\s*'), lambda s: trim(s, {_STRIPS})), lambda s: regexp_matches(s, '^[A-Za-z]'))"
    numbered = rf"list_filter(list_transform({part}, lambda s: {_UN("trim(string_split_regex(s, '[ ]{2,}|[' || chr(9) || '-' || chr(13) || ' ]{2,}|\\s+[·•]\\s+')[1])")}), lambda s: length(s) between 2 and 80)"
    called = r"(?i)^(?:list of|recommended|top\s+\d+)\s+[\w &/,\-]+?\s+in\s+[\w\s]+\s+"
    bare = f"trim(regexp_replace(trim(s, ' .-–—|'), '{called}', ''), ' .-–—|')"
    after = lambda b: f"case when contains({b}, ':') and length(string_split({b}, ':')[1]) < 40 then trim(regexp_extract({b}, '(?s)^[^:]*:(.*)$', 1)) else {b} end"
    item = rf"list_transform(list_transform(string_split_regex({x}, '\s*[·•●]\s*'), lambda s: {bare}), lambda b: {after('b')})"
    bulleted = f"list_filter({item}, lambda s: length(s) between 2 and 80 and regexp_matches(s, '^[A-Za-z]') and not regexp_matches(s, '{dims.CALL_TO_ACTION}'))"
    return rf"list_concat(case when regexp_matches({x}, '\d{{1,2}}[.)]\s*[A-Za-z]') then {numbered} else [] end, case when regexp_matches({x}, '[·•●]') then {bulleted} else [] end)"


def sql_listed_names(rows: str, key: str, x: str) -> str:
    return rf"""with i as (select {key}, {sql_listed(x)} as items from {rows}), u as (select {key}, unnest(items) as name, unnest(range(0, len(items))) as pos from i), c as (select {key}, pos::int as pos, {_UN("trim(regexp_replace(name, '\\s+', ' ', 'g'))")} as name from u),
v as (select * from c where length(name) >= 2 and not {sql_any('name', dims.LISTED_NAME_NOISE)}), f as (select {key}, arg_min(name, pos) as name, min(pos) as pos from v group by {key}, lower(name)), r as (select *, row_number() over (partition by {key} order by pos) as rn from f) select {key}, pos, name from r where rn <= 50"""


@query("e01_listed_names", sql_listed_names("documents", "doc_id", _X))
def e01(spark, sf):
    return extract.listed_names(table(spark, sf, "documents").withColumn("body", F.replace("text", F.lit(", "), F.lit(" • "))), "doc_id", "body")


_DIRECTORY = """pg as (select page_id, url, replace(regexp_replace(html, 'href="/([^"]+)"', 'href="https://\\1.example.biz"', 'g'), '<p>', '<p>7) ') as html from pages)"""
_A = """'(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>'"""
_BARE_NAME = r"trim(regexp_replace(trim(regexp_replace(name, '\s+', ' ', 'g')), '^\d+[.)]\s*', ''))"
_E02 = rf"""with {_DIRECTORY}, a as (select page_id, {sql_domain('url')} as self, unnest(regexp_extract_all(html, {_A}, 1)) as href, trim(regexp_replace(regexp_replace(unnest(regexp_extract_all(html, {_A}, 2)), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as label, unnest(range(0, len(regexp_extract_all(html, {_A}, 1)))) as pos from pg),
b as (select *, {sql_absolute('href', 'self')} as link from a where not regexp_matches(href, '^(#|mailto:|tel:|javascript:)')), c as (select *, {sql_domain('link')} as domain from b), d as (select *, regexp_matches(label, '{dims.CALL_TO_ACTION}') or label = '' as action, replace(string_split(domain, '.')[1], '-', ' ') as host from c where domain <> '' and domain <> self and not {sql_blocked('domain')}),
k as (select page_id, 0 as pass, pos, case when action then case when length(host) >= 3 then upper(host[1]) || host[2:] end when length(label) between 2 and 100 then label end as name, case when {sql_any('link', dims.SOCIAL_LINKS)} then '' else link end as link from d
 union all select page_id, 1, unnest(range(0, len(x))), unnest(x), '' from (select page_id, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', chr(10), 'g'), '(?:^|\n)\s*\d{{1,2}}[.)]\s+([A-Za-z][^\n]{{1,80}})', 1) as x from pg)),
v as (select page_id, pass, pos, {_BARE_NAME} as name, link from k), w as (select * from v where length(name) between 2 and 120 and not regexp_matches(name, '{dims.CALL_TO_ACTION}')),
f as (select page_id, min((pass, pos)) as place, arg_min(name, (pass, pos)) as name, arg_min(link, (pass, pos)) as link from w group by page_id, lower(name)), r as (select *, row_number() over (partition by page_id order by place) as rn from f) select page_id, (rn - 1)::int as pos, name, link from r where rn <= 50"""


@query("e02_directory_companies", _E02)
def e02(spark, sf):
    html = F.replace(F.regexp_replace("html", 'href="/([^"]+)"', 'href="https://$1.example.biz"'), F.lit("<p>"), F.lit("<p>7) "))
    return extract.directory_companies(table(spark, sf, "pages").withColumn("html", html), "page_id", "url", "html", MARKET.blocks)


@query("e03_scraped_companies", f"""with l as ({sql_listed_names("(select page_id, array_to_string(string_split(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1), ' ')[1:4], ' · ') as snippet from pages)", 'page_id', 'trim(snippet)')}), k as ({_E02}),
o as (select page_id, 'https://www.' || lower(regexp_replace(w[2], '[^A-Za-z]', '', 'g')) || '.example.co/x' as link, w[1] || ' ' || coalesce(w[3], '') as title, page_id % 3 as pos from (select page_id, string_split(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1), ' ') as w from pages)),
pan as (select page_id, pos, name, '' as link, '' as snippet from l union all select page_id, 1000 + pos, name, link, '' from k), {sql_merged('pan', 'o', 'page_id', 'directory')}, r as (select *, row_number() over (partition by page_id order by pos) as rn from merged) select page_id, domain, pos::int as pos, link, title, source from r where rn <= 50""")
def _(spark, sf):
    p = table(spark, sf, "pages").withColumn("w", F.split(F.regexp_extract("html", r"<title[^>]*>(.*?)</title>", 1), " "))
    listed = extract.listed_names(p.withColumn("snippet", F.array_join(F.slice("w", 1, 4), " · ")), "page_id", "snippet")
    word = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    organic = p.select("page_id", F.concat(F.lit("https://www."), F.lower(F.regexp_replace(F.get("w", F.lit(1)), "[^A-Za-z]", "")), F.lit(".example.co/x")).alias("link"), F.concat(F.get("w", F.lit(0)), F.lit(" "), word(2)).alias("title"), (F.col("page_id") % 3).alias("pos"))
    return extract.scraped_companies(listed, e02(spark, sf), organic, "page_id", MARKET).select("page_id", "domain", F.col("pos").cast("int").alias("pos"), "link", "title", "source")


_FULL = "upper(first_name[1]) || first_name[2:] || ' ' || upper(last_name[1]) || last_name[2:]"
_ROLES = ["promo", "standard"]


@query("e04_microdata_people", f"with {PARTS} select person, {_FULL} as name, lower(p_type) as title, case when p_size % 2 = 0 then 'https://linkedin.com/in/' || person else '' end as linkedin_url from parts where {sql_any('p_type', _ROLES)}")
def _(spark, sf):
    link = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('<a href="https://linkedin.com/in/'), "person", F.lit('?x=1"></a>'))).otherwise("")
    link = F.replace(link, F.lit("?x=1"), F.lit(""))
    html = F.concat(F.lit('<li itemscope itemtype="https://schema.org/Person"><b itemprop="name"> '), F.initcap("p_name"), F.lit(' </b><i itemprop="jobTitle">'), F.lower("p_type"), F.lit("</i>"), link, F.lit("</li>"))
    return extract.microdata_people(parts(spark, sf).withColumn("html", html), "person", "html", _ROLES).select("person", "name", "title", "linkedin_url")


@query("e05_card_people", f"with {PARTS} select person, {_FULL} as name, lower(p_type) as title from parts where p_size % 3 > 0 and {sql_any('p_type', _ROLES)}")
def _(spark, sf):
    card = F.when(F.col("p_size") % 3 == 0, '<div class="x">').when(F.col("p_size") % 3 == 1, '<div class="our-team-card">').otherwise('<li id="staff1">')
    end = F.when(F.col("p_size") % 3 == 2, "</li>").otherwise("</div>")
    html = F.concat(card, F.lit("<strong> "), F.initcap("p_name"), F.lit("</strong><h3>Our Team</h3><span>about us</span><span>"), F.lower("p_type"), F.lit("</span>"), end)
    return extract.card_people(parts(spark, sf).withColumn("html", html), "person", "html", _ROLES).select("person", "name", "title")


@query("e06_nearby_people", f"with {PARTS} select person, {_FULL} as name, case when p_size % 2 = 0 then 'Vendor Manager' else 'Owner' end as title from parts where p_size % 5 > 0")
def _(spark, sf):
    name = F.initcap("p_name")
    far = F.when(F.col("p_size") % 5 == 0, F.lit("x " * 60)).otherwise("")
    body = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("we met "), name, far, F.lit(", the vendor manager of "), "domain")).otherwise(F.concat(F.lit("the owner: "), far, name, F.lit(" of "), "domain"))
    return extract.nearby_people(parts(spark, sf).withColumn("body", body), "person", "body", ["vendor manager", "owner"]).select("person", "name", "title")


_TEAM = "paths as (select * from (values ('/team', 1), ('/people', 2), ('/about', 3)) t(path, priority))"


@query("e07_page_set_people", f"with {PARTS}, {_TEAM}, p as (select *, ['/team', '/people', '/about'][p_size % 3 + 1] as path, row_number() over (partition by domain, ['/team', '/people', '/about'][p_size % 3 + 1], p_name order by person) as rn from parts), j as (select domain, priority, path, p_name, person from p join paths using (path)), m as (select *, min(priority) over (partition by domain) as best, row_number() over (partition by domain, path order by person) - 1 as pos from j), f as (select domain, p_name, min(pos) as pos from m where priority = best group by 1, 2), r as (select *, row_number() over (partition by domain order by pos) as rn from f) select domain, p_name as name from r where rn <= 5")
def _(spark, sf):
    path = F.element_at(F.array(F.lit("/team"), F.lit("/people"), F.lit("/about")), (F.col("p_size") % 3 + 1).cast("int"))
    cards = F.concat(F.lit('<div class="staff-bio"><h3>'), F.initcap("p_name"), F.lit("</h3><p>owner</p></div>"))
    pages = parts(spark, sf).withColumn("path", path).groupBy("domain", "path").agg(F.sort_array(F.collect_list(F.struct("person", cards.alias("c")))).alias("l"))
    pages = pages.select("domain", "path", F.array_join(F.transform("l", lambda x: x["c"]), " ").alias("html"))
    dim = spark.createDataFrame([("/team", 1), ("/people", 2), ("/about", 3)], "path string, priority int")
    return extract.page_people(pages, dim).select("domain", F.lower("name").alias("name"))


@query("e08_profile_people", f"with {PARTS}, h as (select *, p_size % 2 as engine_rank, p_size % 3 as candidate_rank from parts where p_size % 5 <> 0 and p_size % 7 <> 0), m as (select *, min(engine_rank * 10 + candidate_rank) over (partition by domain) as best from h), f as (select domain, p_name, min(person) as pos, arg_min(p_type, person) as title from m where engine_rank * 10 + candidate_rank = best group by 1, 2), r as (select *, row_number() over (partition by domain order by pos) as rn from f) select domain, p_name as name, title from r where rn <= 10")
def _(spark, sf):
    p = parts(spark, sf)
    name = F.when(F.col("p_size") % 7 == 0, "LinkedIn Member").otherwise(F.concat("p_name", F.lit(" (she/her), MBA")))
    h = p.select(
        "domain", (F.col("p_size") % 2).alias("engine_rank"), (F.col("p_size") % 3).alias("candidate_rank"), F.col("person").alias("pos"), F.concat(F.lit("https://www.linkedin.com/in/"), "person").alias("link"),
        F.concat(name, F.lit(" - "), "p_type", F.lit(" at X | Profile")).alias("title"), F.when(F.col("p_size") % 5 == 0, "a past employee there").otherwise("now here").alias("snippet"),
    )
    return extract.profile_people(h).select("domain", "name", "title")


@query("c19_profile_names", f"with {PARTS} select person, p_size % 6 not in (0, 1, 2) as ok from parts")
def _(spark, sf):
    forms = [F.lit("LinkedIn Member"), F.concat("first_name", F.lit(" X.")), F.concat("p_name", F.lit(" 2")), F.col("p_name"), F.concat("p_name", F.lit(" von der Au")), F.initcap("p_name")]
    return parts(spark, sf).select("person", contacts.is_profile_name(F.element_at(F.array(*forms), (F.col("p_size") % 6 + 1).cast("int"))).alias("ok"))


@query("e09_people_cards", f"with {PARTS}, r as (select *, row_number() over (partition by domain order by person) as rn from parts) select domain, {_FULL} as name, 'Owner ' || p_type as title from r where rn <= 15")
def _(spark, sf):
    frags = F.array(F.lit("Connect"), F.concat(F.initcap("first_name"), F.lit(" Holdings.")), F.lit("LinkedIn Member"), F.concat(F.initcap("p_name"), F.lit(" (he)")), F.lit("1st"), F.concat(F.lit("• Owner "), "p_type"))
    return extract.card_fragments(parts(spark, sf).select("domain", F.col("person").alias("pos"), F.concat(F.lit("u/"), "person").alias("url"), frags.alias("fragments"))).select("domain", "name", "title")


_HOST = "regexp_extract(text, '@([A-Za-z0-9.-]+[.][A-Za-z]{2,})', 1)"
_SPOKEN = extract.SPOKEN_EMAIL.replace("'", "''")


def sql_at(body: str, host: str) -> str:
    """Addresses at a host: plain ones, then spoken ones, lower-cased, first of each."""
    plain = rf"regexp_extract_all({body}, '(?i)\b([A-Za-z0-9._%+\-]+@' || replace({host}, '.', '\.') || ')\b', 1)"
    spoken = f"list_transform(list_filter(list_zip(regexp_extract_all({body}, '{_SPOKEN}', 1), regexp_extract_all({body}, '{_SPOKEN}', 2)), lambda z: lower(z[2]) = {host}), lambda z: z[1] || '@' || z[2])"
    return f"list_distinct(list_transform(list_concat({plain}, {spoken}), lambda e: lower(e)))"


@query("e10_addresses", f"with d as (select doc_id, replace(text, '@mail1', ' [at] mail1') as text, {_HOST} as host from documents) select doc_id, unnest({sql_at('text', 'host')}) as email from d where host <> ''")
def _(spark, sf):
    host = F.regexp_extract("text", "@([A-Za-z0-9.-]+[.][A-Za-z]{2,})", 1)
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("@mail1"), F.lit(" [at] mail1")).alias("text"), host.alias("host"))
    return extract.addresses(d.where("host <> ''"), "doc_id", "text", "host").select("doc_id", "email")


@query("e12_document_addresses", f"with p as (select doc_id // 40 as site, 'mail5.example.com' as host, ((doc_id % 40) // 10) as doc, doc_id % 10 as page, text from documents), f as (select site, doc, unnest({sql_at('text', 'host')}) as email from p where doc < 3 and page < 5), b as (select site, min(doc) as doc from f group by 1) select distinct site, email, doc from f join b using (site, doc)")
def _(spark, sf):
    d = F.col("doc_id")
    p = table(spark, sf, "documents").select(F.floor(d / 40).alias("site"), F.lit("mail5.example.com").alias("domain"), F.floor(d % 40 / 10).alias("doc"), (d % 10).alias("page"), "text")
    return extract.document_addresses(p, "site").select("site", "email", "doc")


_SITE = f"""{PARTS}, mails as (select domain, case when domain like '%2.example.com' then 'doc' else ['/contact', '/about', '/'][case when domain like '%1.example.com' then 3 else p_size % 2 + 1 end] end as path, person as pos, case when p_size % 7 = 0 then 'info' else first_name || p_size end || '@' || domain as email, p_size from parts),
paths as (select * from (values ('/contact', 1), ('/about', 2), ('/', 99)) t(path, priority)), dm as (select *, p_size % 5 as doc, min(p_size % 5) over (partition by domain) as first_doc from mails where path = 'doc'),
m as (select mails.*, priority from mails join paths using (path) union all select domain, path, pos, email, p_size, 1000000 + doc from dm where doc = first_doc and doc < 3),
st as (select *, min(case when not starts_with(email, 'info@') and path not in ('/', 'doc') then priority end) over (partition by domain) as stop from m),
site as (select domain, email, min(priority)::int as priority from st where stop is null or priority <= stop group by 1, 2)"""


def site_pages(spark, sf):
    """Pages, paths and linked documents: sites that end in 2 show addresses in their documents only, those in 1 on their homepage."""
    in_docs, at_home = F.endswith("domain", F.lit("2.example.com")), F.endswith("domain", F.lit("1.example.com"))
    path = F.element_at(F.array(F.lit("/contact"), F.lit("/about"), F.lit("/")), F.when(at_home, 3).otherwise(F.col("p_size") % 2 + 1).cast("int"))
    email = F.concat(F.when(F.col("p_size") % 7 == 0, "info").otherwise(F.concat("first_name", "p_size")), F.lit("@"), "domain")
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("person", email.alias("e")))), lambda x: x["e"]), " , ")
    pages = parts(spark, sf).withColumn("path", path).groupBy("domain", "path").agg(F.when(in_docs, "see our papers").otherwise(shown).alias("text"))
    docs = parts(spark, sf).withColumn("doc", F.col("p_size") % 5).groupBy("domain", "doc").agg(shown.alias("text")).withColumn("page", F.lit(0))
    return pages, spark.createDataFrame([("/contact", 1), ("/about", 2), ("/", 99)], "path string, priority int"), docs


def site(spark, sf):
    pages, paths, docs = site_pages(spark, sf)
    return extract.site_addresses(pages, paths, documents=docs)


@query("e11_site_addresses", f"with {_SITE} select domain, email, priority from site")
def _(spark, sf):
    """Addresses of sites from contact pages, else the homepage, else linked documents."""
    return site(spark, sf).select("domain", "email", "priority")


@query("e13_search_address", f"with {PARTS} select person, first_name || p_size || '@' || domain as email from parts where p_size % 4 <> 0")
def _(spark, sf):
    # three hits a person: another host's address before the own one, a role's address, and the own one again
    own = F.concat("first_name", "p_size", F.lit("@"), "domain")
    texts = [F.concat(F.lit("x@other.com or "), F.when(F.col("p_size") % 4 == 1, own).otherwise("none")), F.concat(F.lit("info@"), "domain", F.lit(" then "), own), F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("write "), F.upper(own), F.lit(".")))]
    h = parts(spark, sf).select("person", "domain", F.posexplode(F.array(*texts)).alias("pos", "snippet"), F.lit("t").alias("title"), F.lit("https://a.b/c").alias("link"))
    return extract.search_address(h)


@query("e14_example_patterns", f"with {PARTS}, n as (select f, l from (select unnest({sql_list(dims.EXAMPLE_FIRST)}) as f), (select unnest({sql_list(dims.EXAMPLE_LAST)}) as l)) select person, f || '.' || l as local_part, 'first.last' as pattern from parts join n on f = ({sql_list(dims.EXAMPLE_FIRST)})[p_size % 5 + 1] and l = ({sql_list(dims.EXAMPLE_LAST)})[p_size % 12 + 1]")
def _(spark, sf):
    f = F.element_at(F.array(*map(F.lit, dims.EXAMPLE_FIRST)), (F.col("p_size") % 5 + 1).cast("int"))
    l = F.element_at(F.array(*map(F.lit, dims.EXAMPLE_LAST)), (F.col("p_size") % 12 + 1).cast("int"))  # noqa: E741
    p = parts(spark, sf).select("person", F.concat(f, F.lit("."), l).alias("local_part"))
    return p.join(emails.example_patterns(spark), "local_part").select("person", "local_part", "pattern")


@query("e14_page_patterns", f"with {PARTS} select person, case p_size % 4 when 0 then {_PATTERN} when 1 then 'flast' when 2 then 'f.last' end as pattern from parts where p_size % 4 <> 3")
def _(spark, sf):
    token = F.element_at(F.array(*map(F.lit, dims.EMAIL_TOKENS)), (F.col("p_size") % 11 + 1).cast("int"))
    kind = F.col("p_size") % 4
    body = F.when(kind == 0, F.concat(F.lit("Format: "), F.upper(token), F.lit("@x"))).when(kind == 1, F.concat(F.lit("such as red@"), "domain", F.lit(" or JSmith@"), "domain")).when(kind == 2, "First initial last, mostly").otherwise("nothing known")
    return emails.page_patterns(parts(spark, sf).withColumn("body", body), "person", "body", "domain")


@query("e15_organic_results", f"with {HITS}, k as (select pos, run, rtrim(regexp_replace(link, '[?#].*$', ''), '/') as url_key, title from hits), v as (select * from k where length(trim(title)) >= 3 and not {sql_any('title', dims.JUNK_TITLES)}) select run, url_key, min(pos) as pos from v group by 1, 2")
def _(spark, sf):
    return extract.organic(hits(spark, sf).select("run", "pos", "link", "title"), ["run"], "link", "title", ["pos"]).select("run", "url_key", "pos")


_PANEL = f"""grp as (select page_id // 8 as page, page_id as pos, 'https://www.' || replace({sql_domain('url')}, ':', '') || '/x' as link, string_split(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1), ' ') as w, {sql_domain('url')} as domain from pages),
nam as (select page, pos, case pos % 3 when 0 then upper(domain[1]) || string_split(domain[2:], '.')[1] || ' Ltd' when 1 then w[1] || ' ' || coalesce(w[2], '') else 'Qq' || w[2] end as name, case when pos % 2 = 0 then link else '' end as link, 'said ' || pos as snippet from grp), res as (select page, link, array_to_string(w, ' ') as title, pos from grp where pos % 5 <> 0)"""


def panel(spark, sf):
    p, n = table(spark, sf, "pages"), F.col("page_id")
    w, d = F.split(F.regexp_extract("html", r"<title[^>]*>(.*?)</title>", 1), " "), web.domain_of(F.col("url"))
    word = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    link = F.concat(F.lit("https://www."), F.replace(d, F.lit(":"), F.lit("")), F.lit("/x"))
    name = F.when(n % 3 == 0, F.concat(F.upper(F.substring(d, 1, 1)), F.substring_index(F.expr("substring(d, 2)"), ".", 1), F.lit(" Ltd"))).when(n % 3 == 1, F.concat(word(0), F.lit(" "), word(1))).otherwise(F.concat(F.lit("Qq"), F.get(w, F.lit(1))))
    g = p.withColumn("d", d).select(F.floor(n / 8).alias("page"), n.alias("pos"), link.alias("found"), name.alias("name"), F.when(n % 2 == 0, link).otherwise("").alias("link"), F.concat(F.lit("said "), n).alias("snippet"), F.array_join(w, " ").alias("title"))
    return g.select("page", "pos", "name", "link", "snippet"), g.where("pos % 5 <> 0").select("page", F.col("found").alias("link"), "title", "pos")


@query("f06_resolve_names", f"with {_PANEL}, {sql_resolved('nam', 'res', 'page')} select n.page, n.name, f.link from (select distinct page, name from nam) n left join found f using (page, name)")
def _(spark, sf):
    names, results = panel(spark, sf)
    return qualify.resolve_names(names.select("page", "name").distinct(), results, ["page"], MARKET)


@query("f07_merge_panel_rows", f"with {_PANEL}, {sql_merged('nam', 'res', 'page', 'local_pack')} select page, domain, pos, link, title, snippet, source from merged")
def _(spark, sf):
    names, results = panel(spark, sf)
    return qualify.merge_panel_rows(names, results, ["page"], MARKET, source="local_pack")


_FIRST = "contains(string_split(email, '@')[1], first_name)"


def _people(spark, sf):
    return parts(spark, sf).select("person", "domain", "first_name", "last_name")


@query("f08_site_email_choice", f"""with {_SITE}, o as (select domain, count(*) as n from site where not starts_with(email, 'info@') group by 1), st2 as (select s.*, n, (select min(pos) from m where m.domain = s.domain and m.email = s.email) as pos from site s join o using (domain)),
j as (select p.person, s.email, case when {_FIRST} or contains(string_split(email, '@')[1], last_name) then 'Site ✓' when n = 1 then 'Site' end as label, row_number() over (partition by p.person order by priority, s.pos) as rn from parts p join st2 s using (domain) where not starts_with(email, 'info@') and ({_FIRST} or contains(string_split(email, '@')[1], last_name) or n = 1))
select person, email, label from j where rn = 1""")
def _(spark, sf):
    return emails.from_site(_people(spark, sf), site(spark, sf))


_GENERIC = f"(len(list_filter({sql_list(dims.GENERIC_PREFIXES)}, lambda p: starts_with(string_split(email, '@')[1], p) and length(string_split(email, '@')[1]) <= length(p) + 3)) > 0)"
_PATTERNS = "patterns as (select domain, min(p_size) as p_size from parts group by 1)"
_CAND = f"cand as (select p.person, {_LOCAL.replace('p_size', 'q.p_size')} || '@' || domain as email from parts p join patterns q using (domain))"
_VER2 = "ver as (select distinct email, case length(email) % 4 when 0 then 'good' when 1 then 'bad' when 2 then 'risky' end as verdict from cand)"


def patterns(spark, sf):
    p = parts(spark, sf).groupBy("domain").agg(F.min("p_size").alias("p_size"))
    return p.select("domain", pattern_of().alias("pattern"))


def verdicts(spark, sf):
    c = _people(spark, sf).join(patterns(spark, sf), "domain").withColumns({"_f": contacts.norm_name(F.col("first_name")), "_l": contacts.norm_name(F.col("last_name"))})
    c = c.select(contacts.candidate_of(F.col("_f"), F.col("_l"), F.col("domain"), F.col("pattern")).alias("email")).distinct()
    n = F.length("email") % 4
    return c.withColumn("verdict", F.when(n == 0, "good").when(n == 1, "bad").when(n == 2, "risky"))


@query("f09_pattern_emails", f"with {PARTS}, {_PATTERNS}, {_CAND}, {_VER2} select person, email, case verdict when 'good' then 'EFmt ✓' when 'risky' then 'EFmt ~' else 'EFmt ?' end as label, coalesce(verdict = 'good', false) as verified from cand left join ver using (email) where coalesce(verdict, '') <> 'bad' and not {_GENERIC}")
def _(spark, sf):
    return emails.from_pattern(_people(spark, sf), patterns(spark, sf), verdicts(spark, sf))


_LAYERS = f"""with {_SITE}, o as (select domain, count(*) as n from site where not starts_with(email, 'info@') group by 1), st2 as (select s.*, n, (select min(pos) from m where m.domain = s.domain and m.email = s.email) as pos from site s join o using (domain)),
j as (select p.person, s.email, row_number() over (partition by p.person order by priority, s.pos) as rn from parts p join st2 s using (domain) where not starts_with(email, 'info@') and ({_FIRST} or contains(string_split(email, '@')[1], last_name) or n = 1)),
{_PATTERNS}, {_CAND}, {_VER2}, l1 as (select person, email, 0 as rank, 'L1-Site' as layer, true as verified from j where rn = 1), l2 as (select person, email, 1 as rank, 'L2-EFmt' as layer, coalesce(verdict = 'good', false) as verified from cand left join ver using (email) where coalesce(verdict, '') <> 'bad' and not {_GENERIC}),
l4 as (select person, 'mail' || person || '@' || domain as email, 2 as rank, 'L4-Search' as layer, true as verified from parts where p_size % 2 = 0), u as (from l1 union all from l2 union all from l4), f as (select *, row_number() over (partition by person order by rank) as rn from u)"""


def _layers(spark, sf):
    who = _people(spark, sf)
    search = parts(spark, sf).where("p_size % 2 = 0").select("person", F.concat(F.lit("mail"), "person", F.lit("@"), "domain").alias("email"))
    return who, [("L1-Site", emails.from_site(who, site(spark, sf))), ("L2-EFmt", emails.from_pattern(who, patterns(spark, sf), verdicts(spark, sf))), ("L4-Search", search)]


@query("n02_first_email_layer", f"{_LAYERS} select person, email, layer, verified from f where rn = 1")
def _(spark, sf):
    return emails.first_layer(_layers(spark, sf)[1]).select("person", "email", "layer", "verified")


@query("o03_find_emails", f"{_LAYERS} select f.person, domain, email, layer from f join parts using (person) where rn = 1 and (layer <> 'L2-EFmt' or verified) and not {_GENERIC}")
def _(spark, sf):
    who, layers = _layers(spark, sf)
    return emails.leads(who, layers).select("person", "domain", "email", "layer")


def mail_inputs(spark, sf):
    p = parts(spark, sf)
    who = p.select(
        "person", "domain", F.col("p_name").alias("full_name"), F.when(F.col("p_size") % 2 == 0, F.col("first_name")).otherwise("").alias("first_name"), F.when(F.col("p_size") % 2 == 0, F.col("last_name")).otherwise("").alias("last_name"),
        F.col("p_type").alias("title"), F.concat(F.lit("Co "), "domain").alias("company_name"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("u/"), "person")).alias("linkedin_url"), F.lit(None).cast("string").alias("email_searched_at"),
    )
    about = patterns(spark, sf).select("domain", F.concat(F.lit("Format "), F.element_at(F.map_from_arrays(F.array(*map(F.lit, dims.EMAIL_PATTERNS)), F.array(*map(F.lit, dims.EMAIL_TOKENS))), F.col("pattern"))).alias("body"))
    hits = p.where("p_size % 2 = 0").select("person", F.lit(0).alias("pos"), "domain", F.concat(F.lit("mail"), "person", F.lit("@"), "domain").alias("snippet"), F.lit("").alias("title"), F.lit("").alias("link"))
    known = p.where("person % 9 = 0").select(F.concat(F.lit("mail"), "person", F.lit("@"), "domain").alias("email"))
    pages, paths, docs = site_pages(spark, sf)
    return who, pages, paths, about, verdicts(spark, sf), hits, known, F.lit("now"), docs


_LEADS = f"""{_LAYERS}, a as (select f.person, domain, email, layer, case layer when 'L1-Site' then case when {_FIRST} or contains(string_split(email, '@')[1], last_name) then 'Site ✓' else 'Site' end when 'L2-EFmt' then 'EFmt ✓' else 'Search ✓' end as email_source, p_name as full_name, first_name, last_name, p_type as title, 'Co ' || domain as company, case when p_size % 3 = 0 then 'u/' || person else '' end as linkedin_url,
row_number() over (partition by email order by f.person) as first from f join parts using (person) where rn = 1 and (layer <> 'L2-EFmt' or verified) and not {_GENERIC})
select person, domain, email, layer, email_source, full_name, first_name, last_name, title, company, linkedin_url from a where first = 1 and email not in (select 'mail' || person || '@' || domain from parts where person % 9 = 0)"""
_LEAD_COLUMNS = ["person", "domain", "email", "layer", "email_source", "full_name", "first_name", "last_name", "title", "company", "linkedin_url"]


@query("o03_mail_run", _LEADS)
def _(spark, sf):
    return emails.mail_run(*mail_inputs(spark, sf))[0].select(*_LEAD_COLUMNS)


@query("k07_resumed_mail_run", _LEADS)
def _(spark, sf):
    """The mail run in three slices, of which the first start does one; the second start does the rest."""
    run = lambda: SlicedRun(spark, folder, 3)
    folder = scratch_folder(spark, "mail-run")
    emails.mail_run_in_slices(run(), *mail_inputs(spark, sf), at_most=1)
    return emails.mail_run_in_slices(run(), *mail_inputs(spark, sf))[0].select(*_LEAD_COLUMNS)


@query("o03_people_after_run", "select p_partkey as person, 'now' as email_searched_at from part")
def _(spark, sf):
    return emails.mail_run(*mail_inputs(spark, sf))[1].select("person", "email_searched_at")


@query("o02_find_people", f"with {PARTS}, k as (select domain, arg_min(person, (person % 2, person)) as person, arg_min(p_type, (person % 2, person)) as p_type from parts group by domain, lower(p_name)), r as (select domain, person, row_number() over (partition by domain order by person % 2, person) as rn from k where {sql_any('p_type', ['standard', 'promo'])}) select domain, person, case person % 2 when 0 then 'xray' else 'Website' end as people_source from r where rn <= 10")
def _(spark, sf):
    rows = parts(spark, sf).select("domain", F.col("person").alias("seq"), F.col("p_name").alias("full_name"), F.col("p_type").alias("title"), F.lit("").alias("linkedin_url"))
    small, large = rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")
    found = people.find_people(rows.select("domain").distinct(), [("xray", lambda c: small.join(c, "domain", "left_semi")), ("Website", lambda c: large.join(c, "domain", "left_semi"))], ["standard", "promo"])
    return found.select("domain", F.col("seq").alias("person"), "people_source")


_RUN = f"""with {PARTS}, c as (select domain, case when domain like '%2.example.com' then '' else 'x' end as linkedin_url, case when domain like '%3.example.com' then 'lsp' else '' end as company_type from parts group by 1),
x as (select domain, p_name as name, min(person) as pos, arg_min(p_type, person) as title, arg_min('https://www.linkedin.com/in/' || person, person) as url from parts where p_size % 3 = 0 group by 1, 2), xr as (select *, row_number() over (partition by domain order by pos) as rn from x), xray as (select domain, name, title, url, pos from xr where rn <= 10),
few as (select domain from c where linkedin_url <> '' and domain not in (select domain from xray group by 1 having count(*) >= 5)),
cr as (select *, {_FULL} as name, row_number() over (partition by domain order by person) as rn from parts where p_size % 3 = 1 and domain in (from few)), cards as (select domain, name, case when length(p_type) between 6 and 79 then p_type else '' end as title, 'u/' || person as url, person as pos from cr where rn <= 15),
sr as (select domain, p_name, min(person) as pos, arg_min(p_type, person) as p_type from parts where p_size % 3 = 2 group by 1, 2), sq as (select *, row_number() over (partition by domain order by pos) as rn from sr), site as (select domain, upper(string_split(p_name, ' ')[1][1]) || string_split(p_name, ' ')[1][2:] || ' ' || upper(string_split(p_name, ' ')[2][1]) || string_split(p_name, ' ')[2][2:] as name, lower(p_type) as title, '' as url, (rn - 1) * 100 as pos from sq where rn <= 5),
u as (select *, 0 as rank, 'xray' as people_source from xray union all select *, 1, 'LI page' from cards union all select *, 2, 'Website' from site),
d as (select *, row_number() over (partition by case when url <> '' then 'u:' || lower(url) else 'n:' || domain || '|' || lower(name) end order by rank, pos) as first from u), t as (select *, row_number() over (partition by domain order by rank, pos) as rn from d where first = 1 and {sql_any('title', ['promo', 'standard'])}),
e as (select *, row_number() over (partition by domain, name order by rank, pos) as once from t where rn <= 10)"""


def people_run(spark, sf):
    p = parts(spark, sf).where("p_size % 3 >= 0")
    domain, size = F.col("domain"), F.col("p_size")
    companies = p.select("domain").distinct().select("domain", F.when(F.endswith(domain, F.lit("2.example.com")), "").otherwise("x").alias("linkedin_url"), F.when(F.endswith(domain, F.lit("3.example.com")), "lsp").otherwise("").alias("company_type"), F.lit(None).cast("string").alias("people_searched_at"), F.concat(F.lit("Co "), domain).alias("company_name"))
    homes = companies.select("domain", F.when(F.endswith(domain, F.lit("1.example.com")), "We translate; a translation agency.").otherwise("").alias("body"))
    hits = p.where("p_size % 3 = 0").select("domain", F.lit(0).alias("engine_rank"), F.lit(0).alias("candidate_rank"), F.col("person").alias("pos"), F.concat(F.lit("https://www.linkedin.com/in/"), "person").alias("link"), F.concat("p_name", F.lit(" - "), "p_type", F.lit(" | Profile")).alias("title"), F.lit("").alias("snippet"))
    cards = p.where("p_size % 3 = 1").select("domain", F.col("person").alias("pos"), F.concat(F.lit("u/"), "person").alias("url"), F.array(F.initcap("p_name"), F.col("p_type")).alias("fragments"))
    card = F.concat(F.lit('<div class="card"><b>'), F.initcap("p_name"), F.lit("</b><p>"), F.lower("p_type"), F.lit("</p></div>"))
    once = first_wins(p.where("p_size % 3 = 2").select("domain", "p_name", "person", card.alias("card")), ["domain", "p_name"], ["person"])
    pages = once.groupBy("domain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("person", "card"))), lambda x: x["card"]), " ").alias("html")).withColumn("path", F.lit("/team"))
    verdicts = companies.select("domain", F.lit("client").alias("company_type"))
    table_now = companies.limit(0).select("domain", F.lit("").alias("full_name"))
    everyone = ["a", "e", "i", "o"]
    return people.people_run(companies, homes, verdicts, hits, cards, pages, spark.createDataFrame([("/team", 1)], "path string, priority int"), table_now, F.lit("now"), ["promo", "standard"], everyone)


@query("o02_people_run", f"{_RUN} select domain, 'Co ' || domain as company_name, string_split(name, ' ')[1] as first_name, array_to_string(string_split(name, ' ')[2:], ' ') as last_name, name as full_name, title, url as linkedin_url, people_source, 'now' as found_at from e where once = 1")
def _(spark, sf):
    return people_run(spark, sf)[0]


@query("o02_companies_after_run", "with c as (select distinct lower(replace(p_brand, '#', '')) || '.example.com' as domain from part) select domain, case when domain like '%3.example.com' then 'lsp' when domain like '%1.example.com' then 'lsp' else 'client' end as company_type, 'now' as people_searched_at from c")
def _(spark, sf):
    return people_run(spark, sf)[1].select("domain", "company_type", "people_searched_at")


@query("g02_hits_by_domain", f"with {HITS}, h as (select run, pos, {sql_domain('link')} as domain, case source when 'web' then 1 else 0 end as panel from hits), f as (select run, domain, min(panel * 1000000 + pos) as place from h group by 1, 2), r as (select *, row_number() over (partition by run order by place) as rn from f) select run, domain, rn::int as rank from r where rn <= 20")
def _(spark, sf):
    h = hits(spark, sf).withColumn("domain", web.domain_of(F.col("link"))).withColumn("panel", F.when(F.col("source") == "web", 1).otherwise(0))
    once = first_wins(h.select("run", "domain", "panel", "pos"), ["run", "domain"], ["panel", "pos"])
    return first_n(once, ["run"], ["panel", "pos"], 20, rank="rank").select("run", "domain", "rank")


@query("g03_panel_rows_by_domain", f"with {HITS}, h as (select pos, source, {sql_domain('link')} as domain from hits where source <> 'web') select domain, arg_min(source, (source, pos)) as source from h group by 1")
def _(spark, sf):
    h = hits(spark, sf).where("source <> 'web'").select("pos", "source", web.domain_of(F.col("link")).alias("domain"))
    return first_wins(h, ["domain"], ["source", "pos"]).select("domain", "source")


@query("g07_distinct_in_order", "select role, conv_id, min(turn) as turn from conversations group by 1, 2")
def _(spark, sf):
    return first_wins(table(spark, sf, "conversations").select("role", "conv_id", "turn"), ["role", "conv_id"], ["turn"])


@query("g09_directory_urls", f"with {HITS}, k as (select run, pos, rtrim(regexp_replace(link, '[?#].*$', ''), '/') as url from hits), f as (select run, url, min(pos) as pos from k group by 1, 2), r as (select *, row_number() over (partition by run order by pos) as rn from f) select run, url from r where rn <= 12")
def _(spark, sf):
    h = hits(spark, sf).select("run", "pos", F.rtrim(F.regexp_replace("link", r"[?#].*$", ""), F.lit("/")).alias("url"))
    return first_n(first_wins(h, ["run", "url"], ["pos"]), ["run"], ["pos"], 12).select("run", "url")


@query("h09_term_yield", "select user_id as run_id, event_type as query, count(*) as raw, count(*) filter (value > 20) as checked, count(*) filter (value > 40) as kept, array_to_string(list_sort(list_distinct(list(case when value > 60 then 'strong' when value > 30 then 'possible' else 'weak' end))), ', ') as tiers from events group by 1, 2")
def _(spark, sf):
    t = F.when(F.col("value") > 60, "strong").when(F.col("value") > 30, "possible").otherwise("weak")
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("query"))
    return e.agg(F.count("*").alias("raw"), F.count_if(F.col("value") > 20).alias("checked"), F.count_if(F.col("value") > 40).alias("kept"), F.array_join(F.array_sort(F.collect_set(t)), ", ").alias("tiers"))


@query("h10_run_totals", "select user_id as run_id, count(*) as events, count(*) filter (event_type = 'purchase') as kept, count(*) filter (event_type = 'error') as failed, count(*) filter (event_type not in ('purchase', 'error')) as filtered from events group by 1")
def _(spark, sf):
    t = F.col("event_type")
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("events"), F.count_if(t == "purchase").alias("kept"), F.count_if(t == "error").alias("failed"), F.count_if(~t.isin("purchase", "error")).alias("filtered"))


@query("i05_rank_hits", f"with {HITS}, h as (select run, pos, case source when 'ai_overview' then 0 when 'local_pack' then 1 else 9 end as priority from hits) select run, pos, row_number() over (partition by run order by priority, pos)::int as rank from h")
def _(spark, sf):
    h = hits(spark, sf).withColumn("priority", gates.hit_priority(F.col("source"), F.lit(False), F.lit(False)))
    return runs.ranked(h.select("run", "pos", "priority"), "run", ["priority", "pos"]).select("run", "pos", F.col("rank").cast("int").alias("rank"))


@query("i06_best_candidate", "select o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as o_orderkey from orders group by 1")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))


@query("i07_trailing_rate", "select event_id, count(*) filter (event_type = 'purchase') over (partition by user_id order by epoch_us(ts) range between 900000000 preceding and current row) as kept from events")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.col("event_type") == "purchase")
    return runs.trailing_count(e, "user_id", "ts", "k", "kept").select("event_id", F.col("kept").cast("long").alias("kept"))


@query("i08_running_total", "select event_id, count(*) filter (event_type = 'purchase') over (partition by user_id order by ts, event_id rows unbounded preceding) as kept from events")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.col("event_type") == "purchase")
    return runs.running_total(e, "user_id", ["ts", "event_id"], "ts", "k", "kept").select("event_id", "kept")


@query("i09_slices", "select page_id, len(string_split(html, ' ')[1:300])::int as n, substr(url, 1, 80) as url from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(F.slice(F.split("html", " "), 1, 300)).alias("n"), F.substring("url", 1, 80).alias("url"))


_STOP = """with e as (select user_id as run_id, event_id as seq, ts, event_type = 'purchase' as kept, event_type <> 'error' as checked, event_type = 'view' as term_end, case event_id % 211 when 3 then 'stop' when 5 then 'error' when 7 then 'down' end as signal from events), t as (select distinct run_id, case when run_id % 3 = 0 then 60 else 8 end as target, 45 as budget from e),
w as (select *, count(*) filter (kept) over r as recent_kept, count(*) filter (term_end) over r as recent_terms, count(*) filter (kept) over s as total_kept, count(*) filter (checked) over s as total_checked, min(ts) over (partition by run_id) as begin from e
 window r as (partition by run_id order by epoch_us(ts) range between 900000000 preceding and current row), s as (partition by run_id order by ts, seq rows unbounded preceding)),
k as (select w.*, case signal when 'error' then 'error' when 'down' then 'serp_unavailable' when 'stop' then 'stopped' else case when total_kept >= target then 'target_met' when total_checked >= budget then 'check_budget' when term_end and target > 50 and recent_terms >= 3 and recent_kept * 3600 / least(900.0, greatest(1.0, (epoch_us(ts) - epoch_us(begin)) / 1e6)) < 12 then 'diminishing_returns' end end as reason from w join t using (run_id)),
f as (select *, row_number() over (partition by run_id order by reason is null, case when reason is null then -epoch_us(ts) else epoch_us(ts) end, case when reason is null then -seq else seq end) as rn from k)"""


def run_events(spark, sf):
    t = F.col("event_type")
    return table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts", (t == "purchase").alias("kept"), (t != "error").alias("checked"), (t == "view").alias("term_end"), F.when(F.col("event_id") % 211 == 3, "stop").when(F.col("event_id") % 211 == 5, "error").when(F.col("event_id") % 211 == 7, "down").alias("signal"))


@query("k05_d06_stop_reason", f"{_STOP} select run_id, seq, coalesce(reason, 'search_exhausted') as reason, total_kept, total_checked from f where rn = 1")
def _(spark, sf):
    e = run_events(spark, sf)
    targets = e.select("run_id").distinct().select("run_id", F.when(F.col("run_id") % 3 == 0, 60).otherwise(8).alias("target"), F.lit(45).alias("budget"))
    return runs.stop_rows(e, targets)


@query("k05_live_stops", f"{_STOP} select run_id, seq, coalesce(reason, 'search_exhausted') as reason, total_kept, total_checked from f where rn = 1")
def _(spark, sf):
    """The stop decision on the events as a stream: the same ends as on the whole history.  A last event of a run of its own, far
    ahead in time, lets the watermark pass all others."""
    e = run_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = scratch_folder(spark, "events")
    e.write.parquet(folder)
    targets = e.select("run_id").distinct().select("run_id", F.when(F.col("run_id") % 3 == 0, 60).otherwise(8).alias("target"), F.lit(45).alias("budget"))
    ahead = e.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).select(F.lit(-1).cast(e.schema["run_id"].dataType).alias("run_id"), F.lit(0).cast(e.schema["seq"].dataType).alias("seq"), "ts", *[F.lit(False).alias(c) for c in ("kept", "checked", "term_end")], F.lit(None).cast("string").alias("signal"))
    return stops.ends_of(spark, folder, e.schema, ahead, targets.unionByName(spark.createDataFrame([(-1, 1, 1)], "run_id int, target int, budget int")), idle_s=60 * 86_400)


@query("k04_windowed_yield", "with b as (select user_id as run_id, event_type as kind, time_bucket(interval '15 minutes', ts) as start from events) select run_id, kind, start, count(*) as n from b group by 1, 2, 3")
def _(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("kind"), F.window(F.col("ts").cast("timestamp"), "15 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select("run_id", "kind", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("k06_fold_run_events", "select user_id as run_id, event_type as kind, count(*) as n from events group by 1, 2")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query("k09_per_domain_memo", f"with {PARTS}, m as (select domain, max(p_size) as best from parts group by 1) select person, best from parts join m using (domain)")
def _(spark, sf):
    p = parts(spark, sf)
    return p.join(p.groupBy("domain").agg(F.max("p_size").alias("best")), "domain").select("person", "best")


_MARKETS = """markets as (select c_custkey as market_id, (['localization', 'legal', '', 'subtitling', 'all', 'translation'])[c_custkey % 6 + 1] as industry, (['Egypt', 'Germany', 'Peru', '', 'All Countries', 'UAE', 'Singapore'])[c_custkey % 7 + 1] as country,
case when c_custkey % 3 = 0 then ['my own term', 'legal agency in Peru'] else [] end as keywords, c_custkey % 50 as shortfall from customer),
mk as (select *, case when country = 'All Countries' then '' else country end as c, case when country in ('', 'All Countries') then '' else ' ' || country end as g, coalesce((map {""" + ", ".join(f"'{k}': {sql_list(dims.MAJOR_CITIES[k])}" for k in ("Egypt", "Germany", "Peru", "UAE", "Singapore")) + """})[country], []::varchar[]) as cities from markets)"""


def markets(spark, sf):
    k = F.col("c_custkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    own = F.when(k % 3 == 0, F.array(F.lit("my own term"), F.lit("legal agency in Peru"))).otherwise(F.array().cast("array<string>"))
    m = table(spark, sf, "customer").select(k.alias("market_id"), pick(["localization", "legal", "", "subtitling", "all", "translation"]).alias("industry"), pick(["Egypt", "Germany", "Peru", "", "All Countries", "UAE", "Singapore"]).alias("country"), own.alias("keywords"), (k % 50).alias("shortfall"))
    return m.withColumn("cities", terms.cities_of(F.col("country")))


def sql_fill(template: str, industry: str = "i") -> str:
    out = "'" + template.replace("'", "''") + "'"
    for k, v in (("i", industry), ("c", "c"), ("g", "g"), ("t", "t"), ("d", "d")):
        out = out.replace("{" + k + "}", f"' || {v} || '")
    return out


def sql_terms(templates: list[str], **kw) -> str:
    return "[" + ", ".join(sql_fill(t, **kw) for t in templates) + "]"


def sql_cities(templates: str, most: int = 1000) -> str:
    return f"flatten(list_transform(cities[1:{most}], lambda t: {templates}))"


def sql_if(condition: str, terms_: str) -> str:
    return f"case when {condition} then {terms_} else []::varchar[] end"


def sql_once(name: str, expr: str, rows: str) -> str:
    """Rows with a list column, its blanks and repeats dropped in order."""
    return f"""{name}_a as (select *, list_filter(list_transform(flatten([{expr}]), lambda s: trim(s)), lambda s: s <> '') as raw from {rows}), {name} as (select * exclude (raw), list_filter(raw, lambda x, i: list_position(raw, x) = i) as {name} from {name}_a)"""


_PRIMARY = sql_once("l1", ", ".join([
    sql_if("industry <> '' and c <> ''", sql_terms(dims.COUNTRY_TERMS, industry="industry")),
    sql_if("industry in ('localization', 'translation', 'subtitling') and c <> ''", f"list_append({sql_terms(dims.LANGUAGE_COUNTRY_TERMS[:-1])}, case when c = 'Egypt' then {sql_fill(dims.EGYPT_OFFICE_TERM)} else {sql_fill(dims.LANGUAGE_COUNTRY_TERMS[-1])} end)"),
    sql_if("industry <> ''", sql_cities(f"list_append({sql_terms(dims.CITY_TERMS[:-1], industry='industry')}, case when industry in ('localization', 'translation') then {sql_fill(dims.LANGUAGE_CITY_TERM)} else {sql_fill(dims.CITY_TERMS[-1], industry='industry')} end)")),
    sql_if("industry = '' and c <> ''", sql_terms(dims.COUNTRY_ONLY_TERMS)), "keywords",
]), "mk")
_IND = "(case when industry = '' then 'localization' else industry end)"
_LABEL = f"(case when {_IND} = 'all' then 'companies' else {_IND} end)"
_DIRECTORIES = sql_once("l2", f"{sql_terms(dims.DIRECTORY_TERMS, industry=_LABEL)}, {sql_if(f'{_IND} in {tuple(dims.TRADE_INDUSTRIES)}', sql_terms(dims.TRADE_TERMS))}, {sql_if(f"{_IND} in {tuple(dims.TRADE_INDUSTRIES)} and c <> ''", sql_terms(dims.TRADE_COUNTRY_TERMS))}", "l1")
_EXPANSION = sql_once("l3w", f"{sql_terms([t for r in dims.EXPANSION_ROLES for t in (f'{{i}} {r} {{c}}', f'translation {r} {{c}}')], industry=_IND)}, {sql_cities(sql_terms(dims.EXPANSION_CITY_TERMS), 6)}, {sql_if("c = 'Egypt'", sql_list(dims.EGYPT_EXPANSION_TERMS))}", "l2")
_NICHES = ", ".join(sql_if("c <> ''", sql_terms([f"{n} company {{c}}", f"{n} agency {{c}}"])) + ", " + sql_terms([f"{n} {{i}} {{c}}"], industry=_IND) for n in dims.ROTATION_NICHES)
_TLD_OF = "(map {" + ", ".join(f"'{k}': '{v}'" for k, v in dims.ROTATION_TLDS.items()) + "})[c]"
_ROTATION = sql_once("l4", f"{_NICHES}, {sql_terms(dims.ROTATION_TERMS, industry=_IND)}, {sql_cities(sql_terms(dims.ROTATION_CITY_TERMS, industry=_IND), 8)}, {sql_if("c = 'Egypt'", sql_list(dims.EGYPT_ROTATION_TERMS))}, {sql_if('d is not null', sql_terms(dims.ROTATION_TLD_TERMS, industry=_IND))}", "l3d")
_BANKS = f"with {_MARKETS}, {_PRIMARY}, {_DIRECTORIES}, {_EXPANSION}, l3 as (select *, l3w[1:greatest(25, least(80, 2 * shortfall))] as l3 from l3w), l3d as (select *, {_TLD_OF} as d from l3), {_ROTATION}, {sql_once('l5', 'l2, l1, l3, l4', 'l4')}"


def bank_query(name: str, column: str, make) -> None:
    @query(name, f"{_BANKS} select market_id, array_to_string({column}, '|') as terms, len({column})::int as n from l5")
    def _(spark, sf):
        m = markets(spark, sf).withColumn("t", make(*map(F.col, ("industry", "country", "cities", "keywords", "shortfall"))))
        return m.select("market_id", F.array_join("t", "|").alias("terms"), F.size("t").alias("n"))


bank_query("l01_primary_terms", "l1", lambda i, c, t, k, s: terms.primary_terms(i, c, t, k))
bank_query("l02_directory_terms", "l2", lambda i, c, t, k, s: terms.directory_terms(i, c))
bank_query("l03_expansion_terms", "l3", lambda i, c, t, k, s: terms.expansion_terms(i, c, t, s))
bank_query("l04_rotation_terms", "l4", lambda i, c, t, k, s: terms.rotation_terms(i, c, t))


@query("l01_l05_term_bank", f"{_BANKS} select market_id, unnest(l5) as term, unnest(range(1, len(l5) + 1))::int as place from l5")
def _(spark, sf):
    m = markets(spark, sf).withColumn("bank", terms.term_bank(*map(F.col, ("industry", "country", "cities", "keywords", "shortfall"))))
    return terms.explode_terms(m, "market_id", "bank")


@query("l03_capped_terms", "with b as (select o_custkey as market_id, o_orderdate as priority, o_orderkey as ord, o_orderpriority || o_orderkey as term from orders), r as (select market_id, term, row_number() over (partition by market_id order by priority, ord, term) as place from b) select market_id, term, place from r where place <= greatest(25, least(80, 2 * (market_id % 50)))")
def _(spark, sf):
    bank = table(spark, sf, "orders").select(F.col("o_custkey").alias("market_id"), F.col("o_orderdate").alias("priority"), F.col("o_orderkey").alias("ord"), F.concat("o_orderpriority", "o_orderkey").alias("term"))
    short = bank.select("market_id").distinct().withColumn("shortfall", F.col("market_id") % 50)
    return terms.capped(bank, short).select("market_id", "term", F.col("place").cast("long").alias("place"))


@query("l06_search_strings", f"with {PARTS} select person, '\"' || first_name || ' ' || last_name || '\" \"@' || domain || '\"' as email_query, 'site:linkedin.com/in/ \"' || p_name || '\"|site:linkedin.com/in/ \"' || string_split(domain, '.')[1] || '\"|site:linkedin.com/in/ \"' || domain || '\"' as profile_queries from parts")
def _(spark, sf):
    names = contacts.search_names(F.concat("p_name", F.lit(" Ltd")), F.lit(""), F.col("domain"))
    return parts(spark, sf).select("person", terms.address_query(F.col("first_name"), F.col("last_name"), F.col("domain")).alias("email_query"), F.array_join(F.transform(names, terms.profile_query), "|").alias("profile_queries"))


def result_pages(spark, sf):
    """Hits by result page: a run's hits in buckets of 20 positions."""
    return hits(spark, sf).withColumn("page", F.concat("run", F.lit("-"), F.floor(F.col("pos") / 20)))


def responses(spark, sf):
    kind = F.when(F.col("pos") % 3 == 0, "ad").when(F.col("pos") % 3 == 1, "Organic").when(F.col("pos") % 3 == 2, "")
    item = F.struct(F.when(F.col("pos") % 5 == 0, "").otherwise(F.col("link")).alias("url"), F.col("title").alias("title"), F.col("snippet").alias("content"), kind.alias("type"), F.col("pos"))
    g = result_pages(spark, sf).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("i")))).alias("l"))
    return g.select("page", F.to_json(F.struct(F.transform("l", lambda x: x["i"]).alias("results"))).alias("body"))


_AT = f"with {HITS}, a as (select *, run || '-' || (pos // 20) as page, row_number() over (partition by run, pos // 20 order by pos) - 1 as place from hits)"


@query("a07_metasearch_source", f"{_AT} select page, place::int as pos, link, title, snippet from a where place < 10 and pos % 5 <> 0")
def _(spark, sf):
    return sources.metasearch(responses(spark, sf), "page", "body", 10)


@query("a08_typed_source", f"{_AT}, g as (select *, row_number() over (partition by page order by place) as rn from a where pos % 5 <> 0 and pos % 3 <> 0) select page, place::int as pos, link from g where rn <= 6")
def _(spark, sf):
    return sources.typed_results(responses(spark, sf), "page", "body", 6).select("page", "pos", "link")


@query("a09_result_page_source", f"{_AT}, g as (select *, row_number() over (partition by page order by place) as rn from a where pos % 4 <> 0) select page, place::int as pos, link, trim(regexp_replace(title, '<[^>]+>', '', 'g')) as title from g where rn <= 6")
def _(spark, sf):
    href = F.when(F.col("pos") % 4 == 0, F.lit("/x")).when(F.col("pos") % 4 == 1, F.col("link")).otherwise(F.concat(F.lit("//r?uddg="), F.url_encode("link"), F.lit("&x=1")))
    h = result_pages(spark, sf).withColumn("a", F.concat(F.lit('<a rel="n" class="result__a" href="'), href, F.lit('">'), "title", F.lit("</a>")))
    page = h.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "a"))), lambda x: x["a"]), "\n").alias("html"))
    return sources.result_page(page, "page", "html", 6)


@query("a10_response_status", "select event_id, case when event_type = 'error' and value > 50 then 'blocked' when event_type = 'error' then 'error' when value > 30 then 'ok' when event_type = 'view' then 'blocked' else 'empty' end as status from events")
def _(spark, sf):
    t, v = F.col("event_type"), F.col("value")
    code = F.when(t == "error", F.when(v > 50, 429).otherwise(500)).otherwise(200)
    return table(spark, sf, "events").select("event_id", sources.response_status(code, F.when(v > 30, 3).otherwise(0), F.when(t == "view", "engine: CAPTCHA").otherwise("")).alias("status"))


@query("a16_run_log", "select event_id, 'TERM' as kind, event_type as query, floor(value)::bigint as raw, event_id % 7 as kept from events where event_type <> 'error'")
def _(spark, sf):
    e = table(spark, sf, "events")
    line = F.when(F.col("event_type") != "error", F.format_string("10:00 TERM '%s' — %d results · %d kept · event %d", "event_type", F.floor("value"), F.col("event_id") % 7, "event_id")).otherwise("noise")
    return sources.parse_run_log(e.select(line.alias("value"), "event_id"), keep=["event_id"])


@query("a17_log_retention", "select event_id from events where ts >= (select max(ts) from events) - interval 7 days")
def _(spark, sf):
    e = table(spark, sf, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    return sources.recent(e.join(newest), "ts", F.col("newest")).select("event_id")
