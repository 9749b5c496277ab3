"""Frames that the registered queries share, in Spark and as SQL.

The driver's tables stand for the engine's own: pages for site pages and result URLs, documents for titles and
snippets, customers for people, nations for companies, orders for updates, events for run events.  Word lists and
country tables are parameters fitted to the invented vocabulary.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.qualify import Market
from siftwell.scratch import scratch_dir

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

KEYWORDS = ["the", "thion", "and", "der", "und", "que", "les", "tion", "heit", "ment"]
STRONG = ["und", "que", "tion", "heit"]
TLDS = {".com": "Alpha", ".org": "Beta", ".net": "Gamma", ".example.net": "Delta"}
GEO = {"Alpha": ("+1", ["thre", "erst"], ["thon", "der", "le"]), "Beta": ("+1", ["und"], ["ist"])}
JUNK = ["anan", "ouer"]
LISTS = ["tion "]
MARKET = Market(country="Alpha", keywords=KEYWORDS, strong=STRONG, tld_country=TLDS, geo=GEO, blocked=["thst.example.com", "example.info"], directories=["ththth.example.net", "thther.example.org"], text_limit=None)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A folder of the shared scratch space for state that a query keeps between batches; it goes when the application ends."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows, one a document: its first line as title, its text as snippet and the URL of a page, dealt in turn."""
    p, d = table(spark, sf, "pages"), table(spark, sf, "documents")
    return d.join(p, d["doc_id"] % p.count() == p["page_id"]).select(
        F.col("doc_id").alias("pos"), F.col("url").alias("link"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("text").alias("snippet"), F.col("lang").alias("run"),
        F.when(F.col("source") == "src1", "ai_overview").when(F.col("source") == "src2", "local_pack").otherwise("web").alias("source"), "html",
    )


HITS = """hits as (select d.doc_id as pos, p.url as link, split_part(d.text, chr(10), 1) as title, d.text as snippet, d.lang as run,
  case d.source when 'src1' then 'ai_overview' when 'src2' then 'local_pack' else 'web' end as source, p.html from documents d join pages p on p.page_id = d.doc_id % (select count(*) from pages))"""


def sql_domain(c: str) -> str:
    u = f"trim(coalesce({c}, ''))"
    return f"(case when contains({u}, '@') then lower(list_last(string_split({u}, '@'))) else lower(replace(regexp_extract({u}, '^(?:[^:/?#]+://)?([^/?#]*)', 1), 'www.', '')) end)"


def sql_suffixes(h: str) -> str:
    p = f"string_split({h}, '.')"
    return f"list_transform(range(2, len({p}) + 1), lambda i: '.' || array_to_string({p}[i:], '.'))"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_any(c: str, values: list[str]) -> str:
    return f"(len(list_filter({sql_list(values)}, lambda k: contains(lower(coalesce({c}, '')), k))) > 0)"


def sql_hits(c: str, values: list[str]) -> str:
    return f"list_filter({sql_list(values)}, lambda k: contains(lower(coalesce({c}, '')), k))"


def sql_below(h: str, values: list[str]) -> str:
    return f"(len(list_intersect(list_append({sql_suffixes(h)}, '.' || {h}), {sql_list(['.' + v for v in values])})) > 0)"


_TABLE = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in TLDS.items()) + "}"


def sql_tld(h: str) -> str:
    """Longest listed TLD, NULL if none."""
    return f"list_filter({sql_suffixes(h)}, lambda s: map_contains({_TABLE}, s))[1]"


def sql_country(h: str) -> str:
    return f"coalesce({_TABLE}[{sql_tld(h)}], '')"


def sql_foreign(h: str, country: str) -> str:
    return f"(case when {sql_tld(h)} is not null and {_TABLE}[{sql_tld(h)}] <> '{country}' then {sql_tld(h)} else '' end)"


def sql_shown(c: str) -> str:
    """Markup without scripts, styles and noscript."""
    x = f"coalesce({c}, '')"
    for t in ("script", "style", "noscript"):
        x = rf"regexp_replace({x}, '<{t}[^>]*>.*?</{t}>', ' ', 'gis')"
    return x


def sql_body(c: str) -> str:
    """html_to_text without its limit."""
    x = sql_shown(c)
    title = rf"case when regexp_matches({x}, '(?is)<title[^>]*>.*?</title>') then trim(regexp_replace(regexp_extract({x}, '<title[^>]*>(.*?)</title>', 1, 'is'), '\s+', ' ', 'g')) end"
    named, valued = """name=["'']description["'']""", """content=["'']([^"'']+)"""
    about = rf"""trim(coalesce(nullif(regexp_extract({x}, '<meta[^>]+{named}[^>]+{valued}', 1, 'i'), ''), nullif(regexp_extract({x}, '<meta[^>]+{valued}["''][^>]+{named}', 1, 'i'), '')))"""
    body = rf"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
    whole = f"array_to_string(list_filter([{title}, {about}, {body}], lambda s: s is not null), ' ')"
    return f"(case when length({whole}) >= 80 then {whole} end)"


def sql_links(c: str) -> str:
    return rf"""list_filter(regexp_extract_all({sql_shown(c)}, 'href=["'']([^"''#\s]+)["'']', 1), lambda u: starts_with(u, 'http') or (starts_with(u, '/') and not starts_with(u, '//')))[1:300]"""


def sql_absolute(u: str, host: str) -> str:
    return f"(case when regexp_matches({u}, '(?i)^https?://') then {u} when starts_with({u}, '//') then 'https:' || {u} when starts_with({u}, '/') then 'https://' || {host} || {u} else 'https://' || {host} || '/' || {u} end)"


def sql_within(u: str, host: str) -> str:
    h = f"string_split(regexp_replace(lower(regexp_extract({u}, '(?i)^https?://([^/]*)', 1)), '^www\\.', ''), ':')[1]"
    return f"({h} = {host} or ends_with({h}, '.' || {host}))"


def sql_blocked(h: str, m: Market = MARKET) -> str:
    from siftwell import dims

    p = f"string_split({h}, '.')"
    subs = " or ".join(f"starts_with({h}, '{s}')" for s in dims.JUNK_SUBDOMAINS)
    return (
        f"({h} = '' or {h} = 'translate.google' or starts_with({h}, 'translate.google.') or regexp_matches({h}, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') or {sql_below(h, dims.SOCIAL_HOSTS)} or {p}[-1] in ('mil', 'gov', 'edu')"
        f" or coalesce(len({p}) >= 3 and {p}[-2] in ('gov', 'edu'), false) or {subs} or {sql_any(p + '[1]', dims.JUNK_NAME_FRAGMENTS)} or {sql_below(h, m.blocked)})"
    )


def sql_token(body: str, needle: str) -> str:
    return f"contains({body}, '{needle}')" if " " in needle else f"regexp_matches({body}, '(^|[^a-z0-9]){needle}($|[^a-z0-9])')"


def sql_any_token(body: str, needles: list[str]) -> str:
    return "(" + " or ".join(sql_token(body, n) for n in needles) + ")"


def sql_resolved(names: str, results: str, key: str) -> str:
    """CTEs that give found (key, name, link) for distinct names and results (key, link, title, pos)."""
    return rf"""rn_n as (select distinct {key}, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as slug, list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: length(w) >= 4) as words, trim(lower(name)) as low from {names} where trim(name) <> ''),
rn_d as (select *, {sql_domain('link')} as domain from {results}), rn_r as (select *, regexp_replace(string_split(domain, '.')[1], '[^a-z0-9]', '', 'g') as label, lower(coalesce(title, '')) as t from rn_d where not {sql_blocked('domain')}),
rn_j as (select n.{key}, n.name, r.link, r.domain, r.pos, case when (slug <> '' and (contains(slug, label) or contains(label, slug))) or len(list_filter(words, lambda w: contains(label, w))) > 0 then 0 when t <> '' and (contains(t, low) or (len(words) > 0 and len(list_filter(words[1:2], lambda w: not contains(t, w))) = 0)) then 1 end as rank from rn_n n join rn_r r using ({key})),
found as (select {key}, name, arg_min(link, (rank, length(domain), case when rank = 0 then -pos else pos end, link)) as link from rn_j where rank is not null group by 1, 2)"""


def sql_merged(panel: str, results: str, key: str, source: str) -> str:
    """CTEs that give merged: panel rows (key, pos, name, link, snippet) by the domain that their names resolve to."""
    both = f"select {key}, link, title, pos from {results} union all select {key}, link, '', pos - 1000000000 from {panel} where starts_with(link, 'http')"
    return f"""rn_all as ({both}), {sql_resolved(panel, 'rn_all', key)}, rn_p as (select p.{key}, pos, f.link, trim(name) as title, substr(coalesce(snippet, ''), 1, 500) as snippet, {sql_domain('f.link')} as domain from {panel} p join found f using ({key}, name)),
merged as (select {key}, domain, min(pos) as pos, arg_min(link, pos) as link, arg_min(title, pos) as title, arg_min(snippet, pos) as snippet, '{source}' as source from rn_p where domain <> '' group by 1, 2)"""
