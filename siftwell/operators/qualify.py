"""Search hits and pages to qualified companies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell import dims
from siftwell.functions import gates, web
from siftwell.operators import extract
from siftwell.operators.dedupe import first_n, first_wins
from siftwell.operators.known import without_known
from siftwell.operators.substrings import holding
from siftwell.scratch import materialize


@dataclass
class Market:
    """What a run looks for; every list can be replaced."""

    country: str = ""
    keywords: list[str] = field(default_factory=lambda: dims.INDUSTRY_KEYWORDS["translation"])
    strong: list[str] | None = None
    tld_country: dict[str, str] = field(default_factory=lambda: dims.TLD_COUNTRY)
    geo: dict[str, tuple] = field(default_factory=lambda: dims.COUNTRY_GEO)
    blocked: list[str] = field(default_factory=list)
    directories: list[str] = field(default_factory=lambda: dims.DIRECTORY_HOSTS)
    text_limit: int | None = 12_000

    @property
    def strong_terms(self) -> list[str]:
        return [k for k in self.keywords if dims.is_strong(k)] if self.strong is None else self.strong

    def blocks(self, url):
        return web.is_blocked(url, social=dims.SOCIAL_HOSTS, junk_subdomains=dims.JUNK_SUBDOMAINS, junk_names=dims.JUNK_NAME_FRAGMENTS, blocked=self.blocked)


def _gated(pages: DataFrame, m: Market, url: str, html: str) -> DataFrame:
    p = web.with_page(pages.withColumn("domain", web.domain_of(F.col(url))), html, limit=m.text_limit)
    p = gates.with_location_gate(p, "geo", F.col("domain"), "body", m.country, m.tld_country, m.geo)
    p = p.withColumns({"_found": web.hits(F.col("body"), m.keywords), "_parked": gates.is_parked(F.col("body"))})
    p = p.withColumn("_industry", gates.industry_evidence_ok(F.col("_found"), m.strong_terms))
    return p.withColumn("_reason", gates.page_reason(F.col("body"), F.col("_parked"), F.col("_industry"), F.col("geo")))


def page_gate(pages: DataFrame, m: Market, url: str = "url", html: str = "html") -> DataFrame:
    """pages with status and reason by the parked, industry and location gates alone."""
    p = _gated(pages, m, url, html)
    return p.select(*pages.columns, gates.page_status(F.col("body"), F.col("_parked"), F.col("_reason").isNull()).alias("status"), F.col("_reason").alias("reason"))


def qualify_pages(pages: DataFrame, m: Market, url: str = "url", html: str = "html", title: str | None = None) -> DataFrame:
    """pages with domain, status, event_status, event_reason, reason, score, tier, reasons, linkedin_url and company_name.

    One narrow stage of a few projections: text and links of the markup, industry gate, location gate, score.  A page that fails
    the industry or location gate, or passes both with a weak score, is stored as rejected and shown as unverified.
    """
    p = _gated(pages, m, url, html).withColumn("linkedin_url", web.profile_url(F.col("links"), F.col("body")))
    p = gates.with_score(p, "s", "body", "links", F.col("linkedin_url"), m.keywords, m.strong_terms, found="_found")
    p = p.withColumn("_status", gates.page_status(F.col("body"), F.col("_parked"), F.col("_reason").isNull() & (F.col("s.tier") != "weak")))
    reason = F.col("_reason")
    status, scored = F.col("_status"), F.col("_status").isin("qualified", "rejected")
    page_title = F.col(title) if title else web.text(F.regexp_extract(web.text(F.col(html)), r"(?is)<title[^>]*>(.*?)</title>", 1))
    passed = [F.lit("shallow_scrape_qualified"), F.lit("industry_evidence_ok"), *([] if gates.gate_off(m.country) else [F.concat(F.lit("geo:"), F.array_join("geo.evidence", ","))])]
    more = F.when(status == "qualified", F.array(*passed)).when(F.startswith(reason, F.lit("geo_fail")), F.array(reason)).otherwise(F.array().cast("array<string>"))
    reasons = F.when(scored, F.concat(F.col("s.reasons"), F.array(F.lit("pages:1"), F.lit("shallow_scrape")), more)).otherwise(F.array(reason))
    return p.select(
        *pages.columns, "domain", status.alias("status"), F.when(status == "rejected", "unverified").otherwise(status).alias("event_status"), gates.event_reason(status, reason).alias("event_reason"), reason.alias("reason"),
        F.when(scored, F.col("s.score")).otherwise(0).alias("score"), F.when(scored, F.col("s.tier")).otherwise("weak").alias("tier"),
        reasons.alias("reasons"), "linkedin_url", web.company_name(F.col("linkedin_url"), F.col("body"), page_title, dims.SEO_WORDS).alias("company_name"),
    )


def screen_hits(hits: DataFrame, known: DataFrame, m: Market) -> DataFrame:
    """hits (link, title, snippet, source, order columns) with domain, priority, keep and reason.  known: domain."""
    k = known.select(F.col("domain").alias("_known")).distinct()
    h = hits.withColumn("domain", web.domain_of(F.col("link"))).join(k, F.col("domain") == F.col("_known"), "left")
    verified = gates.summary_has_industry(F.col("title"), F.col("snippet"), m.keywords, m.strong_terms) & gates.summary_suggests_country(F.col("title"), F.col("snippet"), F.col("domain"), m.country, m.tld_country, m.geo, True)
    priority = gates.hit_priority(F.col("source"), gates.is_directory(F.col("domain"), F.col("title"), m.directories), verified)
    blocked, dup, country = m.blocks(F.col("link")), F.col("_known").isNotNull(), F.lit(m.country)
    hygiene = gates.hygiene_screen(F.col("domain"), blocked, dup, country, m.tld_country)
    loose = gates.loose_screen(F.col("domain"), F.col("title"), F.col("snippet"), blocked, dup, country, m.tld_country)
    h = h.withColumn("priority", priority).withColumn("reason", F.when(F.col("priority").isin(0, 1, 3), hygiene).otherwise(loose))
    return h.withColumn("keep", F.col("reason").isNull()).drop("_known")


def verified_rows(hits: DataFrame) -> DataFrame:
    """Rows for hits that a panel or their own summary vouches for: qualified without a page, score 70."""
    tags = F.create_map(*[x for k, v in dims.VERIFIED_TAGS.items() for x in (F.lit(k), F.lit(v))])
    tag = F.coalesce(F.try_element_at(tags, F.col("source")), F.lit("ai_overview_verified"))
    return hits.select("domain", F.lit("qualified").alias("status"), F.lit(70).alias("score"), F.lit("strong").alias("tier"), F.array(tag).alias("reasons"))


def decide_hits(hits: DataFrame, known: DataFrame, m: Market, page_order: list[str], order: list[str]) -> DataFrame:
    """domain, decision, priority, source, reason of each domain that known (domain) does not hold and that a hit decides on.

    Result pages come one after another (page_order); on a page, panels, directories' companies and hits that their own summary
    vouches for come before normal hits, and a domain that one of them names is not looked at among the page's normal hits.  The
    first hit that decides counts, and decides for good: 'vouched' (hygiene passed), 'page' (its page is to be read), 'failed' (junk
    or a foreign TLD) or 'blocked'.  Hits on directories themselves decide nothing.  Two aggregates, first by page and
    domain, then by domain; both combine before they shuffle.
    """
    h = without_known(hits.withColumn("domain", web.domain_of(F.col("link"))).where("domain <> ''"), "domain", known)
    s = screen_hits(h.drop("domain"), known.limit(0), m)
    vouched = F.col("priority").isin(0, 1, 3)
    junk = (F.col("reason") == "foreign_cctld") | (~vouched & F.col("reason").isin("serp_junk", "junk_title"))
    decision = F.when(F.col("priority") != 2, F.when(F.col("reason").isNull(), F.when(vouched, "vouched").otherwise("page")).when(F.col("reason") == "blocked", "blocked").when(junk, "failed"))
    s = s.withColumn("decision", decision)
    place = list(dict.fromkeys(page_order))
    one = F.struct("decision", "priority", "source", "reason")
    on_page = s.groupBy(*place, "domain").agg(F.min("priority").alias("_least"), F.min_by(one, F.when(F.col("decision").isNotNull(), F.struct("priority", *order))).alias("_d"))
    on_page = on_page.where("_d is not null and (_d.priority < 9 or _least = 9)")
    return on_page.groupBy("domain").agg(F.min_by("_d", F.struct(*place)).alias("_d")).select("domain", "_d.*")


def qualify_decided(decided: DataFrame, pages: DataFrame | None, m: Market) -> DataFrame:
    """domain, status, score, tier, reasons of decided domains: vouched ones at once, 'page' ones by their first page of pages (url,
    html) or, without pages, as discovered; failed and blocked ones with their reason."""
    v = verified_rows(decided.where("decision = 'vouched'").withColumn("source", F.when(F.col("priority") == 3, "serp_summary").otherwise(F.col("source"))))
    out = decided.where("decision in ('failed', 'blocked')").select("domain", F.col("decision").alias("status"), F.lit(0).alias("score"), F.lit("weak").alias("tier"), F.array("reason").alias("reasons"))
    rest = decided.where("decision = 'page'").select("domain")
    if pages is None:
        return v.unionByName(out).unionByName(rest.select("domain", F.lit("discovered").alias("status"), F.lit(0).alias("score"), F.lit("weak").alias("tier"), F.array().cast("array<string>").alias("reasons")))
    page = first_wins(pages.withColumn("domain", web.domain_of(F.col("url"))).select("domain", "url", "html").join(rest, "domain", "left_semi"), ["domain"], ["url"]).join(rest, "domain", "right")
    read = qualify_pages(page.select(F.col("domain").alias("url"), "html"), m).select("domain", "status", "score", "tier", "reasons")
    return v.unionByName(out).unionByName(read)


def qualify_hits(hits: DataFrame, pages: DataFrame, known: DataFrame, m: Market, page_order: list[str], order: list[str]) -> DataFrame:
    """domain, status, score, tier, reasons for the hits' new domains, each once (see decide_hits); pages are read only for
    those that need them."""
    return qualify_decided(materialize(decide_hits(hits, known, m, page_order, order), "decided"), pages, m)


#: pairs of a result page's names and results up to which they are compared one by one
PAGE_PAIRS = 1 << 16


def resolve_names(names: DataFrame, results: DataFrame, page: list[str], m: Market) -> DataFrame:
    """Best result URL for company names of one result page: the host's first label holds the name's slug, lies in it or
    holds a word of four letters (rank 0), or the title holds the name or its first two such words (rank 1); then the
    shorter host, then rank 0's later result or rank 1's earlier one.  Blocked hosts do not count.  names: page + name; results:
    page + link, title, pos."""
    return names.join(best_links(names, results, page, m), [*page, "name"], "left")


def best_links(names: DataFrame, results: DataFrame, page: list[str], m: Market) -> DataFrame:
    """page, name, link of the names that resolve_names finds a URL for.  Names and results of a page of up to PAGE_PAIRS pairs are
    joined by the page and compared; on larger pages they meet where they share a run of characters (see substrings), so a page with
    very many of both makes no product of them.  Both are written once, and no side of the join is broadcast: written texts are
    many times smaller than in memory."""
    n = materialize(names.select(*page, "name").distinct().where(F.trim("name") != ""), "names")
    words = F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    r = results.where(~m.blocks(F.col("link"))).withColumn("_host", web.domain_of(F.col("link")))
    r = materialize(r.select(*page, "link", "pos", F.length("_host").alias("_size"), web.company_slug(F.substring_index("_host", ".", 1)).alias("_label"), F.lower(web.text(F.col("title"))).alias("_title")), "results")
    sizes = n.groupBy(*page).agg(F.count("*").alias("_n")).join(r.groupBy(*page).agg(F.count("*").alias("_r")), page)
    large = materialize(sizes.where(F.col("_n") * F.col("_r") > PAGE_PAIRS).select(*page), "large-pages")
    n = n.withColumns({"_slug": web.company_slug(F.col("name")), "_words": words, "_low": F.trim(F.lower("name"))})
    j = None
    if large.limit(1).count():
        j = _pairs_by_runs(n.join(large, page, "left_semi"), r.join(large, page, "left_semi"), page)
        n, r = n.join(large, page, "left_anti"), r.join(large, page, "left_anti")
    by_host = F.exists("_words", lambda w: F.contains("_label", w)) | ((F.col("_slug") != "") & (F.contains("_label", "_slug") | F.contains("_slug", "_label")))
    two = (F.size("_words") > 0) & F.forall(F.slice("_words", 1, 2), lambda w: F.contains("_title", w))
    by_title = (F.col("_title") != "") & (F.contains("_title", "_low") | two)
    few = n.hint("merge").join(r, page).withColumn("_rank", F.when(by_host, 0).when(by_title, 1)).where("_rank is not null").select(*page, "name", "link", "pos", "_size", "_rank")
    j = few if j is None else few.unionByName(j)
    return j.groupBy(*page, "name").agg(F.min_by("link", F.struct("_rank", "_size", F.when(F.col("_rank") == 0, -F.col("pos")).otherwise(F.col("pos")), "link")).alias("link"))


def _pairs_by_runs(n: DataFrame, r: DataFrame, page: list[str]) -> DataFrame:
    """page, name, link, pos, _size, _rank of the pairs that best_links compares, by runs of characters."""
    slugs = n.where("_slug <> ''")
    in_label = n.select(*page, "name", F.explode(F.array_distinct(F.concat(F.filter(F.array("_slug"), lambda s: s != ""), "_words"))).alias("_part"))
    in_title = n.select(*page, "name", F.explode(F.concat(F.array(F.struct(F.col("_low").alias("part"), F.array().cast("array<string>").alias("more"))), F.transform(F.slice("_words", 1, 1), lambda w: F.struct(w.alias("part"), F.slice("_words", 2, 1).alias("more"))))).alias("_w"))
    in_title = in_title.select(*page, "name", F.col("_w.part").alias("_part"), F.col("_w.more").alias("_more"))
    by_host = holding(r, in_label, page, "_label", "_part").select(*page, "name", "link", "pos", "_size")
    in_slug = holding(slugs.select(*page, "name", "_slug"), r, page, "_slug", "_label").select(*page, "name", "link", "pos", "_size")
    titled = holding(r.where("_title <> ''"), in_title, page, "_title", "_part").where(F.forall("_more", lambda w: F.contains("_title", w))).select(*page, "name", "link", "pos", "_size")
    return by_host.unionByName(in_slug).withColumn("_rank", F.lit(0)).unionByName(titled.withColumn("_rank", F.lit(1)))


def merge_panel_rows(panel: DataFrame, results: DataFrame, page: list[str], m: Market, snippet_limit: int = 500, source: str = "ai_overview") -> DataFrame:
    """page, domain, pos, link, title, snippet, source of panel rows with a name that resolves to a URL that is not blocked,
    first per domain.  The panel's own links count as candidates for all of its names, where the host resembles a name.
    panel: page + pos, name, link, snippet; results: page + link, title, pos."""
    named = panel.where(F.trim(web.text(F.col("name"))) != "")
    own = panel.where(web.text(F.col("link")).startswith("http")).select(*page, "link", F.lit("").alias("title"), (F.col("pos") - 1_000_000_000).alias("pos"))
    found = best_links(named, results.select(*page, "link", "title", "pos").unionByName(own), page, m)
    p = named.drop("link").join(found, [*page, "name"]).where("link is not null").withColumn("domain", web.domain_of(F.col("link")))
    p = p.select(*page, "domain", "pos", "link", F.trim("name").alias("title"), F.substring(web.text(F.col("snippet")), 1, snippet_limit).alias("snippet"), F.lit(source).alias("source"))
    return first_wins(p.where("domain <> ''"), [*page, "domain"], ["pos"])


def classify_companies(pages: DataFrame, verdicts: DataFrame, body: str = "body", keywords: list[str] | None = None) -> DataFrame:
    """domain, company_type, method, hits: two keywords make an lsp, an empty page a client, else the supplied verdict."""
    found = F.size(web.hits(F.col(body), keywords or dims.LSP_KEYWORDS))
    v = verdicts.select(F.col("domain"), F.col("company_type").alias("_given"))
    j = pages.join(v, "domain", "left")
    kind = F.when(found >= 2, "lsp").when(F.trim(web.text(F.col(body))) == "", "client").otherwise(F.coalesce("_given", F.lit("client")))
    method = F.when(found >= 2, "keywords").when(F.trim(web.text(F.col(body))) == "", "default (no homepage text)").otherwise("external")
    return j.select("domain", kind.alias("company_type"), method.alias("method"), found.alias("hits"))


def merge_pages(pages: DataFrame, keys: list[str], order: list[str], limit: int = 24_000, most_links: int = 500) -> DataFrame:
    """keys, body, links: a site's pages as one, bodies joined by a blank line and cut at the feature's limit, links first
    of each.  Only pages that begin before the limit bring their bodies, and first links are ranked before they meet, so
    that a site with very many pages stays small in one row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum(F.length("body") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = pages.select(*keys, *order, "body").withColumn("_before", before).where(F.col("_before") < limit)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "body"))), lambda x: x["body"]), "\n\n")
    bodies = near.groupBy(*keys).agg(F.substring(joined, 1, limit).alias("body"))
    each = pages.select(*keys, *order, F.posexplode("links").alias("_at", "_link"))
    firsts = first_n(first_wins(each, [*keys, "_link"], [*order, "_at"]), keys, [*order, "_at"], most_links)
    links = firsts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, "_at", "_link"))), lambda x: x["_link"]).alias("links"))
    return bodies.join(links, keys, "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


def mine_directories(hits: DataFrame, pages: DataFrame, m: Market, page: list[str], listed: str | None = "snippet") -> DataFrame:
    """page, pos, link, title, snippet, source ('directory') of the companies that hits on directories list, from the lists in their
    column `listed` (None: from none) and their pages; names without a link are resolved against the result page.  hits: page + pos,
    link, title and that column; pages: url, html."""
    d = hits.where(gates.is_directory(web.domain_of(F.col("link")), F.col("title"), m.directories)).withColumn("_dir", F.concat_ws("|", *page, "pos"))
    read = d.join(first_wins(pages.select("url", "html"), ["url"], ["html"]).withColumnRenamed("html", "_html"), F.col("link") == F.col("url"), "left")
    names = extract.listed_names(d, "_dir", listed) if listed else d.select("_dir", F.lit(0).alias("pos"), F.lit("").alias("name")).limit(0)
    linked = extract.directory_companies(read, "_dir", "link", "_html", m.blocks)
    organic = d.select("_dir", *page).join(hits.select(*page, "link", "title", "pos"), page)
    found = extract.scraped_companies(names, linked, organic, "_dir", m).withColumnRenamed("pos", "_at")
    return found.join(d.select("_dir", *page, "pos"), "_dir").select(*page, "pos", "link", "title", "snippet", "source")


def qualify_run(hits: DataFrame, pages: DataFrame, table: DataFrame, blocked: DataFrame, m: Market, page: list[str], page_order: list[str], listed: str | None = "snippet") -> tuple[DataFrame, DataFrame]:
    """(table of domains: domain, status, score, tier; blocked hosts: domain) after a run over hits: directories are mined, each new
    domain is decided on once, the batch is written without demotions, and blocked hosts are noted so that later runs pass
    them by.  hits: page + pos, link, title, snippet, source and page_order; listed: see mine_directories."""
    from siftwell.operators import state

    mined = mine_directories(hits, pages, m, page, listed).join(hits.select(*page, *page_order).distinct(), page)
    mined = materialize(mined.select(*page, *[c for c in page_order if c not in page], "pos", "link", "title", "snippet", "source"), "mined")
    every = hits.select(*mined.columns).unionByName(mined)
    found = materialize(qualify_hits(every, pages, table.select("domain").union(blocked.select("domain")), m, page_order, ["pos", "link"]), "found")
    provided = F.array(*map(F.lit, ("status", "score", "tier")))
    updates = found.where("status <> 'blocked'").select(F.lit(0).alias("seq"), "domain", "status", "score", "tier", provided.alias("provided"))
    after = state.upsert(table, state.without_demotions(table, updates, "domain"), "domain", ["status", "score", "tier"])
    return after, blocked.select("domain").union(found.where("status = 'blocked'").select("domain")).distinct()
