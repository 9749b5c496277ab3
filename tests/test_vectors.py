"""Small cases of the gates, names, addresses and tables."""

import pytest
from pyspark.sql import functions as F

from siftwell import dims
from siftwell.functions import contacts, gates, web
from siftwell.operators import emails, extract, qualify, state, terms
from siftwell.operators.dedupe import first_wins
from siftwell.operators.suffixes import longest_suffix

KW = dims.INDUSTRY_KEYWORDS["translation"]
STRONG = [k for k in KW if dims.is_strong(k)]


def value(spark, column, **row):
    """A column over one row of strings or arrays; every run has one narrow task."""
    names = list(row) or ["x"]
    df = spark.createDataFrame([tuple(row.values()) or ("x",)], ", ".join(f"{n} {'array<string>' if isinstance(row.get(n), list) else 'string'}" for n in names))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://x.com/@Foo", "foo"), ("HTTP://www.A.com/p?q#f", "a.com"), ("a.www.b.org", "a.b.org"), ("http://WWW.a.com", "www.a.com"), ("http://a.com:8080/x", "a.com:8080"),
        ("me@Mail.example.com", "mail.example.com"), ("", ""), (None, ""),
    ],
)
def test_domain(spark, url, want):
    assert value(spark, web.domain_of(F.col("u")), u=url) == want


@pytest.mark.parametrize("host,country,want", [("a.com.au", "Egypt", ".com.au"), ("a.com.au", "Australia", ""), ("a.com", "Egypt", ""), ("a.eg", "All Countries", ""), ("localhost", "Egypt", ""), ("x.com.eg", "Germany", ".eg")])
def test_foreign_tld(spark, host, country, want):
    assert value(spark, web.foreign_tld(F.col("h"), F.lit(country), dims.TLD_COUNTRY), h=host) == want


@pytest.mark.parametrize("url,want", [("https://linkedin.com/x", True), ("https://de.linkedin.com", True), ("https://notlinkedin.com", False), ("http://10.0.0.1/", True), ("http://blog.a.com", True), ("http://a.gov", True), ("http://a.edu.eg", True), ("http://edu.eg", False), ("", True), ("http://acme.com", False), ("https://translate.google.de/x", True), ("https://translate.google", True), ("https://translates.com", False), ("http://sub.blocked.example", True)])
def test_blocked(spark, url, want):
    assert value(spark, qualify.Market(blocked=["blocked.example"]).blocks(F.col("u")), u=url) is want


@pytest.mark.parametrize("score,want", [(80, "strong"), (60, "strong"), (59, "possible"), (30, "possible"), (29, "weak"), (0, "weak")])
def test_tier(spark, score, want):
    assert value(spark, gates.tier(F.lit(score))) == want


def scored(spark, body, links):
    return value(spark, gates.score_page(F.col("b"), F.col("l"), F.lit(""), KW, STRONG), b=body, l=links)


def test_score(spark):
    good = scored(spark, "Certified translation agency. Language services, interpreting, localization, subtitling.", ["/", "/contact", "/about", "/services"])
    assert good["tier"] == "strong" and good["score"] >= 60 and "has contact page" in good["reasons"]
    off = scored(spark, "We sell bricks", ["/contact", "/about"])
    assert (off["score"], off["tier"], off["reasons"]) == (0, "weak", ["missing industry keywords"])
    none = scored(spark, None, [])
    assert (none["score"], none["tier"], none["reasons"]) == (0, "weak", [])
    stuffed = scored(spark, " ".join(KW[:9] * 5), [])
    assert stuffed["score"] <= 50
    one = scored(spark, "our language", ["/kontakt"])
    assert one["tier"] == "weak" and one["score"] <= 29 and "insufficient industry evidence" in one["reasons"]


@pytest.mark.parametrize(
    "host,body,country,ok,evidence",
    [
        ("a.eg", "", "Egypt", True, ["ccTLD .eg"]), ("a.de", "cairo egypt", "Egypt", False, ["foreign ccTLD .de -> Germany"]), ("a.com", "We are based in Egypt", "Egypt", True, ["HQ phrase 'egypt'"]), ("a.com", "Based in Egypt: Cairo, (+20) 2 1234 5678", "Egypt", True, ["HQ phrase 'egypt'", "city 'cairo'", "phone +20 number"]),
        ("a.com", "office in Cairo, +20 2 1234 5678", "Egypt", True, ["city 'cairo'", "phone +20 number"]), ("a.com", "Giza, Egypt", "Egypt", True, ["city 'giza'"]),
        ("a.com", "Giza only", "Egypt", False, ["city 'giza'", "city alone without country/HQ (ignored)"]), ("a.com", "Call (+20) now", "Egypt", False, ["phone +20 code-only (ignored)", "need city or HQ (phone alone insufficient)"]), ("a.com", "0020 2 1234 5678", "Egypt", False, ["phone +20 number", "need city or HQ (phone alone insufficient)"]),
        ("a.com", "preliminary talks", "Peru", False, ["no local address / phone / city"]), ("a.com", "made in bulgaria", "Bulgaria", True, ["name 'Bulgaria'"]), ("a.com", "x", "", True, ["location gate off"]),
    ],
)
def test_location_gate(spark, host, body, country, ok, evidence):
    got = value(spark, gates.location_gate(F.col("h"), F.col("b"), country, dims.TLD_COUNTRY, dims.COUNTRY_GEO), h=host, b=body)
    assert (got["ok"], got["evidence"]) == (ok, evidence)


@pytest.mark.parametrize("text,want", [("+20 1234567", True), ("+20 123456", False), ("x5+20 1234567", False), ("0020-10-1234567", True), (None, False)])
def test_phone(spark, text, want):
    assert value(spark, gates.has_local_phone(F.col("t"), "+20"), t=text) is want


@pytest.mark.parametrize("email,want", [("info@a.com", True), ("info123@a.com", True), ("info1234@a.com", False), ("hiro@a.com", True), ("hirohi@a.com", False)])
def test_generic(spark, email, want):
    assert value(spark, contacts.is_generic(F.col("e")), e=email) is want


@pytest.mark.parametrize("name,want", [("José Ñandú", "josenandu"), ("O'Brien-Smith", "obriensmith"), (None, ""), ("Øre", "re"), ("Nguyễn", "nguyen"), ("ﬁona", "fiona")])
def test_norm_name(spark, name, want):
    assert value(spark, contacts.norm_name(F.col("n")), n=name) == want


@pytest.mark.parametrize("name,want", [("Ann Lee", True), ("Ann", False), ("Ann lee", False), ("Ann B C D E", False), ("Our Team", False), ("Ann Lee2", False), ("Ann Jr", False)])
def test_valid_name(spark, name, want):
    assert value(spark, contacts.is_valid_name(F.col("n")), n=name) is want


@pytest.mark.parametrize("layer,verified,want", [("L1-Site", False, True), ("L4-Search", None, True), ("L2-EFmt", True, True), ("L2-EFmt", False, False), ("L9", True, False)])
def test_lead_gate(spark, layer, verified, want):
    assert value(spark, contacts.is_confirmed(F.lit("a@b.c"), F.lit(layer), F.lit(verified).cast("boolean"))) is want


def test_profile_name(spark):
    read = lambda t: tuple(value(spark, contacts.profile_name(F.col("t")), t=t))
    assert read("Ann Lee - Vendor Manager at Acme | Site") == read("Ann Lee – Vendor Manager – Acme LinkedIn") == ("Ann Lee", "Vendor Manager")
    assert read("Ann Lee | LinkedIn") == ("Ann Lee", "")


@pytest.mark.parametrize("first,last,want", [("Ann", "", ("Ann", "")), ("", "", ("Mary", "Lee")), (" ", None, ("Mary", "Lee")), ("Ann", "Poe", ("Ann", "Poe"))])
def test_split_name(spark, first, last, want):
    cols = (F.lit("Mary Ann Lee"), F.lit(first), F.lit(last).cast("string"))
    assert (value(spark, contacts.first_name(*cols)), value(spark, contacts.last_name(*cols))) == want


@pytest.mark.parametrize("said,want", [("a past employee of", True), ("alumna", True), ("used to work here", True), ("previous", False), ("informers", False), ("formerly", False), (None, False)])
def test_former(spark, said, want):
    assert value(spark, contacts.is_former(F.col("t")), t=said) is want


@pytest.mark.parametrize(
    "name,url,domain,want",
    [
        ("Acme Group", "https://linkedin.com/company/acme_lang-x/?a=1", "the-acme.co.uk", ["Acme", "acme lang x", "the acme", "the-acme.co.uk"]), ("acme.com", "", "acme.com", ["acme", "acme.com"]),
        ("Acme, corporation", None, "", ["Acme"]), ("acme.com", "", "", ["acme.com"]), (None, None, None, []),
    ],
)
def test_search_names(spark, name, url, domain, want):
    s = lambda v: F.lit(v).cast("string")
    assert value(spark, contacts.search_names(s(name), s(url), s(domain))) == want


@pytest.mark.parametrize("name,want", [("Ann Lee", True), ("LinkedIn Member", False), ("Ann", False), ("Ann L.", False), ("Ann Phd", False), ("Ann Lee 2", False)])
def test_profile_person(spark, name, want):
    assert value(spark, contacts.is_profile_name(F.col("n")), n=name) is want


@pytest.mark.parametrize("target,want", [(10, (60, 15, 10)), (25, (75, 24, 10)), (30, (120, 24, 10)), (60, (300, 48, 10)), (100, (500, 80, 12)), (2000, (8000, 150, 25))])
def test_budgets(spark, target, want):
    t = F.lit(target)
    assert tuple(value(spark, f(t)) for f in (gates.check_budget, gates.max_pages, gates.meta_pages)) == want


@pytest.mark.parametrize("host,want", [("ox.ac.uk", None), ("a.gov.uk", "serp_junk"), ("a.mil", "serp_junk"), ("gov.uk", None), ("a.edu", "serp_junk")])
def test_state_hosts(spark, host, want):
    no = F.lit(False)
    assert value(spark, gates.loose_screen(F.col("h"), F.lit("some title"), F.lit("x"), no, no, F.lit(""), dims.TLD_COUNTRY), h=host) == want


@pytest.mark.parametrize("title,want", [("Company rankings 2024", True), ("Best translation companies in", True), ("Translation firms in", True), ("Reviews", False), (None, False)])
def test_directory_titles(spark, title, want):
    assert value(spark, gates.is_directory(F.lit("a.com"), F.lit(title).cast("string"))) is want


def test_page_text_and_links(spark):
    page = """<html><head><title> A
 b </title><meta content="About us." name="description"><script>x='<a href="/no">'</script></head><body>""" + "word " * 20 + """<a href="/a b">x</a><a href='/c'>y</a><a href="//z.com">z</a><a href="http://q.com/r#s">q</a></body></html>"""
    assert value(spark, web.html_to_text(F.col("h")), h=page) == "A b About us. A b " + "word " * 20 + "x y z q"
    assert value(spark, web.links_of(F.col("h")), h=page) == ["/c"]
    assert value(spark, web.html_to_text(F.col("h")), h="<p>short</p>") is None


def test_internal_pages_and_high_value_urls(spark):
    links = ["/", "/About/", "https://www.a.com:8080/about?x=1", "https://b.a.com/Team", "http://other.com/contact", "/logo.png", "mailto:x@a.com", "contact", "/services#top"]
    assert value(spark, web.internal_pages(F.col("l"), F.lit("www.A.com"), dims.ASSET_EXTENSIONS), l=links) == 5
    got = value(spark, web.high_value_urls(F.col("l"), F.lit("a.com"), dims.PATH_HINTS), l=links)
    assert [(r["score"], r["url"]) for r in got] == [(100, "https://a.com/About/"), (97, "https://a.com/services"), (95, "https://a.com/contact")]
    assert value(spark, web.profile_url(F.array().cast("array<string>"), F.col("b")), b="see https://www.linkedin.com/company/a-b/) now") == "https://www.linkedin.com/company/a-b"


def test_email_patterns(spark):
    d = {r["local_part"]: r["pattern"] for r in emails.example_patterns(spark).collect()}
    assert d["john.smith"] == "first.last" and d["jsmith"] == "flast" and d["smith"] == "last"


def column(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def test_addresses(spark):
    text = "Mail Ann.Lee@A.com or bob [at] a.com, cy at a.com, DEE AT b.org; x@a.com.eg, ann.lee@a.com"
    df = spark.createDataFrame([(1, text, "a.com"), (2, None, "a.com")], "k int, t string, d string")
    assert column(extract.addresses(df, "k", "t", "d").orderBy("k", "pos"), "k", "email") == [(1, "ann.lee@a.com"), (1, "x@a.com"), (1, "bob@a.com"), (1, "cy@a.com")]
    assert "dee@b.org" in column(extract.addresses(df, "k", "t"), "email")


@pytest.mark.parametrize(
    "snippet,want",
    [
        ("List of Translation Service Providers in Egypt Bayan-tech · Ali Saad Agency for Translation Services · DB Group · saudisoft", ["Bayan-tech", "Ali Saad Agency for Translation Services", "DB Group", "saudisoft"]),
        ("1. Milestone localization 2. GTE Localize 3. Globalization Partners International GPI 4. Bayan-tech", ["Milestone localization", "GTE Localize", "Globalization Partners International GPI", "Bayan-tech"]),
        ("Members: Alpha • read more • beta 12 • Alpha • 99 red • reviews of all", ["Alpha", "beta"]), ("no list here", []), (None, []),
    ],
)
def test_listed_names(spark, snippet, want):
    got = extract.listed_names(spark.createDataFrame([(1, snippet)], "k int, s string"), "k", "s")
    assert column(got.orderBy("pos"), "name") == want


MARKET = qualify.Market(country="", blocked=dims.DIRECTORY_HOSTS)
DIRECTORY = """<html><body><h2>1. Bayan-tech</h2><a href="https://www.bayantech.com/">Visit Website</a><h2>2. Future Trans</h2><a href="https://future-trans.com/about">Future Trans</a>
<a href="https://clutch.co/profile/x">Other directory</a><a href="/inside">Inside</a><a href="mailto:x@y.z">Mail us</a></body></html>"""


def test_directory_companies(spark):
    df = spark.createDataFrame([(1, "https://www.goodfirms.co/directory/egypt", DIRECTORY)], "k int, u string, h string")
    got = extract.directory_companies(df, "k", "u", "h", MARKET.blocks)
    assert column(got.orderBy("pos"), "name", "link") == [("Bayantech", "https://www.bayantech.com/"), ("Future Trans", "https://future-trans.com/about"), ("Bayan-tech", "")]


def test_mining_a_directory(spark):
    hits = spark.createDataFrame(
        [("p", 0, "https://www.goodfirms.co/directory/egypt", "Top Translation Companies in Egypt", "Bayan-tech · saudisoft · EgyTransLane"), ("p", 1, "https://saudisoft.com/", "saudisoft — Translation", "")],
        "page string, pos long, link string, title string, snippet string",
    )
    pages = spark.createDataFrame([("https://www.goodfirms.co/directory/egypt", DIRECTORY)], "url string, html string")
    got = qualify.mine_directories(hits, pages, MARKET, ["page"])
    assert {web: s for web, s in column(got, "link", "source")} == dict.fromkeys(["https://www.bayantech.com/", "https://future-trans.com/about", "https://saudisoft.com/"], "directory")
    known = spark.createDataFrame([("saudisoft.com", "rejected", 5, "weak")], "domain string, status string, score int, tier string")
    rows = hits.withColumn("source", F.lit("web")).union(spark.createDataFrame([("p", 2, "https://linkedin.com/in/x", "L", "", "web"), ("q", 0, "https://old.com", "", "", "web")], "page string, pos long, link string, title string, snippet string, source string"))
    run, blocked = qualify.qualify_run(rows, pages, known, spark.createDataFrame([("old.com",)], "domain string"), MARKET, ["page"], ["page"])
    assert sorted(r["domain"] for r in blocked.collect()) == ["linkedin.com", "old.com"]
    assert {r["domain"]: r["status"] for r in run.collect()} == {"bayantech.com": "qualified", "future-trans.com": "qualified", "saudisoft.com": "rejected"}


def test_panel_rows(spark):
    panel = spark.createDataFrame([(1, 0, "BayanTech", "", "x" * 600), (1, 1, "Arabize", "https://arabize.com", None), (1, 2, "Ghost Company", "", ""), (1, 3, "Clutch", "https://clutch.co/x", ""), (1, 4, " ", "https://zqx.org", ""), (1, 5, "Bayan Tech", "", "")], "page int, pos long, name string, link string, snippet string")
    results = spark.createDataFrame([(1, "https://bayantech.com/", "BayanTech | Home", 0), (1, "https://other.org", "Something else", 1)], "page int, link string, title string, pos long")
    got = qualify.merge_panel_rows(panel, results, ["page"], MARKET, source="local_pack")
    assert sorted((r["domain"], r["pos"], r["source"], len(r["snippet"])) for r in got.collect()) == [("arabize.com", 1, "local_pack", 0), ("bayantech.com", 0, "local_pack", 500)]


def test_people_on_pages(spark):
    html = """<li itemscope itemtype="https://schema.org/Person"><b itemprop="name">Ann Lee</b><i itemprop="jobTitle">Vendor Manager</i><a href="https://linkedin.com/in/ann"></a></li>
<li itemtype="http://schema.org/Person"><b itemprop="name">Bo Fix</b><i itemprop="jobTitle">Plumber</i></li><div class="team-card"><h3>Cy Poe</h3><span>since 1999</span><span>Project  Manager</span></div><h3>Dee Roe</h3><p>CEO</p>"""
    df = spark.createDataFrame([(1, html)], "k int, h string")
    assert column(extract.microdata_people(df, "k", "h"), "name", "title", "linkedin_url") == [("Ann Lee", "Vendor Manager", "https://linkedin.com/in/ann")]
    assert column(extract.card_people(df, "k", "h"), "name", "title") == [("Cy Poe", "Project Manager")]
    near = spark.createDataFrame([(1, "Ann Lee, our Vendor Manager, and the CEO: Bo Poe.")], "k int, t string")
    # a title beside a title passes for a name, which is why this one is off in the live flow
    assert sorted(column(extract.nearby_people(near, "k", "t", ["ceo", "vendor manager"]), "name", "title")) == [("Ann Lee", "Vendor Manager"), ("Vendor Manager", "Ceo")]
    after = spark.createDataFrame([(1, "The owner: Bo Poe. " + "x " * 80 + "owner")], "k int, t string")
    assert column(extract.nearby_people(after, "k", "t", ["owner"]), "name", "title") == [("Bo Poe", "Owner")]
    assert ("Ann Lee", "Vendor Manager") in column(extract.nearby_people(near, "k", "t", ["vendor manager"]), "name", "title")


@pytest.mark.parametrize("fragments,want", [(["Connect", "Acme Holdings.", "Ann Lee (she)", "• Vendor Manager"], ("Ann Lee", "Vendor Manager")), (["1st", "Bo Poe", "writes all day"], ("Bo Poe", "writes all day")), (["1st", "x"], (None, ""))])
def test_cards(spark, fragments, want):
    got = value(spark, extract.card_person(F.col("f")), f=fragments)
    assert (got["name"], got["title"]) == want


def test_mail_layers(spark):
    people = spark.createDataFrame([(1, "a.com", "Ann", "Lee"), (2, "b.com", "Bo", "Poe"), (3, "b.com", "Cy", "Roe")], "person int, domain string, first_name string, last_name string")
    site = spark.createDataFrame([("a.com", "info@a.com", 1, 0), ("a.com", "x@a.com", 1, 1), ("b.com", "bo.p@b.com", 1, 0), ("b.com", "zed@b.com", 2, 0)], "domain string, email string, priority int, pos int")
    assert sorted(column(emails.from_site(people, site), "person", "email", "label")) == [(1, "x@a.com", "Site"), (2, "bo.p@b.com", "Site ✓")]
    patterns = spark.createDataFrame([("a.com", "first"), ("b.com", "first.last")], "domain string, pattern string")
    none = spark.createDataFrame([], "email string, verdict string")
    names = people.withColumn("first_name", F.when(F.col("person") == 1, "Info").otherwise(F.col("first_name")))
    assert sorted(column(emails.from_pattern(names, patterns, none), "email")) == ["bo.poe@b.com", "cy.roe@b.com"]
    hits = spark.createDataFrame([(1, 0, "a.com", "x@other.com or zed@a.com", "", ""), (2, 0, "b.com", "info@b.com and bo@b.com", "", ""), (2, 1, "b.com", "see Bo@B.com", "", "")], "person int, pos int, domain string, snippet string, title string, link string")
    assert sorted(column(extract.search_address(hits), "person", "email")) == [(1, "zed@a.com"), (2, "bo@b.com")]
    pages = spark.createDataFrame([("a.com", "{first}.{last}@a.com"), ("b.com", "like x@b.com, jsmith@b.com"), ("c.com", "firstname.lastname"), ("d.com", "nothing")], "d string, body string").withColumn("own", F.col("d"))
    assert dict(column(emails.page_patterns(pages, "d", "body", "own"), "d", "pattern")) == {"a.com": "first.last", "b.com": "flast", "c.com": "first.last"}


def test_directory_terms(spark):
    of = lambda i, c: value(spark, terms.directory_terms(F.lit(i), F.lit(c)))
    egypt, games = of("localization", "Egypt"), of("gaming", "Germany")
    assert "site:proz.com translation company Egypt" in egypt and "site:translationdirectory.com Egypt" in egypt and egypt[0] == "site:clutch.co localization Egypt"
    assert games[0] == "site:clutch.co gaming Germany" and not any("proz.com" in t for t in games)
    mine = value(spark, terms.primary_terms(F.lit("legal"), F.lit("Peru"), terms.cities_of(F.lit("Peru")), F.array(F.lit("my term"), F.lit("my term")), F.lit(True)))
    assert mine == ["my term"]


def test_snapshot_survives_a_crash_before_the_pointer_moves(spark, tmp_path):
    s = state.Snapshots(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([("a", "qualified", "x")], T)
    assert s.write(df)
    (tmp_path / "t" / "current.1").write_text("{")  # a write that died half way
    df.union(df).write.parquet(str(tmp_path / "t" / "v=1"))
    assert s.read().count() == 1 and s.write(df.union(df)) and s.read().count() == 2
    for _ in range(4):
        s.write(df)
    s.forget(2)
    assert sorted(p.name for p in (tmp_path / "t").glob("v=*")) == ["v=4", "v=5"] and s.read().count() == 1


def test_unverified_layer_hides_search(spark):
    p = spark.createDataFrame([(1, "a.com")], "person int, domain string")
    l2 = spark.createDataFrame([(1, "ann@a.com", False)], "person int, email string, verified boolean")
    l4 = spark.createDataFrame([(1, "ann.lee@a.com")], "person int, email string")
    assert emails.leads(p, [("L2-EFmt", l2), ("L4-Search", l4)]).count() == 0
    assert emails.leads(p, [("L4-Search", l4)]).count() == 1


U = "seq long, domain string, status string, note string, provided array<string>"
T = "domain string, status string, note string"


def test_upsert(spark):
    t = spark.createDataFrame([("a", "qualified", "x"), ("b", "discovered", "y")], T)
    u = spark.createDataFrame([(1, "a", "failed", "", ["status"]), (2, "b", None, "", ["note"]), (3, "c", "qualified", "n", ["status", "note"]), (4, "c", "rejected", None, ["status"]), (5, "", "x", "", ["status"])], U)
    once = state.upsert(t, u, "domain", ["status", "note"])
    rows = sorted(map(tuple, once.collect()))
    assert rows == [("a", "failed", "x"), ("b", "discovered", ""), ("c", "rejected", "n")]
    assert sorted(map(tuple, state.upsert(once, u, "domain", ["status", "note"]).collect())) == rows
    kept = state.upsert(t, state.without_demotions(t, u, "domain"), "domain", ["status", "note"])
    assert sorted(map(tuple, kept.collect())) == [("a", "qualified", "x"), ("b", "discovered", ""), ("c", "qualified", "n")]


def test_first_wins_ignores_partitioning(spark):
    df = spark.createDataFrame([(i % 7, i, f"v{i}") for i in range(200)], "k int, seq int, v string")
    want = sorted(map(tuple, first_wins(df, ["k"], ["seq"]).collect()))
    assert want == [(k, k, f"v{k}") for k in range(7)]
    assert sorted(map(tuple, first_wins(df.repartition(9), ["k"], ["seq"]).collect())) == want


def test_longest_suffix(spark):
    rows = spark.createDataFrame([("x.com.eg",), ("x.eg",), ("com.eg",), ("y.org",), ("eg",)], "h string")
    dim = spark.createDataFrame([(".eg", "E"), (".com.eg", "C")], "s string, v string")
    got = {r["h"]: r["o"] for r in longest_suffix(rows, "h", dim, "s", "v", "o").collect()}
    assert got == {"x.com.eg": "C", "x.eg": "E", "com.eg": "E", "y.org": None, "eg": None}


def test_snapshots(spark, tmp_path):
    s = state.Snapshots(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([("a", "qualified", "x")], T)
    assert s.write(df, batch=0) and not s.write(df.limit(0), batch=0)
    assert s.read().count() == 1 and s.pointer() == {"version": 0, "batch": 0}
    assert s.write(df.limit(0)) and s.read().count() == 0
