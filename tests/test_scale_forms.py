"""Forms that stand for plain ones at scale: one-pass word lists, signals, Bloom filter, buckets, indexes, slices, live stops."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from siftwell import dims
from siftwell.functions import gates, web
from siftwell.operators import emails, extract, known, qualify, runs, substrings
from siftwell.operators.buckets import Buckets
from siftwell.operators.qualify import Market
from siftwell.operators.resume import SlicedRun
from siftwell.streaming import harvest, stops


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


# --- word lists


def test_lists_in_one_pass_equal_value_by_value(spark):
    r = random.Random(1)
    alphabet = "ab c-é.1"
    word = lambda most: "".join(r.choice(alphabet) for _ in range(r.randint(1, most))).strip() or "a"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(400)] + ["", "translations of a translation", "per perú perx"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (5, 60):
        values = list(dict.fromkeys([word(4) for _ in range(n)] + ["translation", "trans", "per", "perú"]))
        low = F.lower("t")
        got = df.select("t", web.hits_in(low, values).alias("h"), web.any_in(low, values).alias("any"), web.tokens_in(low, values).alias("k"), web.any_token_in(low, values).alias("any_k")).collect()
        for g in got:
            assert g["h"] == [v for v in values if v in g["t"]] and g["any"] == bool(g["h"])
            held = [v for v in values if (v in g["t"] if " " in v else re.search(rf"(?<![a-z0-9]){re.escape(v)}(?![a-z0-9])", g["t"]))]
            assert g["k"] == held and g["any_k"] == bool(held)
    assert df.select(web.hits_in(F.col("t"), []).alias("h"), web.any_in(F.col("t"), []).alias("a")).first() == ([], False)


def test_long_lists_cost_one_scan(spark):
    values = [f"word{i}x" for i in range(500)]
    text = plan(spark.createDataFrame([("a",)], "t string").select(F.size(web.hits(F.col("t"), values)).alias("n")))
    assert text.count("regexp_extract_all") == 1 and "Contains(" not in text


def test_signals_are_taken_once(spark):
    """Regular expressions and list scans in the optimised plan: one for each signal."""
    d = spark.createDataFrame([("h.example", "text")], "h string, b string")
    p = optimized(gates.with_location_gate(d, "g", F.col("h"), "b", "Egypt", dims.TLD_COUNTRY, dims.COUNTRY_GEO))
    assert len(re.findall(r"regexp_extract_all\(|RLIKE", p)) <= 3  # tokens, phone and, where the list is long, headquarters
    assert p.count("lower(") == 1
    page = optimized(web.with_page(spark.createDataFrame([("<p>",)], "html string"), "html"))
    assert len(re.findall(r"regexp_replace\(", page)) <= 6  # three dropped elements, tags, two runs of white space


# --- known keys


def test_bloom_filter_in_front_of_the_anti_join(spark):
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else f"h{i % 700}") for i in range(3000)], "n int, domain string")
    held = spark.createDataFrame([(f"h{i}",) for i in range(0, 700, 3)] + [(None,), ("h3",)], "domain string")
    want = rows.join(held.where("domain is not null").distinct(), "domain", "left_anti").select("n", "domain")
    for most in (1, 64):
        got = known.without_known(rows, "domain", held, most_blocks=most)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    bits = known.bloom_filter(held, "domain", 4)
    marked = known.with_maybe(rows, "domain", bits, 4)
    assert marked.where("not _maybe").count() > 0.9 * want.count()
    assert marked.where("not _maybe").join(held, "domain").count() == 0
    assert known.without_known(rows, "domain", held.limit(0)).count() == 3000 and known.without_known(rows.limit(0), "domain", held).count() == 0
    # a row that the filter rules out passes a broadcast and no shuffle
    branch = plan(known.with_maybe(rows, "domain", bits, 4).where("not _maybe"))
    assert "BroadcastHashJoin" in branch and "LeftAnti" not in branch


# --- buckets


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def merged(old, rows):
    return harvest.with_rows(old, rows)


def state_rows(spark, rows):
    return spark.createDataFrame([(d, s, 1, "weak", None) for d, s in rows], harvest.STATE)


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    t = harvest.domains_table(spark, str(tmp_path / "t"), buckets=32)
    first = [(f"d{i}.com", "discovered") for i in range(400)]
    assert len(t.merge(0, state_rows(spark, first), merged)) == 32
    before = files(tmp_path / "t" / "rows")
    touched = t.merge(1, state_rows(spark, [("d1.com", "qualified"), ("new.com", "failed")]), merged)
    after = files(tmp_path / "t" / "rows")
    changed = {re.search(r"bucket=(\d+)", f).group(1) for f in before ^ after}
    assert 1 <= len(touched) <= 2 and changed == set(map(str, touched))
    want = dict(first) | {"d1.com": "qualified", "new.com": "failed"}
    assert {r["domain"]: r["status"] for r in t.read().collect()} == want
    assert t.merge(1, state_rows(spark, [("d2.com", "failed")]), merged) == [] and files(tmp_path / "t" / "rows") == after  # it comes again
    assert t.merge(2, state_rows(spark, [("d1.com", "failed")]), merged) != []  # no demotion
    assert {r["domain"]: r["status"] for r in t.read().collect()} == want
    assert t.merge(3, state_rows(spark, []), merged) == [] and t.applied() == 3
    assert "PartitionFilters: [isnotnull(bucket" in plan(t.read(touched)) or "PartitionFilters: [bucket" in plan(t.read(touched))


@pytest.mark.parametrize("complete", [True, False])
def test_a_batch_that_died_takes_effect_whole_or_not_at_all(spark, tmp_path, monkeypatch, complete):
    t = harvest.domains_table(spark, str(tmp_path / "t"), buckets=8)
    t.merge(0, state_rows(spark, [(f"d{i}.com", "discovered") for i in range(40)]), merged)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Buckets, "_apply", die)
        with pytest.raises(KeyboardInterrupt):
            t.merge(1, state_rows(spark, [("d1.com", "qualified"), ("x.com", "failed")]), merged)
    if not complete:
        os.remove(tmp_path / "t" / "staged" / "batch=1" / "_SUCCESS")
    again = harvest.domains_table(spark, str(tmp_path / "t"), buckets=8)
    again.recover()
    status = {r["domain"]: r["status"] for r in again.read().collect()}
    assert (status["d1.com"], "x.com" in status, again.applied()) == (("qualified", True, 1) if complete else ("discovered", False, 0))
    again.merge(1, state_rows(spark, [("d1.com", "qualified"), ("x.com", "failed")]), merged)
    status = {r["domain"]: r["status"] for r in again.read().collect()}
    assert len(status) == 41 and status["d1.com"] == "qualified" and status["x.com"] == "failed"


# --- decisions by result page


def decide(spark, rows, m=None, held=()):
    hits = spark.createDataFrame(rows, "page int, pos int, link string, title string, snippet string, source string")
    k = spark.createDataFrame([(d,) for d in held], "domain string")
    d = qualify.decide_hits(hits, k, m or Market(country="Egypt", directories=["dir.com"]), ["page"], ["pos", "link"])
    return {r["domain"]: (r["decision"], r["reason"]) for r in d.collect()}


def test_first_deciding_page_counts_and_panels_lead_on_their_page(spark):
    rows = [
        (1, 0, "https://brick.com", "Bricks", "red bricks", "web"), (2, 0, "https://brick.com", "B", "", "ai_overview"),  # page 1 decides
        (1, 1, "https://panel.com", "P", "text", "web"), (1, 2, "https://panel.com/x", "P", "", "local_pack"),  # the panel leads on its page
        (1, 3, "https://dir.com/list", "Top agencies", "", "web"), (2, 3, "https://dir.com/list", "Top", "", "web"),  # directories decide nothing
        (1, 4, "https://junk.com", "Login", "x", "web"), (1, 5, "https://junk.com/ok", "Fine", "x", "web"),  # junk first: failed for good
        (1, 6, "https://linkedin.com/in/a", "L", "x", "web"), (1, 7, "https://waren.de", "S", "x", "ai_overview"), (1, 8, "https://known.com", "K", "x", "ai_overview"), (1, 9, "", "E", "x", "web"),
    ]
    want = {"brick.com": ("page", None), "panel.com": ("vouched", None), "junk.com": ("failed", "junk_title"), "linkedin.com": ("blocked", "blocked"), "waren.de": ("failed", "foreign_cctld")}
    assert decide(spark, rows, held=["known.com"]) == want
    assert decide(spark, []) == {}


def test_a_weak_page_that_passes_both_gates_is_rejected(spark):
    """Four keywords, two of them strong, no contact page: 28 points."""
    m = Market(country="", keywords=["translation", "interpreter", "language", "subtitling", "zzz"], strong=["translation", "interpreter"])
    body = "translation interpreter language subtitling " + "of many long years in one small town " * 5
    rows = [("https://a.com", f"<p>{body}</p>"), ("https://b.com", f'<p>{body}</p><a href="/contact">c</a>')]
    got = {r["domain"]: r for r in qualify.qualify_pages(spark.createDataFrame(rows, "url string, html string"), m).collect()}
    a, b = got["a.com"], got["b.com"]
    assert (a["status"], a["event_status"], a["event_reason"], a["score"], a["tier"]) == ("rejected", "unverified", "industry_mismatch", 28, "weak")
    assert a["reasons"] == ["4 industry keywords", "pages:1", "shallow_scrape"]
    assert (b["status"], b["score"], b["tier"], b["event_reason"]) == ("qualified", 48, "possible", None)
    assert b["reasons"] == ["4 industry keywords", "has contact page", "pages:1", "shallow_scrape", "shallow_scrape_qualified", "industry_evidence_ok"]
    gate = {r["url"]: r["status"] for r in qualify.page_gate(spark.createDataFrame(rows, "url string, html string"), m).collect()}
    assert gate == {"https://a.com": "qualified", "https://b.com": "qualified"}


def test_event_reasons(spark):
    m = Market(country="Egypt", keywords=["translation", "interpreter", "language"], strong=["translation", "interpreter"])
    filler = "of many long years in one small town " * 5
    rows = [("https://a.com", f"<p>translation interpreter {filler}</p>"), ("https://b.com", f"<p>bricks {filler}</p>"), ("https://c.com", "<p>short</p>"), ("https://d.com", "<p>domain for sale, one of many long years, buy this domain while it is on offer, so long as it is for sale</p>")]
    got = {r["domain"]: r for r in qualify.qualify_pages(spark.createDataFrame(rows, "url string, html string"), m).collect()}
    assert (got["a.com"]["event_reason"], got["a.com"]["reason"][:9], got["a.com"]["reasons"][-1][:9]) == ("location_mismatch", "geo_fail:", "geo_fail:")
    assert (got["b.com"]["event_reason"], got["b.com"]["reason"], got["b.com"]["reasons"][-1]) == ("industry_mismatch", "industry_fail", "shallow_scrape")
    assert (got["c.com"]["status"], got["c.com"]["event_reason"], got["c.com"]["reasons"]) == ("unreachable", None, ["timeout_or_empty"])
    assert (got["d.com"]["status"], got["d.com"]["event_reason"]) == ("failed", "parked_or_empty")


# --- indexes of substrings


def test_holding_equals_a_product(spark):
    r = random.Random(3)
    word = lambda most: "".join(r.choice("abc ") for _ in range(r.randrange(most)))
    texts, needles = [(i % 3, word(12)) for i in range(120)] + [(0, None)], [(i % 3, word(7)) for i in range(80)] + [(0, None), (1, "")]
    t, n = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(needles, "k int, n string")
    got = sorted((x["k"], x["t"], x["n"]) for x in substrings.holding(t, n, ["k"], "t", "n").collect())
    assert got == sorted((k, a, b) for k, a in texts for j, b in needles if k == j and a is not None and b is not None and b in a)


def test_site_addresses_by_name(spark):
    site = [("a.com", 1, 0, "info@a.com"), ("a.com", 1, 1, "anne-marie@a.com"), ("a.com", 2, 0, "o'brien.p@a.com"), ("a.com", 2, 1, "lee@a.com"), ("b.com", 1, 0, "x@b.com"), ("c.com", 1, 0, "info@c.com")]
    people = [(1, "a.com", "Anne-Marie", "Smith"), (2, "a.com", "Pat", "O'Brien"), (3, "a.com", "Max", "Power"), (4, "b.com", "Max", "Power"), (5, "c.com", "Info", "Info"), (6, "a.com", None, "LEE"), (7, "a.com", "", ""), (8, "a.com", "Annemarie", "")]
    s = spark.createDataFrame(site, "domain string, priority int, pos int, email string")
    p = spark.createDataFrame(people, "person int, domain string, first_name string, last_name string")
    got = {r["person"]: (r["email"], r["label"]) for r in emails.from_site(p, s).collect()}
    assert got == {1: ("anne-marie@a.com", "Site ✓"), 2: ("o'brien.p@a.com", "Site ✓"), 4: ("x@b.com", "Site"), 6: ("lee@a.com", "Site ✓")}


def test_many_people_and_addresses_of_one_domain(spark):
    """Twenty thousand of each: four hundred million pairs that are never made."""
    n = 20_000
    site = spark.range(n).select(F.lit("a.com").alias("domain"), F.lit(1).alias("priority"), F.col("id").cast("int").alias("pos"), F.concat(F.hex(F.xxhash64("id")), F.lit("@a.com")).alias("email"))
    site = site.withColumn("email", F.lower("email"))
    people = spark.range(n).select(F.col("id").alias("person"), F.lit("a.com").alias("domain"), F.hex(F.xxhash64("id")).alias("first_name"), F.lit("zzz").alias("last_name"))
    found = emails.from_site(people, site)
    assert found.where("label = 'Site ✓'").count() == n


def test_layers_read_what_is_left_open(spark):
    pages = [("a.com", "/contact", "x@a.com"), ("a.com", "/", "home@a.com"), ("b.com", "/contact", "none"), ("b.com", "/", "home@b.com"), ("c.com", "/contact", "none"), ("d.com", "/contact", "info@d.com"), ("d.com", "/about", "y@d.com")]
    docs = [(d, n, 0, f"doc{n}@{d}") for d in ("a.com", "b.com", "c.com", "e.com") for n in (1, 2)] + [("c.com", 0, 0, "nothing")]
    paths = spark.createDataFrame([("/contact", 1), ("/about", 2), ("/", 99)], "path string, priority int")
    d = spark.createDataFrame(docs, "domain string, doc int, page int, text string")
    got = extract.site_addresses(spark.createDataFrame(pages, "domain string, path string, text string"), paths, documents=d)
    assert sorted(r["email"] for r in got.collect()) == ["doc1@c.com", "doc1@e.com", "home@b.com", "info@d.com", "x@a.com", "y@d.com"]
    assert "LeftAnti" in plan(got)


# --- slices


def test_a_dead_run_starts_again_at_its_slice(spark, tmp_path):
    todo = spark.range(200).select(F.col("id").alias("person"))
    seen = []

    def work(part, die_at=None):
        if die_at is not None and len(seen) == die_at:
            raise RuntimeError("lost")
        seen.append(sorted(r["person"] for r in part.collect()))
        return {"leads": part.select("person", (F.col("person") * 2).alias("twice"))}

    with pytest.raises(RuntimeError):
        SlicedRun(spark, str(tmp_path / "r"), 5).run(todo, "person", lambda p: work(p, 2))
    again = SlicedRun(spark, str(tmp_path / "r"), 99)  # the number of slices is the first one's
    assert again.committed() == [0, 1] and again.slices == 5
    assert sorted(r["person"] for r in again.read("done").collect()) == sorted(seen[0] + seen[1])
    assert again.run(todo, "person", work) == 3
    assert sorted(x for s in seen for x in s) == list(range(200)) and len(seen) == 5
    assert sorted(map(tuple, again.read("leads").collect())) == [(i, 2 * i) for i in range(200)] and again.read("done").count() == 200
    assert again.run(todo, "person", work) == 0


# --- live stops


def test_live_stops_equal_the_batch(spark, tmp_path):
    r = random.Random(7)
    rows, seq = [], 0
    for run in range(25):
        t = 1_700_000_000 + r.randrange(1000)
        for _ in range(r.randrange(5, 60)):
            t += r.choice([0, 1, 20, 300])
            seq += 1
            rows.append((run, seq, t, r.random() < 0.3, r.random() < 0.8, r.random() < 0.3, r.choice([None] * 150 + ["stop", "error", "down"])))
    r.shuffle(rows)  # order of arrival
    schema = "run_id long, seq long, s long, kept boolean, checked boolean, term_end boolean, signal string"
    e = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    targets = spark.createDataFrame([(i, 60 if i % 3 == 0 else 8, 22) for i in range(-1, 25)], "run_id long, target int, budget int")
    want = sorted(map(tuple, runs.stop_rows(e, targets).collect()))
    assert {"target_met", "check_budget", "diminishing_returns", "search_exhausted"} <= {w[2] for w in want}
    folder = str(tmp_path / "events")
    for part in range(3):  # files that arrive one after another hold events of all times, none later than the delay
        e.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(folder)
    ahead = spark.createDataFrame([(-1, 0, 2_000_000_000, False, False, False, None)], schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = stops.ends_of(spark, folder, e.schema, ahead, targets, late="1 day", idle_s=86_400)
    assert sorted(map(tuple, got.select("run_id", "seq", "reason", "total_kept", "total_checked").collect())) == want
