"""Inputs on which a reviewer found queries that failed or differed from their SQL."""

import glob

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siftwell.llm import fingerprints, token_alignment
from siftwell.operators import emails, qualify, substrings
from siftwell.operators.resume import SlicedRun
from siftwell.plans import catalog
from siftwell.scratch import materialize
from tests.compare import same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def tables(spark, folder, **rows):
    """Parquet tables under folder, and DuckDB views of them."""
    con = duckdb.connect()
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["o01_mined_directories", "o01_qualify_run"])
def test_documents_that_hold_lists_are_no_directories_lists(spark, tmp_path, name):
    texts = ["Alpha Beta Gamma\n1. Erthtionth the of\n2. Delta works", "Top ten firms\nwork · under · Licensed under", "Plain words only"]
    docs = [(i, t, "en", "src0") for i, t in enumerate(texts)]
    pages = [(i, f"https://ththth.example.net/{i}", "<p>x</p>") for i in range(3)]
    sf, con = tables(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string, source string"), pages=(pages, "page_id long, url string, html string"), nation=([(0, "N")], "n_nationkey long, n_name string"))
    same(QUERIES[name](spark, sf), con, SQL[name])


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_of_texts_are_not_broadcast(spark):
    """Spark takes the runs of a text to be as large as the text and would send them to the driver."""
    t = materialize(spark.createDataFrame([(1, "abcdefgh" * 40)], "k int, t string"), "texts")
    n = materialize(spark.createDataFrame([(1, "cdefg"), (1, "zz")], "k int, n string"), "needles")
    found = substrings.holding(t, n, ["k"], "t", "n")
    assert "BroadcastHashJoin" not in joins(found)
    assert found.count() == 1


PEOPLE = ["Acme Works", "Bolt", "ab", "x y", "Über Ünder", "1.", "Works Acme Great", "--"]


@pytest.mark.parametrize("limit", [0, 1 << 16])
def test_small_and_large_pages_resolve_alike(spark, monkeypatch, limit):
    monkeypatch.setattr(qualify, "PAGE_PAIRS", limit)
    names = spark.createDataFrame([(p, n) for p in (1, 2) for n in PEOPLE], "page int, name string")
    links = ["https://acmeworks.com/a", "https://www.bolt.example.net/", "https://ab.com", "https://-x.org/", "https://great.example.com/z", "https://facebook.com/bolt"]
    titles = ["Great Acme and Works", "Bolt", "", "1. place", None, "works acme"]
    results = spark.createDataFrame([(p, link, t, i) for p in (1, 3) for i, (link, t) in enumerate(zip(links, titles, strict=True))], "page int, link string, title string, pos long")
    market = qualify.Market(country="")
    found = qualify.resolve_names(names, results, ["page"], market)
    assert limit == 0 or "BroadcastHashJoin" not in joins(qualify.best_links(names, results, ["page"], market))
    want = {"Acme Works": links[0], "Bolt": links[1], "ab": links[2], "x y": links[3], "1.": links[3], "Works Acme Great": links[0]}
    got = {(r["page"], r["name"]): r["link"] for r in found.collect()}
    assert got == {(p, n): want.get(n) if p == 1 else None for p in (1, 2) for n in PEOPLE}


def test_an_address_is_computed_once_for_all_role_words(spark):
    people = spark.createDataFrame([(1, "a.com", "Ann", "Lee")], "person int, domain string, first_name string, last_name string")
    patterns, verdicts = spark.createDataFrame([("a.com", "first.last")], "domain string, pattern string"), spark.createDataFrame([("ann.lee@a.com", "good")], "email string, verdict string")
    found = emails.from_pattern(people, patterns, verdicts)
    assert "exists(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r["email"] for r in found.collect()] == ["ann.lee@a.com"]


def test_slices_share_their_domains_evidence(spark, tmp_path, monkeypatch):
    reads = []
    monkeypatch.setattr(emails, "site_addresses", lambda *a, f=emails.site_addresses, **k: reads.append(1) or f(*a, **k))
    people = spark.createDataFrame([(i, "a.com", f"P{i} Lee", f"P{i}", "Lee", None) for i in range(6)], "person int, domain string, full_name string, first_name string, last_name string, email_searched_at string")
    pages = spark.createDataFrame([("a.com", "/contact", "p1@a.com p2@a.com")], "domain string, path string, text string")
    empty = lambda s: spark.createDataFrame([], s)
    rest = (spark.createDataFrame([("/contact", 1)], "path string, priority int"), empty("domain string, body string"), empty("email string, verdict string"), empty("person int, pos int, domain string, snippet string, title string, link string"), empty("email string"), F.lit("now"))
    found, done = emails.mail_run_in_slices(SlicedRun(spark, f"{tmp_path}/run", 3), people, pages, *rest)
    assert len(reads) == 1
    whole, stamped = emails.mail_run(people, pages, *rest)
    assert sorted(found.collect()) == sorted(whole.collect()) and sorted(done.collect()) == sorted(stamped.collect())
    assert {r["email"] for r in found.collect()} == {"p1@a.com", "p2@a.com"}


def test_slices_of_two_tokenizers_are_held_one_at_a_time(spark, monkeypatch):
    paths = {}

    def written(df, label, **options):
        out = materialize(df, label, **options)
        paths[label] = out._scratch_path
        return out

    monkeypatch.setattr(token_alignment, "materialize", written)
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 20) for i in range(60)] + [(60, ""), (61, None)], "doc_id long, text string").coalesce(1)
    small, plan = token_alignment.align(docs, slice_bytes=500), "".join(joins(token_alignment.align(docs, slice_bytes=500)).split())
    groups = [g for f in glob.glob(f"{paths['aligned']}/*.parquet") for g in (lambda m: [m.row_group(i).num_rows for i in range(m.num_row_groups)])(pq.read_metadata(f))]
    assert len(groups) > 20 and set(groups) == {1}
    assert "collect_list" not in plan
    assert sorted(small.collect()) == sorted(token_alignment.align(docs).collect())


def test_copies_of_a_text_are_one_node(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(fingerprints, "materialize", lambda df, label, f=materialize: seen.setdefault(label, f(df, label)))
    base = " ".join(f"w{i}" for i in range(60))
    texts = {1: base, 2: base, 3: base, 4: base + " end", 5: "quite other words in this text here", 6: "two copies of these words only", 7: "two copies of these words only", 8: "", 9: "", 10: None, 11: " \n"}
    docs = spark.createDataFrame(list(texts.items()) + [(7, base)], "doc_id long, text string")
    got = sorted(tuple(r) for r in fingerprints.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (6, 6), (7, 1), (7, 6)]
    assert seen["bands"].select("node").distinct().count() == 4
