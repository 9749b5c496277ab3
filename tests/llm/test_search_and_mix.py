"""Top-k, mixing and packing against plain code."""

import math
import zlib

import numpy as np
import pytest

from siftwell.llm import mixing, packing, tokens, topk
from tests.compare import TABLES, same
from tests.llm.cases import TEXTS, docs, empty


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(20)] + [(300, None, 0), (301, [1.0, None], 0), (302, [float("nan")], 0), (303, [float("inf")] * 8, 0), (400, [1.0, 2.0], 0), (None, rows[1][1], 0), (5, rows[5][1], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 25 = 0"), k=7).collect()))
    whole = [(i, [math.floor(1024 * x) for x in e]) for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = []
    for q, a in whole:
        if q % 25 == 0:
            best = sorted((-dot(a, b), c) for c, b in whole if c != q)[:7]
            want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [TEXTS, []])
def test_mix_report_against_sql(spark, texts, tmp_path):
    import duckdb

    from siftwell.llm.oracles import OP8

    d = docs(spark, texts) if texts else empty(spark)
    d.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    same(mixing.mix_report(d), con, OP8)
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns
    assert mixed.count() == sum(r["taken"] // r["size"] for r in mixing.mix_report(d).where("size > 0").collect()) + mixed.where("text is null or trim(translate(text, '\t\n', '')) = ''").count()
    assert TABLES


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 60), f"s{min(i % 9, 3)}") for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    r = mixing.mix_report(d).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(x["sum(taken)"] - x["target"]) <= 0.01 * x["target"] for x in r)
    total = sum(x["source_size"] for x in r)
    assert abs(sum(x["target"] for x in r) - total) < 1e-6 * total and all(x["target"] <= 3 * x["source_size"] + 1e-9 for x in r)


def check_pieces(rows, texts, capacity):
    enc = tokens.encoder(tokens.default_path())
    ids = {}
    for i, t in texts:
        ids.setdefault(i, []).append([*enc.whole.encode(t or "", add_special_tokens=False).ids, 0])
    sums = {}
    for r in rows:
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["length"]
        docs_ids = ids[r["doc_id"]][0]
        assert r["doc_tokens"] == len(docs_ids)
        part = np.array(docs_ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert len(part) == 4 * r["length"] and r["ids_crc32"] == zlib.crc32(part)
    assert sums == {i: sum(map(len, lists)) for i, lists in ids.items()}
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= capacity


def test_packing_hard_cases(spark):
    special = [(50, "a<|endoftext|>b"), (51, "it's  we'll\t\tgo \x1c a\x85 b "), (52, "\n x")]
    for capacity in (64, 1024):
        check_pieces(packing.pack(docs(spark, TEXTS + special), capacity).collect(), TEXTS + special, capacity)
    assert packing.pack(empty(spark)).count() == 0


def test_windows_are_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(40):
        at = np.cumsum(rng.integers(1, 9, 14))
        penalty = rng.choice([0.0, 2.0, 32.0], len(at))
        cap = 32
        lengths = [w for w in (1, 2, 4, 8, 16) if w * packing.SHORTEST >= cap]
        places, cost = [0, *at.tolist()], {0: 0.0}
        for j, p in enumerate(places[1:], 1):
            cost[p] = min(cost[q] + (0 if p - q in lengths else cap - (p - q)) for q in places[:j] if p - q <= cap) + penalty[j - 1]
        ends = packing.best_windows(at, penalty, cap)
        total, last = 0.0, 0
        for e in ends:
            total += (0 if e - last in lengths else cap - (e - last)) + penalty[at.tolist().index(e)]
            last = e
        assert last == at[-1] and abs(total - cost[int(at[-1])]) < 1e-9


def test_padding_is_small(spark, sf):
    r = packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("sequence_id").sum("length").collect()
    sizes = [x["sum(length)"] for x in r]
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes) < 0.03 * sum(sizes)


def test_products_beyond_64_bits_are_refused(spark):
    big = spark.createDataFrame([(1, [1e15, 1e15]), (2, [1e15, 3.0])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        topk.top_k(big, big)
    fits = spark.createDataFrame([(1, [2e6, -1.0]), (2, [1e6, 3.5]), (3, [0.0, 1e6])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(fits, fits).collect()}
    assert got[1, 2] == 2_048_000_000 * 1_024_000_000 - 1024 * 3584 and got[3, 1] == -1024 * 1_024_000_000


def test_thresholds_lose_nothing(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) * (1 + i % 3)).round(2).tolist()) for i in range(400)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = np.array([np.floor(np.array(x) * 1024).astype(np.int64) for _, x in rows])
    got = {}
    for r in topk.top_k(v, v.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for i in range(0, 400, 20):
        scores = whole @ whole[i]
        want = sorted((-int(scores[j]), j) for j in range(400) if j != i)[:10]
        assert sorted(got[i]) == [(n + 1, j, -x) for n, (x, j) in enumerate(want)]
