"""Near duplicates, repeated passages and fingerprints against plain code."""

import hashlib

import numpy as np
import pyarrow as pa

from siftwell.llm import components, fingerprints, ngram_join, substring_dedup, textkit
from tests.compare import connect, same
from tests.llm.cases import A as A_TEXT
from tests.llm.cases import TEXTS, base_text, docs, empty, shingles


def plain_components(texts):
    sets = [(i, shingles(t)) for i, t in texts if i is not None]
    group = {i: i for i, _ in sets}
    again = True
    while again:
        again = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    again = True
    return sorted(((i, len(shingles(t)), group.get(i)) for i, t in texts), key=repr)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (6, 5), (5, 4), (4, 11), (20, 20), (None, 3)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components.connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **dict.fromkeys([4, 5, 6, 7, 8, 9, 11], 4)}


def test_join_on_hard_cases(spark):
    got = sorted([tuple(r) for r in ngram_join.near_duplicate_components(docs(spark)).collect()], key=repr)
    assert got == plain_components(TEXTS)
    assert ngram_join.near_duplicate_components(empty(spark)).count() == 0


def test_join_of_a_group_of_edited_copies(spark):
    base = base_text(150, 5).split()
    texts = []
    for n in range(60):
        w = list(base)
        for j in range(n % 5):
            w[(n * 13 + j * 29) % len(w)] = f"e{n}-{j}"
        texts.append((100 - n, " ".join(w)))
    got = sorted([tuple(r) for r in ngram_join.near_duplicate_components(docs(spark, texts)).collect()], key=repr)
    assert got == plain_components(texts)


def test_join_query_against_sql(spark, sf):
    from siftwell.llm import queries

    con = connect(sf)
    for name in ("op6_ngram_jaccard_join", "op2_exact_topk", "op8_source_mix"):
        same(queries.queries()[name](spark, sf), con, queries.oracle_sql()[name])


def test_repeats_are_found_and_removed(spark):
    passage, near = base_text(60, 7), base_text(80, 8)
    edited = near.replace(near.split()[40], "new")
    texts = [
        (1, "start here\n" + passage), (2, base_text(40, 20) + " " + passage + " " + base_text(40, 21)), (3, near), (4, base_text(30, 22) + "\n" + edited), (5, base_text(50, 23)), (6, None), (7, ""),
        (8, passage + "\n" + passage), (9, "All rights reserved."), (10, "All rights reserved."), (None, passage),
    ]
    d = docs(spark, texts)
    spans = substring_dedup.repeated_spans(d).collect()
    assert {r["doc_id"] for r in spans} == {1, 2, 3, 4, 8}
    by = dict(texts)
    for r in spans:
        piece = by[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert piece == piece.strip() and len(piece.split()) == r["n_words"]
    out = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(d).collect() if r["doc_id"] is not None}
    assert out[1] == by[1] and out[3] == by[3] and out[5] == by[5] and out[9] == out[10] == by[9]
    assert out[4] == base_text(30, 22) and 8 not in out and out[6] is None
    assert out[2].startswith(base_text(40, 20)) and out[2].endswith(base_text(40, 21)) and len(out[2].split()) < 110
    assert substring_dedup.remove_repeats(d).columns == d.columns
    assert substring_dedup.repeated_spans(empty(spark)).count() == 0 and substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_word_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(0, 9)), rng.integers(0, 4, rng.integers(0, 9))
        assert substring_dedup.word_edit_distance(a, b, 99) == plain(a.tolist(), b.tolist())
        assert min(substring_dedup.word_edit_distance(a, b, 2), 3) == min(plain(a.tolist(), b.tolist()), 3)


def test_fingerprints_and_edits(spark):
    for block in (1 << 30, 20_000, 2_000):
        got = sorted([tuple(r) for r in fingerprints.fingerprints_and_edits(docs(spark), block_bytes=block).collect()], key=repr)
        low = -(1 << 62)
        order = sorted(((low if i is None else i, t or "") for i, t in TEXTS), key=lambda x: (-x[0], x[1]))
        want = []
        for n, (i, t) in enumerate(order):
            nxt = order[(n + 1) % len(order)][1]
            k = len(t) // 3
            edited = t[: len(t) - k] + nxt[:k]
            sig = fingerprints.signatures(pa.array([t, edited, nxt]))
            near = [float((sig[0] == s).mean()) for s in sig[1:]]
            want.append((None if i == low else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.encode(sig[0]), fingerprints.encode(sig[1]), *near))
        assert got == sorted(want, key=repr)
    assert fingerprints.fingerprints_and_edits(empty(spark)).count() == 0


def test_likeness_estimates_jaccard():
    a, b = base_text(400, 1).split(), base_text(400, 1).split()
    b[200:] = base_text(200, 3).split()
    x, y = " ".join(a), " ".join(b)
    true = len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
    s = fingerprints.signatures(pa.array([x, y, x.upper()]))
    assert abs(float((s[0] == s[1]).mean()) - true) < 0.13 and (s[0] == s[2]).all()


def test_banded_near_duplicates(spark):
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_duplicates(docs(spark)).collect()}
    want = {i: c for i, _, c in plain_components(TEXTS) if i is not None}
    size = {}
    for c in want.values():
        size[c] = size.get(c, 0) + 1
    assert got == {i: c for i, c in want.items() if size[c] > 1 and not (i == 16 and size[c] == 1)}
    fp = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs(spark)).collect()}
    assert fp[1] == fp[2] == fp[16] != fp[5]


def test_near_paragraphs_behind_a_different_first_one(spark):
    """Three lines in a chain: the ends are near the middle only, and the first of all is near nobody's end."""
    w = base_text(100, 60).split()
    edit = lambda at: " ".join(f"x{i}" if i in at else v for i, v in enumerate(w))
    lines = [edit(set()), edit({10, 30}), edit({10, 30, 50}), edit({10, 30, 50, 70}), edit({90, 10, 20}), edit({90, 10, 20, 40})]
    texts = [(n, t) for n, t in enumerate(lines)] + [(9, lines[3]), (10, lines[3]), (11, base_text(100, 61))]
    spans = substring_dedup.repeats(docs(spark, texts)).where("kind = 'line'").collect()
    want = dict.fromkeys([0, 1, 2, 3, 4, 5, 9, 10], 0)  # by Jaccard or five words in a hundred
    assert {r["doc_id"]: r["component_id"] for r in spans} == want and sum(r["kept"] for r in spans) == len(set(want.values()))


def test_pairs_of_a_template_group_that_shares_all_bands(spark, monkeypatch):
    """Lines of one template meet in every band and stay below the threshold but for pairs; the pairs are found all the same."""
    monkeypatch.setattr(substring_dedup, "CROWD", 16, raising=False)
    base, lines, serial = base_text(60, 70).split(), [], 0

    def bands(w):
        s = next(textkit.word_slices(pa.array([" ".join(w)])))
        return substring_dedup.keys_and_bands(textkit.shingle_hashes(s.hashes), np.array([0]), np.array([len(s.hashes)]))[1][0].tolist()

    want = bands(base)
    while len(lines) < 60:
        serial += 1
        line = [*base, *(f"p{serial}q{i}" for i in range(8))] if len(lines) % 2 == 0 else [*lines[-1][:-1], f"r{serial}"]
        if bands(line) == want:
            lines.append(line)
    texts = [(n, " ".join(w)) for n, w in enumerate(lines)]
    sets = [shingles(t) for _, t in texts]
    assert all((10 * len(a & b) >= 8 * len(a | b)) == (i // 2 == j // 2) for i, a in enumerate(sets) for j, b in enumerate(sets))
    spans = substring_dedup.repeats(docs(spark, texts)).where("kind = 'line'").collect()
    assert {r["doc_id"]: r["component_id"] for r in spans} == {i: i - i % 2 for i in range(60)}


def test_edit_distances_of_many_pairs():
    rng = np.random.default_rng(7)
    pairs = []
    for _ in range(300):
        a = rng.integers(1, 9, rng.integers(1, 30)).astype(np.uint64)
        b = a.tolist()
        for _ in range(rng.integers(0, 8)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = rng.integers(1, 9, rng.integers(0, 2)).tolist()
        pairs.append((a, np.array(b, np.uint64)))
    for most in (1, 3, 6):
        assert substring_dedup.edit_distances(pairs, most).tolist() == [min(substring_dedup.word_edit_distance(a, b, most), most + 1) for a, b in pairs]


def test_passages_inside_lines_are_found_whole(spark):
    """Passages of 24 words or more amid other words: none is missed, and no word of one is left over."""
    text = lambda tag, n: [f"{tag}x{i}" for i in range(n)]
    sizes = {k: 24 + k % 12 for k in range(48)} | {48: 23, 49: 60}
    passage = {k: text(f"p{k}", n) for k, n in sizes.items()}
    passage[47] = ["la", "la", "li"] * 10  # few distinct triples
    parts = lambda k, n: (text(f"a{k}n{n}", 40 + k), passage[k], text(f"b{k}n{n}", 30))
    texts = [(100 * n + k, " ".join(sum(parts(k, n), []))) for k in sizes for n in (0, 1)]
    got = {(r["doc_id"], r["n_words"], r["component_id"], r["kept"]) for r in substring_dedup.repeated_spans(docs(spark, texts)).collect()}
    assert got == {(100 * n + k, len(passage[k]), k, n == 0) for k in sizes if k != 48 for n in (0, 1)}
    out = {r["doc_id"]: r["text"].split() for r in substring_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert all(out[100 + k] == parts(k, 1)[0] + (passage[k] if k == 48 else []) + parts(k, 1)[2] for k in sizes)


def test_rows_that_share_an_id_and_hold_different_texts(spark):
    """Each row is cut where its own text repeats, whatever other texts its id has."""
    p, q = base_text(60, 80), base_text(70, 81)
    own = lambda n: base_text(40, 90 + n)
    texts = [(1, own(0) + "\n" + p), (1, "short"), (1, own(1) + " " + q + " " + own(2)), (2, "x\ny\n" + p), (2, q), (2, own(3)), (2, None), (2, " "), (3, own(4) + "\n" + p), (3, own(4) + "\n" + p)]
    d = docs(spark, texts)
    spans = substring_dedup.repeated_spans(d).collect()
    held = {}
    for i, t in texts:
        held.setdefault(i, []).append(t or "")
    assert all(any(t[r["start"] : r["start"] + r["length"]] in (p, q) for t in held[r["doc_id"]]) for r in spans)
    assert sorted((r["doc_id"], r["n_words"], r["component_id"], r["kept"]) for r in spans) == [(1, 60, 1, True), (1, 70, 1, True), (2, 60, 1, False), (2, 70, 1, False), (3, 60, 1, False), (3, 60, 1, False)]
    out = sorted((r["doc_id"], r["text"] or "") for r in substring_dedup.remove_repeats(d).collect())
    assert out == sorted([(1, own(0) + "\n" + p), (1, "short"), (1, texts[2][1]), (2, "x\ny"), (2, own(3)), (2, ""), (2, " "), (3, own(4)), (3, own(4))])


def test_minhash_against_plain_code():
    for t in [A_TEXT, "one two", "", "é ü ñ 日本 語 x y"]:
        (_, grams), *_ = textkit.shingle_sets(pa.array([t]))
        plain = [min((((int(a) * int(x) + int(b)) % (1 << 64)) >> 32 for x in grams), default=fingerprints.EMPTY) for a, b in zip(fingerprints._A, fingerprints._B)]
        assert fingerprints.minhash(grams).tolist() == plain and fingerprints.signatures(pa.array([t]))[0].tolist() == plain


def test_recall_of_the_band_join(spark, sf):
    """Against the exact join on the same table."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    exact = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicate_components(d).where("n_shingles > 0").collect()}
    size = {}
    for c in exact.values():
        size[c] = size.get(c, 0) + 1
    want = {i: c for i, c in exact.items() if size[c] > 1}
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_duplicates(d).collect()}
    assert set(got) <= set(want) and sum(got.get(i) == c for i, c in want.items()) >= 0.99 * len(want)


def test_band_join_of_rows_that_share_an_id(spark):
    a, b = base_text(60, 3), base_text(60, 4)
    got = fingerprints.near_duplicates(docs(spark, [(1, a), (1, b), (2, b + " x"), (3, a), (9, None), (9, "")])).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 1)]


def test_recall_of_repeated_lines(spark, sf):
    """Lines of documents whose shingle sets are near, by brute force, against the clusters found."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("text is not null").collect()
    lines = [(r["doc_id"], shingles(x)) for r in rows for x in r["text"].split("\n") if len(x.split()) >= substring_dedup.MIN_WORDS]
    near = {(min(i, j), max(i, j)) for n, (i, a) in enumerate(lines) for j, b in lines[:n] if i != j and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)}
    found = {r["doc_id"] for r in substring_dedup.repeats(spark.read.parquet(f"{sf}/documents.parquet")).where("kind = 'line'").collect()}
    held = [i for pair in near for i in pair]
    assert sum(i in found for i in held) >= 0.99 * len(held)


def test_pairs_of_lines_are_checked_many_at_once(monkeypatch):
    """As pair by pair, but with two calls for the shingles of all pairs."""
    rng, pairs, calls = np.random.default_rng(11), [], []
    for _ in range(400):
        a = rng.integers(1, 40 if rng.random() < 0.3 else 1 << 40, rng.integers(25, 70)).astype(np.int64)
        b = a.tolist()
        for _ in range(rng.integers(0, 5)):
            at = int(rng.integers(0, len(b)))
            b[at : at + int(rng.integers(0, 3))] = rng.integers(1, 1 << 40, rng.integers(0, 3)).tolist()
        pairs.append((a.tolist(), b))
    pairs.append((list(range(1, 3001)), [*range(1, 1500), 9, *range(1501, 3001)]))

    def plain(a, b):
        x, y = (set(textkit.shingle_hashes(np.array(w, np.uint64)).tolist()) for w in (a, b))
        most = max(len(a), len(b)) // 20
        return 100 * len(x & y) >= 80 * len(x | y) or substring_dedup.word_edit_distance(np.array(a), np.array(b), most) <= most

    want = [n for n, (a, b) in enumerate(pairs) if plain(a, b)]
    lists = [pa.array([p[c] for p in pairs], pa.list_(pa.int64())) for c in (0, 1)]
    n = pa.array(range(len(pairs)), pa.int64())
    batch = pa.RecordBatch.from_arrays([n, n, *lists], ["a", "b", "wa", "wb"])
    count = lambda *a, **k: calls.append(1) or textkit.shingle_hashes(*a, **k)
    monkeypatch.setattr(substring_dedup, "shingle_hashes", count)
    got = [x for t in substring_dedup._check(iter([batch.slice(0, 150), batch.slice(150), batch.slice(0, 0)])) for x in t.column("a").to_pylist()]
    assert got == want and 50 < len(want) < 380 and len(calls) <= 4
    monkeypatch.setattr(substring_dedup, "PAIRS_WORDS", 500)
    assert [x for t in substring_dedup._check(iter([batch])) for x in t.column("a").to_pylist()] == want


def test_runs_that_overlap_are_one_row():
    """Whatever documents hold them first: two runs of document 3 that other documents hold, one starting in the other."""
    places = [(1, 5, 10), (2, 0, 20), (3, 7, 10), (3, 8, 20), (3, 50, 20), (4, 0, 30)]
    ids = np.array([(d, 0, no) for d, no, _ in places], substring_dedup._ID)
    t = pa.table({"ids": [ids.tobytes()], "hashes": [np.array([h for *_, h in places], np.uint64).tobytes()]})
    got = sorted(map(tuple, (r.values() for r in substring_dedup._meet_runs(t).to_pylist())))
    assert got == [(1, 0, 5, 24, 1, True), (2, 0, 0, 24, 2, True), (3, 0, 7, 25, 1, False), (3, 0, 50, 24, 2, False)]


def test_keys_of_lines_with_repeated_shingles():
    rng = np.random.default_rng(5)
    words = [rng.integers(1, k, n).astype(np.uint64) for k in (2, 3, 1 << 50) for n in (25, 60, 400)]
    last = np.cumsum([len(w) for w in words])
    key, band = substring_dedup.keys_and_bands(textkit.shingle_hashes(np.concatenate(words)), np.append(0, last[:-1]), last)
    assert key.tolist() == [textkit.set_key(np.unique(textkit.shingle_hashes(w))) for w in words]
    alone = [substring_dedup.keys_and_bands(textkit.shingle_hashes(w), np.array([0]), np.array([len(w)]))[1][0].tolist() for w in words]
    assert band.tolist() == alone


def test_places_that_overlap_or_touch_are_one_passage():
    """Against a plain loop over each document's places; a batch that is cut, with a row without places."""
    rng = np.random.default_rng(3)
    texts = ["\n".join(" ".join(f"w{i}é" for i in range(rng.integers(1, 9))) for _ in range(rng.integers(1, 7))) for _ in range(60)]
    texts[5:7] = ["", None]
    marks, want = [], []
    for n, t in enumerate(texts):
        rows = [x.split() for x in (t or "").split("\n")]
        at = np.cumsum([0, *map(len, rows)]).tolist()
        places = []
        for _ in range(rng.integers(0, 5) if at[-1] else 0):
            no, n_words = int(rng.integers(0, at[-1])), int(rng.integers(1, 6))
            if rng.random() < 0.3:
                no, n_words = int(rng.integers(0, len(rows))), 0
            else:
                n_words = min(n_words, at[-1] - no)
            places.append({"no": no, "n_words": n_words, "component_id": int(rng.integers(0, 9)), "kept": bool(rng.random() < 0.5)})
        marks.append(places or None)
        for kept in (False, True):
            spans = []
            for p in places:
                if p["kept"] == kept:
                    spans.append((at[p["no"]], at[p["no"] + 1], p["component_id"]) if p["n_words"] == 0 else (p["no"], p["no"] + p["n_words"], p["component_id"]))
            done = []
            for a, b, c in sorted(spans):
                if done and a <= done[-1][1]:
                    done[-1] = (done[-1][0], max(b, done[-1][1]), min(c, done[-1][2]))
                else:
                    done.append((a, b, c))
            want += [(n, *x, kept) for x in done]
    kind = pa.list_(pa.struct([("no", pa.int32()), ("n_words", pa.int32()), ("component_id", pa.int64()), ("kept", pa.bool_())]))
    texts, marks = pa.array(["x", *texts])[1:], pa.array([[{"no": 0, "n_words": 0, "component_id": 1, "kept": True}], *marks], kind)[1:]
    got = []
    for s, doc, a, b, c, k in substring_dedup._spans(texts, marks):
        lo = s.word_from[doc]
        got += list(zip((s.first + doc).tolist(), (a - lo).tolist(), (b - lo).tolist(), c.tolist(), k.tolist()))
    assert sorted(got) == sorted(want) and len(want) > 50
