"""Byte-level BPE, whitening and token alignment against plain code and the public libraries."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftwell.llm import bidiagonal, prefix_bpe, token_alignment, whitening
from tests.llm.cases import TEXTS, docs, empty

BITS = ["a", "b", " ", "  ", "\n", "'s", "'", "re", "é", "日本", "1", "23", "!", "the", "ing", "🙂", "x" * 30, "\t", "\x1c", "’", "\x0b", "<|endoftext|>", "▁", "<0x41>"]


@pytest.fixture(scope="module")
def codes():
    return prefix_bpe.codes(prefix_bpe.default_path())


@pytest.fixture(scope="module")
def library(codes):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=prefix_bpe.PATTERN, mergeable_ranks=codes.merges.ranks, special_tokens={})


def any_text(r, most=60):
    return "".join(r.choice(BITS) for _ in range(r.randrange(most)))


def ids_of(data):
    return np.frombuffer(data, prefix_bpe.ID).tolist()


def test_codes_equal_the_library(codes, library):
    r = random.Random(1)
    texts = [any_text(r) for _ in range(3000)] + [t or "" for _, t in TEXTS] + ["a" * 20_000, " " * 20_000, "ab" * 9_000 + "日本語" * 3_000]
    for t in texts:
        got = codes.encode(t)
        assert ids_of(got) == library.encode_ordinary(t)
        assert codes.decode(got) == t.encode()


def test_every_code_point_is_cut_as_the_library_does(codes, library):
    for first in range(0, 0x110000, 7):  # each seventh; all were compared once
        c = chr(first)
        if not "\ud800" <= c < "":
            t = f"a{c}1{c}! {c}{c}b  {c}"
            assert ids_of(codes.encode(t)) == library.encode_ordinary(t)


def test_prefix_tables_follow_appends_and_edits(codes):
    r = random.Random(2)
    for _ in range(400):
        data = bytes(r.choice(b"abcde the\xc3\xa9\xff") for _ in range(r.randrange(80)))
        p = prefix_bpe.Prefixes(codes.merges, data)
        for _ in range(4):
            start = r.randrange(len(p.data) + 1)
            p.replace(start, r.randrange(start, len(p.data) + 1), bytes(r.choice(b"abthe ") for _ in range(r.randrange(9))))
            fresh = prefix_bpe.Prefixes(codes.merges, p.data)
            assert p.last == fresh.last and p.ids() == fresh.ids()
            # the entry of a prefix is the last id of that prefix by itself
            cut = r.randrange(len(p.data) + 1)
            assert prefix_bpe.Prefixes(codes.merges, p.data[:cut]).last[-1] == p.last[cut]


def test_edits_touch_little_and_equal_the_library(codes, library):
    r = random.Random(3)
    for _ in range(500):
        t = prefix_bpe.EditableText(codes, any_text(r))
        for _ in range(4):
            t.edit(r.randrange(-2, len(t.text) + 3), r.randrange(8), any_text(r, 5))
            assert t.ids() == library.encode_ordinary(t.text)
        t.append(" and more")
        assert t.ids() == library.encode_ordinary(t.text)
    letters = "".join(r.choice("abcdefgh") for _ in range(60_000))  # one piece; in a run of one letter an edit moves all later borders
    for long in ("some words of a text " * 5_000, letters):
        t = prefix_bpe.EditableText(codes, long)
        before = t.computed
        t.edit(30_000, 3, "new")
        assert abs(t.computed - before) < 400 and t.ids() == library.encode_ordinary(t.text)


def test_round_trip_and_edits_in_spark(spark, library):
    got = Counter(map(tuple, prefix_bpe.round_trip(docs(spark)).collect()))
    want = Counter()
    for i, t in TEXTS:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert prefix_bpe.round_trip(empty(spark)).count() == 0
    back = prefix_bpe.decode(prefix_bpe.encode(docs(spark))).collect()
    assert Counter((r["doc_id"], bytes(r["data"])) for r in back) == Counter((i, (t or "").encode()) for i, t in TEXTS)
    rows = [(1, "some text here", [(5, 4, "words"), (0, 0, "so ")]), (2, None, [(0, 9, "x")]), (3, "kept", None), (4, "kept", [(None, None, None)])]
    d = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,length:int,replacement:string>>")
    found = {r["doc_id"]: ids_of(r["ids"]) for r in prefix_bpe.encode_after_edits(d).collect()}
    assert found == {i: library.encode_ordinary(t) for i, t in ((1, "so some words here"), (2, "x"), (3, "kept"), (4, "kept"))}


# --- whitening


def spectrum(r, x, count):
    tri = np.linalg.qr(x, mode="r")
    d = x.shape[1]
    tri = np.vstack([tri, np.zeros((max(d - len(tri), 0), d))])
    a, b, v = bidiagonal.bidiagonalise(tri)
    values, z = bidiagonal.right_vectors(a, b, count)
    vectors, truth = v @ z, np.linalg.svd(tri, compute_uv=False) ** 2
    solid = int((truth[:count] > 1e-12 * truth[0]).sum())
    vectors = vectors[:, :solid]
    assert np.abs(values - truth[:count]).max() <= 1e-12 * truth[0]
    assert np.abs(vectors.T @ vectors - np.eye(solid)).max() < 1e-10
    assert np.abs(tri.T @ (tri @ vectors) - vectors * values[:solid]).max() < 1e-12 * truth[0]


def test_values_and_vectors():
    r = np.random.default_rng(0)
    orthogonal = lambda n: np.linalg.qr(r.standard_normal((n, n)))[0]
    plain = r.standard_normal((300, 24))
    spectrum(r, plain, 24)
    spectrum(r, plain[:9], 16)
    spectrum(r, plain * 10.0 ** -np.arange(24), 16)
    spectrum(r, np.eye(12), 12)
    spectrum(r, np.eye(20).repeat(2, axis=1), 16)
    spectrum(r, plain[:, :8].repeat(3, axis=1), 16)
    spectrum(r, (orthogonal(24) * np.r_[np.full(8, 5.0), np.full(8, 1.0), r.random(8)]) @ orthogonal(24), 20)
    spectrum(r, (orthogonal(24) * (5 + 1e-9 * np.arange(24))) @ orthogonal(24), 24)
    spectrum(r, np.outer(plain[:, 0], plain[0]), 3)
    for _ in range(100):
        x = r.integers(-2, 3, (r.integers(1, 12), r.integers(1, 9))).astype(float)
        if x.any():
            spectrum(r, x, x.shape[1])


def test_small_values_keep_their_digits():
    """Graded bidiagonal matrices, against the products of exact fractions: determinants are products of the diagonal."""
    a, b = 10.0 ** -np.arange(0, 12.0), 10.0 ** -np.arange(0, 11.0) * 0.3
    values = bidiagonal.squared_singular_values(a, b)
    from fractions import Fraction

    q, e = [Fraction(x) ** 2 for x in a.tolist()], [Fraction(x) ** 2 for x in b.tolist()]

    def below(shift):  # number of eigenvalues under the shift, by exact pivots
        count, d = 0, q[0] - shift
        for i in range(1, len(q) + 1):
            count += d < 0
            if i < len(q):
                d = q[i] + e[i - 1] - shift - q[i - 1] * e[i - 1] / d
        return count

    for k, v in enumerate(values.tolist()):
        assert below(Fraction(v) * (1 - Fraction(1, 10**13))) == len(a) - 1 - k
        assert below(Fraction(v) * (1 + Fraction(1, 10**13))) == len(a) - k


def vectors(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int, n string, x double").repartition(5)


def test_whitening_against_plain_code(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((400, 20)) * np.linspace(0.2, 3, 20) @ r.standard_normal((20, 20))
    rows = [(i, [float(c) for c in v], i, "a", 0.0) for i, v in enumerate(base)]
    rows += [(i, rows[7][1], 0, None, None) for i in range(1000, 1200)]  # a third of all rows is one vector
    rows += [(None, rows[3][1], 0, "", 1.0), (5, rows[5][1], 0, "", 1.0), (2000, None, 0, "", 0.0), (2001, [1.0, None] * 10, 0, "", 0.0), (2002, [float("nan")] * 20, 0, "", 0.0)]
    rows += [(2003, [float("inf")] * 20, 0, "", 0.0), (2004, [], 0, "", 0.0), (2005, [1.0, 2.0], 0, "", 0.0)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    part = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, *_ in rows if v and len(v) == 20 and all(c is not None and math.isfinite(c) for c in v)]
    distinct = np.array(sorted({tuple(x) for _, x in part}))
    n, s = len(distinct), distinct.sum(axis=0)
    centred = (distinct * n - s) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    assert len(got) == 16 * len(part) and {g["n"] for g in got} == {n}
    assert all(g["identity_error"] <= 1e-9 for g in got) and len({g["identity_error"] for g in got}) == 1
    want = Counter((i, sum((n * c - int(t)) ** 2 for c, t in zip(x, s, strict=True))) for i, x in part)
    assert Counter((g["vec_id"], g["deviation"]) for g in got if g["component"] == 1) == want
    signs = {}
    by_id = {i: x for i, x in part}
    for g in got:
        k = g["component"] - 1
        assert abs(g["explained"] - values[k] / values.sum()) < 1e-10 * g["explained"]
        if g["vec_id"] is not None:
            plain = (np.array(by_id[g["vec_id"]]) * n - s) / n @ directions[:, k] / math.sqrt(values[k])
            if abs(plain) > 1e-3:
                sign = signs.setdefault(k, np.sign(plain * g["whitened"]))
                assert abs(sign * g["whitened"] - plain) < 1e-8 * (1 + abs(plain))


def test_whitening_of_little(spark):
    whole = lambda rows, kind="array<double>": whitening.whiten(vectors(spark, rows, kind)).collect()
    assert whole([]) == [] and whole([(1, None, 0, "", 0.0)]) == [] and whole([(1, [0.5, 1.0], 0, "", 0.0)] * 3) == []
    two = whole([(1, [0.0, 1.0], 0, "", 0.0), (2, [1.0, 1.0], 0, "", 0.0)], "array<float>")
    assert sorted((g["vec_id"], g["component"], abs(round(g["whitened"], 9)), g["deviation"], round(g["explained"], 9)) for g in two) == [(1, 1, 1.0, 4096, 1.0), (2, 1, 1.0, 4096, 1.0)]
    with pytest.raises(Exception, match="64 bits|overflow"):
        whole([(1, [1e17], 0, "", 0.0), (2, [-1e17], 0, "", 0.0), (3, [0.0], 0, "", 0.0)])


# --- alignment


def plain_alignment(texts):
    """Rows by walking over bytes, without dictionaries of ends."""
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    a_sizes = token_alignment.tokenizers(*token_alignment.default_paths()).a_size
    rows, holders = [], Counter()
    for doc, text in texts:
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        pieces = [bytes([int(x[3:5], 16)]) if b_lib.is_byte(i) else x.replace("▁", " ").encode() for i in b for x in [b_lib.id_to_piece(i)]]
        if b"".join(pieces) != (" " + (text or "")).encode() or not text:
            rows.append((doc, [], [], []))
            continue
        owner_a = [k for k, i in enumerate(a) for _ in range(a_sizes[i])]
        owner_b = [k for k, x in enumerate(pieces) for _ in x]
        link = sorted(set(zip(owner_a, owner_b, strict=True)))
        groups, ga, gb = [], [], []
        for k in range(len(owner_a)):
            end_a, end_b = k + 1 == len(owner_a) or owner_a[k + 1] != owner_a[k], k + 1 == len(owner_b) or owner_b[k + 1] != owner_b[k]
            if end_a:
                ga.append(str(a[owner_a[k]]))
            if end_b:
                gb.append(str(b[owner_b[k]]))
            if end_a and end_b:
                groups.append(",".join(ga) + "|" + ",".join(gb))
                ga, gb = [], []
        ids = [(a[i], b[j]) for i, j in link]
        holders.update(set(ids))
        rows.append((doc, a, b, (groups, ids)))
    best = defaultdict(int)
    for (i, _), c in holders.items():
        best[i] = max(best[i], c)
    for doc, a, b, rest in rows:
        groups, ids = rest or ([], [])
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        yield doc, len(a), len(b), len(groups), len(ids), sum(holders[x] == best[x[0]] for x in ids), sum(holders[x] for x in ids), sha


@pytest.mark.parametrize("slice_bytes", [300, 1 << 22])
def test_alignment_against_plain_code(spark, slice_bytes):
    r = random.Random(4)
    texts = [t for t in TEXTS if len(t[1] or "") < 20_000] + [(1000 + i, any_text(r)) for i in range(150)] + [(3, "<s> </s> <unk> plain <0x0A> text"), (4, "ends in spaces  "), (5, "  begins"), (6, "ﬁ ½ Å é")]
    got = Counter(map(tuple, token_alignment.align(docs(spark, texts), slice_bytes=slice_bytes).collect()))
    assert got == Counter(plain_alignment(texts))
    assert token_alignment.align(empty(spark)).count() == 0
