import numpy as np
import pyarrow as pa

from siftwell.llm import textkit
from tests.llm.cases import TEXTS, shingles, words


def test_words_and_shingles_match_plain_code():
    texts = [t for _, t in TEXTS]
    for size in (50, 1 << 20):
        found = [None] * len(texts)
        for s in textkit.word_slices(pa.array(texts), size):
            for d in range(s.n_docs):
                at = range(s.word_from[d], s.word_from[d + 1])
                found[s.first + d] = [bytes(textkit._LOWER[s.raw[s.start[i] : s.end[i]]]).decode() for i in at]
        assert found == [words(t) for t in texts]
    sets = dict(textkit.shingle_sets(pa.array(texts)))
    assert [len(sets[i]) for i in range(len(texts))] == [len(shingles(t)) for t in texts]
    same = [[textkit.set_key(sets[i]) == textkit.set_key(sets[j]) for j in range(len(texts))] for i in range(len(texts))]
    assert same == [[shingles(a) == shingles(b) for b in texts] for a in texts]


def test_hashes_do_not_depend_on_place():
    a = np.concatenate([s.hashes for s in textkit.word_slices(pa.array(["x y z", "y"]))])
    assert a[1] == a[3] and len(set(a.tolist())) == 3


def test_sliced_and_empty_arrays():
    col = pa.array(["skip", "a b", None, "c"]).slice(1)
    assert [len(g) for _, g in textkit.shingle_sets(col)] == [1, 0, 1]
    assert list(textkit.shingle_sets(pa.array([], pa.string()))) == []
