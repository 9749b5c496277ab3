"""Repeated passages: near-duplicate paragraphs by MinHash bands, and word-for-word runs inside paragraphs.

Paragraphs are lines of MIN_WORDS words or more.  Each has a MinHash signature over its five-word
shingles, cut into BANDS bands of ROWS rows: at Jaccard 0.8 a pair shares a band with probability
1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9997, so recall is what the bands are tuned for and the exact check
does the rest.  Paragraphs of equal shingle sets are one; different sets that share a band are paired in
ROUNDS rounds (see link_in_rounds: in each, a band held by n sets costs n pairs at most, first with the set that
meets most others, then with others) and checked by exact Jaccard or, where that fails, by edit distance over words.  What
the rounds leave apart meets whole: every two sets of a band that lie in different clusters are compared, a group of
up to 2 * CROWD sets at a time (see _links), which gives links and no row per pair.  Removals are clustered by connected components:
the first paragraph (smallest doc_id, then position) of a component stays.

A passage set into a longer line has no line of its own.  Every run of RUN_WORDS words that stands in two documents is
therefore a repeat too, and overlapping runs join into one span, the whole common passage.  A run's seed is the
SEED_WORDS words from its least word triple on (the first of equal ones, among those where a seed fits in the run), so equal
runs have equal seeds.  Seeds meet first; then all runs of the seeds that two documents hold, word for word.

Exchanges carry packed blocks per hash block (see ngram_join), not one row per paragraph and band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.components import link_in_rounds
from siftwell.llm.runtime import block_count, materialize
from siftwell.llm.textkit import SHINGLE_WORDS, U64, Slice, _power_tables, mix64, seeded, set_key, shingle_hashes, word_slices

MIN_WORDS = 25
PERCENT = 80
BANDS, ROWS = 12, 3
RUN_WORDS = 24
SEED_WORDS = 14
ROUNDS = 3
CROWD = 512
GROUP_ROWS = 8192
CHUNK_WORDS = 1 << 17
SEND_DOCS = 4000
OWNER_BITS = 10
PAIRS = 1 << OWNER_BITS
PAIRS_WORDS = 1 << 20
_A, _B = seeded(BANDS * ROWS, 101) | U64(1), seeded(BANDS * ROWS, 102)


def lines(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and document (in the slice) of every line that holds words."""
    breaks = np.flatnonzero(s.raw == 10)
    at = np.searchsorted(s.start, breaks)
    cuts = np.unique(np.concatenate([s.word_from, at]))
    first, last = cuts[:-1], cuts[1:]
    return first, last, np.searchsorted(s.word_from, first, "right") - 1


def keys_and_bands(grams: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the shingle set (see set_key) and bands of each paragraph, words first .. last - 1 of which grams holds the shingles
    that begin there.  A signature is the minima of BANDS * ROWS universal hashes over a set; ROWS of them make a band."""
    size = last - first - SHINGLE_WORDS + 1
    cut = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), CHUNK_WORDS), "left")
    cut = np.unique(np.append(cut, len(size)))
    parts = [_keys_and_bands(grams, first[a:b], size[a:b]) for a, b in zip([0, *cut[cut > 0][:-1]], cut[cut > 0], strict=True)]
    return np.concatenate([k for k, _ in parts]), np.concatenate([b for _, b in parts])


def _again(g: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where an owner's value stands that the owner has at another place too, but for one place of each."""
    with np.errstate(over="ignore"):
        x = mix64(g + owner.astype(U64) * U64(0x9E3779B97F4A7C15))
    s = np.sort(x)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    maybe = np.zeros(1 << 18, bool)
    maybe[twice & U64(len(maybe) - 1)] = True
    i = np.flatnonzero(maybe[x & U64(len(maybe) - 1)])
    i = i[np.lexsort((g[i], owner[i]))]
    return i[1:][(g[i[1:]] == g[i[:-1]]) & (owner[i[1:]] == owner[i[:-1]])]


def _keys_and_bands(grams: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(first)), size)
    g = grams[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(owner))]
    again = _again(g, owner)
    if len(again):
        g, owner = np.delete(g, again), np.delete(owner, again)
    starts = np.searchsorted(owner, np.arange(len(first)))
    out = np.empty((len(first), BANDS, ROWS), U64)
    with np.errstate(over="ignore"):
        x = mix64(g + U64(0x632BE59BD9B4E019))
        key = np.add.reduceat(x, starts) * U64(0xFF51AFD7ED558CCD) + np.bitwise_xor.reduceat(x, starts)
        for k in range(BANDS * ROWS):
            np.multiply(g, _A[k], out=x)
            x += _B[k]
            x >>= U64(32)
            out[:, k // ROWS, k % ROWS] = np.minimum.reduceat(x, starts)
        band = np.tile(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (len(first), 1))
        for j in range(ROWS):
            band = mix64(band + out[:, :, j])
    return key.view(np.int64), band


_SENT = "to long, kind int, ids binary, keys binary, hashes binary"
_SENT_ARROW = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("hashes", pa.binary())])
_LINE, _SEED, _BAND, _RUN, _OTHER, _COPY, _HELD = 0, 1, 2, 3, 4, 5, 6


def _send(n_blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SEND_DOCS):
                yield from _send_piece(batch.slice(at, SEND_DOCS), n_blocks)

    return run


def _send_piece(piece: pa.RecordBatch, n_blocks: int) -> Iterator[pa.RecordBatch]:
    """Messages of a piece.  What many of its documents hold goes to the hash block once: a set's first place stands for all of the
    piece, and so does the first place of a seed that several of its documents hold.  Their other places travel with the piece, to a
    block of its own, and meet nothing there."""
    ids, tags = (piece.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
    line_doc, line_no, line_key, line_band = [], [], [], []
    run_doc, run_at, run_hash = [], [], []
    read: dict[int, int] = {}  # line_key's place of each line by the line's own hash
    n_known = 0
    for s in word_slices(piece.column(1)):
        grams = shingle_hashes(s.hashes)
        first, last, doc = lines(s)
        number = np.arange(len(first)) - np.searchsorted(first, s.word_from[:-1])[doc] if len(first) else first
        wide = np.flatnonzero(last - first >= MIN_WORDS)
        spans, at, same = np.unique(_span_hash(s.hashes, first[wide], last[wide]), return_index=True, return_inverse=True)
        fresh = np.array([h not in read for h in spans.tolist()], bool)
        if fresh.any():
            some = wide[at[fresh]]
            key, band = keys_and_bands(grams, first[some], last[some])
            line_key.append(key)
            line_band.append(band)
            read.update(zip(spans[fresh].tolist(), range(n_known, n_known + len(some)), strict=True))
            n_known += len(some)
        line_doc.append(s.first + doc[wide])
        line_no.append(np.column_stack([number[wide], np.array([read[h] for h in spans.tolist()], np.int64)[same]]))
        _, pick = run_starts(s)
        pick = pick[np.append(True, pick[1:] != pick[:-1])] if len(pick) else pick  # seeds of later runs are never earlier
        run_hash.append(_hash_of(s.hashes, pick, SEED_WORDS))
        owner = np.searchsorted(s.word_from, pick, "right") - 1
        run_doc.append(s.first + owner)
        run_at.append(pick - s.word_from[owner])
    home = 0
    if run_hash and len(run_hash[0]):
        home = int(run_hash[0][0] % U64(n_blocks))
    if line_key:
        row, (no, at) = np.concatenate(line_doc), np.concatenate(line_no).T
        key, band = np.concatenate(line_key)[at], np.concatenate(line_band)
        _, one, lead = np.unique(key, return_index=True, return_inverse=True)
        # equal sets share all bands: the first band brings the pieces' places together, the others need each set once
        yield from _deal(_LINE, ids[row[one]], tags[row[one]], no[one], key[one], band[at[one], 0], n_blocks)
        more = np.repeat(one, BANDS - 1)
        yield from _deal(_OTHER, ids[row[more]], tags[row[more]], no[more], key[more], band[at[one], 1:].ravel(), n_blocks)
        rest = np.ones(len(key), bool)
        rest[one] = False
        if rest.any():
            by = one[lead[rest]]
            yield _message(home, _COPY, _ids_bytes(ids[row[rest]], tags[row[rest]], no[rest]), key[rest].tobytes(), _ids_bytes(ids[row[by]], tags[row[by]], no[by]))
    if run_hash:
        row, at, h = np.concatenate(run_doc), np.concatenate(run_at), np.concatenate(run_hash)
        code = _coded(np.frombuffer(_ids_bytes(ids[row], tags[row], at), _ID))[0]
        _, one, lead = np.unique(h, return_index=True, return_inverse=True)
        several = (np.bincount(lead, code != code[one[lead]], len(one)) > 0)[lead]
        sent = ~several
        sent[one] = True
        yield from _deal(_SEED, ids[row[sent]], tags[row[sent]], at[sent], None, h[sent], n_blocks)
        if several.any():
            yield _message(home, _HELD, _ids_bytes(ids[row[several]], tags[row[several]], at[several]), b"", b"")


def run_starts(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """First word of every run of RUN_WORDS words within a document, and of the run's seed."""
    if len(s.hashes) < RUN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    three = shingle_hashes(s.hashes, 3)
    least = lambda a, b: np.where(three[a] <= three[b], a, b)
    places, width = RUN_WORDS - SEED_WORDS + 1, 1
    seed = np.arange(len(s.hashes) - SEED_WORDS + 1)
    while width * 2 <= places:
        seed = least(seed[:-width], seed[width:])
        width *= 2
    if width < places:
        seed = least(seed[: width - places], seed[places - width :])
    start = np.arange(len(seed))
    inside = start + RUN_WORDS <= s.word_from[np.searchsorted(s.word_from, start, "right")]
    return start[inside], seed[inside]


def _hash_of(hashes: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each start on."""
    up, down = _power_tables(len(hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * up[: len(hashes)], dtype=U64)])
        return mix64((sums[start + n] - sums[start]) * down[start])


def _span_hash(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from each start to its end."""
    up, down = _power_tables(len(hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * up[: len(hashes)], dtype=U64)])
        return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def _send_runs(n_blocks: int):
    """All runs of the wanted seeds; runs of one seed go to one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SEND_DOCS):
                piece = batch.slice(at, SEND_DOCS)
                ids, tags, seeds = piece.column(0).to_numpy(zero_copy_only=False), piece.column(3).to_numpy(zero_copy_only=False), piece.column(2).to_pylist()
                parts = []
                for s in word_slices(piece.column(1)):
                    wanted = np.zeros(len(s.hashes) + 1, bool)
                    for d in range(s.n_docs):
                        no = np.array(seeds[s.first + d], np.int64) + s.word_from[d]
                        wanted[no[no < s.word_from[d + 1]]] = True
                    start, seed = run_starts(s)
                    start, seed = start[wanted[seed]], seed[wanted[seed]]
                    owner = np.searchsorted(s.word_from, start, "right") - 1
                    parts.append((s.first + owner, start - s.word_from[owner], _hash_of(s.hashes, start, RUN_WORDS), _hash_of(s.hashes, seed, SEED_WORDS)))
                if parts:
                    row, no, h, by = (np.concatenate(c) for c in zip(*parts, strict=True))
                    yield from _deal(_RUN, ids[row], tags[row], no, None, h, n_blocks, by)

    return run


_RUNS = "doc long, tag int, no int, n_words int, lead long, kept boolean"
_ID = [("doc", "<i8"), ("tag", "<u4"), ("no", "<u4")]


def _coded(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each place's document, in the order of (doc, tag), and doc and tag of each number."""
    order = np.lexsort((ids["tag"], ids["doc"]))
    doc, tag = ids["doc"][order], ids["tag"][order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    return code, doc[new], tag[new].view(np.int32) if len(tag) else tag.astype(np.int32)


def _several(h: np.ndarray) -> np.ndarray:
    """Where the values stand that occur more than once."""
    order = np.argsort(h)
    s = h[order]
    same = np.zeros(len(h) + 1, bool)
    np.equal(s[1:], s[:-1], out=same[1:-1]) if len(h) else None
    return np.sort(order[same[1:] | same[:-1]])


def _meet_runs(table: pa.Table) -> pa.Table:
    """One block of runs: those that several documents hold, consecutive ones in one row; the first holder keeps its own.
    Of the documents that hold runs of a row first, lead is the smallest."""
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), _ID)
    h = np.frombuffer(b"".join(table.column("hashes").to_pylist()), U64)
    several = _several(h)
    ids, h = ids[several], h[several]
    code, docs, tags = _coded(ids)
    order = np.lexsort((ids["no"], code, h))
    h, doc, no = h[order], code[order], ids["no"][order].astype(np.int64)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    first = np.flatnonzero(new)
    at = np.cumsum(new) - 1
    lead = doc[first][at]
    other = doc != lead
    take = np.bincount(at, other, len(first))[at] > 0
    doc, no, lead, kept = doc[take], no[take], lead[take], ~other[take]
    order = np.lexsort((no, kept, doc))
    doc, no, lead, kept = doc[order], no[order], lead[order], kept[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (kept[1:] != kept[:-1]) | (no[1:] > no[:-1] + RUN_WORDS)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(doc)) - 1
    least = np.minimum.reduceat(lead, a) if len(a) else lead
    cols = [pa.array(docs[doc[a]]), pa.array(tags[doc[a]]), pa.array(no[a].astype(np.int32)), pa.array((no[b] - no[a] + RUN_WORDS).astype(np.int32)), pa.array(docs[least]), pa.array(kept[a])]
    return pa.table(cols, names=["doc", "tag", "no", "n_words", "lead", "kept"])


def _message(to: int, kind: int, ids: bytes, keys: bytes, hashes: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((to, kind, ids, keys, hashes), _SENT_ARROW, strict=True)], schema=_SENT_ARROW)


def _dealt(h: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their hash blocks, and where each block's begin, with the end appended."""
    to = (h >> U64(40)) % U64(n_blocks)
    if n_blocks <= 1 << 16:
        to = to.astype(np.uint16)  # sorted by radix
    return np.argsort(to, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(to.astype(np.int64), minlength=n_blocks))])


def _deal(kind: int, doc: np.ndarray, tag: np.ndarray, no: np.ndarray, key: np.ndarray | None, h: np.ndarray, n_blocks: int, by: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    order, cuts = _dealt(h if by is None else by, n_blocks)
    out = []
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        i = order[cuts[p] : cuts[p + 1]]
        out.append((p, kind, _ids_bytes(doc[i], tag[i], no[i]), b"" if key is None else key[i].tobytes(), h[i].tobytes()))
    for i in range(0, len(out), 64):
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out[i : i + 64]], f.type) for c, f in enumerate(_SENT_ARROW)], schema=_SENT_ARROW)


def _ids_bytes(doc: np.ndarray, tag: np.ndarray, no: np.ndarray) -> bytes:
    """8 bytes of id, 4 of its text's tag and 4 of number."""
    out = np.empty(len(doc), _ID)
    out["doc"], out["tag"], out["no"] = doc, tag.view(np.uint32), no
    return out.tobytes()


_FOUND = "kind int, doc long, tag int, no int, other_doc long, other_tag int, other_no int, key long, other_key long"
_FOUND_ARROW = pa.schema([(c, pa.int64() if k == "long" else pa.int32()) for c, k in (x.split() for x in _FOUND.split(", "))])


def _meet(table: pa.Table) -> pa.Table:
    """One hash block: link every holder of a set in the first band to the first one; of seeds, the places if several documents
    hold one.  Also the sets of each band that different sets hold: doc and no give a place of the set, other_key the band.
    What pieces found among their own documents passes through."""
    out = []
    for kind in (_COPY, _HELD):
        t = table.filter(pa.array(table.column("kind").to_numpy() == kind))
        ids = np.frombuffer(b"".join(t.column("ids").to_pylist()), _ID)
        own = [ids["doc"], ids["tag"].view(np.int32), ids["no"]] if len(ids) else []
        if len(ids) and kind == _COPY:
            lead, key = np.frombuffer(b"".join(t.column("hashes").to_pylist()), _ID), np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64)
            out.append([np.full(len(ids), _LINE), *own, lead["doc"], lead["tag"].view(np.int32), lead["no"], key, key])
        elif len(ids):
            out.append([np.full(len(ids), _SEED), *own, *[np.zeros(len(ids), np.int64)] * 5])
    for kind in (_LINE, _OTHER, _SEED):
        t = table.filter(pa.array(table.column("kind").to_numpy() == kind))
        if not t.num_rows:
            continue
        ids = np.frombuffer(b"".join(t.column("ids").to_pylist()), _ID)
        h = np.frombuffer(b"".join(t.column("hashes").to_pylist()), U64)
        key = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64) if kind != _SEED else np.zeros(len(h), np.int64)
        several = _several(h)
        ids, h, key = ids[several], h[several], key[several]
        code, docs, tags = _coded(ids)
        order = np.lexsort((ids["no"], code, key, h))
        h, key, code, no = h[order], key[order], code[order], ids["no"][order]
        place = lambda i: [docs[code[i]], tags[code[i]], no[i]]  # noqa: B023, E731
        bucket = np.ones(len(h), bool)
        np.not_equal(h[1:], h[:-1], out=bucket[1:])
        new = bucket.copy()  # first place of each set of a bucket
        new[1:] |= key[1:] != key[:-1]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        if kind != _SEED:
            at = np.cumsum(bucket) - 1
            i = np.flatnonzero(new & (np.bincount(at, new)[at] > 1))
            out.append([np.full(len(i), _BAND), *place(i), *place(i), key[i], h[i].astype(np.int64)])
        else:
            at = np.cumsum(bucket) - 1
            i = np.flatnonzero(np.bincount(at, code != code[lead])[at] > 0)
            out.append([np.full(len(i), kind), *place(i), *[np.zeros(len(i), np.int64)] * 5])
            continue
        if kind == _OTHER:
            continue
        a, b = np.flatnonzero(~new), lead[~new]
        out.append([np.full(len(a), kind), *place(a), *place(b), key[a], key[b]])
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 9
    return pa.Table.from_arrays([pa.array(c.astype(np.int64)).cast(f.type) for c, f in zip(cols, _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)


def word_edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance over words if it is at most `most`, else most + 1 (banded)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    j = np.arange(len(b) + 1)
    row = j.copy()
    for i in range(1, len(a) + 1):
        step = np.empty_like(row)
        step[0] = i
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != a[i - 1]))
        row = np.minimum.accumulate(step - j) + j
        if row.min() > most:
            return most + 1
    return int(row[-1])


def _paragraphs_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, words (hashes) of wanted paragraphs; wanted: doc, tag, no, key."""
    by_doc = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("no", "key")).alias("want"))
    rows = docs.join(by_doc, (docs["_id"] == by_doc["doc"]) & (docs["_tag"] == by_doc["tag"])).select("text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b.column("want").to_pylist()
            keys, words = [], []
            for s in word_slices(b.column("text")):
                first, last, doc = lines(s)
                base = np.searchsorted(first, s.word_from[:-1])
                for d in range(s.n_docs):
                    for w in want[s.first + d]:
                        i = base[d] + w["no"]
                        if i < len(first) and doc[i] == d:
                            keys.append(w["key"])
                            words.append(s.hashes[first[i] : last[i]].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.list_(pa.int64()))], ["key", "words"])

    return rows.mapInArrow(run, "key long, words array<long>")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        wa, wb, at, keep = t.column("wa"), t.column("wb"), 0, [np.zeros(0, bool)]
        n_words = np.cumsum(wa.value_lengths().to_numpy() + wb.value_lengths().to_numpy(), dtype=np.int64)
        while at < t.num_rows:
            fits = int(np.searchsorted(n_words, (n_words[at - 1] if at else 0) + PAIRS_WORDS, "right")) - at
            n = min(max(fits, 1), PAIRS)
            keep.append(_near(wa.slice(at, n), wb.slice(at, n)))
            at += n
        yield t.select(["a", "b"]).filter(pa.array(np.concatenate(keep)))


def _near(wa: pa.ListArray, wb: pa.ListArray) -> np.ndarray:
    """Which pairs of word lists, PAIRS at most, are near by Jaccard (see _row_sets) or by edit distance."""
    (x, a, la), (y, b, lb) = _row_sets(wa), _row_sets(wb)
    n, both = len(la), np.sort(np.concatenate([x, y]))
    both, x, y = (np.bincount(c >> U64(64 - OWNER_BITS), minlength=n) for c in (both[1:][both[1:] == both[:-1]], x, y))
    keep = 100 * both >= PERCENT * (x + y - both)
    # an edit takes SHINGLE_WORDS shingles from either set at most
    longest = np.maximum(la, lb)
    most = longest * (100 - PERCENT) // 400
    may = np.flatnonzero(~keep & (np.abs(la - lb) <= most) & (np.maximum(x, y) - both <= SHINGLE_WORDS * most))
    may = may[np.argsort(longest[may], kind="stable")]
    while len(may):
        k = may[: max(1, int(np.searchsorted(np.arange(1, len(may) + 1) * longest[may], CHUNK_WORDS, "right")))]
        may = may[len(k) :]
        keep[k] = edit_distances([(a(i), b(i)) for i in k.tolist()], int(most[k].max())) <= most[k]
    return keep


def _row_sets(lists: pa.ListArray) -> tuple[np.ndarray, Callable[[int], np.ndarray], np.ndarray]:
    """Shingle sets of all rows as one sorted array (the row, then 64 - OWNER_BITS bits of a shingle's hash), the words of a row
    and the rows' numbers of words."""
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(U64)
    n_words = np.diff(offsets)
    size = np.maximum(n_words - SHINGLE_WORDS + 1, 0)
    owner = np.repeat(np.arange(len(size)), size)
    grams = shingle_hashes(flat[offsets[0] : offsets[-1]])
    g = grams[np.repeat(offsets[:-1] - offsets[0] - (np.cumsum(size) - size), size) + np.arange(len(owner))]
    g = np.sort((owner.astype(U64) << U64(64 - OWNER_BITS)) | (g >> U64(OWNER_BITS)))
    return g[np.append(True, g[1:] != g[:-1])] if len(g) else g, lambda i: flat[offsets[i] : offsets[i + 1]], n_words


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]], most: int) -> np.ndarray:
    """Edit distance over words of each pair, most + 1 where it is more: word_edit_distance for many pairs at once."""
    la, lb = (np.array([len(p[c]) for p in pairs]) for c in (0, 1))
    n, width, step = len(pairs), 2 * most + 1, np.arange(2 * most + 1, dtype=np.int32)
    # column d of the band at row i is word i + d - most of b; words beyond either end equal nothing that counts
    b = np.zeros((n, max(int(la.max()), int(lb.max())) + width + 1), U64)
    a = np.zeros((n, int(la.max())), U64)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = x
        b[i, most : most + len(y)] = y
    row = np.tile(np.abs(step - most), (n, 1)).astype(np.int32)
    row[:, :most] = most + 1
    out = np.full(n, most + 1, np.int32)
    at = np.clip(lb - la + most, 0, width - 1)
    fits = np.abs(lb - la) <= most
    for i in range(1, a.shape[1] + 1):
        new = row + (b[:, i - 1 : i - 1 + width] != a[:, i - 1 : i])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        if i <= most:
            new[:, : most - i] = most + 1
            new[:, most - i] = i
        row = np.minimum.accumulate(new - step, axis=1) + step
        if i <= most:
            row[:, : most - i] = most + 1
        done = np.flatnonzero((la == i) & fits)
        out[done] = row[done, at[done]]
    return np.minimum(out, most + 1)


def _common(grams: list[np.ndarray]) -> np.ndarray:
    """Size of what each two sets share."""
    n = len(grams)
    owner = np.repeat(np.arange(n), [len(g) for g in grams])
    _, col, held = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    number = np.cumsum(held > 1) - 1
    shared = held[col] > 1
    owner, col = owner[shared], number[col[shared]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    out = np.zeros((n, n), np.float32)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        i, j = np.searchsorted(col, [c, c + 4096])
        m = np.zeros((n, min(4096, int(col[-1]) + 1 - c)), np.float32)
        m[owner[i:j], col[i:j] - c] = 1
        out += m @ m.T
    return out


def _group_links(words: list[np.ndarray], grams: list[np.ndarray], comp: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """True links that join all that true links of the group join.  Where there is a second part, pairs lie across the parts."""
    _, comp = np.unique(comp, return_inverse=True)
    if not comp.any():
        return []
    both, size, n_words = _common(grams), np.array([len(g) for g in grams]), np.array([len(w) for w in words])
    a, b = np.nonzero(np.triu(comp[:, None] != comp[None, :]) & ((second[:, None] != second[None, :]) if second.any() else True))
    both = both[a, b]
    out: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        if comp[i] != comp[j]:
            out.append((i, j))
            comp[comp == comp[j]] = comp[i]

    same = 100 * both >= PERCENT * (size[a] + size[b] - both)
    for i, j in zip(a[same].tolist(), b[same].tolist(), strict=True):
        join(i, j)
    # an edit takes SHINGLE_WORDS shingles from either set at most
    longest = np.maximum(n_words[a], n_words[b])
    most = longest * (100 - PERCENT) // 400
    may = np.flatnonzero(~same & (np.abs(n_words[a] - n_words[b]) <= most) & (np.maximum(size[a], size[b]) - both <= SHINGLE_WORDS * most))
    may = may[np.argsort(longest[may], kind="stable")]
    at = 0
    while at < len(may):
        k = may[at : at + 1024]
        at += len(k)
        k = k[comp[a[k]] != comp[b[k]]]
        if len(k):
            d = edit_distances([(words[a[i]], words[b[i]]) for i in k.tolist()], int(most[k].max()))
            for i in k[d <= most[k]].tolist():
                join(int(a[i]), int(b[i]))
    return out


def _links(table: pa.Table) -> pa.Table:
    """Links of a block of groups."""
    t = table.combine_chunks()
    bucket, p, q, second, node, comp = (t.column(c).to_numpy() for c in ("bucket", "p", "q", "second", "node", "comp"))
    lists = t.column("words").chunk(0)
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(U64)
    order = np.lexsort((node, q, p, bucket))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (bucket, p, q)], axis=0)
    cuts = np.append(np.flatnonzero(new), len(order))
    known: dict[int, np.ndarray] = {}
    a, b = [], []
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        rows = order[x:y]
        words = [flat[offsets[r] : offsets[r + 1]] for r in rows.tolist()]
        for r, w in zip(rows.tolist(), words, strict=True):
            if node[r] not in known:
                known[node[r]] = np.unique(shingle_hashes(w))
        for i, j in _group_links(words, [known[node[r]] for r in rows], comp[rows], second[rows]):
            a.append(min(node[rows[i]], node[rows[j]]))
            b.append(max(node[rows[i]], node[rows[j]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _whole_round(left: DataFrame, words: DataFrame) -> DataFrame:
    """Links between all sets of a band; left: bucket, node, comp.

    A band of many sets is cut into parts of about CROWD by hash, and every two parts meet in a group of their own.
    Bands of two sets were compared in the first round; of bands that hold the same sets, one is enough.
    """
    h = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    sizes = left.groupBy("bucket").agg(F.count("*").alias("n"), h(1).alias("x"), h(2).alias("y")).where("n > 2")
    sizes = sizes.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / CROWD).cast("int").alias("parts"))
    e = left.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    e = e.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    e = e.select("bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("part") > F.col("other")).cast("int").alias("second"), "node", "comp")
    e = materialize(e, "groups")
    blocks = max(1, -(-e.count() // GROUP_ROWS))
    e = e.join(words.withColumnRenamed("key", "node"), "node").withColumn("block", F.pmod(F.xxhash64("bucket", "p", "q"), F.lit(blocks)))
    return e.groupBy("block").applyInArrow(_links, "a long, b long")


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), _text().alias("text"), _tag().alias("_tag"))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _tag() -> Column:
    """Tells texts under one doc_id apart."""
    return F.shiftright(F.xxhash64(_text()), 32).cast("int")


def repeats(docs: DataFrame) -> DataFrame:
    """Every repeated passage: doc_id, tag (of the row's text), kind ('line' or 'run'), no (line number or first word),
    n_words of a run (0 for a line), component_id (smallest doc_id that holds it) and kept (this place keeps its copy).

    Rows that share a doc_id and hold different texts are documents of their own; rows equal in both are one document.
    Null ids, null or empty texts and short lines give no rows.
    """
    d = _prepared(docs)
    found = d.mapInArrow(_send(block_count(docs)), _SENT).groupBy("to").applyInArrow(_meet, _FOUND)
    found = materialize(found, "repeats")  # rows that stand twice do no harm below
    linked = found.where(f"kind = {_LINE}")
    sets = found.where(f"kind = {_BAND}").select("doc", "tag", "no", "key", F.col("other_key").alias("bucket"))
    wanted = sets.groupBy("key").agg(F.min(F.struct("doc", "tag", "no")).alias("at")).select("at.*", "key")
    words = materialize(_paragraphs_of(d, wanted).dropDuplicates(["key"]), "paragraphs")
    side = lambda x: words.selectExpr(f"key as {x}", f"words as w{x}")
    verify = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "wa", "wb").mapInArrow(_check, "a long, b long")
    groups = link_in_rounds(sets.select("bucket", F.col("key").alias("node")).distinct(), verify, ROUNDS, lambda left: _whole_round(left, words))
    places = linked.select("doc", "tag", "no", "key").union(linked.select("other_doc", "other_tag", "other_no", "other_key")).union(sets.select("doc", "tag", "no", "key")).distinct()
    places = places.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("cluster", F.coalesce("component", "key"))
    lead = places.groupBy("cluster").agg(F.min(F.struct("doc", "tag", "no")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    out = places.join(lead, "cluster").select(
        F.col("doc").alias("doc_id"), "tag", F.lit("line").alias("kind"), "no", F.lit(0).alias("n_words"), F.col("lead.doc").alias("component_id"),
        (F.struct("doc", "tag", "no") == F.col("lead")).alias("kept"),
    )
    seeds = found.where(f"kind = {_SEED}").groupBy("doc", "tag").agg(F.collect_set("no").alias("seeds"))
    held = d.join(seeds, (d["_id"] == seeds["doc"]) & (d["_tag"] == seeds["tag"])).select("_id", "text", "seeds", "_tag")
    runs = held.mapInArrow(_send_runs(block_count(docs)), _SENT).groupBy("to").applyInArrow(_meet_runs, _RUNS)
    out = out.union(runs.select("doc", "tag", F.lit("run"), "no", "n_words", "lead", "kept"))
    return materialize(out, "passages")


_SPAN = "doc_id long, start long, length long, n_words long, component_id long, kept boolean"
_SPAN_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("n_words", pa.int64()), ("component_id", pa.int64()), ("kept", pa.bool_())])


def _spans(texts: pa.Array, marks: pa.ListArray) -> Iterator[tuple[Slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of the texts its passages: document (in the slice), first word, end word, component and kept.
    Places that overlap or touch and are kept alike are one passage."""
    row = np.repeat(np.arange(len(marks)), marks.value_lengths().fill_null(0).to_numpy())
    columns = [c.to_numpy(zero_copy_only=False) for c in marks.flatten().flatten()]
    for s in word_slices(texts, want_hashes=False):
        i, j = np.searchsorted(row, [s.first, s.first + s.n_docs])
        doc = row[i:j] - s.first
        no, n_words, component, kept = (c[i:j] for c in columns)
        first, last, _ = lines(s)
        a = s.word_from[doc] + no
        b = a + n_words
        line = np.flatnonzero(n_words == 0)
        at = np.searchsorted(first, s.word_from[doc[line]]) + no[line]
        a[line], b[line] = first[at], last[at]
        order = np.lexsort((a, doc, kept))
        doc, a, b, component, kept = (c[order] for c in (doc, a, b, component, kept))
        # words of later documents have higher numbers, so one running maximum serves all; kept ones come after the others
        shift = kept * (s.word_from[-1] + 1)
        new = np.ones(len(a), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (kept[1:] != kept[:-1]) | ((a + shift)[1:] > np.maximum.accumulate(b + shift)[:-1])
        new = np.flatnonzero(new)
        if len(new):
            yield s, doc[new], a[new], np.maximum.reduceat(b, new), np.minimum.reduceat(component, new), kept[new]


def _marked(docs: DataFrame, id_col: str, marks: DataFrame, how: str) -> DataFrame:
    """docs with its columns and __marks; each row gets the marks of its own id and text."""
    m = marks.groupBy(F.col("doc_id").alias("__mark_id"), F.col("tag").alias("__mark_tag")).agg(F.collect_list(F.struct("no", "n_words", "component_id", "kept")).alias("__marks"))
    tagged = docs.withColumn("__tag", _tag())
    return tagged.join(m, (tagged[id_col] == m["__mark_id"]) & (tagged["__tag"] == m["__mark_tag"]), how).drop("__mark_id", "__mark_tag", "__tag")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per repeated span: doc_id, start and length in code points, n_words, component_id, kept."""
    rows = _marked(_prepared(docs), "_id", repeats(docs), "inner").select("_id", "text", "__marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0).to_numpy(), [[np.zeros(0, np.int64)] * len(_SPAN_ARROW)]
            for s, doc, first, last, component, kept in _spans(b.column(1), b.column(2)):
                solid = np.concatenate([[0], np.cumsum((s.raw & 0xC0) != 0x80)])
                at = solid[s.start[first]]
                out.append([ids[s.first + doc], at - solid[s.doc_start[doc]], solid[s.end[last - 1]] - at, last - first, component, kept])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(f.type) for c, f in zip(zip(*out, strict=True), _SPAN_ARROW, strict=True)], schema=_SPAN_ARROW)

    return rows.mapInArrow(run, _SPAN)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with every repeated passage cut from all places but the one that keeps it; n_chars, where there is
    such a column, counts the new text.  Documents of which nothing but white space is left go; rows of which nothing is
    cut, empty ones too, stay as they are."""
    marked = _marked(docs, "doc_id", repeats(docs).where("not kept"), "left")
    keep = docs.columns
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks, cut = b.column(len(keep)), np.zeros(b.num_rows, bool)
            cols = [b.column(i) for i in range(len(keep))]
            if marks.null_count < len(marks):
                texts = b.column(at).to_pylist()
                for s, doc, first, last, *_ in _spans(b.column(at), marks):
                    mask = np.zeros(len(s.raw) + 1, np.int32)
                    np.add.at(mask, s.start[first], 1)
                    np.add.at(mask, s.end[last - 1], -1)
                    mask = np.cumsum(mask[:-1]) == 0
                    for d in np.unique(doc).tolist():
                        x, y = s.doc_start[d : d + 2].tolist()
                        texts[s.first + d], cut[s.first + d] = s.raw[x:y][mask[x:y]].tobytes().decode("utf-8").strip(), True
                cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cut)], [*keep, "__cut"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = marked.select(*keep, "__marks").mapInArrow(run, f"{ddl}, __cut boolean").where("not __cut or length(text) > 0")
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*keep)
