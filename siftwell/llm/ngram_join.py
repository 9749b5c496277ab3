"""Similarity join of documents on word n-gram sets (Jaccard), exact.

Rare-first prefix filtering.  Three packed exchanges replace one row per shingle:

1. every block of documents sends, per hash block, the 40-bit remainders of its shingle
   hashes and one count per document;
2. a hash block finds each shingle's document frequency and answers only for shingles
   that two or more distinct sets hold (a shingle of one set can match nothing);
3. the documents' block orders each set rare-first, with the sets' own shingles ahead of
   all, and keeps its prefix of n - ceil(t n) + 1: a set whose prefix holds only its own
   shingles has no partner and leaves here.

Prefixes are joined on their shingles with length and positional filters.  A shingle's
holders are first paired with one holder each (two rounds: the holder with the fewest shingles of
its own, which is the middle of a group of edited copies, then another), components are taken, and the last round pairs whatever holders of a shingle still lie in
different components.  So a group of n copies costs about n pairs, and no link that would
change a component is lost.  A pair is verified once: suffix filter, then exact overlap.

Sharing is found on log2(blocks) + 40 bits of a shingle's 64-bit hash; blocks grow with
the table, which keeps chance agreement near 1 in 300,000 shingles at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.components import connected_components
from siftwell.llm.runtime import block_count, materialize
from siftwell.llm.textkit import SHINGLE_WORDS, U64, set_key, shingle_sets

STAR_ROUNDS = 2
BLOCK_DOCS = 8000
_LOW = (1 << 40) - 1


def _pack40(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


_SENT = pa.schema([("to", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])
_SENT_DDL = "to long, block long, ids binary, counts binary, hashes binary"


def _send(n_blocks: int, k: int, id_col: str, text_col: str):
    """Blocks of documents to hash blocks (to >= 0), and each block's own list to itself (to = -1 - block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                piece = batch.slice(at, BLOCK_DOCS)
                block = (part << 24) + serial
                serial += 1
                yield from _send_block(piece, block, n_blocks, k, id_col, text_col)

    return run


def _send_block(piece, block, n_blocks, k, id_col, text_col):
    ids = piece.column(id_col)
    first: dict[tuple[int, int], int] = {}
    meta = np.zeros((piece.num_rows, 4), np.int64)  # id, set size, set key, row of the first equal set here
    kept, rows = [], []
    for row, grams in shingle_sets(piece.column(text_col), k):
        key = set_key(grams)
        twin = first.setdefault((key, len(grams)), row) if len(grams) else row
        meta[row] = (0, len(grams), key, twin)
        if twin == row and len(grams):
            kept.append(grams)
            rows.append(row)
    meta[:, 0] = np.asarray(ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
    out = [(-1 - block, block, meta.tobytes(), b"", b"")]
    if kept:
        sizes = np.array([len(g) for g in kept])
        grams = np.concatenate(kept)
        owner = np.repeat(np.array(rows, np.int64), sizes)
        to = (grams >> U64(40)) % U64(n_blocks)
        order = np.argsort(to, kind="stable")
        grams, owner = grams[order] & U64(_LOW), owner[order]
        cuts = np.searchsorted(to[order], np.arange(n_blocks + 1, dtype=U64))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[p], cuts[p + 1]
            counts = np.bincount(owner[a:b], minlength=piece.num_rows).astype("<u4")
            out.append((p, block, b"", counts.tobytes(), _pack40(grams[a:b])))
    for i in range(0, len(out), 64):
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out[i : i + 64]], f.type) for c, f in enumerate(_SENT)], schema=_SENT)


_REPLY = pa.schema([("block", pa.int64()), ("from", pa.int64()), ("meta", pa.binary()), ("owner", pa.binary()), ("freq", pa.binary()), ("hashes", pa.binary())])
_REPLY_DDL = "block long, from long, meta binary, owner binary, freq binary, hashes binary"


def _frequencies(table: pa.Table) -> pa.Table:
    """One hash block: frequency of each shingle, sent back where it is 2 or more."""
    to = table.column("to")[0].as_py()
    if to < 0:
        cols = [table.column("block"), table.column("to"), table.column("ids"), table.column("counts"), table.column("counts"), table.column("hashes")]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, _REPLY, strict=True)], schema=_REPLY)
    blocks = table.column("block").to_pylist()
    hashes = [_unpack40(x.as_py()) for x in table.column("hashes")]
    freq = _document_frequency(np.concatenate(hashes))
    out, at = [], 0
    for block, h, counts in zip(blocks, hashes, table.column("counts"), strict=True):
        f = freq[at : at + len(h)]
        at += len(h)
        shared = f > 1
        if shared.any():
            counts = np.frombuffer(counts.as_py(), "<u4")
            owner = np.repeat(np.arange(len(counts), dtype="<u4"), counts)[shared]
            out.append((block, to, b"", owner.tobytes(), f[shared].astype("<u4").tobytes(), _pack40(h[shared])))
    return pa.Table.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(_REPLY)], schema=_REPLY)


def _document_frequency(h: np.ndarray) -> np.ndarray:
    order = np.argsort(h)
    s = h[order]
    new = np.empty(len(s), bool)
    new[:1] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    runs = np.flatnonzero(new)
    size = np.diff(np.append(runs, len(s)))
    freq = np.empty(len(h), np.int64)
    freq[order] = np.repeat(size, size)
    return freq


_SETS = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("twin", pa.int64()), ("tokens", pa.list_(pa.int64())), ("own", pa.int64())])
_SETS_DDL = "doc long, n long, key long, twin long, tokens array<long>, own long"


def _order_sets(percent: int):
    def run(table: pa.Table) -> pa.Table:
        meta, owner, freq, token = None, [], [], []
        for i in range(table.num_rows):
            if (m := table.column("meta")[i].as_py()) and table.column("from")[i].as_py() < 0:
                meta = np.frombuffer(m, np.int64).reshape(-1, 4)
                continue
            base = U64(table.column("from")[i].as_py()) << U64(40)
            owner.append(np.frombuffer(table.column("owner")[i].as_py(), "<u4"))
            freq.append(np.frombuffer(table.column("freq")[i].as_py(), "<u4"))
            token.append(_unpack40(table.column("hashes")[i].as_py()) | base)
        n_docs = len(meta)
        lists: list = [None] * n_docs
        own = np.zeros(n_docs, np.int64)
        if owner:
            owner, freq, token = np.concatenate(owner), np.concatenate(freq), np.concatenate(token)
            order = np.lexsort((token, freq, owner))
            owner, token = owner[order], token[order].astype(np.int64)
            cuts = np.searchsorted(owner, np.arange(n_docs + 1))
            shared = np.diff(cuts)
            need = -(-percent * meta[:, 1] // 100)
            for d in np.flatnonzero((shared >= need) & (shared > 0)).tolist():
                lists[d] = token[cuts[d] : cuts[d + 1]]
            own = meta[:, 1] - shared
        ids = meta[:, 0]
        return pa.Table.from_arrays(
            [pa.array(ids), pa.array(meta[:, 1]), pa.array(meta[:, 2]), pa.array(ids[meta[:, 3]]), pa.array(lists, pa.list_(pa.int64())), pa.array(own)], schema=_SETS
        )

    return run


def shared_sets(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc, n (set size), key (of the set), twin (first equal set of its block),
    tokens (shingles that other sets hold too, rare-first; null if no partner is possible), own (shingles of its own)."""
    slim = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    n_blocks = block_count(docs)
    sent = slim.mapInArrow(_send(n_blocks, k, id_col, text_col), _SENT_DDL)
    reply = sent.groupBy("to").applyInArrow(_frequencies, _REPLY_DDL)
    return reply.groupBy("block").applyInArrow(_order_sets(percent), _SETS_DDL)


def _bounded_overlap(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    """Upper bound of the overlap of two sorted sets: split at a's median, twice."""
    if depth == 0 or len(a) < 4 or len(b) < 4:
        return min(len(a), len(b))
    m = a[len(a) // 2]
    i, j = len(a) // 2, int(np.searchsorted(b, m))
    return _bounded_overlap(a[:i], b[:j], depth - 1) + _bounded_overlap(a[i:], b[j:], depth - 1)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a_off, b_off = (t.column(c).offsets.to_numpy() for c in ("ta", "tb"))
            a_val, b_val = (t.column(c).values.to_numpy() for c in ("ta", "tb"))
            total = t.column("na").to_numpy() + t.column("nb").to_numpy()
            need = -(-percent * total // (100 + percent))
            keep = np.zeros(t.num_rows, bool)
            for i in range(t.num_rows):
                a, b = a_val[a_off[i] : a_off[i + 1]], b_val[b_off[i] : b_off[i + 1]]
                if min(len(a), len(b)) < need[i]:
                    continue
                a, b = np.sort(a), np.sort(b)
                keep[i] = _bounded_overlap(a, b, 2) >= need[i] and len(np.intersect1d(a, b, assume_unique=True)) >= need[i]
            yield t.select(["a", "b"]).filter(pa.array(keep))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity."""
    side = lambda x: sets.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(_verify(percent), "a long, b long")


def _filters(percent: int) -> str:
    """Length and positional filters on two prefix entries of one shingle; nor can an overlap exceed
    what either set shares with any other."""
    least = f"ceil({percent} * (l.n + r.n) / {100 + percent}.0)"
    return f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n) and least(l.n - l.pos, r.n - r.pos) >= {least} and least(l.shared, r.shared) >= {least}"


def link_components(sets: DataFrame, percent: int = 80) -> DataFrame:
    """(doc, component) for documents with at least one link; sets as from shared_sets(), written to scratch."""
    held = sets.where("tokens is not null")
    small = held.groupBy("key", "n").agg(F.min("doc").alias("rep"))
    twins = held.select("doc", "key", "n").join(small, ["key", "n"]).select("doc", "rep")
    copies = sets.where("n > 0 and twin <> doc").select(F.col("twin").alias("a"), F.col("doc").alias("b"))
    found = materialize(copies.union(twins.where("doc <> rep").select("rep", "doc")), "copies")
    prefix = held.selectExpr("doc", "n", "own", "slice(tokens, 1, cast(n - ceil({0} * n / 100.0) + 1 - own as int)) as prefix".format(percent)).where("size(prefix) > 0")
    entries = prefix.selectExpr("doc", "n", "own", "posexplode(prefix) as (at, token)").selectExpr("token", "doc", "n", "own + at as pos", "n - own as shared")
    reps = twins.where("doc = rep").select("doc")
    entries = entries.join(reps, "doc", "left_semi")
    entries = materialize(entries, "prefixes")
    labels, tried = None, None
    for step in range(STAR_ROUNDS + 1):
        e = entries.withColumn("comp", F.col("doc")) if labels is None else entries.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
        if step:
            mixed = e.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token")
            e = materialize(e.join(mixed, "token", "left_semi"), "mixed")
            if not e.limit(1).count():
                break
            entries = e.drop("comp")
        if step < STAR_ROUNDS:
            lead = e.groupBy("token").agg(F.min_by(F.struct("doc", "n", "pos", "shared", "comp"), F.struct(F.lit(0) if step else F.col("n") - F.col("shared"), F.xxhash64("doc", F.lit(step)))).alias("lead"))
            right = lead.select("token", "lead.*")
            met = e.alias("l").join(right.alias("r"), "token").where("l.comp <> r.comp")
        else:
            met = e.alias("l").join(e.alias("r"), "token").where("l.comp < r.comp")
        pairs = met.where(_filters(percent)).selectExpr("least(l.doc, r.doc) as a", "greatest(l.doc, r.doc) as b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        good = materialize(verified(pairs, held, percent), "linked")
        tried = pairs if tried is None else tried.union(pairs)
        found = found.union(good)
        labels = connected_components(found, "a", "b")
    return labels.select(F.col("node").alias("doc"), "component")


def near_duplicate_components(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links).

    Null or empty texts and texts without words have an empty set and link with nothing; texts of
    fewer than k words are one shingle; equal texts always link.  Rows that repeat a doc_id stay
    separate rows of one component; a null doc_id comes back null, linked with nothing.  Further
    columns of docs are ignored.  An empty table gives an empty result.
    """
    sets = materialize(shared_sets(docs, k, percent, id_col, text_col), "sets")
    linked = link_components(sets.where(F.col("doc") > F.lit(-(1 << 63))), percent)
    doc = F.when(F.col("doc") > F.lit(-(1 << 63)), F.col("doc"))
    return (
        sets.select("doc", "n").join(linked, "doc", "left")
        .select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", doc).alias("component_id"))
    )
