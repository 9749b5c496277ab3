"""MinHash document fingerprints, and near duplicates through signature bands.

A text's shingles are its distinct runs of five words (its whole word sequence, if shorter).  A
fingerprint is, for each of PERMUTATIONS multiply-shift universal hashes, the least value over the
shingles, 32 bits each; the share of equal places of two fingerprints estimates the Jaccard
similarity of their shingle sets.  Equal texts have equal fingerprints.  A text without words has
the fingerprint of the empty set, like only to itself.

Null texts are empty.  A null id counts as the smallest and comes back null; rows that repeat an id
follow one another in the order of their texts.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.components import link_in_rounds
from siftwell.llm.runtime import block_count, materialize
from siftwell.llm.textkit import U64, mix64, seeded, shingle_sets

PERMUTATIONS = 128
BAND_ROWS = 4  # 32 bands: a pair of similarity 0.8 shares one with probability 0.99999993
PERCENT = 80
MAX_RANGES = 20_000
EMPTY = 0xFFFFFFFF
_A, _B = seeded(PERMUTATIONS, 201) | U64(1), seeded(PERMUTATIONS, 202)
_NO_ID = -(1 << 63)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """PERMUTATIONS minima over a set of 64-bit shingle hashes, in blocks that stay in cache."""
    out = np.full(PERMUTATIONS, EMPTY, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 512):
            x = shingles[i : i + 512]
            out = np.minimum(out, ((x[None, :] * _A[:, None] + _B[:, None]) >> U64(32)).min(axis=1).astype(np.uint32))
    return out


def signatures(texts: pa.Array) -> np.ndarray:
    out = np.empty((len(texts), PERMUTATIONS), np.uint32)
    for row, grams in shingle_sets(texts):
        out[row] = minhash(grams)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity, row by row."""
    return (a == b).mean(axis=1)


def encode(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u4").tobytes()).decode()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id and fingerprint, one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(s) for s in signatures(b.column(1))], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id (smallest doc_id reachable by links) of documents that have a near duplicate.  Rows that share
    an id and hold different texts are documents of their own: such an id comes back once per class that it lies in.

    Equal texts are one node from the start, so copies cost neither bands nor pairs.  Bands of signatures are joined on their value
    (see link_in_rounds); a pair's Jaccard similarity is taken exactly on the shingle sets of its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, owner = b.column(0).to_numpy(zero_copy_only=False), [], []
            for row, grams in shingle_sets(b.column(1)):
                if len(grams):
                    sig = minhash(grams).astype(U64).reshape(-1, BAND_ROWS)
                    key = np.arange(len(sig), dtype=U64)
                    for j in range(BAND_ROWS):
                        key = mix64(key * U64(0x9E3779B97F4A7C15) + sig[:, j])
                    keys.append(key.astype(np.int64))
                    owner.append(ids[row])
            n = [len(k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(owner, np.int64), n)), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))], ["node", "bucket"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = dict(shingle_sets(b.column("ta"))), dict(shingle_sets(b.column("tb")))
            both = [(len(np.intersect1d(a[i], c[i], assume_unique=True)), len(a[i]) + len(c[i])) for i in range(b.num_rows)]
            yield b.select(["a", "b"]).filter(pa.array([100 * x >= percent * (n - x) for x, n in both], pa.bool_()))

    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    slim = slim.select(F.xxhash64("text").alias("node"), "doc", "text")
    texts = materialize(slim.select("node", "text").dropDuplicates(["node"]), "texts")
    copies = slim.select("node", "doc").distinct()
    held = materialize(texts.mapInArrow(run, "node long, bucket long"), "bands")
    text = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    verify = lambda pairs: pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")
    near = link_in_rounds(held, verify).withColumnRenamed("component", "near")
    # copies of a text are one node; a text without near ones is a class if several documents hold it, unless it has no words
    worded = held.select("node").distinct().join(near, "node", "left").select("node", F.coalesce("near", "node").alias("component"))
    every = materialize(copies.join(worded, "node"), "classes")
    least = every.groupBy("component").agg(F.min("doc").alias("class_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return every.join(least, "component").select(F.col("doc").alias("doc_id"), "class_id").distinct()


def _splits(ids: DataFrame, n: int) -> list[int]:
    """n - 1 ids that cut the table into ranges of about equal row counts (one bounded sketch per task)."""
    if n < 2:
        return []
    row = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n).alias("p")).first()
    return sorted(set(row["p"] or []))


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare_with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges in order, each by descending id with its halo last: every own row against the row after it.

    One row is carried from batch to batch, so memory is bounded by a batch.  A range without halo is the whole
    table; its last row is followed by its first.
    """
    held = first = None  # (part, id, text, signature)

    def emit(pairs: list) -> pa.RecordBatch:
        edited = []
        for (_, _, a, _), (_, _, b, _) in pairs:
            k = len(a) // 3
            edited.append(a[: len(a) - k] + b[:k])
        sig, nxt = (np.array([p[side][3] for p in pairs], np.uint32).reshape(-1, PERMUTATIONS) for side in (0, 1))
        changed = signatures(pa.array(edited, pa.large_string()))
        cols = [
            pa.array([None if p[1] == _NO_ID else p[1] for p, _ in pairs], pa.int64()), pa.array([len(p[2]) for p, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), pa.array([encode(x) for x in sig], pa.string()),
            pa.array([encode(x) for x in changed], pa.string()), pa.array(likeness(sig, changed)), pa.array(likeness(sig, nxt)),
        ]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _EDITED.split(", ")])

    for b in batches:
        sig = signatures(b.column("text"))
        pairs = []
        for i, (part, own, id_, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("part", "own", "id", "text")), strict=True)):
            row = (part, id_, text, sig[i])
            if held is not None and held[0] == part:
                pairs.append((held, row))
            held = row if own else None if held is None or held[0] == part else held
            first = row if first is None else first
        if pairs:
            yield emit(pairs)
    if held is not None:
        yield emit([(held, first)])


def fingerprints_and_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last floor(n_chars / 3) code points replaced by as
    many first ones of the next document by descending id (after the last, the first).

    The table is dealt once, by ranges of ids, and sorted within them by Spark, which spills; the row that
    follows a range is sent to it as well.
    """
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    splits = np.array(_splits(slim.select("id"), min(block_count(docs, block_bytes), MAX_RANGES)), np.int64)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for b in batches:
            ids = b.column(0).to_numpy()
            part = np.searchsorted(splits, ids, "right")
            for p in np.unique(part).tolist():
                most[p] = max(most.get(p, _NO_ID), int(ids[part == p].max()))
        yield pa.RecordBatch.from_arrays([pa.array(most.keys(), pa.int32()), pa.array(most.values(), pa.int64())], ["part", "top"])

    tops = dict(slim.select("id").mapInArrow(top, "part int, top long").groupBy("part").agg(F.max("top")).collect())  # one row per range
    full = sorted(tops)
    goes = {tops[p]: full[(i + 1) % len(full)] for i, p in enumerate(full)}  # the first row of a range follows the next higher range
    first = np.array(sorted(goes), np.int64)
    to = np.array([goes[i] for i in first.tolist()], np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            part = np.searchsorted(splits, ids, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.ones(len(ids), bool)), b.column(0), b.column(1)], ["part", "own", "id", "text"])
            at = np.minimum(np.searchsorted(first, ids), len(first) - 1)
            halo = np.flatnonzero(first[at] == ids)
            if len(halo) and len(full) > 1:
                h = b.take(pa.array(halo))
                yield pa.RecordBatch.from_arrays([pa.array(to[at[halo]]), pa.array(np.zeros(len(halo), bool)), h.column(0), h.column(1)], ["part", "own", "id", "text"])

    dealt = slim.mapInArrow(deal, "part int, own boolean, id long, text string").repartition(max(len(full), 1), "part")
    return dealt.sortWithinPartitions("part", F.desc("own"), F.desc("id"), "text").mapInArrow(_compare_with_next, _EDITED)
