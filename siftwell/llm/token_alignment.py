"""Ids of two tokenizers side by side, and how often each pair of ids meets.

Both tokenizers cut the same bytes (a space and the text).  Two dictionaries lead from the byte offsets at which tokens end to
the tokens' places; the offsets that both hold cut the id lists into groups.  Tokens of a group link where their bytes overlap: as no
two ends inside a group agree, its links are as many as its ends, one for each stretch between neighbouring ends.

Documents are read in slices of SLICE_BYTES of text.  A slice is one row: its documents' figures, their links as places in the slice's
list of different pairs, and that list with the number of documents that hold each.  Only these lists are exploded and
summed, so a pair in every document is one row a slice and not one a document, and no group holds more than a slice.

Null and empty texts, and texts whose tokens do not give back the same bytes, have no tokens: zeros and ''.  Repeated rows are
documents each.  An empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import tokens
from siftwell.llm.runtime import materialize

SLICE_BYTES = 4 << 20
#: texts that go to the second tokenizer at once
BATCH_BYTES = 1 << 18

FIGURES = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_SLICE = "slice long, " + ", ".join(f"{c} array<long>" for c in FIGURES) + ", groups_sha256 array<string>, n_pairs array<int>, steps array<int>, times array<int>, pairs array<long>, holders array<long>"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """A byte-level BPE file (a) and a sentencepiece model with byte fallback (b)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = tokens.encoder(a_path).fast
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        ranks = self.a._mergeable_ranks
        self.a_size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.a_size[i] = len(token)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        # each id written with what follows it: ',' within a side, '|' after a group's last id of a, ';' after that of b
        names = [str(i).encode() for i in range(max(len(self.a_size), len(self.b_size)))]
        self.width = len(names)
        self.written = [n + sep for sep in (b",", b"|", b";") for n in names]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Both id lists of each text; empty ones where a text has no tokens by the rules above."""
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            same = text and b"".join(map(self.b_bytes.__getitem__, b)) == (" " + text).encode()
            a = np.array(self.a.encode_ordinary(" " + text) if same else [], np.int64)
            # a's tokens are the text's bytes cut: they differ only if some are missing
            yield (a, np.array(b, np.int64)) if len(a) and self.a_size[a].sum() == len(text.encode()) + 1 else (a[:0], a[:0])

    def spelled(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> bytes:
        """a1,a2|b1;a3|b2,b3"""
        group_a, group_b = np.searchsorted(cut_a, np.arange(len(a)), "right"), np.searchsorted(cut_b, np.arange(len(b)), "right")
        written = np.empty(len(a) + len(b), np.int64)
        sep_a, sep_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sep_a[cut_a - 1], sep_b[cut_b - 1] = 1, 2
        written[np.arange(len(a)) + np.append(0, cut_b)[group_a]] = a + self.width * sep_a
        written[np.arange(len(b)) + cut_a[group_b]] = b + self.width * sep_b
        return b"".join(map(self.written.__getitem__, written.tolist()))[:-1]


@lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def cuts(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places behind each group's last token in either list, by the ends that both dictionaries hold."""
    place_a, place_b = dict(zip(ends_a, range(1, len(ends_a) + 1), strict=True)), dict(zip(ends_b, range(1, len(ends_b) + 1), strict=True))
    common = sorted(place_a.keys() & place_b.keys())
    return np.array(list(map(place_a.__getitem__, common)), np.int64), np.array(list(map(place_b.__getitem__, common)), np.int64)


def links(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Every link as a * 2**32 + b.  Slices are expanded together: a stretch between two neighbouring ends lies in one token of
    each list, and two tokens overlap in one stretch."""
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = ends[np.append(ends[1:] != ends[:-1], True)]
    return (a[np.searchsorted(ends_a, ends)] << 32) | b[np.searchsorted(ends_b, ends)]


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, ascending, and how often each stands there."""
    v = np.sort(values)
    at = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    return v[at], np.diff(at, append=len(v))


class _Slice:
    def __init__(self):
        self.figures: list[tuple] = []
        self.digests: list[str] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, t: Tokenizers, doc: int | None, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            self.figures.append((doc, 0, 0, 0, 0))
            self.digests.append("")
            self.pairs.append(np.zeros(0, np.int64))
            self.times.append(np.zeros(0, np.int64))
            return
        ends_a, ends_b = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
        cut_a, cut_b = cuts(ends_a.tolist(), ends_b.tolist())
        every = links(a, b, ends_a, ends_b)
        pairs, times = counted(every)
        self.figures.append((doc, len(a), len(b), len(cut_a), len(every)))
        self.digests.append(hashlib.sha256(t.spelled(a, b, cut_a, cut_b)).hexdigest())
        self.pairs.append(pairs)
        self.times.append(times)

    def row(self, number: int) -> pa.RecordBatch:
        pairs, place = np.unique(np.concatenate(self.pairs), return_inverse=True)
        sizes = [len(p) for p in self.pairs]
        steps = np.diff(place, prepend=0)
        firsts = np.cumsum([0, *sizes[:-1]])
        firsts = firsts[np.array(sizes) > 0]
        steps[firsts] = place[firsts]
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        cols = [pa.array([number], pa.int64()), *[one([f[i] for f in self.figures], pa.int64()) for i in range(len(FIGURES))], one(self.digests, pa.string())]
        cols += [one(sizes, pa.int32()), one(steps, pa.int32()), one(np.concatenate(self.times), pa.int32()), one(pairs, pa.int64()), one(np.bincount(place, minlength=len(pairs)), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["slice", *FIGURES, "groups_sha256", "n_pairs", "steps", "times", "pairs", "holders"])


def slices(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = tokenizers(a_path, b_path), TaskContext.get().partitionId() << 33
        part, held, size, waiting = _Slice(), [], 0, 0

        def encode_held() -> None:
            for (doc, _), (a, b) in zip(held, t.encode([text for _, text in held]), strict=True):
                part.add(t, doc, a, b)
            held.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                held.append((doc.as_py(), text.as_py() or ""))
                size, waiting = size + len(held[-1][1]), waiting + len(held[-1][1])
                if waiting >= BATCH_BYTES or len(held) >= 1000:
                    encode_held()
                    waiting = 0
                if size >= slice_bytes:
                    encode_held()
                    yield part.row(number)
                    number, part, size, waiting = number + 1, _Slice(), 0, 0
        encode_held()
        if part.figures:
            yield part.row(number)

    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, _SLICE)


def pair_counts(parts: DataFrame) -> DataFrame:
    """pair, n (documents that hold it), best (n is the highest of its a id)."""
    n = parts.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.holders").alias("n"))
    n = materialize(n.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return n.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, slice_bytes: int = SLICE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its tokens, groups and links, how many links are the best of their a id, and the sum of the links' counts."""
    a_default, b_default = default_paths()
    parts = materialize(slices(docs, a_path or a_default, b_path or b_default, slice_bytes, id_col, text_col), "aligned", rows_a_group=1)
    asked = parts.select("slice", F.posexplode("pairs").alias("at", "pair"))
    value = F.shiftleft("n", 1) + F.col("best").cast("long")
    answers = asked.join(pair_counts(parts).select("pair", value.alias("value")), "pair").select(F.col("slice").alias("of"), "at", "value")

    def run(slice_row: pa.Table, found: pa.Table) -> pa.Table:
        row = {name: slice_row.column(name).chunk(0)[0].values for name in slice_row.column_names if name != "slice"}
        value = np.zeros(found.num_rows, np.int64)
        value[found.column("at").to_numpy()] = found.column("value").to_numpy()
        sizes, steps, times = (row[c].to_numpy(zero_copy_only=False) for c in ("n_pairs", "steps", "times"))
        best, total, at = [], [], 0
        for size in sizes.tolist():
            v, t = value[np.cumsum(steps[at : at + size])], times[at : at + size].astype(np.int64)
            best.append(int(((v & 1) * t).sum()))
            total.append(int(((v >> 1) * t).sum()))
            at += size
        return pa.Table.from_arrays([*[row[c] for c in FIGURES], pa.array(best, pa.int64()), pa.array(total, pa.int64()), row["groups_sha256"]], [f.split()[0] for f in OUT.split(", ")])

    # one slice at a time: gathered lists would hold as many slices at once as a task or a batch has
    return parts.drop("pairs", "holders").groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(run, OUT)
