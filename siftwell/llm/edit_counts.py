"""Token counts that follow edits, by segment trees over pre-token runs.

A document is cut into leaves of about LEAF characters at places no pre-token crosses: before a space
with text on both sides.  Two sum trees hold each leaf's ids and characters.  An edit finds its leaves by
character offset, takes one leaf more on either side as boundary context, encodes that region alone
and updates the sums on the way to the root.  The count after any series of edits equals a full
encoding of the edited text.

Null texts are empty.  Edits are applied in order, each to the text that the one before has left; offsets
beyond the text's end mean its end, negative ones its start, null replacements the empty string.  A null
list of edits is an empty one.  Repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.tokens import Encoder, default_path, encoder

LEAF = 256


def cut_leaves(text: str, size: int = LEAF) -> list[str]:
    """Pieces of about `size` characters; longer where no safe place follows."""
    out, at, n = [], 0, len(text)
    while n - at > size:
        i = text.find(" ", at + size)
        while i >= 0 and (i + 1 >= n or text[i - 1].isspace() or text[i + 1].isspace()):
            i = text.find(" ", i + 1)
        if i < 0:
            break
        out.append(text[at:i])
        at = i
    out.append(text[at:])
    return out


class CountTree:
    """Leaves of a text with sum trees of ids and characters."""

    def __init__(self, text: str, enc: Encoder):
        self.enc, self.encoded = enc, len(text)
        self._build(cut_leaves(text))

    def _build(self, leaves: list[str]) -> None:
        self.leaves = leaves
        self.cap = 1 << max(len(leaves) - 1, 0).bit_length()
        self.ids, self.chars = [0] * (2 * self.cap), [0] * (2 * self.cap)
        for i, leaf in enumerate(leaves):
            self.ids[self.cap + i], self.chars[self.cap + i] = len(self.enc.ids(leaf)) if leaf else 0, len(leaf)
        for i in range(self.cap - 1, 0, -1):
            self.ids[i] = self.ids[2 * i] + self.ids[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.ids[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, offset: int) -> tuple[int, int]:
        """Leaf that holds a character offset (the last one at the end) and the offset within it."""
        i = 1
        while i < self.cap:
            i *= 2
            if offset >= self.chars[i] and self.chars[i + 1]:
                offset -= self.chars[i]
                i += 1
        return i - self.cap, offset

    def _set(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        i = self.cap + leaf
        ids, chars = (len(self.enc.ids(text)) if text else 0) - self.ids[i], len(text) - self.chars[i]
        while i:
            self.ids[i] += ids
            self.chars[i] += chars
            i //= 2

    def edit(self, start: int, length: int, replacement: str) -> None:
        start = min(max(start, 0), self.n_chars)
        length = min(max(length, 0), self.n_chars - start)
        first, at = self._find(start)
        last, _ = self._find(max(start + length - 1, start))
        lo, hi = first, last
        while lo > 0 and (lo == first or not self.leaves[lo]):
            lo -= 1
        while hi < len(self.leaves) - 1 and (hi == last or not self.leaves[hi]):
            hi += 1
        at += sum(map(len, self.leaves[lo:first]))
        region = "".join(self.leaves[lo : hi + 1])
        region = region[:at] + replacement + region[at + length :]
        self.encoded += len(region)
        new = cut_leaves(region)
        slots = hi - lo + 1
        if len(new) > 4 * slots:  # a long insertion: the leaves no longer fit their places
            self._build(self.leaves[:lo] + new + self.leaves[hi + 1 :])
            self.encoded += self.n_chars - len(region)
            return
        share = -(-len(new) // slots)
        for k in range(slots):
            self._set(lo + k, "".join(new[k * share : (k + 1) * share]))


def count_after_edits(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """docs: doc_id, text, edits (array of start, length, replacement).  Returns doc_id, n_tokens (before),
    edited_chars, edited_tokens and encoded_chars (characters encoded for the edits)."""
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            out = []
            for doc, text, edits in zip(b.column(0), b.column(1), b.column(2), strict=True):
                tree = CountTree(text.as_py() or "", enc)
                before, built = tree.n_tokens, tree.encoded
                for e in edits.as_py() or []:
                    tree.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
                out.append((doc.as_py(), before, tree.n_chars, tree.n_tokens, tree.encoded - built))
            names = ["doc_id", "n_tokens", "edited_chars", "edited_tokens", "encoded_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names)

    edits = F.col("edits").cast("array<struct<start:long,length:long,replacement:string>>")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"), edits.alias("edits"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, edited_chars long, edited_tokens long, encoded_chars long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the edits of a table (doc_id, seq, start, length, replacement) as an ordered list."""
    lists = edits.where("doc_id is not null").groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "start", "length", "replacement"))), lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["replacement"].alias("replacement"))).alias("edits")
    )
    return docs.select("doc_id", "text").join(lists, "doc_id", "left")


def three_edits(docs: DataFrame) -> DataFrame:
    """docs with three edits each: a cut at a quarter, an insertion of the text's own start at the half, a
    replacement at three quarters."""
    n = F.length(F.coalesce("text", F.lit("")))
    e = lambda start, length, text: F.struct(F.floor(start).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), text.alias("replacement"))
    start = F.substring(F.coalesce("text", F.lit("")), 1, 24)
    return docs.select("doc_id", "text", F.array(e(n / 4, 17, F.lit("")), e(n / 2, 0, start), e(n * 3 / 4, 9, F.lit(" edited here "))).alias("edits"))
