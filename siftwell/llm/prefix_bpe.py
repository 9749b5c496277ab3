"""Byte-level BPE by dynamic programming over byte prefixes.

The codes of a byte string end in one token, and so do the codes of each of its prefixes: last[i] is the last token of
the first i bytes.  A token t that ends at i is last[i] exactly if BPE would leave last[i - len(t)] and t side by side,
so last[i] follows from the bytes before i and from earlier entries alone.  Codes are read off by walking back.  An
append computes the new entries only; an edit computes entries from its start until as many entries as the longest token
has bytes agree with the old ones, after which all others do.

A text is first cut into the matches of a pattern, each of which is coded by itself.  Ids equal tiktoken's: a match that
is a token as a whole is that token, and equal merges are taken from the left.

Null texts are empty: no ids, and digests of no bytes.  Repeated rows give a row each; an empty table gives no rows; columns
other than the id and the text are not read.  Edits follow the rules of edit_counts.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.tokens import PATTERN

#: entries of a worker's tables of codes of pieces and of pairs; when full they are emptied
MEMO_ENTRIES = 400_000
#: longer pieces are coded each time
MEMO_CHARS = 64
ID = np.dtype("<u4")

_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"  # letters, all of them
_MARKS = "\u2010-\u2015\u2018-\u201e\u2026\u20ac"  # neither letters, digits nor white space
#: PATTERN with its classes written out for texts of these characters alone, which the standard library cuts in half the time
NOT_PLAIN = re.compile(f"[^\\x00-\\x7f{_LATIN}{_MARKS}]")
PLAIN_PATTERN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{_LATIN}]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9{_LATIN}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Merges:
    """Tokens of a rank file with the merge that makes each, and tests of neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.whole: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and max(a, b) < i and self._stay_apart(a, b):
                    self.parts[i], self.whole[a, b] = (a, b), i
                    break
        # tokens by their bytes read backwards; what no merge makes is left out
        self.ending: dict = {}
        for token, i in ranks.items():
            if len(token) == 1 or i in self.parts:
                node = self.ending
                for byte in reversed(token):
                    node = node.setdefault(byte, {})
                node[-1] = i

    def _stay_apart(self, a: int, b: int) -> bool:
        """Follow the tokens on both sides of the border back in time: a stands until the merge that swallows it, and so
        does b.  They meet if their own merge comes before that of a, and before that of b or together with it (it lies further left)."""
        gone_a = gone_b = len(self.ranks) + 1
        while True:
            meet = self.whole.get((a, b))
            if meet is not None and meet < gone_a and meet <= gone_b:
                return False
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is not None and (pb is None or a > b):
                gone_a, a = a, pa_[1]
            elif pb is not None:
                gone_b, b = b, pb[0]
            else:
                return True

    def apart(self, a: int, b: int) -> bool:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= MEMO_ENTRIES:
                self.known.clear()
            found = self.known[a, b] = self._stay_apart(a, b)
        return found

    def fill(self, data: bytes, last: list[int]) -> list[int]:
        """last with the entries of the remaining prefixes of data."""
        top, known, apart = self.ending, self.known, self.apart
        for end in range(len(last), len(data) + 1):
            at, fits = end - 1, []
            node = top.get(data[at])
            while node is not None:
                token = node.get(-1)
                if token is not None:
                    fits.append((at, token))
                if not at:
                    break
                at -= 1
                node = node.get(data[at])
            while fits:
                at, token = fits.pop()
                if not at:
                    break
                pair = (last[at], token)
                fine = known.get(pair)
                if fine or (fine is None and apart(*pair)):
                    break
            else:
                raise ValueError("the rank file lacks a single byte")
            last.append(token)
        return last


class Prefixes:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data, self.last, self.computed = merges, b"", [-1], 0
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.last = self.merges.fill(self.data, self.last)
        self.computed += len(data)

    def replace(self, start: int, stop: int, data: bytes) -> None:
        """Put data in place of the bytes start .. stop - 1."""
        old, shift = self.last, len(data) - (stop - start)
        whole = self.data = self.data[:start] + data + self.data[stop:]
        last, need, edited = old[: start + 1], self.merges.longest, start + len(data)
        agree, end = 0, start
        while end < len(whole):
            block = min(max(end + need, edited), len(whole))
            self.merges.fill(whole[:block], last)
            self.computed += block - end
            for end in range(end + 1, block + 1):
                agree = agree + 1 if end >= edited and old[end - shift] == last[end] else 0
            if agree >= need:
                last.extend(old[end - shift + 1 :])
                break
        self.last = last

    def become(self, data: bytes) -> None:
        """Replace what differs between the old bytes and data."""
        old = self.data
        start, most = 0, min(len(old), len(data))
        while start < most and old[start] == data[start]:
            start += 1
        tail = 0
        while tail < most - start and old[-1 - tail] == data[-1 - tail]:
            tail += 1
        self.replace(start, len(old) - tail, data[start : len(data) - tail])

    def ids(self) -> list[int]:
        out, end, size = [], len(self.data), self.merges.bytes_of
        while end:
            out.append(self.last[end])
            end -= len(size[out[-1]])
        return out[::-1]


class Codes(dict):
    """Ids, as bytes, of the pieces met so far; others are coded on the way."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        super().__init__()
        self.merges = Merges(ranks)
        self.pattern = regex.compile(pattern)
        self.plain = PLAIN_PATTERN if pattern == PATTERN else None

    def cut(self, text: str) -> list[str]:
        if self.plain is not None and not NOT_PLAIN.search(text):
            return self.plain.findall(text)
        return self.pattern.findall(text)

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        token = self.merges.ranks.get(data)
        ids = [token] if token is not None else Prefixes(self.merges, data).ids()
        out = np.array(ids, ID).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as unsigned 32-bit little-endian bytes."""
        return b"".join(map(self.__getitem__, self.cut(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merges.bytes_of.__getitem__, np.frombuffer(ids, ID).tolist()))


class EditableText:
    """A text with the prefix tables of its pieces, kept up to date through appends and edits."""

    def __init__(self, codes: Codes, text: str = ""):
        self.codes, self.text = codes, text
        self.pieces = [Prefixes(codes.merges, p.encode()) for p in codes.cut(text)]
        self.sizes = [len(p) for p in codes.cut(text)]
        self.dropped = 0

    @property
    def computed(self) -> int:
        """Entries computed so far."""
        return self.dropped + sum(p.computed for p in self.pieces)

    def append(self, text: str) -> None:
        self.edit(len(self.text), 0, text)

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Pieces are cut anew from two pieces before the edit (and before white space there, which is read ahead), until a
        border falls on an old one behind the edit: a match reads nothing before its start, so all later ones are as before."""
        start = min(max(start, 0), len(self.text))
        stop = min(start + max(length, 0), len(self.text))
        ends = list(accumulate(self.sizes))
        first = max(bisect_right(ends, max(start - 1, 0)) - 2, 0)
        begins = [0, *ends]
        while first and self.text[begins[first] : begins[first + 1]].isspace():
            first -= 1
        self.text = self.text[:start] + replacement + self.text[stop:]
        shift, edited = len(replacement) - (stop - start), start + len(replacement)
        old_at = {b: i for i, b in enumerate(begins) if b >= stop}
        at, sizes, cuts = begins[first], [], []
        until = len(self.sizes)
        while at < len(self.text):
            if at >= edited and at - shift in old_at:
                until = old_at[at - shift]
                break
            piece = self.codes.pattern.match(self.text, at).group()
            sizes.append(len(piece))
            cuts.append(piece)
            at += len(piece)
        old = self.pieces[first:until]
        new = []
        for i, piece in enumerate(cuts):
            data = piece.encode()
            if i < len(old):  # the piece in the same place most likely shares a part of its bytes
                old[i].become(data)
                new.append(old[i])
            else:
                new.append(Prefixes(self.codes.merges, data))
        self.dropped += sum(p.computed for p in old[len(cuts) :])
        self.pieces[first:until], self.sizes[first:until] = new, sizes

    def ids(self) -> list[int]:
        ranks = self.codes.merges.ranks
        return [i for p in self.pieces for i in ([ranks[p.data]] if p.data in ranks else p.ids())]


@lru_cache(maxsize=1)
def codes(path: str) -> Codes:
    return Codes(path)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: unsigned 32-bit little-endian) of every text.  One pass, nothing is shuffled."""
    file = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codes(file)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t.as_py() or "") for t in b.column(1)], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, data (binary) of rows doc_id, ids."""
    file = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codes(file)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(i.as_py() or b"") for i in b.column(1)], pa.binary())], ["doc_id", "data"])

    return rows.select(F.col("doc_id").cast("long").alias("doc"), "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text coded, and its ids decoded again."""
    file = path or default_path()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codes(file)
        for b in batches:
            n, ids_sha, data_sha = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py() or "")
                n.append(len(ids) // ID.itemsize)
                ids_sha.append(_sha(ids))
                data_sha.append(_sha(c.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())], names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_after_edits(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs: doc_id, text, edits (array of start, length, replacement; see edit_counts).  doc_id, ids (binary) of the edited
    text and computed: the prefixes whose last token the edits made anew."""
    file = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codes(file)
        for b in batches:
            ids, computed = [], []
            for text, edits in zip(b.column(1), b.column(2), strict=True):
                t = EditableText(c, text.as_py() or "")
                before = t.computed
                for e in edits.as_py() or []:
                    t.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
                ids.append(np.array(t.ids(), ID).tobytes())
                computed.append(t.computed - before)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(computed, pa.int64())], ["doc_id", "ids", "computed"])

    edits = F.col("edits").cast("array<struct<start:long,length:long,replacement:string>>")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"), edits.alias("edits"))
    return slim.mapInArrow(run, "doc_id long, ids binary, computed long")
