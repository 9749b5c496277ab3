"""Vectorised word and shingle hashing over Arrow string batches.

Words are maximal runs of bytes other than space and 0x09-0x0D, after A-Z are
lower-cased; every separator is one ASCII byte, so UTF-8 text is split as
bytes.  A word hash is a polynomial over per-byte random values, read off
prefix sums, so a slice of many documents costs a fixed number of numpy passes
whatever its words are.  Hashes are 64 bits wide and depend on nothing but the
text: two runs, two executors and two partitionings agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
SLICE_BYTES = 1 << 19
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n reproducible 64-bit values for a seed."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed) * U64(0xD1B54A32D192ED03))


_BYTE = seeded(256, 11)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C55  # odd, hence invertible modulo 2**64
_COEF = seeded(64, 12) | U64(1)
_LOWER_BYTE = _BYTE[_LOWER]
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        with np.errstate(over="ignore"):
            up = np.full(size, U64(_BASE))
            down = np.full(size, U64(pow(_BASE, -1, 1 << 64)))
            up[0] = down[0] = U64(1)
            _powers = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
    return _powers


@dataclass
class Slice:
    """Words of documents first .. first + n_docs - 1 of a batch."""

    first: int
    n_docs: int
    raw: np.ndarray  #: the bytes of the slice
    doc_start: np.ndarray  #: byte offset of each document, with the end appended
    start: np.ndarray  #: byte offset of each word
    end: np.ndarray
    hashes: np.ndarray
    word_from: np.ndarray  #: index of each document's first word, with the end appended


def _string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    bufs = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return offsets, data


def word_slices(col: pa.Array, slice_bytes: int = SLICE_BYTES, want_hashes: bool = True) -> Iterator[Slice]:
    """Cut a string column into slices of whole documents and hash their words.

    Nulls are empty texts.  A document longer than slice_bytes is a slice of its own.
    """
    offsets, data = _string_buffers(col)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + slice_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        raw = data[offsets[i] : offsets[j]]
        doc_start = offsets[i : j + 1] - offsets[i]
        solid = np.ones(len(raw) + 1, dtype=bool)
        solid[0] = False
        np.logical_not(_SPACE[raw], out=solid[1:])
        begin = solid[1:] & ~solid[:-1]
        inner = doc_start[:-1][doc_start[:-1] < len(raw)]
        begin[inner] |= solid[1:][inner]
        start = np.flatnonzero(begin)
        stop = np.empty(len(raw), dtype=bool)
        if len(raw):
            stop[:-1] = solid[1:-1] & ~solid[2:]
            stop[-1] = solid[-1]
            last = doc_start[1:] - 1
            last = last[(last >= 0) & (np.diff(doc_start) > 0)]
            stop[last] |= solid[1:][last]
        end = np.flatnonzero(stop) + 1
        if want_hashes:
            up, down = _power_tables(len(raw) + 1)
            with np.errstate(over="ignore"):
                sums = np.empty(len(raw) + 1, U64)
                sums[0] = 0
                np.cumsum(_LOWER_BYTE[raw] * up[: len(raw)], dtype=U64, out=sums[1:])
                hashes = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
        else:
            hashes = np.zeros(0, U64)
        yield Slice(i, j - i, raw, doc_start, start, end, hashes, np.searchsorted(start, doc_start))
        i = j


def shingle_hashes(hashes: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of every k consecutive words (across documents too: callers cut per document)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = hashes[:n] * _COEF[0]
        for j in range(1, k):
            out += hashes[j : j + n] * _COEF[j]
        return mix64(out)


def short_hash(hashes: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer than k words: its whole sequence."""
    with np.errstate(over="ignore"):
        return mix64((hashes * _COEF[: len(hashes)]).sum(dtype=U64, keepdims=True) + U64(len(hashes)) * _COEF[63])


def shingle_sets(col: pa.Array, k: int = SHINGLE_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every row; empty for texts without words."""
    for s in word_slices(col):
        grams = shingle_hashes(s.hashes, k)
        bounds = s.word_from.tolist()
        for d in range(s.n_docs):
            a, b = bounds[d], bounds[d + 1]
            if b - a >= k:
                g = np.sort(grams[a : b - k + 1])
                keep = np.empty(len(g), bool)
                keep[0] = True
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                yield s.first + d, g[keep]
            elif b > a:
                yield s.first + d, short_hash(s.hashes[a:b])
            else:
                yield s.first + d, np.zeros(0, U64)


def set_key(values: np.ndarray) -> int:
    """Order-free 64-bit key of a set of hashes, as a signed integer."""
    with np.errstate(over="ignore"):
        x = mix64(values + U64(0x632BE59BD9B4E019))
        total = x.sum(dtype=U64) * U64(0xFF51AFD7ED558CCD) + np.bitwise_xor.reduce(x) if len(x) else U64(0)
    return int(np.int64(np.uint64(total)))
