"""Document scores by prediction by partial matching (PPM) over bytes, pretrained on the whole corpus.

A document is its bytes with A-Z lower-cased, after START marks, and one END.  Each byte is predicted from the ORDER
bytes before it, whatever they are (spaces and earlier words too), with escapes by method D and symbol exclusion: in
the longest context that training saw, a symbol seen c of n times among d distinct ones has probability
(2c - 1) / 2n and the escape d / 2n; after an escape, n and d of the next shorter context leave out the symbols of
the one before; below order 0, all symbols not seen there are equally likely.

At an anchor a context of LONG bytes comes first, if training saw one continuation only (a deterministic context, as
in PPM*).  An anchor follows a separator whose last ORDER + 1 bytes hash to a multiple of ANCHOR, so equal passages
have equal anchors wherever they stand; the bytes up to the next anchor are a unit.  Where training saw c times the
unit u and nothing else after the LONG bytes, each byte of u costs log10((2c - 1) / 2c), and a document that goes on
otherwise escapes at the anchor by log10(1 / 2c) and spells its unit by the shorter contexts.  The probabilities of
all texts sum to at most one.

The model has every context of every training document and grows with them; none is pruned and nothing of it passes
through the driver or a broadcast.  Documents are written once in pieces of PIECE_BYTES.  A piece sends its distinct
(context, byte) keys, long contexts and words with their training counts to hash blocks, one entry a key, so that a
key of a third of all rows arrives as one entry a piece.  A block adds up and answers with costs and counts.  Keys that
training never saw (in held-out documents) get their escapes by joins of the counts of orders ORDER to 0, one level at
a time over distinct keys: at most 256 rows meet in one key there.  The piece's own block sums up its documents.

Long contexts and words are told apart by log2(hash blocks) + 40 bits of a 64-bit hash, units by 32 bits beside their
context.  The baseline counts words exactly otherwise.

Null texts are empty: one end token.  Null ids hash as empty text and come back null.  Rows that repeat an
id are scored and counted each.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.ngram_join import _pack40, _unpack40
from siftwell.llm.runtime import block_count, materialize, release_memory
from siftwell.llm.textkit import _BYTE, _LOWER, _SPACE, U64, _power_tables, _string_buffers, mix64

ORDER = 4
LONG = 16
ANCHOR = 4
HOLD_OUT = 10
PIECE_DOCS = 4_000
PIECE_BYTES = 5 << 19
HASH_BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 19
START, END = 0xFF, 0xFE  # bytes that UTF-8 never uses
SYMBOLS = 255  # that can be predicted: all but START
_LOW40 = U64((1 << 40) - 1)


@dataclass
class Parts:
    """Symbols, units and words of a piece of documents."""

    key: np.ndarray  #: of every symbol: the ORDER symbols before it and itself, a byte each
    doc: np.ndarray  #: its document
    long: np.ndarray  #: hash of the LONG symbols before each unit (first units of documents are left out)
    unit: np.ndarray  #: 32-bit hash of the unit
    begin: np.ndarray  #: its symbols
    end: np.ndarray
    unit_doc: np.ndarray
    word: np.ndarray  #: hash of every word
    word_doc: np.ndarray


def parts_of(raw: np.ndarray, bounds: np.ndarray) -> Parts:
    """raw: lower-cased bytes of all documents; bounds: where each begins, with the end appended."""
    out: list[list[np.ndarray]] = [[] for _ in range(9)]
    at, i, n = 0, 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + SLICE_BYTES, "right")) - 1
        j = min(max(j, i + 1), n)
        for c, x in zip(out, _slice_parts(raw, bounds, i, j, at), strict=True):
            c.append(x)
        at += len(out[0][-1])
        i = j
    kinds = (U64, np.int32, U64, np.uint32, np.int64, np.int64, np.int32, U64, np.int32)
    return Parts(*(np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(out, kinds, strict=True)))


def _slice_parts(raw: np.ndarray, bounds: np.ndarray, i: int, j: int, at: int) -> tuple[np.ndarray, ...]:
    n, size = j - i, np.diff(bounds[i : j + 1])
    first = np.arange(n) * (LONG + 1) + LONG + (bounds[i:j] - bounds[i])  # of each document in the padded bytes
    buf = np.full(int(size.sum()) + n * (LONG + 1), START, np.uint8)
    for d in range(n):
        buf[first[d] : first[d] + size[d]] = raw[bounds[i + d] : bounds[i + d + 1]]
    stop = first + size
    buf[stop] = END
    wide = buf.astype(U64)
    key = wide.copy()
    for k in range(1, ORDER + 1):
        key[k:] |= wide[:-k] << U64(8 * k)
    real = buf != START
    doc = np.repeat(np.arange(i, j, dtype=np.int32), size + 1)
    up, down = _power_tables(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(buf) + 1, U64)
        sums[0] = 0
        np.cumsum(_BYTE[buf] * up[: len(buf)], dtype=U64, out=sums[1:])
        space = _SPACE[buf]
        gap = np.flatnonzero(space)
        anchor = gap[mix64(key[gap]) % U64(ANCHOR) == 0] + 1
        edge = np.sort(np.concatenate([first, anchor]))
        owner = np.searchsorted(first, edge, "right") - 1
        end = np.minimum(np.append(edge[1:], len(buf)), stop[owner] + 1)
        inner = edge != first[owner]
        edge, end, owner = edge[inner], end[inner], owner[inner]
        long = mix64((sums[edge] - sums[edge - LONG]) * down[edge - LONG])
        unit = (mix64((sums[end] - sums[edge]) * down[edge] + (end - edge).astype(U64)) >> U64(32)).astype(np.uint32)
        solid = ~space & (buf < END)
        word = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
        word_end = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
        hashes = mix64((sums[word_end] - sums[word]) * down[word] + (word_end - word).astype(U64))
    shift = at - (owner + 1) * LONG  # padded places to numbers of symbols
    return key[real], doc, long, unit, edge + shift, end + shift, (owner + i).astype(np.int32), hashes, (np.searchsorted(first, word, "right") - 1 + i).astype(np.int32)


def _held_out(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % HOLD_OUT == 0 for i in ids.to_pylist()], bool)


_PIECE_DDL = "block long, docs binary, size long, text binary"


def _write_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of bounded rows and bytes (a longer document is one by itself): ids, flags and lengths, and compressed text."""
    part, serial, codec = TaskContext.get().partitionId(), 0, pa.Codec("zstd")
    for batch in batches:
        offsets, data = _string_buffers(batch.column(1))
        held = _held_out(batch.column(0))
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        i, n = 0, batch.num_rows
        while i < n:
            j = int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, "right")) - 1
            j = min(max(j, i + 1), i + PIECE_DOCS, n)
            docs = np.column_stack([ids[i:j], held[i:j], missing[i:j], np.diff(offsets[i : j + 1])]).astype(np.int64)
            raw = _LOWER[data[offsets[i] : offsets[j]]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + serial]), pa.array([docs.tobytes()], pa.binary()), pa.array([len(raw)]), pa.array([codec.compress(raw.tobytes(), asbytes=True)], pa.binary())],
                ["block", "docs", "size", "text"],
            )
            serial += 1
            i = j
        del data, offsets, batch
        release_memory()


def _read_piece(docs: bytes, size: int, text: bytes) -> tuple[np.ndarray, Parts]:
    d = np.frombuffer(docs, np.int64).reshape(-1, 4)
    raw = np.frombuffer(pa.Codec("zstd").decompress(text, size, asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return d, parts_of(raw, np.concatenate([[0], np.cumsum(d[:, 3])]))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each stands (a plain sort is several times as fast as np.unique here)."""
    x = np.sort(x)
    cut = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[cut], np.diff(np.append(cut, len(x)))


def _found(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and which of them each value is."""
    coded = pa.array(x).dictionary_encode()
    values = coded.dictionary.to_numpy()
    order = np.argsort(values)
    place = np.empty(len(values), np.int32)
    place[order] = np.arange(len(values), dtype=np.int32)
    return values[order], place[coded.indices.to_numpy()]


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each stands in training documents."""
    seen, times = _distinct(keys[train])
    every, _ = _distinct(np.concatenate([seen, _distinct(keys[~train])[0]]))
    count = np.zeros(len(every), "<u4")
    count[np.searchsorted(every, seen)] = times
    return every, count


def _longs(p: Parts, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct long contexts, sorted; the unit that training documents have after each and how often (0: none).
    Contexts with more than one are given the unit 0 and the count _MANY.  Last, which context each unit has."""
    every, place = _found(p.long)
    unit, count = np.zeros(len(every), "<u4"), np.zeros(len(every), "<u4")
    at = place[train]
    order = np.argsort(at, kind="stable")
    at, u = at[order], p.unit[train][order]
    if len(at):
        cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        low, high, times = np.minimum.reduceat(u, cut), np.maximum.reduceat(u, cut), np.diff(np.append(cut, len(at)))
        unit[at[cut]] = np.where(low == high, low, 0)
        count[at[cut]] = np.where(low == high, times, _MANY)
    return every, unit, count, place


_MANY = (1 << 32) - 1
_ASK_DDL = "to long, block long, keys binary, key_counts binary, longs binary, units binary, unit_counts binary, words binary, word_counts binary"
_ASK = pa.schema([("to", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("keys", "key_counts", "longs", "units", "unit_counts", "words", "word_counts"))])
_TOLD_DDL = "block long, from long, costs binary, novel binary, units binary, unit_counts binary, word_counts binary, trie_keys binary, trie_counts binary, n_words long, n_distinct long"
_TOLD = pa.schema([("block", pa.int64()), ("from", pa.int64()), *((c, pa.binary()) for c in ("costs", "novel", "units", "unit_counts", "word_counts", "trie_keys", "trie_counts")), ("n_words", pa.int64()), ("n_distinct", pa.int64())])


def _places(n_blocks: int, key: np.ndarray, long: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash block of each key (by its context), long context and word."""
    b = U64(n_blocks)
    return mix64(key >> U64(8)) % b, (long >> U64(40)) % b, (word >> U64(40)) % b


def _dealt(to: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(n_blocks + 1, dtype=U64))


def _ask(n_blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs, size, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                d, p = _read_piece(docs, size, text)
                train = d[:, 1] == 0
                key, key_count = _counted(p.key, train[p.doc])
                word, word_count = _counted(p.word, train[p.word_doc])
                long, unit, unit_count, _ = _longs(p, train[p.unit_doc])
                del p
                (ko, kc), (lo, lc), (wo, wc) = (_dealt(t, n_blocks) for t in _places(n_blocks, key, long, word))
                out = []
                for b in range(n_blocks):
                    k, x, w = ko[kc[b] : kc[b + 1]], lo[lc[b] : lc[b + 1]], wo[wc[b] : wc[b + 1]]
                    if len(k) or len(x) or len(w):
                        out.append((b, block, _pack40(key[k]), key_count[k].tobytes(), _pack40(long[x] & _LOW40), unit[x].tobytes(), unit_count[x].tobytes(), _pack40(word[w] & _LOW40), word_count[w].tobytes()))
                del key, key_count, word, word_count, long, unit, unit_count, ko, lo, wo
                for i in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out[i : i + 64]], f.type) for c, f in enumerate(_ASK)], schema=_ASK)
                del out
                release_memory()

    return run


def _column(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """A packed column as one array, and where each row's part of it begins."""
    parts = [_unpack40(x) if kind is None else np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _sum_by(at: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, counts, n).astype(np.int64)


def _answer(table: pa.Table) -> pa.Table:
    """One hash block: costs of keys that training saw (others: NaN), the one unit of a long context, counts of words."""
    to, blocks = table.column("to")[0].as_py(), table.column("block").to_pylist()
    key, kb = _column(table, "keys", None)
    known, at = _found(key)
    c = _sum_by(at, _column(table, "key_counts", "<u4")[0], len(known))
    seen, seen_count = known[c > 0], c[c > 0]
    cut = np.flatnonzero(np.append(True, (seen[1:] >> U64(8)) != (seen[:-1] >> U64(8)))) if len(seen) else np.zeros(0, np.int64)
    n = np.repeat(np.add.reduceat(seen_count, cut), np.diff(np.append(cut, len(seen)))) if len(seen) else seen_count
    cost = np.full(len(known), np.nan, np.float64)
    cost[c > 0] = np.log10((2.0 * seen_count - 1) / (2.0 * n))
    cost = cost[at]
    long, lb = _column(table, "longs", None)
    own, own_count = _column(table, "units", "<u4")[0], _column(table, "unit_counts", "<u4")[0].astype(np.int64)
    names, la = _found(long)
    many = np.bincount(la, own_count == _MANY, len(names)) > 0
    one = (own_count > 0) & (own_count < _MANY)
    low, high = np.full(len(names), 1 << 32, np.int64), np.full(len(names), -1, np.int64)
    np.minimum.at(low, la[one], own[one].astype(np.int64))
    np.maximum.at(high, la[one], own[one].astype(np.int64))
    times = np.where(many | (low != high), 0, _sum_by(la[one], own_count[one], len(names)))[la].astype("<u8")
    unit = np.where((times > 0) & ~one, low[la], 0).astype("<u4")  # a piece knows the unit that it sent
    word, wb = _column(table, "words", None)
    terms, wa = _found(word)
    total = _sum_by(wa, _column(table, "word_counts", "<u4")[0], len(terms)).astype("<u8")
    counts = total[wa]
    out = []
    for r, block in enumerate(blocks):
        k, x, w = slice(kb[r], kb[r + 1]), slice(lb[r], lb[r + 1]), slice(wb[r], wb[r + 1])
        mine = cost[k]
        out.append((block, to, mine.astype("<f4").tobytes(), _pack40(key[k][np.isnan(mine)]), unit[x].tobytes(), times[x].tobytes(), counts[w].tobytes(), None, None, None, None))
    del cost, key, long, word, at, la, wa, counts, times, unit
    out.append((None, to, None, None, None, None, None, seen.tobytes(), seen_count.tobytes(), int(total.sum()), int((total > 0).sum())))
    told = pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_TOLD)], schema=_TOLD)
    del out
    release_memory()
    return told


def _rows_of(columns: str, kinds: dict):
    """Unpack binary columns into rows; kinds: numpy kind of each, None for 40-bit keys, "" for a plain column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                cells = {c: b.column(c)[r].as_py() for c in kinds}
                packed = {c: _unpack40(v) if kinds[c] is None else np.frombuffer(v, kinds[c]) for c, v in cells.items() if kinds[c] != ""}
                n = len(next(iter(packed.values())))
                cols = [pa.array(packed[c].astype(np.int64)) if c in packed else pa.array(np.full(n, cells[c], np.int64)) for c in kinds]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in columns.split(", ")])

    return run


def escape_costs(trie: DataFrame, keys: DataFrame) -> DataFrame:
    """key and cost (log10) of keys that the trie lacks; trie: key, times of order ORDER."""
    mask = lambda k: (1 << (8 * (k + 1))) - 1
    cut = lambda c, k: F.col(c).bitwiseAND(F.lit(mask(k)))
    context = F.shiftright("key", 8).alias("ctx")
    seen = {ORDER: trie}
    for k in range(ORDER - 1, -1, -1):
        seen[k] = materialize(seen[k + 1].groupBy(cut("key", k).alias("key")).agg(F.sum("times").alias("times")), f"order{k}")
    stats = {k: t.groupBy(context).agg(F.sum("times").alias("n"), F.count("*").alias("d")) for k, t in seen.items()}
    steps, open_ = {}, materialize(keys.select("key").distinct(), "novel")
    for k in range(ORDER, 0, -1):
        # what the context of order k takes away from the next shorter one
        wanted = open_.select(context).distinct()
        held = seen[k].withColumn("ctx", F.shiftright("key", 8)).join(wanted, "ctx", "left_semi").select("ctx", cut("key", k - 1).alias("low"))
        gone = held.join(seen[k - 1].selectExpr("key as low", "times"), "low").groupBy("ctx").agg(F.sum("times").alias("gone"), F.count("*").alias("gone_d"))
        step = open_.withColumn("ctx", F.shiftright("key", 8)).withColumn("low", cut("key", k - 1)).withColumn("low_ctx", F.shiftright("low", 8))
        step = step.join(gone, "ctx", "left").join(stats[k].selectExpr("ctx", "n as own_n", "d as own_d"), "ctx", "left")
        step = step.join(stats[k - 1].selectExpr("ctx as low_ctx", "n", "d"), "low_ctx", "left").join(seen[k - 1].selectExpr("key as low", "times"), "low", "left")
        n, d = F.coalesce("n", F.lit(0)) - F.coalesce("gone", F.lit(0)), F.coalesce("d", F.lit(0)) - F.coalesce("gone_d", F.lit(0))
        first = F.when(F.col("own_n") > 0, F.log10(F.col("own_d") / (2 * F.col("own_n")))).otherwise(0.0) if k == ORDER else F.lit(0.0)
        here = F.when(F.col("times").isNotNull(), F.log10((2 * F.col("times") - 1) / (2 * n))).when(n > 0, F.log10(d / (2 * n))).otherwise(0.0)
        steps[k] = materialize(step.select("key", "low", (first + here).alias("cost"), F.col("times").isNull().alias("open")), f"escape{k}")
        open_ = steps[k].where("open").select(F.col("low").alias("key")).distinct()
    unseen = max(SYMBOLS - seen[0].count(), 1)
    costs = open_.select("key", F.lit(-math.log10(unseen)).alias("cost"))
    for k in range(1, ORDER + 1):
        below = costs.select(F.col("key").alias("low"), F.col("cost").alias("rest"))
        costs = steps[k].join(below, "low", "left").select("key", (F.col("cost") + F.when(F.col("open"), F.col("rest")).otherwise(0.0)).alias("cost"))
    return costs


_DOC = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("raw", pa.float64()), ("score", pa.float64())])
_DOC_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, raw double, score double"


def _sum_up(n_blocks: int):
    def run(table: pa.Table) -> pa.Table:
        """One piece: its documents' sums, from its text, the answers of the hash blocks and the costs of novel keys."""
        having = lambda c: table.filter(table.column(c).is_valid())
        own = having("text").select(["docs", "size", "text"]).to_pylist()[0]
        d, p = _read_piece(**own)
        told = {r["from"]: r for r in having("costs").select(["from", "costs", "units", "unit_counts", "word_counts"]).to_pylist()}
        novel = having("key")
        (key, key_at), (word, word_at) = _found(p.key), _found(p.word)
        train = d[:, 1] == 0
        long, sent, sent_count, at = _longs(p, train[p.unit_doc])
        cost, unit, times, count = np.zeros(len(key)), np.zeros(len(long), np.uint32), np.zeros(len(long), np.int64), np.zeros(len(word), np.int64)
        (ko, kc), (lo, lc), (wo, wc) = (_dealt(t, n_blocks) for t in _places(n_blocks, key, long, word))
        for b, r in told.items():
            cost[ko[kc[b] : kc[b + 1]]] = np.frombuffer(r["costs"], "<f4")
            x = lo[lc[b] : lc[b + 1]]
            unit[x], times[x] = np.frombuffer(r["units"], "<u4"), np.frombuffer(r["unit_counts"], "<u8")
            count[wo[wc[b] : wc[b + 1]]] = np.frombuffer(r["word_counts"], "<u8")
        if novel.num_rows:
            cost[np.searchsorted(key, novel.column("key").to_numpy().astype(U64))] = novel.column("cost").to_numpy()
        unit = np.where(sent_count > 0, sent, unit)
        n = len(d)
        symbol = cost[key_at]
        score = np.bincount(p.doc, symbol, n)
        sums = np.concatenate([[0.0], np.cumsum(symbol)])
        sure = times[at] > 0
        at, begin, end, doc, same = at[sure], p.begin[sure], p.end[sure], p.unit_doc[sure], (unit[at] == p.unit)[sure]
        twice = 2.0 * times[at]
        change = np.where(same, (end - begin) * np.log10((twice - 1) / twice) - (sums[end] - sums[begin]), -np.log10(twice))
        score += np.bincount(doc, change, n)
        c = count[word_at]
        words = np.bincount(p.word_doc, minlength=n)
        cols = [
            pa.array(d[:, 0], mask=d[:, 2] != 0), pa.array(d[:, 1] != 0), pa.array(words + 1), pa.array(np.bincount(p.word_doc, c > 0, n).astype(np.int64)),
            pa.array(np.bincount(p.word_doc, np.log10(c + 0.1), n)), pa.array(score),
        ]
        del p, symbol, sums, cost, key, key_at, word_at, c, told
        release_memory()
        return pa.Table.from_arrays(cols, schema=_DOC)

    return run


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    n_blocks = max(64, block_count(docs, HASH_BLOCK_BYTES))
    slim = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(slim.mapInArrow(_write_pieces, _PIECE_DDL), "pieces")
    told = materialize(pieces.mapInArrow(_ask(n_blocks), _ASK_DDL).groupBy("to").applyInArrow(_answer, _TOLD_DDL), "answers")
    answers, facts = told.where("block is not null"), told.where("block is null")
    trie = materialize(facts.select("trie_keys", "trie_counts").mapInArrow(_rows_of("key long, times long", {"trie_keys": "<u8", "trie_counts": "<i8"}), "key long, times long"), "trie")
    asked = materialize(answers.where("length(novel) > 0").select("block", "novel").mapInArrow(_rows_of("block long, key long", {"block": "", "novel": None}), "block long, key long"), "asked")
    costs = asked.join(escape_costs(trie, asked), "key")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    all_rows = (
        pieces.select("block", "docs", "size", "text", *none("long", "from"), *none("binary", "costs", "units", "unit_counts", "word_counts"), *none("long", "key"), *none("double", "cost"))
        .union(answers.select("block", *none("binary", "docs"), *none("long", "size"), *none("binary", "text"), "from", "costs", "units", "unit_counts", "word_counts", *none("long", "key"), *none("double", "cost")))
        .union(costs.select("block", *none("binary", "docs"), *none("long", "size"), *none("binary", "text"), *none("long", "from"), *none("binary", "costs", "units", "unit_counts", "word_counts"), "key", "cost"))
    )
    rows = materialize(all_rows.groupBy("block").applyInArrow(_sum_up(n_blocks), _DOC_DDL), "scores")
    words = facts.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_distinct"), F.lit(0)).alias("distinct")).first()
    ends = rows.where("not held_out").count()
    n, v = words["words"] + ends, words["distinct"] + (ends > 0)
    base = F.col("raw") + F.log10(F.lit(ends + 0.1)) - F.col("n_tokens") * F.log10(F.lit(n + 0.1 * (v + 1)))
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
