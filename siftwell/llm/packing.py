"""Pack documents into token sequences, in order, by dynamic programming.

Documents of a partition follow one another, each as its ids and an end id.  Windows are cut at
document ends, sentence ends or, where a sentence runs on for more than HARD_EVERY ids, inside it.
The cheapest cuts minimise padding plus a penalty per cut inside a document:

    cost[j] = penalty[j] + min over i of cost[i] + padding(at[j] - at[i]),   at[j] - at[i] <= capacity

Padding is capacity - length, so cost[i] + at[i] has a sliding minimum, kept in a monotone queue;
a window whose length is a power of two (from capacity / SHORTEST) has no padding and is a transition of its own.

Nothing is shuffled: each partition is packed by itself in chunks of CHUNK_IDS ids that end with a
document, so memory is bounded by a chunk or the longest document.  A chunk wastes at most one
window.  Sequence ids hold the partition above 2**33 and count within it: they are unique, and a
partition computed again after an executor is lost gives the same ones.

Null and empty texts are the end id alone.  Repeated rows are packed each.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.tokens import default_path, encoder

CAPACITY = 1024
END_ID = 0
CHUNK_IDS = 1 << 20
HARD_EVERY = 128
SENTENCE_PENALTY = 2.0
HARD_PENALTY = 32.0
SHORTEST = 16  # windows of a power of two count as full from capacity / SHORTEST

_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, hard_every: int = HARD_EVERY) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending, and the penalty of each."""
    kind = np.zeros(len(ids) + 1, np.uint8)
    kind[1:][ends_sentence[ids]] = 1
    kind[doc_ends] = 2
    known = np.flatnonzero(kind)
    starts = np.concatenate([[0], known[:-1]])
    for i in np.flatnonzero(known - starts > hard_every):
        kind[starts[i] + hard_every : known[i] : hard_every] = 3
    at = np.flatnonzero(kind)
    return at, np.array([0.0, SENTENCE_PENALTY, 0.0, HARD_PENALTY])[kind[at]]


def best_windows(at: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """Window ends of least total cost.  Gaps between places must not exceed capacity."""
    places = [0, *at.tolist()]
    extra = [0.0, *penalty.tolist()]
    index = {p: i for i, p in enumerate(places)}
    powers = [w for w in (1 << k for k in range(capacity.bit_length() - 1)) if w * SHORTEST >= capacity]
    cost, back = [0.0] * len(places), [0] * len(places)
    queue: deque[int] = deque([0])
    level = [0.0] * len(places)  # cost[i] + places[i]
    for j in range(1, len(places)):
        p = places[j]
        low = p - capacity
        while places[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = level[i] + capacity - p
        for w in powers:
            h = index.get(p - w)
            if h is not None and cost[h] < best:
                best, i = cost[h], h
        best += extra[j]
        cost[j], back[j] = best, i
        lv = level[j] = best + p
        while queue and level[queue[-1]] >= lv:
            queue.pop()
        queue.append(j)
    ends, j = [], len(places) - 1
    while j:
        ends.append(places[j])
        j = back[j]
    return ends[::-1]


def _pack_chunk(docs: list[tuple[int | None, bytes]], ends_sentence: np.ndarray, first_sequence: int, capacity: int) -> tuple[pa.RecordBatch, int]:
    end = np.array([END_ID], "<u4").tobytes()
    stream = b"".join(x for _, b in docs for x in (b, end))
    ids = np.frombuffer(stream, "<u4")
    sizes = np.array([len(b) // 4 + 1 for _, b in docs])
    doc_ends = np.cumsum(sizes)
    ends = np.array(best_windows(*cut_points(ids, doc_ends, ends_sentence, min(HARD_EVERY, capacity)), capacity))
    starts = np.unique(np.concatenate([[0], ends[:-1], doc_ends[:-1]]))
    stops = np.append(starts[1:], len(ids))
    doc = np.searchsorted(doc_ends, starts, "right")
    seq = np.searchsorted(ends, starts, "right")
    seq_start = np.concatenate([[0], ends[:-1]])[seq]
    view = memoryview(stream)
    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    cols = [
        pa.array([docs[d][0] for d in doc.tolist()], pa.int64()), starts - (doc_ends - sizes)[doc], stops - starts, crc, sizes[doc], first_sequence + seq, starts - seq_start,
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], schema=_PIECES), len(ends)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sequence = encoder(path), TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, bytes]] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = enc.packed(text.as_py() or "")
                held.append((doc.as_py(), ids))
                size += len(ids) // 4 + 1
                if size >= CHUNK_IDS:
                    out, n = _pack_chunk(held, enc.ends_sentence, sequence, capacity)
                    yield out
                    sequence, held, size = sequence + n, [], 0
        if held:
            yield _pack_chunk(held, enc.ends_sentence, sequence, capacity)[0]

    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, ", ".join(f"{f.name} long" for f in _PIECES))
