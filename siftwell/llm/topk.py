"""Exact top-k inner products by pivot-table elimination.

Components become whole numbers, floor(scale * x).  For vectors q and c, 2 q.c = |q|^2 + |c|^2 - d(q, c)^2,
and for every pivot p the triangle inequality gives d(q, c) >= |d(q, p) - d(c, p)|.  The greatest of these
over a table of precomputed pivot distances bounds q.c from above.  Candidates are evaluated in the order
of their bounds until the next bound is below the k-th score found: what is left out cannot enter.

A query's threshold comes first: its k-th score among SAMPLE candidates of smallest id hash (broadcast, bounded by that
parameter), or less if there are fewer.  No candidate whose bound is below it is evaluated anywhere.

Candidates and queries are packed into blocks of bounded size; a block of queries meets a block of
candidates in one group of a grid (row block, query block), so memory does not depend on the table and a vector is sent
once per QUERY_BLOCK queries or ROW_BLOCK candidates.  Each group keeps its k best per query that reach the threshold; a
window over those rows takes the k best of all.

Scores are 64 bits wide: where the longest query and candidate could give a product beyond that, an OverflowError is
raised before any is taken.

Vectors that are null or hold null or non-finite components take no part.  A shorter vector counts as
padded with zeros.  A row is not its own query's candidate (nor another row of the same id); null ids take
no part.  Ties go to the smaller id; fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.runtime import hash_sample, materialize

K = 10
SCALE = 1024
PIVOTS = 48
ROW_BLOCK = 16_384
QUERY_BLOCK = 8_192
SAMPLE = 2_048
STEP = 512

_NONE = np.iinfo(np.int64).min
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(col: pa.ListArray, width: int) -> np.ndarray:
    offsets, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    if len(size) and (size == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, : b - a] = values[a:b]
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    sq = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(sq, 0))


def kth_scores(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th score among the candidates but itself; the least 64-bit value where there are fewer."""
    out = np.full(len(q), _NONE, np.int64)
    for i in range(len(q)):
        scores = (c @ q[i])[c_ids != q_ids[i]]
        if len(scores) >= k:
            out[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
    return out


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, pivots: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score) of the k best candidates of a block for each query, none below its least score."""
    dq, dc = _distances(q, pivots), _distances(c, pivots)
    nq, nc = (q.astype(np.float64) ** 2).sum(1), (c.astype(np.float64) ** 2).sum(1)
    dc_t = np.ascontiguousarray(dc.T)
    out = []
    for i in range(len(q)):
        low = np.zeros(len(c))
        for p in range(len(pivots)):
            np.maximum(low, np.abs(dc_t[p] - dq[i, p]), out=low)
        # rounding slack, so that a bound is never below the true product
        bound = (nq[i] + nc - low**2) / 2 + 1e-6 * (nq[i] + nc) + 1e-6
        bound[c_ids == q_ids[i]] = -np.inf
        floor = _NONE if least is None else least[i]
        order = np.flatnonzero((bound > -np.inf) & (bound >= floor))
        order = order[np.argsort(-bound[order], kind="stable")]
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(order), STEP):
            if len(scores) >= k and bound[order[at]] < scores[k - 1]:
                break
            take = order[at : at + STEP]
            ids, scores = np.append(ids, c_ids[take]), np.append(scores, c[take] @ q[i])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        out += [(int(q_ids[i]), int(a), int(s)) for a, s in zip(ids, scores, strict=True) if s >= floor]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k candidates of highest score."""

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vec_col).cast("array<double>")
        ok = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))

    rows = materialize(whole(vectors), "vectors")
    asked = materialize(whole(queries), "queries")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w"), F.max(square).alias("longest")).first()
    asked_n, asked_w, asked_longest = asked.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    if (facts["longest"] or 0) * (asked_longest or 0) >= 2.0**126:
        raise OverflowError("inner products of these vectors do not fit into 64 bits")
    width = max(facts["w"] or 1, asked_w or 1)
    row_blocks, query_blocks = -(-facts["n"] // ROW_BLOCK) or 1, -(-asked_n // QUERY_BLOCK) or 1
    picked = hash_sample(rows, "id", PIVOTS, 7).collect()  # at most PIVOTS rows
    pivots = np.zeros((max(len(picked), 1), width))
    for i, r in enumerate(picked):
        pivots[i, : len(r["v"])] = r["v"]

    near = hash_sample(rows, "id", SAMPLE, 11).collect()  # at most SAMPLE rows
    sample = np.zeros((len(near), width), np.int64)
    for i, r in enumerate(near):
        sample[i, : len(r["v"])] = r["v"]
    held = vectors.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in near], np.int64), sample))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, v = b.column("id"), b.column("v")
            least = kth_scores(ids.to_numpy(), _matrix(v, width), *held.value, k) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids, v, pa.array(least)], ["id", "v", "least"])

    asked = materialize(asked.mapInArrow(settle, "id long, v array<long>, least long"), "thresholds")

    def meet(c: pa.Table, q: pa.Table) -> pa.Table:
        if not c.num_rows or not q.num_rows:
            return _OUT.empty_table()
        c, q = c.combine_chunks(), q.combine_chunks()
        one = lambda t: (t.column("id").to_numpy(), _matrix(t.column("v").combine_chunks(), width))
        found = search_block(*one(q), *one(c), pivots, k, q.column("least").to_numpy())
        return pa.Table.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], schema=_OUT)

    block = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n)).cast("int")
    grid_c = rows.withColumn("r", block(row_blocks)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    grid_q = asked.withColumn("g", block(query_blocks)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    local = grid_c.groupBy("r", "g").cogroup(grid_q.groupBy("r", "g")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
