"""Whitening of embeddings by the singular values of their centred rows.

Entries become integers, x = floor(scale * c) + shift, so sums and deviations are exact.  Each distinct x counts once.  Tasks
reduce the centred rows block by block to one triangular R each (QR of the R so far above the next block), and the Rs
meet in a tree of FAN at a time; only the last one, of dimensions squared numbers, reaches the driver, where
bidiagonal.py finds values and directions.  The covariance itself is never formed, so small eigenvalues keep their digits.

Rows whose vector is null or holds null or non-finite entries take no part, nor do empty vectors; where lengths differ, the length that
most distinct vectors have counts (ties: the least) and rows of others take no part.  Repeated rows give rows each.  Directions of no
variance (eigenvalue under 1e-24 of the greatest) have no whitened values and are left out; so an empty table, a
single vector or equal vectors give no rows.  Entries so large that n * x or a deviation leaves 64 bits are refused by an
ArithmeticError.  Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.bidiagonal import bidiagonalise, right_vectors
from siftwell.llm.runtime import discard, materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
FAN = 16
LEAST = 1e-24
LIMIT = 1 << 62
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  #: per dimension, over the fit list
    directions: np.ndarray  #: dimensions x components, each over the root of its eigenvalue
    explained: np.ndarray
    identity_error: float


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """vec_id, x of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.where(fine).select("vec_id", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c) + F.lit(shift)).alias("x"))


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(distinct: DataFrame, d: int) -> tuple[int, np.ndarray, int]:
    """(number of vectors, sums per dimension, greatest magnitude); each task brings one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, np.zeros(d, object), 0
        for b in batches:
            x = _matrix(b.column(0), d)
            n += len(x)
            if len(x):
                high = max(int(x.max()), -int(x.min()))
                most = max(most, high)
                total = total + (x.sum(axis=0) if high * len(x) < LIMIT else x.astype(object).sum(axis=0)).astype(object)
        text = [str(int(t)) for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(text), pa.array([str(most)] * d)], ["dim", "n", "total", "most"])

    rows = distinct.select("x").mapInArrow(run, "dim int, n long, total string, most string")
    found = rows.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max(F.col("most").cast("decimal(38,0)")).alias("most")).orderBy("dim").collect()
    n, most = (int(found[0]["n"]), int(found[0]["most"])) if found else (0, 0)
    if 2 * max(n, 1) * most >= LIMIT:
        raise ArithmeticError("n times the greatest entry leaves 64 bits")
    return n, np.array([int(r["total"]) for r in found], np.int64), most


def _triangle(distinct: DataFrame, d: int, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows."""

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, seen = np.zeros((0, d)), 0
        for b in batches:
            x = (n * _matrix(b.column(0), d) - sums) / n
            for at in range(0, len(x), 8 * d):
                r = np.linalg.qr(np.vstack([r, x[at : at + 8 * d]]), mode="r")
            seen += len(x)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["block", "r"])

    def meet(table: pa.Table) -> pa.Table:
        ordered = sorted(zip(table["block"].to_pylist(), table["r"].to_pylist(), strict=True))
        r = np.linalg.qr(np.vstack([np.frombuffer(m).reshape(-1, d) for _, m in ordered]), mode="r")
        return pa.table({"block": pa.array([ordered[0][0] // FAN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    level = materialize(distinct.select("x").mapInArrow(reduce_rows, "block long, r binary"), "triangles")
    while level.limit(2).count() > 1:
        above = materialize(level.groupBy(F.floor(F.col("block") / FAN)).applyInArrow(meet, "block long, r binary"), "triangles")
        discard(level)
        level = above
    r = np.zeros((d, d))
    last = np.frombuffer(level.first()["r"]).reshape(-1, d)
    r[: len(last)] = last
    discard(level)
    return r


def _identity_error(distinct: DataFrame, fitted: Whitening) -> float:
    """Greatest entry, but for the sign, of the whitened fit list's covariance less the identity."""
    d, k = fitted.directions.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            w = (fitted.n * _matrix(b.column(0), d) - fitted.sums) / fitted.n @ fitted.directions
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int64()), pa.array(total.ravel())], ["place", "value"])

    entry = F.sum("value") / fitted.n - F.when(F.col("place") % (k + 1) == 0, 1.0).otherwise(0.0)
    return float(distinct.select("x").mapInArrow(run, "place long, value double").groupBy("place").agg(F.abs(entry).alias("off")).agg(F.max("off")).first()[0])


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of rows (x: array of long); None where nothing varies."""
    distinct = materialize(rows.select("x").distinct(), "vectors")
    length = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not length:
        return None
    d = length[0]["d"]
    same = distinct.where(F.size("x") == d)
    n, sums, _ = _sums(same, d)
    r = _triangle(same, d, n, sums)
    trace = float((r * r).sum())
    if not trace:
        return None
    a, b, v = bidiagonalise(r)
    values, z = right_vectors(a, b, min(components, d))
    kept = values > LEAST * values[0]
    values, directions = values[kept], (v @ z)[:, kept]
    out = Whitening(n, sums, directions / np.sqrt(values / n), values / trace, 0.0)
    out.identity_error = _identity_error(same, out)
    discard(distinct)
    return out


def apply(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """The contract's row per vector and component, for rows vec_id, x.  Nothing is shuffled."""
    d, k = fitted.directions.shape

    def deviations(c: np.ndarray) -> list[int]:
        top = int(np.abs(c).max(initial=0))
        if top * top * d < LIMIT:
            return (c * c).sum(axis=1).tolist()
        out = [sum(e * e for e in row) for row in c.tolist()]
        if max(out) >= 1 << 63:
            raise ArithmeticError("a deviation leaves 64 bits")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = fitted.n * _matrix(b.column(1), d) - fitted.sums
            m = len(c)
            cols = [
                pa.array(b.column(0).to_pylist(), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, fitted.n), pa.int64()),
                pa.array(np.repeat(np.array(deviations(c), np.int64), k)), pa.array((c / fitted.n @ fitted.directions).ravel()), pa.array(np.tile(fitted.explained, m)), pa.array(np.full(m * k, fitted.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in OUT.split(", ")])

    return rows.where(F.size("x") == d).mapInArrow(run, OUT)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = integer_vectors(vectors, id_col, vector_col, scale, shift)
    fitted = fit(rows, components)
    return vectors.sparkSession.createDataFrame([], OUT) if fitted is None else apply(rows, fitted)
