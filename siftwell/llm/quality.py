"""Quality scores by positive-unlabelled learning with a non-negative risk estimator.

Trusted positives are the rows labelled good; everything else is unlabelled web text, rows labelled bad among it with
their labels unread: no negative label teaches anything, neither weights nor prior nor calibration.  A linear model g(x)
on text statistics minimises, with logistic loss l and the estimated class prior p,

    p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)])

where the second term, an estimate of the negatives' risk, may not go below zero: when it does, the step is taken
against it.

Positives are a sample of the good rows only, so rows labelled good that lie among the unlabelled would count as bad:
the unlabelled sample is drawn from all training rows, labelled or not.  The prior is estimated from positives and
unlabelled rows alone: a model told apart by nothing but that flag gives each row a score, and whatever the scores of
the unlabelled rows look like, at every cut a share of p of them has to be spread as the positives are.  So p is at most
(share of unlabelled rows above a cut) / (share of positives above it); the estimate is the least such bound over cuts
with enough rows, on rows the flag model has not been fitted to (each half is scored by the other's model).  Scores are
a logistic curve over g whose slope and shift minimise the same unbiased risk with the log loss.

The fit reads FIT_ROWS positive and FIT_ROWS unlabelled rows at most, those of smallest id hash, one row an id (a
documented bound), all of rows with crc32(id) mod 5 other than 0, and runs in one task on that bounded sample.  Scoring
reads every document whole, in one pass without a shuffle.  Features come from the text alone.

Null and empty texts have the features of an empty text and get a score too.  Rows whose label or id is null teach
nothing as positives; an id labelled twice counts with its lower label; an id with several texts teaches its smallest
one.  The fit is held towards PRIOR_DEFAULT as if by TRUST more rows of no information: with n positives and unlabelled rows
each (the smaller number), a score's log odds are n / (n + TRUST) of the model's and the rest the default's, so a model of very few
rows says little and one of thousands is as it was fitted.  Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.runtime import hash_sample
from siftwell.llm.textkit import U64, Slice, mix64, shingle_hashes, word_slices

FIT_ROWS = 8_000
TRUST = 100
PRIOR_DEFAULT = 0.8
THRESHOLD = 0.3
HOLD_OUT = 5

_CLASSES = 20
_CLASS = np.full(256, 19, np.uint8)
for _i, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",", "!", "?", ";:", "'\"`", "|", "#", "$", "%", "&", "*+=<>~^_\\", "()[]{}", "/-@"]):
    _CLASS[[ord(c) for c in _chars]] = _i
_UPPER_LATIN = 1


def _segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct_share(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct values over values, per owner."""
    key = np.sort(mix64(hashes + owner.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(20) | owner.astype(U64) << U64(44))
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    all_, dis = np.bincount(owner, minlength=n), np.bincount((key[new] >> U64(44)).astype(np.int64), minlength=n)
    return np.where(all_ > 0, dis / np.maximum(all_, 1), 1.0)


def slice_features(s: Slice) -> np.ndarray:
    """One row of text statistics per document of a slice."""
    n = s.n_docs
    size = np.diff(s.doc_start)
    doc_of_byte = np.repeat(np.arange(n), size)
    c = _CLASS[s.raw].astype(np.int64)
    pair = np.bincount(doc_of_byte[:-1] * _CLASSES**2 + c[:-1] * _CLASSES + c[1:], minlength=n * _CLASSES**2).reshape(n, -1) if len(c) > 1 else np.zeros((n, _CLASSES**2))
    one = np.bincount(doc_of_byte * _CLASSES + c, minlength=n * _CLASSES).reshape(n, -1)
    chars = np.maximum(size, 1)[:, None]
    words = np.diff(s.word_from)
    owner = np.repeat(np.arange(n), words)
    length = (s.end - s.start).astype(np.float64)
    n_words = np.maximum(words, 1)
    mean = _segment_sums(length, s.word_from) / n_words
    spread = np.sqrt(np.maximum(_segment_sums(length**2, s.word_from) / n_words - mean**2, 0))
    same = np.zeros(len(s.hashes))
    if len(s.hashes) > 1:
        same[1:] = (s.hashes[1:] == s.hashes[:-1]) & (owner[1:] == owner[:-1])
    grams = shingle_hashes(s.hashes, 5)
    inside = owner[: len(grams)] == owner[4 : 4 + len(grams)] if len(grams) else np.zeros(0, bool)
    last = s.raw[s.end - 1] if len(s.end) else np.zeros(0, np.uint8)
    lead = _CLASS[s.raw[s.start]] if len(s.start) else np.zeros(0, np.uint8)
    tail = _CLASS[last]
    rates = [_segment_sums(x, s.word_from) / n_words for x in (same, lead == _UPPER_LATIN, tail == 5, tail == 6, tail == 7, (tail >= 11) & (tail <= 16), length == 1, length > 14)]
    distinct = _distinct_share(s.hashes, owner, n)
    return np.column_stack([
        np.log1p(words), np.log1p(size), mean / 10, spread / 10, distinct, (1 - distinct) * np.log1p(words) / 5, 1 - _distinct_share(grams[inside], owner[: len(grams)][inside], n),
        *rates, one / chars, np.sqrt(one / chars), np.sqrt(pair / chars),
    ]).astype(np.float32)


def features(col: pa.Array) -> np.ndarray:
    parts = [slice_features(s) for s in word_slices(col)]
    return np.concatenate(parts) if parts else np.zeros((0, 0), np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float
    held: float = 1.0  #: share of the model in a score's log odds; the rest is the default prior's

    def score(self, x: np.ndarray) -> np.ndarray:
        g = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        z = self.slope * g + self.shift
        z = np.where(np.abs(z) > 10, np.sign(z) * (10 + 20 * np.tanh((np.abs(z) - 10) / 20)), z)  # far scores keep their order
        return _sigmoid(self.held * z + (1 - self.held) * np.log(PRIOR_DEFAULT / (1 - PRIOR_DEFAULT)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _standardised(pos: np.ndarray, unl: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """mean and scale over both, and both in float32 by them."""
    n = len(pos) + len(unl)
    mean = (pos.sum(0, dtype=np.float64) + unl.sum(0, dtype=np.float64)) / n
    var = (np.square(pos - mean).sum(0, dtype=np.float64) + np.square(unl - mean).sum(0, dtype=np.float64)) / n
    scale = np.sqrt(var) + 1e-3
    turn = lambda x: np.clip((x - mean) / scale, -8, 8).astype(np.float32)
    return mean, scale, turn(pos), turn(unl)


def _descend(gradient, width: int, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Full-batch Adam over a linear model's weights and bias; gradient(w, b) gives (of w, of b)."""
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        gw, gb = gradient(w, b)
        grad = np.append(gw + decay * w, gb)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, rate: float = 0.02, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative unbiased risk; p, u: standardised rows."""

    def gradient(w, b):
        gp, gu = p @ w.astype(np.float32) + b, u @ w.astype(np.float32) + b
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d_pos = -prior * (1 - _sigmoid(gp)) / len(p)  # of p E_pos[l(g)]
        d_neg_u, d_neg_p = _sigmoid(gu) / len(u), -prior * _sigmoid(gp) / len(p)  # of the negatives' risk
        dp, du = (d_pos + d_neg_p, d_neg_u) if negative >= 0 else (-d_neg_p, -d_neg_u)
        return dp.astype(np.float32) @ p + du.astype(np.float32) @ u, dp.sum() + du.sum()

    return _descend(gradient, p.shape[1], steps, rate, decay)


def _fit_flag(p: np.ndarray, u: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression of positive against unlabelled, both sides of equal weight."""

    def gradient(w, b):
        dp, du = -(1 - _sigmoid(p @ w.astype(np.float32) + b)) / (2 * max(len(p), 1)), _sigmoid(u @ w.astype(np.float32) + b) / (2 * max(len(u), 1))
        return dp.astype(np.float32) @ p + du.astype(np.float32) @ u, dp.sum() + du.sum()

    return _descend(gradient, p.shape[1], steps, 0.05, 3e-3)


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of the unlabelled rows that are spread as the positives are: the least ratio, over cuts that at least half of the positives lie above, of what lies above."""
    sp, su = [], []
    for half in (0, 1):
        w, b = _fit_flag(p[half::2], u[half::2])
        w = w.astype(np.float32)
        sp.append(p[1 - half :: 2] @ w + b)
        su.append(u[1 - half :: 2] @ w + b)
    sp, su = np.concatenate(sp), np.concatenate(su)
    cuts = np.quantile(sp, np.linspace(0, 0.5, 101))
    fp = np.array([(sp >= c).mean() for c in cuts])
    fu = np.array([(su >= c).mean() for c in cuts])
    return float(np.clip((fu / fp).min(), 0.02, 0.98))


def _calibrate(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve over g, by the unbiased log risk of positives and unlabelled rows: as
    l(z) - l(-z) = -z, that is E_unl[log(1 + exp z)] - p E_pos[z] with z = a g + b, which is convex."""
    a, b, high = 1.0, 0.0, gp.mean()
    risk = lambda a, b: np.logaddexp(0, a * gu + b).mean() - prior * (a * high + b) + 3e-4 * a * a
    for _ in range(100):
        q = _sigmoid(a * gu + b)
        h = q * (1 - q) + 1e-9
        grad = np.array([(q * gu).mean() - prior * high + 6e-4 * a, q.mean() - prior])
        hess = np.array([[(h * gu * gu).mean() + 6e-4, (h * gu).mean()], [(h * gu).mean(), h.mean() + 1e-9]])
        move, step, now = np.linalg.solve(hess, grad), 1.0, risk(a, b)
        while step > 1e-6 and not risk(max(a - step * move[0], 0.1), b - step * move[1]) < now:
            step /= 2
        if step <= 1e-6:
            break
        a, b = max(a - step * move[0], 0.1), b - step * move[1]
    return float(a), float(b)


def _fold(col: str) -> F.Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % HOLD_OUT


_MODEL = "mean binary, scale binary, weight binary, bias double, slope double, shift double, prior double, held double"


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from docs and labels; at most fit_rows positive and fit_rows unlabelled rows are read as features."""
    taught = labels.where((_fold("doc_id") != 0) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y")).where("y = 1").select("doc_id")
    ids = docs.where((F.col("doc_id").isNotNull()) & (_fold("doc_id") != 0)).select("doc_id").distinct()
    good = hash_sample(taught.join(ids, "doc_id", "left_semi"), "doc_id", fit_rows).withColumn("y", F.lit(1))
    free = hash_sample(ids, "doc_id", fit_rows, 1).withColumn("y", F.lit(0))
    picked = good.union(free)  # at most 2 * fit_rows rows of 12 bytes
    text = F.col("text").cast("string")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(picked), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("size"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "size", "x"])

    rows = chosen.select("doc_id", "y", F.length("text").alias("size"), "text").mapInArrow(run, "doc_id long, y int, size int, x binary")
    one = rows.groupBy("y", "doc_id").agg(F.min(F.struct(F.coalesce("size", F.lit(0)), "x")).alias("least")).select("y", "doc_id", F.col("least.x").alias("x"))
    # one group of at most 2 * fit_rows rows of 2 kB
    found = one.groupBy(F.lit(0).alias("all")).applyInArrow(_fit_rows, _MODEL).first()
    if found is None:
        return _plain_model()
    return Model(*(np.frombuffer(found[c], np.float64) for c in ("mean", "scale", "weight")), found["bias"], found["slope"], found["shift"], found["prior"], found["held"])


def _plain_model() -> Model:
    width, p = features(pa.array([""])).shape[1], PRIOR_DEFAULT
    return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, float(np.log(p / (1 - p))), p)


def _fit_rows(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("y", "ascending"), ("doc_id", "ascending")])
    y = rows.column("y").to_numpy()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(len(y), -1)
    m = _learn(x[y == 1], x[y == 0])
    kinds = ((m.mean.tobytes(), pa.binary()), (m.scale.tobytes(), pa.binary()), (m.weight.tobytes(), pa.binary()), (m.bias, pa.float64()), (m.slope, pa.float64()), (m.shift, pa.float64()), (m.prior, pa.float64()), (m.held, pa.float64()))
    return pa.Table.from_arrays([pa.array([v], k) for v, k in kinds], [c.split()[0] for c in _MODEL.split(", ")])


def _learn(pos: np.ndarray, unl: np.ndarray) -> Model:
    n = min(len(pos), len(unl))
    if not n:
        return _plain_model()
    mean, scale, p, u = _standardised(pos, unl)
    prior = estimate_prior(p, u)
    w, b = fit_nnpu(p, u, prior)
    slope, shift = _calibrate(p @ w.astype(np.float32) + b, u @ w.astype(np.float32) + b, prior)
    return Model(mean, scale, w, b, slope, shift, prior, n / (n + TRUST))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs' columns in keep, then __score (0 to 1) and __predicted (1 if the score is THRESHOLD or more)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = np.concatenate([held.value.score(slice_features(s)) for s in word_slices(b.column(len(keep)))] or [np.zeros(0)])
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(q, pa.float64()), pa.array((q >= THRESHOLD).astype(np.int32))], [*keep, "__score", "__predicted"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, f"{ddl}, __score double, __predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; held_out is null where the id is."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels, fit_rows), ["doc_id"])
    return out.select("doc_id", (_fold("doc_id") == 0).alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that the classifier does not reject, columns unchanged."""
    return score(docs, fit(docs, labels, fit_rows), docs.columns).where("__predicted = 1").select(*docs.columns)
