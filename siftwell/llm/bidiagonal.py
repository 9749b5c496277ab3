"""Singular values and right singular vectors of a small square matrix by way of a bidiagonal one.

Householder reflections make R = U B V' with B upper bidiagonal (diagonal a, superdiagonal b).  The differential qd
algorithm with shifts finds the squares of B's singular values from q = a * a and e = b * b, smallest first: no step
subtracts what it has not divided by, so small values are as accurate as large ones.  Shifts come from below, by Laguerre's bound
on the least root.  Vectors of B'B come from twisted factorisations: one factorisation from the top, one from the
bottom, joined where the remainder is least.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
MAX_STEPS = 200  # per value; three or four are usual


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v) with v orthogonal and r @ v = u @ B for some orthogonal u."""
    m = np.array(r, float)
    n = m.shape[0]
    v = np.eye(n)
    for k in range(n):
        x = m[k:, k]
        h, scale = _reflector(x)
        if scale:
            m[k:, k:] -= np.outer(scale * h, h @ m[k:, k:])
        if k < n - 2:
            h, scale = _reflector(m[k, k + 1 :])
            if scale:
                m[k:, k + 1 :] -= np.outer(m[k:, k + 1 :] @ h, scale * h)
                v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ h, scale * h)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """h, scale with (I - scale h h') x along the first axis; scale 0 where x is so already."""
    if not x[1:].any():
        return x, 0.0
    top = np.abs(x).max()
    h = x / top
    h[0] += np.copysign(np.linalg.norm(h), h[0])
    return h, 2.0 / float(h @ h)


def _least_root_bound(q: list[float], e: list[float]) -> float:
    """Laguerre's bound: at most the least eigenvalue.  t1 and t2 are the traces of the inverse and of its square, from the first
    two derivatives of the pivots by the shift; all terms of each sum have one sign."""
    n, tiny = len(q), EPS**6
    if min(q) < tiny:
        return 0.0
    d1, d2 = -1.0, 0.0
    t1, t2 = 1.0 / q[0], 1.0 / (q[0] * q[0])
    for i in range(n - 1):
        ratio = e[i] / q[i]
        d2 = ratio * (d2 - 2.0 * d1 * d1 / q[i])
        d1 = -1.0 + ratio * d1
        x = d1 / q[i + 1]
        t1 -= x
        t2 += x * x - d2 / q[i + 1]
        if t2 > 1e200:  # a value far under rounding of the largest
            return 0.0
    return n / (t1 + max((n - 1) * (n * t2 - t1 * t1), 0.0) ** 0.5)


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd transformation; None where the shift lies above the least value."""
    d = q[0] - shift
    new_q, new_e = [], []
    for i in range(len(e)):
        if d < 0:
            return None
        x = d + e[i]
        t = q[i + 1] / x
        new_q.append(x)
        new_e.append(e[i] * t)
        d = d * t - shift
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix, falling.

    Entries under rounding of the largest are noise of the reduction: such a superdiagonal entry is 0 and splits the matrix, such
    a diagonal entry is lifted to that level, so that no division is by 0.
    """
    size = float(max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)))
    if not size:
        return np.zeros(len(a))
    out: list[float] = []
    for lo, hi in split(a, b):
        q = [max(abs(x) / size, EPS) ** 2 for x in a[lo:hi].tolist()]
        e = [(x / size) ** 2 for x in b[lo : hi - 1].tolist()]
        if sum(q[: len(q) // 2]) < sum(q[len(q) // 2 :]):  # small ones last: they are found first
            q.reverse()
            e.reverse()
        out += _values(q, e)
    return np.sort(np.array(out))[::-1] * size * size


def split(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows that no superdiagonal entry beyond rounding joins."""
    size = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    at = (np.flatnonzero(np.abs(b) <= EPS * size) + 1).tolist()
    return list(zip([0, *at], [*at, len(a)], strict=True))


def _values(q: list[float], e: list[float]) -> list[float]:
    out, done = [], 0.0
    while q:
        for _ in range(MAX_STEPS):
            if len(q) == 1 or e[-1] <= EPS * EPS * max(done + q[-1], EPS * EPS):
                break
            shift = _least_root_bound(q, e) * (1 - 4 * EPS)
            new = _step(q, e, shift)
            while new is None:  # rounding alone can put the bound above the least value
                shift = shift * (1 - 1e-8) if shift > EPS * q[0] * 1e-8 else 0.0
                new = _step(q, e, shift)
            q, e = new
            done += shift
        else:
            raise ArithmeticError("the qd iteration did not settle")
        out.append(done + q.pop())
        if e:
            e.pop()
    return out


def _twisted(d: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """(unit vector, correction of the value) of L D L' at a value, by the twist of least remainder."""
    n = len(d)
    tiny = EPS * max(abs(value), d.max()) * EPS
    safe = lambda t: t if abs(t) > tiny else tiny
    down, s = np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = safe(s[i] + d[i])
        down[i] = d[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    up, p = np.zeros(n), np.zeros(n)
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        t = d[i] / safe(d[i] * low[i] * low[i] + p[i + 1])
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    gamma = s + p + value
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    norm2 = float(z @ z)
    return z / norm2**0.5, float(gamma[k]) / norm2


def right_vectors(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors in columns) of B'B for its `count` greatest eigenvalues.

    Values that lie close to one another are taken as a cluster: their vectors are made orthogonal to the earlier ones of the cluster.
    """
    found: list[tuple[float, int, int, int]] = []
    parts = split(a, b)
    for part, (lo, hi) in enumerate(parts):
        found += [(-v, part, k, lo) for k, v in enumerate(squared_singular_values(a[lo:hi], b[lo : hi - 1]).tolist())]
    found.sort()
    size = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    values, vectors, origin = [], [], []
    for value, part, _, lo in found[:count]:
        value, hi = -value, parts[part][1]
        diagonal = np.maximum(np.abs(a[lo:hi]), EPS * size)
        d, low = diagonal**2, b[lo : hi - 1] / np.copysign(diagonal, a[lo:hi])[:-1]
        z, more = _twisted(d, low, value)
        if abs(more) < 1e-6 * value:
            z, _ = _twisted(d, low, value + more)
            value += more
        full = np.zeros(len(a))
        full[lo:hi] = z
        near = [v for v, o, w in zip(vectors, origin, values, strict=True) if o == part and abs(w - value) <= 1e-3 * w]
        if near:
            full = _apart_from(full, near, d, low, value, lo, hi)
        values.append(value)
        vectors.append(full)
        origin.append(part)
    return np.array(values), np.array(vectors).T.reshape(len(a), len(vectors))


def _apart_from(z: np.ndarray, near: list[np.ndarray], d: np.ndarray, low: np.ndarray, value: float, lo: int, hi: int) -> np.ndarray:
    """z, or where z falls on the earlier vectors of its cluster a start of its own after inverse iteration, orthogonal to them."""
    basis = np.array(near)
    left = z
    for _ in range(2):
        left = left - basis.T @ (basis @ left)
    if np.linalg.norm(left) > 0.5:
        for _ in range(2):
            left = left - basis.T @ (basis @ left)
        return left / np.linalg.norm(left)
    t = np.diag(d + np.append(0.0, d[:-1] * low**2)) + np.diag(d[:-1] * low, 1) + np.diag(d[:-1] * low, -1)
    t[np.diag_indices(hi - lo)] -= value * (1 + 1e-11)  # off the cluster, so that the system can be solved
    x = np.zeros(len(z))
    x[lo:hi] = np.random.default_rng(len(near)).standard_normal(hi - lo)
    for _ in range(4):
        x -= basis.T @ (basis @ x)
        x[lo:hi] = np.linalg.solve(t, x[lo:hi])
        x -= basis.T @ (basis @ x)
        x /= np.linalg.norm(x)
    return x
