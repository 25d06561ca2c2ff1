"""Embedding whitening by QR, bidiagonalisation and qd iterations.

The covariance is never formed: the singular values of the centred rows are
computed, whose squares are its eigenvalues times n.

1. Entries become integers, so row count and sums are exact in any order, and
   a row is centred without loss as (n * x - S) / n.
2. Blockwise QR: each task reduces its rows block by block to one triangle;
   triangles are stacked and reduced ``FAN`` at a time until one is left.  A
   triangle has as many rows as the vectors have entries, whatever the input.
3. That one triangle (``dim`` x ``dim``) is bidiagonalised by Householder
   reflections.  dqds iterations give the singular values of the bidiagonal
   to high relative accuracy, twisted factorisations of its square, shifted by
   each, the right singular vectors; values that agree closely share a
   space, in which the vectors are made orthogonal.
4. Rows are projected where they lie; one more pass measures how far the
   covariance of the whitened rows is from the identity.

Defined results: rows whose vector is null, holds null or non-finite entries or
has another length than most vectors (of equally frequent lengths the smaller)
are dropped; a null id is kept; repeated rows are rows each.  A direction
without variance (fewer than two different rows, constant entries) has no
component, as nothing can be scaled to 1 there.  An empty table gives an empty
result.  An entry or deviation beyond a long is an error.  Other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import written
from basketry.llm.multi_index import dimension, matrix, usable

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
BLOCK = 4096                    # rows of a QR step
FAN = 16                        # triangles reduced at a time
EPS = np.finfo(float).eps
CLOSE = 1e-6                    # singular values that agree so closely (relative) share a space


# ------------------------------------------------------------------ the solver, on a matrix of the vectors' dimension
def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, v): r = u @ B @ v.T with an upper bidiagonal B, by Householder reflections."""
    a, n = r.astype(float).copy(), r.shape[1]
    v = np.eye(n)
    for k in range(n):
        w, beta = _reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(w, w @ a[k:, k:])
        if k < n - 2:
            w, beta = _reflector(a[k, k + 1:])
            a[k:, k + 1:] -= beta * np.outer(a[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= beta * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(w, beta) so that x - beta * w * (w @ x) is zero but for its first entry."""
    w, size = x.copy(), float(np.abs(x).max(initial=0))
    if not size or not np.any(x[1:]):
        return w, 0.0
    norm = size * np.linalg.norm(x / size)
    w[0] += np.copysign(norm, w[0])
    w /= np.abs(w).max()
    return w, 2.0 / float(w @ w)


def singular_values(d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The singular values of an unreduced upper bidiagonal, falling, by differential qd steps with shifts."""
    if len(d) == 1:
        return np.abs(d)
    size = max(np.abs(d).max(), np.abs(e).max())
    q, t = (d / size) ** 2, (e / size) ** 2                # qd array: q squares of d, t squares of e
    q, t = q.tolist(), t.tolist()
    shift, found = 0.0, []
    parts = [(q, t, shift)]
    while parts:
        q, t, shift = parts.pop()
        guess, tries = 0.0, 0
        while q:
            n = len(q)
            if n == 1:
                found.append(shift + q[0])
                break
            if t[-1] <= EPS * EPS * (shift + q[-1]):      # the last value stands alone
                found.append(shift + q.pop())
                t.pop()
                guess, tries = 0.0, 0
                continue
            cut = next((i for i in range(n - 2, -1, -1) if t[i] <= EPS * EPS * (shift + min(q[i], q[i + 1]))), None)
            if cut is not None:
                parts.append((q[:cut + 1], t[:cut], shift))
                q, t, guess, tries = q[cut + 1:], t[cut + 1:], 0.0, 0
                continue
            step = _dqds(q, t, guess)
            if step is None:                               # the shift passed the smallest value
                tries += 1
                guess = guess / 4 if tries < 4 else 0.0
                continue
            q, t, least, last = step
            shift, tries = shift + guess, 0
            guess = max(0.0, min(least, last) * (0.99 if t[-1] < 1e-3 * q[-1] else 0.5) - t[-1])
    return np.sqrt(np.sort(np.maximum(found, 0.0))[::-1]) * size


def _dqds(q: list[float], t: list[float], s: float):
    """One differential qd step with shift s: the new array, its smallest and its last pivot; None if one is negative."""
    qq, tt, d, least = [], [], q[0] - s, q[0] - s
    for i in range(len(t)):
        if d < 0:
            return None
        x = d + t[i]
        if x == 0.0:
            return None if s else _zero_pivot(q, t)
        qq.append(x)
        ratio = q[i + 1] / x
        tt.append(t[i] * ratio)
        d = d * ratio - s
        least = min(least, d)
    if d < 0:
        return None
    qq.append(d)
    return qq, tt, least, d


def _zero_pivot(q: list[float], t: list[float]):
    """A step over an exact zero: eigenvalues of the small tridiagonal, as its qd array without couplings."""
    b = np.diag(np.sqrt(q)) + np.diag(np.sqrt(t), 1)
    values = np.linalg.svd(b, compute_uv=False) ** 2
    return values.tolist(), [0.0] * len(t), float(values[-1]), float(values[-1])


def twisted(d: np.ndarray, e: np.ndarray, value: float, skip: int = 0) -> np.ndarray:
    """The right singular vector of an unreduced bidiagonal for a singular value, by a twisted factorisation.

    B'B - value^2 is factored from the top (stationary qd) and from the bottom (progressive qd); at the index where
    both meet with the smallest remainder, the vector is read off both.  ``skip`` takes a next best index.
    """
    n, lam = len(d), value * value
    tiny = EPS * EPS * max(lam, float((d * d).max()), 1e-300)
    # stationary: L+ D+ L+' from the top; l(i) = d(i) e(i) / (d(i)^2 + ...) in differential form
    s, up, low = np.empty(n), np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s[0] = -lam
    for i in range(n - 1):
        pivot = s[i] + d[i] * d[i]
        pivot = pivot if abs(pivot) > tiny else -tiny
        up[i] = d[i] * e[i] / pivot
        s[i + 1] = up[i] * e[i] / d[i] * s[i] - lam if d[i] else e[i] * e[i] - lam
    p = np.empty(n)
    p[-1] = d[-1] * d[-1] - lam
    for i in range(n - 2, -1, -1):
        pivot = e[i] * e[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else -tiny
        low[i] = d[i] * e[i] / pivot
        p[i] = p[i + 1] * (d[i] * d[i] / pivot) - lam
    gamma = s + p + lam
    r = int(np.argsort(np.abs(gamma), kind="stable")[min(skip, n - 1)])
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -low[i] * z[i]
    return z / np.linalg.norm(z)


def directions(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of a matrix, by falling value; zero values are left out."""
    n = r.shape[1]
    if not n or not np.any(r):
        return np.empty(0), np.empty((n, 0))
    d, e, v = bidiagonal(r)
    norm = max(np.abs(d).max(), np.abs(e).max(initial=0))
    # couplings and pivots below rounding split the bidiagonal; a zero pivot is chased out by rotations of rows
    e[np.abs(e) <= EPS * norm * 1e-2] = 0.0
    d[np.abs(d) <= EPS * norm * 1e-2] = EPS * norm * 1e-2
    values, vectors, start = [], [], 0
    for end in [*(np.flatnonzero(e == 0.0) + 1).tolist(), n]:
        dd, ee = d[start:end], e[start:end - 1]
        got = singular_values(dd, ee)
        block: list[np.ndarray] = []
        for i, x in enumerate(got):
            close = [j for j in range(i) if abs(got[j] - x) <= CLOSE * got[0]]
            for skip in range(len(dd)):
                z = twisted(dd, ee, x, skip)
                for _ in range(2):
                    for j in close:
                        z = z - (block[j] @ z) * block[j]
                size = np.linalg.norm(z)
                if size > 0.1 or not close:
                    break
            block.append(z / size)
        for x, z in zip(got, block, strict=True):
            whole = np.zeros(n)
            whole[start:end] = z
            values.append(x)
            vectors.append(v @ whole)
        start = end
    order = np.argsort(-np.array(values), kind="stable")
    values, vectors = np.array(values)[order], np.array(vectors).T[:, order]
    keep = values > values[0] * n * EPS * 8
    return values[keep], vectors[:, keep]


# ------------------------------------------------------------------ over the table
@dataclass
class Whitening:
    """What whitens rows: n, exact sums S, eigenvalues e and eigenvectors (columns) of the covariance, its trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    dim: int

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in longs where they hold it, else in Python's integers."""
        far = np.abs(x).max(initial=0).item() * max(self.n, 1)
        if max(far, max((abs(int(s)) for s in self.sums), default=0)) < 2 ** 61:
            return x * np.int64(self.n) - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def project(self, y: np.ndarray, count: int) -> np.ndarray:
        return (y.astype(float) / self.n) @ self.vectors[:, :count] / np.sqrt(self.values[:count])


def integers(df: DataFrame, dim: int, vec_col: str, *keep) -> DataFrame:
    """(x, kept columns...) of the rows that take part; x is the array of longs floor(SCALE * c) + OFFSET."""
    x = F.transform(F.col(vec_col).cast("array<double>"), lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    return df.where(usable(vec_col, dim)).select(x.alias("x"), *keep)


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for b in batches:
            x = matrix(b.column(0), dim)
            n += len(x)
            # halves of 32 bits, so a batch's sum cannot overflow
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total = [t + (h << 32) + o for t, h, o in zip(total, high.tolist(), low.tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([str(n), *map(str, total)])],
                                             ["place", "total"])
    return run


def _triangles(model: Whitening):
    """Rows of a task to the triangle of their centred values, in row-major order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        r = np.empty((0, model.dim))
        for b in batches:
            y = model.deviations(matrix(b.column(0), model.dim)).astype(float) / model.n
            for at in range(0, len(y), BLOCK):
                r = np.linalg.qr(np.concatenate([r, y[at:at + BLOCK]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([r.ravel()], pa.list_(pa.float64()))], ["part", "r"])
    return run


def _stack(dim: int):
    def run(key, rows):
        stacked = np.concatenate([np.array(v).reshape(-1, dim) for v in rows["r"].to_pylist()])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()),
                         "r": pa.array([np.linalg.qr(stacked, mode="r").ravel()], pa.list_(pa.float64()))})
    return run


def fit(df: DataFrame, vec_col: str = "embedding") -> Whitening:
    """The whitening of all rows of ``df``; the driver gets sums and one triangle of the vectors' dimension."""
    dim = dimension(df, vec_col)
    rows = integers(df, dim, vec_col)
    got = (rows.mapInArrow(_sums(dim), "place int, total string")
           .groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    sums = {r.place: int(r.total) for r in got}
    model = Whitening(sums.get(-1, 0), np.array([sums.get(i, 0) for i in range(dim)], object), np.empty(0),
                      np.empty((dim, 0)), 0.0, dim)
    if not model.n or not dim:
        return model
    parts = written(rows.mapInArrow(_triangles(model), "part long, r array<double>"), "triangles")
    while parts.count() > 1:
        parts = written(parts.groupBy(F.expr(f"part div {FAN}").alias("group")).applyInArrow(_stack(dim), "part long, r array<double>"),
                        "triangles")
    r = np.array(parts.first().r).reshape(-1, dim)
    values, vectors = directions(r)
    model.values, model.vectors = values ** 2 / model.n, vectors
    model.trace = float((r * r).sum()) / model.n
    return model


def _moments(model: Whitening, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, sums = np.zeros((count, count)), np.zeros(count)
        for b in batches:
            w = model.project(model.deviations(matrix(b.column(0), model.dim)), count)
            squares += w.T @ w
            sums += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(count * count + count), pa.int32()), pa.array(np.r_[squares.ravel(), sums])],
                                         ["place", "total"])
    return run


def identity_error(df: DataFrame, model: Whitening, vec_col: str = "embedding", components: int = COMPONENTS) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, measured over all rows."""
    count = min(components, len(model.values))
    if not count:
        return 0.0
    total = np.zeros(count * count + count)
    for r in (integers(df, model.dim, vec_col).mapInArrow(_moments(model, count), "place int, total double")
              .groupBy("place").agg(F.sum("total").alias("total")).collect()):
        total[r.place] = r.total
    mean = total[count * count:] / model.n
    return float(np.abs(total[:count * count].reshape(count, count) / model.n - np.outer(mean, mean) - np.eye(count)).max())


def _rows(model: Whitening, count: int, id_name: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = model.values / model.trace if model.trace else model.values
        for b in batches:
            y = model.deviations(matrix(b.column(0), model.dim))
            w = model.project(y, count)
            far = [int(v) for v in (y.astype(object) ** 2).sum(axis=1)] if y.dtype == object or not _fits(y) else (y * y).sum(axis=1)
            n = len(y)
            yield pa.RecordBatch.from_arrays(
                [b.column(1).take(pa.array(np.repeat(np.arange(n), count))), pa.array(np.tile(np.arange(1, count + 1), n), pa.int32()),
                 pa.array(np.repeat(pa.array(far, pa.int64()).to_numpy(), count)), pa.array(w.ravel()),
                 pa.array(np.tile(share[:count], n))], [id_name, "component", "deviation", "whitened", "explained"])
    return run


def _fits(y: np.ndarray) -> bool:
    """Whether the sums of the rows' squares fit into longs."""
    return float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2.0 ** 62


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """(id, component, deviation, whitened, explained) of every row that takes part and component from 1."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = df.schema[id_col].dataType
    return integers(df, model.dim, vec_col, F.col(id_col)).mapInArrow(
        _rows(model, min(components, len(model.values)), id_col, to_arrow_type(kind)),
        f"`{id_col}` {kind.simpleString()}, component int, deviation long, whitened double, explained double")
