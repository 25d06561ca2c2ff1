"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of a whole text (shares of character classes, repetition, lengths)
are standardised and mapped to random Fourier features, whose dot product
approximates a Gaussian kernel.  Each partition of the training rows sums its
part of the normal equations, which Spark adds; the ridge solution gives scores
and the pool-adjacent-violators fit over training scores turns them into
probabilities.  Training takes at most ``sample`` labelled rows, chosen by a
hash of the id.  Scoring is one pass over the whole texts.

Defined results: a null text is scored as an empty one; without labels of both
classes nothing is learned and everything scores the known label, or 0 without
any; repeated rows are scored one by one (a repeated label row counts again, up to the sample's size); a null label
is no label; a column of the output's name is replaced, others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import fold, text_or_empty, written

SAMPLE = 8000           # labelled rows that the model is fitted on
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 7
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
SPACE = b" \t\n\x0b\x0c\r"
STOPS = b".,;:!?'\"()-"
HIGH = bytes(range(128, 256))
OTHER = bytes(sorted(set(range(33, 127)) - set(UPPER + LOWER + DIGITS + STOPS)))
N_STATS = 19


def statistics(raw: bytes) -> list[float]:
    """Statistics of a UTF-8 text, all defined for the empty one."""
    n = max(len(raw), 1)
    words = raw.split()
    k, m = len(words), max(len(words), 1)
    share = [(len(raw) - len(raw.translate(None, c))) / n for c in (UPPER, LOWER, DIGITS, SPACE, STOPS, HIGH, OTHER)]
    same = sum(map(eq, words, words[1:]))
    run = max((sum(1 for _ in g) for x, g in groupby(map(eq, words, words[1:])) if x), default=0) + 1 if same else 1
    lines = raw.split(b"\n")
    bare = sum(1 for w in words if not w.rstrip(OTHER + STOPS))      # words of symbols only
    marked = sum(1 for w in words if w[-1] in OTHER or w[-1] in b"!?")
    capital = sum(map(bytes.isupper, words))
    return [
        *share, np.log1p(len(raw)), np.log1p(k), len(raw) / m / 10, len(set(words)) / m, same / m, np.log1p(run),
        len(set(lines)) / len(lines), np.log1p(k / len(lines)), bare / m, marked / m, capital / m,
        raw.count(b".") / m,
    ]


@dataclass
class Model:
    """standardise, project to cosines, score linearly, calibrate by steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values) if len(self.weights) else np.full(len(x), self.values[0])


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel of width ``WIDTH``, and a constant."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, 1 / WIDTH, (x.shape[1], FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    return np.c_[np.cos(np.clip(x, -10, 10) @ w + b) * np.sqrt(2 / FEATURES), np.ones(len(x))]


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the best non-decreasing fit (pool adjacent violators); ties of the score pool first."""
    x, at = np.unique(score, return_inverse=True)
    total, weight = np.bincount(at, label), np.bincount(at).astype(float)
    blocks: list[list[float]] = []
    for lo, t, w in zip(x, total, weight, strict=True):
        blocks.append([lo, lo, t, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, t2, w2 = blocks.pop()
            blocks[-1][1] = hi
            blocks[-1][2] += t2
            blocks[-1][3] += w2
    knots = np.array([k for lo, hi, _, _ in blocks for k in (lo, hi)])
    return knots, np.array([v for _, _, t, w in blocks for v in (t / w,) * 2])


def labelled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """(y, x): label and statistics of at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, 3) != 1))
    picked = known.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(id_col).alias("sample_id"), "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(raw) for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("raw"))
    return (rows.join(F.broadcast(picked), F.col("id") == F.col("sample_id"))
            .select(F.col("quality").cast("double").alias("y"), "raw")
            .mapInArrow(run, "y double, x array<double>"))


def _sums(function, width: int):
    """Partition sums of function(x, y) (a matrix of ``width`` columns), one row per matrix row."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for p in parts:
            if len(p):
                total = total + function(np.stack(p["x"].to_numpy()), p["y"].to_numpy(float))
        if not np.isscalar(total):
            yield pd.DataFrame({"i": range(len(total)), "v": list(total)})

    def add(rows: DataFrame) -> np.ndarray:
        row = F.array(*[F.sum(F.get("v", F.lit(j))) for j in range(width)])
        got = rows.mapInPandas(run, "i int, v array<double>").groupBy("i").agg(row.alias("v")).toPandas().sort_values("i")
        return np.stack(got["v"].to_numpy()) if len(got) else np.zeros((0, width))
    return add


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the labelled rows whose fold is not held out (crc32 of the id modulo 3 is not 1)."""
    rows = written(labelled(docs, labels, sample, id_col, text_col), "quality-rows")
    moments = _sums(lambda x, y: np.c_[np.full(N_STATS, len(x)), x.sum(0), (x * x).sum(0), np.full(N_STATS, y.sum())], 4)(rows)
    if not len(moments) or not 0 < moments[0, 3] < moments[0, 0]:
        known = float(moments[0, 3] > 0) if len(moments) else 0.0
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(0), np.zeros(1), np.array([known]))
    n = moments[0, 0]
    mean = moments[:, 1] / n
    scale = np.sqrt(np.maximum(moments[:, 2] / n - mean * mean, 1e-12))
    scale[scale < 1e-5] = 1.0
    # the normal equations: Z'Z and Z'y as the last column, balanced by class
    share = {0.0: n / 2 / (n - moments[0, 3]), 1.0: n / 2 / moments[0, 3]}

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z, w = fourier((x - mean) / scale), np.where(y > 0, share[1.0], share[0.0])
        return np.c_[z.T @ (z * w[:, None]), z.T @ (w * y)]
    both = _sums(equations, FEATURES + 2)(rows)
    weights = np.linalg.solve(both[:, :-1] + RIDGE * n / 100 * np.eye(FEATURES + 1), both[:, -1])
    model = Model(mean, scale, weights, np.zeros(1), np.zeros(1))
    pairs = rows.toPandas()                                            # at most ``sample`` rows of N_STATS numbers
    model.knots, model.values = isotonic(model.raw(np.stack(pairs["x"].to_numpy())), pairs["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a double column ``out`` (replacing one of that name), the probability that a text is good."""
    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            x = np.array([statistics(raw) for raw in texts], float).reshape(-1, N_STATS)
            yield pd.Series(model.score(x))

    return docs.withColumn(out, run(text_or_empty(text_col).cast("binary")))
