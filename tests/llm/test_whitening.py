import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import whitening as W
from basketry.llm.queries import op12_whitening
from tests.llm.helpers import SF

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, components=32):
    """(n, deviations, eigenvalues, projections) by the eigenvectors of the covariance."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    centred = np.array(y, float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    count = min(components, int((e > e[0] * 1e-12).sum()) if e[0] > 0 else 0)
    return n, [sum(c * c for c in r) for r in y], e, centred @ v[:, :count] / np.sqrt(e[:count])


def test_query_matches_eigenvectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, far, e, want = brute([r.embedding for r in table])
    out = op12_whitening(spark, SF).orderBy("vec_id", "component").toPandas()
    assert len(out) == 32 * n and (out.n == n).all() and out.component.tolist() == list(range(1, 33)) * n
    assert out.deviation.tolist() == [d for d in far for _ in range(32)]
    got = out.whitened.to_numpy().reshape(n, 32)
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-8
    assert np.abs(out.explained.to_numpy().reshape(n, 32) / (e[:32] / e.sum()) - 1).max() < 1e-9
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    assert np.abs(got.T @ got / n - np.eye(32)).max() < 1e-9


@pytest.mark.parametrize("name", ["plain", "wide scale", "equal values", "nearly equal values", "low rank", "one column"])
def test_solver(name):
    rng = np.random.default_rng(3)
    orth = np.linalg.qr(rng.normal(size=(90, 24)))[0]
    turn = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    a = {"plain": rng.normal(size=(90, 24)), "wide scale": rng.normal(size=(90, 24)) * 10.0 ** -np.linspace(0, 9, 24),
         "equal values": orth * np.repeat(np.arange(1, 9), 3) @ turn,
         "nearly equal values": orth * (np.repeat(np.arange(1, 9), 3) * (1 + 1e-8 * rng.normal(size=24))) @ turn,
         "low rank": rng.normal(size=(90, 5)) @ rng.normal(size=(5, 24)), "one column": rng.normal(size=(90, 1))}[name]
    values, vectors = W.directions(np.linalg.qr(a, mode="r"))
    true = np.linalg.svd(a, compute_uv=False)
    assert len(values) == np.linalg.matrix_rank(a)
    assert np.abs(values / true[:len(values)] - 1).max() < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-10
    assert np.abs(a.T @ (a @ vectors) - vectors * values ** 2).max() < 1e-12 * values[0] ** 2


def test_small_values_keep_their_digits():
    """The qd steps find tiny singular values of a bidiagonal to high relative accuracy."""
    d, e = 10.0 ** -np.arange(0, 12, 2.0), np.full(5, 1e-13)
    got = W.singular_values(d, e)
    assert np.abs(got / d - 1).max() < 1e-2 and np.all(got > 0)
    assert abs(np.prod(got) / np.prod(d) - 1) < 1e-13      # the determinant of a bidiagonal is its diagonal's product


def test_rows_that_take_no_part(spark):
    good = [(i, [float(i % 5), float(i * i % 7) / 8, float(i % 3) - 1]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, [1.0]),
           (105, [])]
    odd = [(None, [0.0, 0.0, 0.0]), (7, [2.0, 0.5, -1.0]), (7, [2.0, 0.5, -1.0])]
    df = spark.createDataFrame(good + bad + odd, SCHEMA).withColumn("x", F.lit("clash")).withColumn("n", F.lit(1))
    model = W.fit(df)
    out = W.whiten(df, model).toPandas()
    n, far, e, want = brute([v for _, v in good + odd])
    assert model.n == n == 43 and len(out) == 43 * 3 and out.vec_id.isna().sum() == 3
    assert sorted(out.deviation) == sorted(d for d in far for _ in range(3))
    assert np.abs(np.sort(np.abs(out.whitened)) - np.sort(np.abs(want).ravel())).max() < 1e-9
    assert W.identity_error(df, model) < 1e-10


def test_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        df = spark.createDataFrame(rows, SCHEMA)
        model = W.fit(df)
        assert W.whiten(df, model).collect() == [] and W.identity_error(df, model) == 0.0
    df = spark.createDataFrame([(i, [1.0, float(i), 3.0]) for i in range(10)], SCHEMA)       # two constant entries
    assert {r.component for r in W.whiten(df, W.fit(df)).collect()} == {1}


def test_large_entries_are_exact(spark):
    rows = [(i, [float((-1) ** i * i * 2 ** 16), float(i)]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, far, _, _ = brute([v for _, v in rows])
    out = W.whiten(df, W.fit(df)).where("component = 1").orderBy("vec_id").collect()
    assert [r.deviation for r in out] == far
