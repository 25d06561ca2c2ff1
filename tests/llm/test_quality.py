import zlib

import numpy as np

from basketry.llm import quality as Q
from tests.llm.helpers import SF, docs_of, documents, edge_docs

LABELS = "doc_id long, quality int"


def test_given_labels_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = Q.score(docs.join(labels, "doc_id"), Q.train(docs, labels), out="p").collect()
    import zlib
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 50 and all(0 <= r.p <= 1 for r in out)
    assert sum((r.p >= 0.5) != (r.quality == 1) for r in held) <= 0.05 * len(held)


def test_isotonic_by_hand():
    knots, values = Q.isotonic(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0.0, 1, 0, 1, 0, 1]))
    assert list(zip(knots, values)) == [(1, 0), (1, 0), (2, 0.5), (4, 0.5), (5, 1), (5, 1)]
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    knots, values = Q.isotonic(x, (rng.random(300) < 1 / (1 + np.exp(-x))).astype(float))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()


def test_fourier_approximates_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, Q.N_STATS))
    z = Q.fourier(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * Q.WIDTH**2))
    assert np.abs(z @ z.T - exact).max() < 0.35 and np.abs(z @ z.T - exact).mean() < 0.06


def test_partition_sums_do_not_depend_on_the_partitions(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    x = [Q.train(docs.repartition(n), labels).score(np.ones((1, Q.N_STATS)))[0] for n in (1, 7)]
    assert abs(x[0] - x[1]) < 1e-6


def test_edges(spark):
    docs, given = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.train(docs, given.unionByName(given.limit(1).selectExpr("cast(null as long) doc_id", "1 quality", "1 toxic")))
    out = Q.score(edge_docs(spark).withColumnRenamed("row", "sample_id"), model)
    assert out.count() == edge_docs(spark).count()
    assert all(0 <= r.quality <= 1 for r in out.collect())
    wide = edge_docs(spark).unionByName(docs.selectExpr("doc_id", "text", "lang AS k1", "n_chars AS row", "1.5D AS quality"))
    assert np.allclose(Q.train(wide, given).score(np.ones((1, Q.N_STATS))), Q.train(
        wide.select("doc_id", "text"), given).score(np.ones((1, Q.N_STATS))))
    for labels, want in (([], 0.0), ([(1, None)], 0.0), ([(1, 1)], 1.0)):
        model = Q.train(docs, docs_of(spark, labels, LABELS))
        assert {r.quality for r in Q.score(edge_docs(spark), model).collect()} == {want}
    assert Q.score(docs_of(spark, []), model).collect() == []
    assert len(Q.statistics(b"")) == Q.N_STATS


def test_scores_match_brute_force(spark):
    """The whole way again on one machine: dense ridge over the Fourier features, isotonic values as max-min of averages."""
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    label = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    ids = [i for i in texts if i in label]
    x, y = np.array([Q.statistics(texts[i]) for i in ids]), np.array([label[i] for i in ids], float)
    mean, scale = x.mean(0), np.sqrt(np.maximum((x * x).mean(0) - x.mean(0) ** 2, 1e-12))
    scale[scale < 1e-5] = 1.0
    z, n = Q.fourier((x - mean) / scale), len(ids)
    w = np.where(y > 0, n / 2 / y.sum(), n / 2 / (n - y.sum()))
    stacked = np.r_[z * np.sqrt(w)[:, None], np.sqrt(Q.RIDGE * n / 100) * np.eye(z.shape[1])]
    weights = np.linalg.lstsq(stacked, np.r_[y * np.sqrt(w), np.zeros(z.shape[1])], rcond=None)[0]
    order = np.argsort(z @ weights)
    s, t = (z @ weights)[order], y[order]
    up = np.r_[0, np.cumsum(t)]
    level = np.array([max(min((up[k + 1] - up[j]) / (k + 1 - j) for k in range(i, n)) for j in range(i + 1)) for i in range(n)])
    out = Q.score(docs, Q.train(docs, labels)).collect()
    want = np.interp(Q.fourier((np.array([Q.statistics(texts[r.doc_id]) for r in out]) - mean) / scale) @ weights, s, level)
    assert np.abs(np.array([r.quality for r in out]) - want).max() < 1e-5


def test_repeated_labels_and_clashing_names(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    twice = labels.unionByName(labels)
    x = [Q.train(d, x).score(np.zeros((1, Q.N_STATS)))[0] for d, x in ((docs, labels), (docs.withColumnRenamed("lang", "sample_id"), twice))]
    assert abs(x[0] - x[1]) < 0.2 and 0 <= x[1] <= 1
