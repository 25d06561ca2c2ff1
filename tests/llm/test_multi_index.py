from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from basketry.llm import multi_index as M
from basketry.llm.queries import op13_nearest_neighbours
from tests.llm.helpers import SF

SCHEMA = "vec_id long, embedding array<float>"


def inner(v, w):
    """From left to right (sum() of floats compensates)."""
    return reduce(lambda a, p: a + p[0] * p[1], zip(map(float, v), map(float, w), strict=True), 0.0)


def brute(rows, k=20, queries=lambda i: i % 20 == 0):
    """{query: [(id, score)]} over usable rows, best first, ties to the smaller id."""
    out = {}
    for i, v in rows:
        if queries(i):
            found = sorted((-inner(v, w), j) for j, w in rows if j != i)
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, want = ranked(op13_nearest_neighbours(spark, SF)), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    true = {q: dict(brute(rows, k=len(rows), queries=lambda i, q=q: i == q)[q]) for q in want}
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(true[q][i] == s for i, s in found)       # to the last bit


def test_everything_visited_is_exact(spark):
    """With a target of all neighbours and many shards and blocks, nothing is lost."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).astype("float32").tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = M.build(df, centroid_count=6, shard=50)
    assert index.first.max() > 5
    asked = df.where("vec_id % 20 = 0")
    got = ranked(M.search(index, asked, target=1.0, block=7))
    assert got == brute([(i, np.float32(v).tolist()) for i, v in rows])


def test_ties_and_copies(spark):
    """A third of the rows are one vector; copies go by their ids, and the others are still found."""
    rng = np.random.default_rng(5)
    common = rng.normal(size=4).astype("float32").tolist()
    rows = [(i, common if i % 3 == 0 else rng.normal(size=4).astype("float32").tolist()) for i in range(300)]
    got = ranked(M.search(M.build(spark.createDataFrame(rows, SCHEMA), centroid_count=4, shard=16),
                          spark.createDataFrame([r for r in rows if r[0] % 20 == 0], SCHEMA), target=1.0))
    assert got == brute([(i, np.float32(v).tolist()) for i, v in rows])


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [-1.0, 2.0]), (3, [-1.0, 2.0]), (5, [0.0, -0.0]), (40, None), (60, [1.0, None]),
            (7, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (100, [])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cell", F.lit("clash")).withColumn("id", F.lit(0))
    got = ranked(M.search(M.build(df), df.where("vec_id % 20 = 0")))
    assert got == brute([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [-1.0, 2.0])])


def test_small_tables(spark):
    for rows in ([], [(0, None)], [(0, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert M.search(M.build(df), df).collect() == []
    for rows in ([(0, [1.0]), (1, [2.0]), (2, [-1.0])], [(0, [1.0, 1.0, 1.0]), (1, [2.0, 0.0, 0.0])]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert ranked(M.search(M.build(df), df.where("vec_id = 0"))) == brute(rows)


def test_traversal_is_in_order():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=9), rng.normal(size=13)
    cells = list(M.traverse(a, b))
    sums = [a[c // 13] + b[c % 13] for c in cells]
    assert sorted(cells) == list(range(9 * 13)) and sums == sorted(sums)


def test_recall_counts_pairs(spark):
    pairs = "query_id long, vec_id long"
    assert M.recall(spark.createDataFrame([(1, 2), (1, 3)], pairs), spark.createDataFrame([(1, 2), (1, 4)], pairs)) == 0.5
