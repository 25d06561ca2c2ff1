"""As-of joins against brute force; mergeable sketches within their bounds of the exact figures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basketry.operators import asof as AS
from basketry.operators import sketches as SK

T0 = dt.datetime(2024, 1, 1)
ROWS = "customer_id long, event_time timestamp, order_id long"
CHANGES = "customer_id long, changed_at timestamp, name string, email string, segment string"


def brute(rows, changes):
    out = []
    for c, t, i in rows:
        mine = [x for x in changes if x[0] is not None and x[0] == c and x[1] is not None and t is not None and x[1] <= t]
        last = max(mine, key=lambda x: (x[1], *[(v is not None, v or "") for v in x[2:]]), default=None)
        out.append((i, last[1] if last else None, *(last[2:] if last else (None, None, None))))
    return sorted(out, key=str)


def found(df):
    return sorted([(r.order_id, r.known_since, r.name, r.email, r.segment) for r in df.collect()], key=str)


@pytest.mark.parametrize("block", [60, 3600, 86_400, 10 ** 9])
def test_asof_matches_brute_force(spark, block):
    rng = random.Random(block)
    moment = lambda: T0 + dt.timedelta(seconds=rng.randint(0, 40_000), microseconds=rng.choice([0, 0, 1, 999_999]))
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), moment() if rng.random() > 0.05 else None, i) for i in range(300)]
    changes = [(rng.choice([1, 1, 2, 4, None]), moment() if rng.random() > 0.1 else None, rng.choice(["a", "b", None]), f"e{i % 7}",
                rng.choice(["VIP", None])) for i in range(60)]
    changes += changes[:5]                                  # repeated rows
    changes += [(1, rows[0][1], "same time", "x", "y"), (1, rows[0][1], "same time", "z", None)]
    got = AS.fact_orders_asof(spark.createDataFrame(rows, ROWS), spark.createDataFrame(changes, CHANGES), block)
    assert found(got) == brute(rows, changes)


def test_asof_without_changes_or_rows(spark):
    none, rows = spark.createDataFrame([], CHANGES), spark.createDataFrame([(1, T0, 5), (None, None, 6)], ROWS)
    assert found(AS.fact_orders_asof(rows, none)) == [(5, None, None, None, None), (6, None, None, None, None)]
    assert AS.fact_orders_asof(rows.limit(0), none).collect() == []


def test_asof_groups_are_bounded_in_time(spark):
    """A customer with all orders is spread over the blocks: no window group spans two."""
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("customer_id"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("event_time"),
                                    F.col("id").alias("order_id"))
    changes = spark.createDataFrame([(1, dt.datetime(2023, 1, 1), "n", "e", "s")], CHANGES)
    got = AS.fact_orders_asof(rows, changes, 3600)
    assert got.filter("name = 'n'").count() == 5000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "Window" in plan


def test_sketches_roll_up_within_their_bounds(spark):
    rows = spark.range(200_000).select(
        (F.col("id") % 40).alias("day"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("status"),
        F.when(F.col("id") % 50 != 7, F.pmod(F.xxhash64("id"), F.lit(30_000))).alias("customer_id"),
        F.when(F.col("id") % 41 != 5, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) / 100).alias("total_amount"))
    parts = SK.sketched(rows, "day", "status")
    for by, filters in ((["status"], "true"), ([], "day < 10"), (["day"], "status = 'b'")):
        got = SK.figures(SK.rolled_up(parts.filter(filters), *by))
        exact = rows.filter(filters).groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("customer_id").alias("c"), F.collect_list("total_amount").alias("values"),
            F.sum(F.floor(F.col("total_amount") * 100 + 0.5)).alias("cents"))
        want = {tuple(r[b] for b in by): r for r in exact.collect()}
        assert len(want) == got.count()
        for r in got.collect():
            w = want[tuple(r[b] for b in by)]
            assert r.row_count == w.n and r.revenue == w.cents / 100
            assert abs(r.customers - w.c) <= SK.hll_error() * w.c
            values = sorted(w["values"])
            for q, x in zip(SK.QUARTILES, r.amount_quantiles, strict=True):
                low = sum(v < x for v in values) / len(values)
                high = sum(v <= x for v in values) / len(values)
                assert low - SK.kll_error() <= q <= high + SK.kll_error()


def test_rolled_up_rows_roll_up_again(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("day"), (F.col("id") % 100).alias("customer_id"), (F.col("id") * 1.0).alias("total_amount"))
    once = SK.rolled_up(SK.sketched(rows, "day"))
    twice = SK.rolled_up(SK.rolled_up(SK.sketched(rows, "day"), (F.col("day") % 2).alias("half")))
    assert [r.customers for r in SK.figures(once).collect()] == [r.customers for r in SK.figures(twice).collect()]


def test_sketches_of_nothing(spark):
    rows = spark.createDataFrame([("a", None, None), ("a", None, None)], "status string, customer_id long, total_amount double")
    r = SK.figures(SK.rolled_up(SK.sketched(rows, "status"), "status")).first()
    assert (r.row_count, r.customers, r.amount_quantiles) == (2, 0, [None] * 5)
    assert SK.figures(SK.sketched(rows.limit(0), "status")).collect() == []
