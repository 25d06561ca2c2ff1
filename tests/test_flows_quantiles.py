"""The batch run's reports against the same reports over its tables; exact quantiles against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketry.operators import model as M
from basketry.operators.model import dedup_keep_first
from basketry.operators.quantiles import exact_quantiles
from basketry.plans import flows as FL
from basketry.plans.context import context
from basketry.session import shared_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    c = context(spark, SF)
    raw = {"orders": c.raw_orders, "customers": c.raw_customers, "order_items": c.raw_items, "products": c.raw_products}
    return raw, FL.run_batch_medallion(spark, raw, shared_dir(spark, "medallion"), c.rules), c


def test_reports_measured_while_writing(spark, run):
    """What the write measured equals what a scan of the tables says, report by report, all rows and columns."""
    raw, p, c = run
    newest = spark.read.parquet(p["silver/orders"]).select(F.max(F.when(F.col("is_valid_order") == 1, F.col("order_date_cleaned")))).first()[0]
    suite = FL.quality_suite(raw["orders"], raw["customers"], raw["order_items"], raw["products"], F.lit(newest).cast("date"))
    for name, want in suite.items():
        got = spark.read.parquet(p[f"quality/{name}"])
        assert sorted(got.columns) == sorted(want.columns), name
        assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect())), name


def test_metrics_need_no_scan(spark, run):
    _, p, _ = run
    for name in ("null_counts_orders", "order_date_range"):
        assert spark.read.parquet(p[f"quality/{name}"]).count() == 1


def test_bronze_equals_the_feed(spark, run):
    raw, p, _ = run
    for name, df in raw.items():
        got = spark.read.schema(df.schema).parquet(p[f"bronze/{name}"])
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, df.collect()))


def test_order_ids_are_counted_once(spark, run):
    """One count per order id serves the report of repeated ids, the summary, the orphans and the de-duplication of Silver."""
    raw, p, _ = run
    keys = spark.read.parquet(p["quality/order_keys"])
    assert keys.columns == ["order_id", "row_count"]
    assert dict(map(tuple, keys.collect())) == Counter(r.order_id for r in raw["orders"].select("order_id").collect())
    want = dedup_keep_first(raw["orders"], ["order_id"])
    got = spark.read.parquet(p["silver/orders"]).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_fact_by_month_equals_the_fact(spark, run):
    """The same rows as the plain joins, months dealt into parts or not; orders without lines stay."""
    _, p, _ = run
    orders, customers, items, products = (spark.read.parquet(p[f"silver/{n}"]) for n in ("orders", "customers", "order_items", "products"))
    items = items.filter(F.col("order_id") % 5 != 0)
    want = M.fact_orders_enhanced(orders, customers, items, products)
    rows = Counter(map(tuple, want.collect()))
    assert any(r[9] is None for r in rows)
    for month_rows in (4_000_000, 3):
        got = M.fact_orders_by_month(orders, customers, items, products, month_rows)
        assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert Counter(map(tuple, got.collect())) == rows


def test_fact_lines_travel_without_their_order(spark, run):
    """The join by product carries no column of the order but its id and month; one file a month is written."""
    _, p, _ = run
    layers = [spark.read.parquet(p[f"silver/{n}"]) for n in ("orders", "customers", "order_items", "products")]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.fact_orders_by_month(*layers)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    by_product = plan[plan.index("Join LeftOuter, (product_id"):]
    assert "total_amount_cleaned" not in by_product.split("Join LeftOuter, (order_id")[0]
    assert plan.count("RepartitionByExpression") == 1
    files = spark.read.parquet(p["silver/fact_orders"]).select(F.input_file_name().alias("f"), "order_year", "order_month").distinct()
    assert files.groupBy("order_year", "order_month").count().filter("count > 1").count() == 0


LAYERS = ["silver/orders", "silver/customers", "silver/fact_orders", "silver/customer_metrics", "gold/customer_rfm", "gold/potential_fraud_orders",
          "gold/customer_segment_monthly", "gold/segment_analysis", "quality/referential_integrity", "quality/duplicate_order_ids"]


def test_tables_of_many_rows_are_not_broadcast(spark, run, monkeypatch):
    """Counted rows decide, not the size of compressed files: beyond the bounds the driver builds no table, and all rows stay."""
    raw, p, c = run
    plans = {}
    for writer in ("write_parquet", "write_partitioned"):
        def spy(df, path, *args, write=getattr(FL.LY, writer), **options):
            plans[path] = df._jdf.queryExecution().sparkPlan().toString()
            return write(df, path, *args, **options)
        monkeypatch.setattr(FL.LY, writer, spy)
    monkeypatch.setattr(FL, "BROADCAST_ROWS", 0, raising=False)
    monkeypatch.setattr(FL, "BROADCAST_KEYS", 0, raising=False)
    many = FL.run_batch_medallion(spark, raw, shared_dir(spark, "medallion"), c.rules)
    assert [path for path, plan in plans.items() if "Broadcast" in plan] == []
    assert sum(plan.count("SortMergeJoin") for plan in plans.values()) >= 10
    for layer in LAYERS:
        want, got = spark.read.parquet(p[layer]), spark.read.parquet(many[layer])
        assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect())), layer


def test_few_rows_are_broadcast_beside_many(spark, run):
    """A table of few rows is the one that is built, however small the files of the other look."""
    _, p, c = run
    orders, customers = (spark.read.parquet(p[f"silver/{n}"]) for n in ("orders", "customers"))
    rows = {}
    for few in (True, False):
        rfm = M.customer_rfm(FL.counted(orders, 10**9), FL.counted(customers, 10 if few else 10**9), F.lit("1998-08-02").cast("date"), c.rules.rfm)
        plan = rfm._jdf.queryExecution().sparkPlan().toString()
        assert ("BroadcastHashJoin" in plan and "BuildRight" in plan) == few and ("SortMergeJoin" in plan) != few
        rows[few] = Counter(map(tuple, rfm.collect()))
    assert rows[True] == rows[False] and rows[True]


def test_together_runs_all_and_raises(spark):
    done = []

    def bad():
        raise ValueError("one job failed")
    with pytest.raises(ValueError):
        FL.together(spark, lambda: done.append(1), bad, lambda: done.append(2))
    assert sorted(done) == [1, 2]


def brute(values, probs):
    values = sorted(v for v in values if v is not None)
    out = []
    for p in probs:
        at = (len(values) - 1) * p
        lo, hi = values[math.floor(at)], values[math.ceil(at)]
        out.append(lo + (hi - lo) * (at - math.floor(at)))
    return out


def test_quantiles_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice([None, 7.0, 7.0, float(rng.randint(0, 50)), rng.random()])) for _ in range(3000)]
    rows += [("one", 3.0), ("none", None)]
    df, probs = spark.createDataFrame(rows, "g string, x double"), [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in exact_quantiles(df, "x", probs, ["g"]).collect()}
    want = {g: brute([x for h, x in rows if h == g], probs) for g in {g for g, x in rows if x is not None}}
    assert got.keys() == want.keys()
    for g in want:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[g], want[g], strict=True)), g
    assert all(abs(a - b) < 1e-9 for a, b in zip(exact_quantiles(df, "x", probs).first().q, brute([x for _, x in rows], probs), strict=True))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "g string, x double")
    assert exact_quantiles(df, "x", [0.5]).collect() == [] and exact_quantiles(df, "x", [0.5], ["g"]).collect() == []
