"""Dimensions, facts, Gold, RFM and revenue reports on small literal tables."""
import datetime as dt
from collections import Counter
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.functions.rules import RfmRules
from basketry.operators import analytics as A
from basketry.operators import cleaning as CL
from basketry.operators import model as M

ORDERS = "order_id long, customer_id long, order_date string, status string, total_amount double, source_system string"
CUSTOMERS = ("customer_id long, name string, email string, join_date string, segment string, phone string, age long, "
             "marketing_opt_in string")


def orders_customers(spark):
    orders = spark.createDataFrame([
        (1, 101, "2024-01-10", "completed", 100.0, "web"),
        (1, 101, "2024-01-10", "Completed", 100.0, "replay"),   # re-delivered
        (2, 101, "01/20/2024", "COMPLETE", 300.0, "web"),
        (3, 102, "2024-02-05", "completed", 50.0, "web"),
        (4, 102, "2024-02-06", "pending", 70.0, "web"),
        (5, None, "2024-02-07", "completed", 10.0, "web"),       # no customer -> invalid
        (6, 103, "2024-13-45", "completed", 10.0, "web"),       # bad date -> invalid
    ], ORDERS)
    customers = spark.createDataFrame([
        (101, "Ann", "ann@x.com", "2023-01-01", "VIP", None, 30, "Y"),
        (101, "ANN", "ann@x.com", "2023-01-01", "Gold", None, 30, "Y"),       # duplicate id
        (102, "Bob", "bob@x.com", "2023-06-01", "basic", None, 40, "N"),
        (103, "N/A", None, None, None, None, None, None),                     # no usable name
    ], CUSTOMERS)
    o = CL.clean_orders(M.dedup_keep_first(orders, ["order_id"]))
    c = CL.clean_customers(customers, "2024-02-29")
    return o, c


def test_dedup_keep_first_matches_row_number(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 5), (1, "a", None), (2, None, 1), (None, "z", 1), (None, "y", 1)],
                               "k int, s string, n int")
    got = sorted(M.dedup_keep_first(df, ["k"]).collect(), key=str)
    w = Window.partitionBy("k").orderBy("s", "n")
    want = sorted(df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn").collect(), key=str)
    assert got == want


def test_gold_order_grain_no_fanout(spark):
    o, c = orders_customers(spark)
    gold = {(r.order_year, r.order_month, r.customer_segment): r
            for r in M.gold_segment_monthly(o, c, "2024-02-29", RfmRules()).collect()}
    jan = gold[(2024, 1, "Premium")]
    # order 1 once (re-delivery removed) + order 2; customer 101 once
    assert jan.revenue == 400.0 and jan.order_count == 2 and jan.customer_count == 1
    assert jan.value_segment == "medium_value"   # 400 >= 250 and 40 days <= 90 (but 400 < 500)
    feb = gold[(2024, 2, "Regular")]
    assert feb.revenue == 50.0 and feb.order_count == 1
    assert len(gold) == 2


def test_rfm_segments(spark):
    o, c = orders_customers(spark)
    rfm = {r.customer_id: r for r in M.customer_rfm(o, c, "2024-02-29", RfmRules(high_monetary=300)).collect()}
    assert rfm[101].monetary == Decimal("400.00") and rfm[101].frequency == 2 and rfm[101].recency_days == 40
    assert rfm[101].value_segment == "high_value"
    assert rfm[102].value_segment == "low_value"


def test_customer_metrics_and_top(spark):
    o, c = orders_customers(spark)
    m = {r.customer_id: r for r in M.customer_metrics(o, c, "2024-02-29").collect()}
    assert m[101].total_orders == 2 and m[101].total_revenue == 400.0 and m[101].avg_order_value == 200.0
    assert m[101].segment == "Premium" and m[101].tenure_days == (dt.date(2024, 2, 29) - dt.date(2023, 1, 1)).days
    top = A.top_customers(M.customer_metrics(o, c, "2024-02-29"), 1).collect()
    assert [r.customer_id for r in top] == [101]


def test_revenue_anomalies_rule_book_case(spark):
    monthly = spark.createDataFrame([(2024, m, float(v)) for m, v in
                                     zip(range(1, 6), [10000, 12000, 11500, 80000, 13000])],
                                    "order_year long, order_month long, monthly_revenue double")
    rows = A.revenue_anomalies(monthly, 0.2).collect()
    assert [(r.order_month, round(r.revenue_drop_pct, 4)) for r in rows] == [(5, 0.8375)]


def test_revenue_anomalies_calendar_gap(spark):
    monthly = spark.createDataFrame([(2024, 1, 100.0), (2024, 3, 10.0)],
                                    "order_year long, order_month long, monthly_revenue double")
    assert len(A.revenue_anomalies(monthly, 0.2).collect()) == 1
    assert A.revenue_anomalies(monthly, 0.2, calendar=True).collect() == []


def test_status_and_overall(spark):
    o, _ = orders_customers(spark)
    dist = {r.status: r.order_count for r in A.status_distribution(o).collect()}
    assert dist == {"completed": 5, "pending": 1}
    ov = A.overall_revenue(o).collect()[0]
    assert ov.total_orders == 3 and ov.total_revenue == 450.0 and ov.avg_order_value == 150.0


def test_dedup_with_known_repeats_compares_only_those(spark):
    """The same rows as without, null keys included; rows of other keys are not shuffled."""
    rows = [(1, "b", 2), (1, "b", 1), (1, "a", 9), (2, "x", 1), (None, "z", 1), (None, None, 5), (3, None, None), (4, "q", 1), (4, "q", 1)]
    df = spark.createDataFrame(rows, "k long, s string, n int")
    for data, repeats in ((df, [(1,), (4,), (None,)]), (df.dropDuplicates(["k"]), [])):
        repeated = spark.createDataFrame(repeats, "k long")
        got = M.dedup_keep_first(data, ["k"], repeated=repeated)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, M.dedup_keep_first(data, ["k"]).collect()))
    plan = M.dedup_keep_first(df, ["k"], repeated=F.broadcast(spark.createDataFrame([(1,)], "k long")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("LeftAnti") < plan.index("Aggregate") < plan.index("LeftSemi")
