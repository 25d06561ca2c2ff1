"""Quality reports, duplicate flags, fraud scoring - against brute force."""
import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.functions.rules import FraudRules
from basketry.operators import fraud as FR
from basketry.operators import quality as Q


def test_flag_duplicates_matches_row_number(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice(["a", "b", None]), rnd.choice([1, 2])) for _ in range(200)]
    rows += [(1, "a", 1)] * 5                      # identical copies
    df = spark.createDataFrame(rows, "k int, s string, n int")
    got = sorted(Q.flag_duplicates(df, ["k"]).collect(), key=str)
    w = Window.partitionBy("k").orderBy("s", "n")
    want = sorted(df.withColumn("is_duplicate", F.row_number().over(w) > 1).collect(), key=str)
    assert got == want


def test_null_counts_report_and_summary(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "", 1.0), (2, None, float("nan"))], "order_id int, s string, x double")
    assert Q.null_counts(df).collect()[0].asDict() == {"order_id": 0, "s": 1, "x": 1}
    assert Q.nan_counts(df).collect()[0].x == 1
    rep = {r.column_name: (r.null_count, r.null_percentage) for r in Q.column_report(df, "t").collect()}
    assert rep == {"order_id": (0, 0.0), "s": (2, 66.67), "x": (1, 33.33)}
    s = Q.table_summary(df, "t").collect()[0]
    assert (s.total_rows, s.total_columns, s.duplicate_rows) == (3, 3, 1)
    assert s.completeness_score == round((100 + (100 - 66.67) + (100 - 33.33)) / 3, 2)


def test_referential_integrity_and_quarantine(spark):
    orders = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 99), (5, 99)], "order_id long, customer_id long")
    customers = spark.createDataFrame([(10,), (11,), (11,)], "customer_id long")
    items = spark.createDataFrame([(1, 1, 7), (2, 8, 7), (3, None, 9)], "item_id long, order_id long, product_id long")
    products = spark.createDataFrame([(7,)], "product_id long")
    got = {r.check_name: r.orphan_count for r in Q.referential_integrity(orders, customers, items, products).collect()}
    assert got == {"orders_missing_customers": 2, "order_items_missing_orders": 1, "order_items_missing_products": 1}
    q = {r.order_id: r.quarantined for r in Q.quarantine_split(orders, customers, "customer_id").collect()}
    assert q == {1: False, 2: False, 3: True, 4: True, 5: True}


def test_iqr_outliers(spark):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100, None]], "x double")
    flags = {r.x: r.x_is_outlier for r in Q.iqr_outliers(df, "x").collect()}
    assert flags[100.0] is True and flags[5.0] is False and flags[None] is False


def test_days_since_last_order_matches_window(spark):
    rnd = random.Random(3)
    base = dt.date(2024, 1, 1)
    rows = [(i, rnd.choice([1, 2, 3]), base + dt.timedelta(days=rnd.randint(0, 20))) for i in range(300)]
    df = spark.createDataFrame(rows, "order_id long, customer_id long, order_date_cleaned date")
    got = {r.order_id: r.days_since_last_order for r in FR.days_since_last_order(df).collect()}
    w = Window.partitionBy("customer_id").orderBy("order_date_cleaned", "order_id")
    want = {r.order_id: r.d for r in df.select(
        "order_id", F.datediff("order_date_cleaned", F.lag("order_date_cleaned").over(w)).alias("d")).collect()}
    assert got == want


def test_orders_in_last_hour_matches_brute_force(spark):
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice([1, 2]), t0 + dt.timedelta(seconds=rnd.randint(0, 4 * 3600))) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, customer_id long, event_time timestamp")
    got = {r.event_id: r.orders_in_last_hour for r in FR.orders_in_last_hour(df).collect()}
    for i, c, t in rows:
        want = sum(1 for _, c2, t2 in rows if c2 == c and 0 <= (t - t2).total_seconds() <= 3600)
        assert got[i] == want


def test_fraud_golden_case(spark):
    """Order 208 of the exported run: 2200, same-day repeat, qty 14 -> 7, High, Velocity + High Value."""
    orders = spark.createDataFrame([
        (207, 150, dt.date(2024, 1, 15), 900.0, 1),
        (208, 150, dt.date(2024, 1, 15), 2200.0, 1)],
        "order_id long, customer_id long, order_date_cleaned date, total_amount_cleaned double, is_valid_order int")
    items = spark.createDataFrame([(1, 208, 14), (2, 207, 1)], "item_id long, order_id long, quantity_cleaned long")
    r = {x.order_id: x for x in FR.fraud_orders(orders, items, FraudRules(), keep_all=True).collect()}[208]
    assert (r.fraud_score, r.risk_level, r.fraud_type, r.total_quantity, r.max_item_quantity) == \
        (7, "High", "Velocity + High Value", 14, 14)


def test_alert_reasons(spark):
    ev = spark.createDataFrame([
        (1, 1, dt.datetime(2024, 1, 1), "cancelled", 6000.0, 1),
        (2, 1, dt.datetime(2024, 1, 1), "completed", 2500.0, 1),
        (3, 1, dt.datetime(2024, 1, 1), "refunded", 2500.0, 1)],
        "order_id long, customer_id long, event_time timestamp, status string, total_amount double, is_valid_order int")
    alerts = {r.order_id: r for r in FR.fraud_alerts(ev).collect()}
    assert set(alerts) == {1, 3}
    assert alerts[1].reasons == ["High transaction amount", "Suspicious order status"]
    assert alerts[1].risk_level == "HIGH" and alerts[1].requires_review is True
    assert alerts[3].fraud_score == 3 and alerts[3].risk_level == "MEDIUM"
    alt = {r.order_id: r for r in FR.fraud_alert_score_alt(ev).collect()}
    assert alt[1].fraud_score == 5 and alt[2].reasons == ["Suspicious pattern"] and alt[2].fraud_score == 3


def test_fraud_shuffles_an_order_once(spark):
    """Days come by order id, as the item statistics do: the same as by customer and day, and orders travel whole only once."""
    rnd = random.Random(8)
    base = dt.date(2024, 1, 1)
    rows = [(i, rnd.choice([1, 2, 3]), base + dt.timedelta(days=rnd.randint(0, 20)), rnd.choice([50.0, 2500.0]), 1) for i in range(300)]
    orders = spark.createDataFrame(rows, "order_id long, customer_id long, order_date_cleaned date, total_amount_cleaned double, is_valid_order int")
    days = FR.days_by_order(orders)
    joined = orders.join(days, "order_id", "left").select("order_id", "__days", "__first")
    got = {i: (d if first else 0) for i, d, first in map(tuple, joined.collect())}
    assert got == {r.order_id: r.days_since_last_order for r in FR.days_since_last_order(orders).collect()}
    items = spark.createDataFrame([(i, i % 300, 1 + i % 9) for i in range(900)], "item_id long, order_id long, quantity_cleaned long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = FR.fraud_orders(orders, items, FraudRules())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    keys = [line.split("hashpartitioning(")[1].split(", ")[0].split("#")[0] for line in plan.splitlines() if "hashpartitioning(" in line]
    # orders, statistics and days by order id; days by customer and day, then by customer
    assert keys.count("order_id") + keys.count("__first_id") == 3 and keys.count("customer_id") == 2, keys
