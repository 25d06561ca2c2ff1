"""Incremental Gold: after every delivery the same table as a full run, only touched partitions written, crashes healed."""

import os

import pytest
from pyspark.sql import functions as F

from basketry.functions.rules import RuleSet
from basketry.operators import cleaning as CL
from basketry.operators import model as M
from basketry.operators.cleaning import orders_as_of
from basketry.plans import incremental as IN
from basketry.session import shared_dir
from basketry.sinks.layers import CUSTOMERS_SCHEMA, ORDERS_SCHEMA

RULES = RuleSet()
COLUMNS = ["order_year", "order_month", "customer_segment", "value_segment", "revenue", "order_count", "customer_count"]


def customers(spark, n=30, gold=()):
    rows = [(i, None if i % 7 == 3 else f"Name {i}", f"c{i}@example.com", "2020-01-01", "Gold" if i in gold else "Regular", None, 30, "yes", None, None)
            for i in range(n)]
    return spark.createDataFrame(rows, CUSTOMERS_SCHEMA)


def order(i, customer, date, amount=100.0, status="completed", source="web"):
    return (i, customer, date, status, amount, source, None)


def full(spark, orders, people):
    raw = spark.createDataFrame(orders, ORDERS_SCHEMA)
    clean = CL.clean_orders(M.dedup_keep_first(raw, ["order_id"]), RULES.cleaning)
    gold = M.gold_segment_monthly(clean, CL.clean_customers(people, F.lit("2024-01-01").cast("date")), orders_as_of(raw, RULES.cleaning), RULES.rfm)
    return sorted(map(tuple, gold.select(*COLUMNS).collect()), key=str)


def rows_of(store):
    return sorted(map(tuple, store.gold().select(*COLUMNS).collect()), key=str)


def files(root, table):
    out = {}
    for folder, _, names in os.walk(f"{root}/{table}"):
        out.update({os.path.join(folder, n): os.stat(os.path.join(folder, n)).st_mtime_ns for n in names if n.endswith(".parquet")})
    return out


DELIVERIES = [
    [order(i, i % 30, f"2024-{1 + i % 3:02d}-{1 + i % 27:02d}", 40.0 + i) for i in range(120)]
    + [order(500, 1, "no date"), order(501, None, "2024-01-05"), order(502, 2, "2024-01-06", None), order(None, 3, "2024-01-07")],
    [order(200, 4, "2024-03-28", 900.0), order(201, 5, "2024-03-29", 20.0, "cancelled")],                      # one month only
    [order(10, 10, "2024-02-11", 1.0, "completed", "a replay"), order(11, 11, "2023-12-24", 51.0), order(200, 4, "2024-03-28", 900.0)],
    [order(300, 6, "2024-06-30", 10.0)],                                                                       # as-of moves: segments change
    [order(12, 12, "2024-01-13", -5.0), order(None, 3, "2024-01-01", 1.0), order(500, 1, "2024-01-09")],       # the only valid copy is a worse one
]


def store_of(spark):
    root = shared_dir(spark, "gold_store")
    return IN.GoldStore(spark, root, RULES, id_block=50, customer_block=10), root


def test_every_delivery_equals_a_full_run(spark):
    store, _ = store_of(spark)
    seen, people = [], customers(spark)
    for n, rows in enumerate(DELIVERIES):
        seen += rows
        store.deliver(f"d{n}", spark.createDataFrame(rows, ORDERS_SCHEMA), CL.clean_customers(people, F.lit("2024-01-01").cast("date")))
        assert rows_of(store) == full(spark, seen, people), n


def test_changed_customers_move(spark):
    store, _ = store_of(spark)
    for n, gold in enumerate([(), (1, 2, 4), (2,)]):
        people = customers(spark, 30, gold)
        rows = DELIVERIES[0] if n == 0 else []
        store.deliver(f"d{n}", spark.createDataFrame(rows, ORDERS_SCHEMA), CL.clean_customers(people, F.lit("2024-01-01").cast("date")))
        assert rows_of(store) == full(spark, DELIVERIES[0], people)


def test_only_touched_partitions_are_written(spark):
    store, root = store_of(spark)
    people = CL.clean_customers(customers(spark), F.lit("2024-01-01").cast("date"))
    store.deliver("d0", spark.createDataFrame(DELIVERIES[0], ORDERS_SCHEMA), people)
    before = {t: files(root, t) for t in ("first", "orders", "months", "totals", "gold")}
    # a cancelled order of a day that is not the newest: its own block and month, nobody's totals
    store.deliver("d1", spark.createDataFrame([order(201, 5, "2024-03-05", 20.0, "cancelled")], ORDERS_SCHEMA), people)
    after = {t: files(root, t) for t in before}
    changed = {t: {f for f in {*before[t], *after[t]} if before[t].get(f) != after[t].get(f)} for t in before}
    assert changed["first"] and all("id_block=4" in f for f in changed["first"])
    for t in ("orders", "months", "gold"):
        assert changed[t] and all("order_year=2024/order_month=3" in f for f in changed[t]), t
    assert not changed["totals"]
    # the same delivery again, and one without news, write nothing at all
    for name in ("d1", "d2"):
        store.deliver(name, spark.createDataFrame([order(201, 5, "2024-03-05", 20.0, "cancelled")], ORDERS_SCHEMA), people)
        assert {t: files(root, t) for t in before} == after


@pytest.mark.parametrize("step", range(6))
def test_a_delivery_that_died_is_done_again(spark, monkeypatch, step):
    store, _ = store_of(spark)
    people = customers(spark)
    clean = CL.clean_customers(people, F.lit("2024-01-01").cast("date"))
    store.deliver("d0", spark.createDataFrame(DELIVERIES[0], ORDERS_SCHEMA), clean)
    rows = DELIVERIES[2] + DELIVERIES[3]
    calls, replace = [], IN.GoldStore._replace

    def dying(self, name, *args):
        calls.append(name)
        if len(calls) == step + 1:
            raise OSError("executor lost")
        replace(self, name, *args)
    monkeypatch.setattr(IN.GoldStore, "_replace", dying)
    with pytest.raises(OSError):
        store.deliver("d1", spark.createDataFrame(rows, ORDERS_SCHEMA), clean)
    monkeypatch.setattr(IN.GoldStore, "_replace", replace)
    store.deliver("d1", spark.createDataFrame(rows, ORDERS_SCHEMA), clean)
    assert rows_of(store) == full(spark, DELIVERIES[0] + rows, people)


def test_nothing_delivered(spark):
    store, _ = store_of(spark)
    store.deliver("d0", spark.createDataFrame([], ORDERS_SCHEMA), CL.clean_customers(customers(spark), F.lit("2024-01-01").cast("date")))
    assert rows_of(store) == []
