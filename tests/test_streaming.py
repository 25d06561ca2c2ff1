"""Streams against fixtures: late data, stream == batch twin, idempotent Silver, stateful velocity."""
import datetime as dt
import json
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from basketry.plans.landing import landing_events
from basketry.session import shared_dir
from basketry.streaming import orders_stream as S


def write_events(path, events):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, f"part-{uuid.uuid4().hex}.json"), "w") as f:
        for e in events:
            f.write(json.dumps(e) + "\n")


def order(i, t, amount=100.0, status="completed", customer=1):
    return {"event_type": "order", "event_timestamp": t.isoformat(timespec="microseconds"), "order_id": i,
            "customer_id": customer, "order_date": t.isoformat(), "status": status, "total_amount": amount,
            "source_system": "test"}


def local_dir(spark, name):
    return shared_dir(spark, name).replace("file:", "")


def test_late_event_dropped_in_append_mode(spark):
    t = dt.datetime(2024, 1, 1, 10, 0, 0, 123456)
    landing, out, ck = local_dir(spark, "land"), local_dir(spark, "out"), local_dir(spark, "ck")

    def run():
        orders = S.enrich_stream(S.route_events(S.read_event_files(spark, landing, max_files_per_trigger=None), "order"))
        S.await_all(spark, [S.to_parquet(S.windowed_revenue(orders, "1 minute", watermark="10 minutes"), out, ck)])

    write_events(landing, [order(1, t), order(2, t + dt.timedelta(minutes=20))])
    run()
    write_events(landing, [order(3, t + dt.timedelta(minutes=1)), order(4, t + dt.timedelta(minutes=40))])
    run()
    rows = {r.window_start: r.order_count for r in spark.read.parquet(out).collect()}
    # window 10:00 closed after batch 1; 10:01 arrives behind the watermark (10:10) -> dropped;
    # 10:20 closes once 10:40 moves the watermark to 10:30
    assert rows == {dt.datetime(2024, 1, 1, 10, 0): 1, dt.datetime(2024, 1, 1, 10, 20): 1}


def test_stream_windows_equal_batch_twin_on_closed_windows(spark):
    t = dt.datetime(2024, 1, 1, 12, 0)
    evs = [order(i, t + dt.timedelta(seconds=37 * i), amount=10.0 + i, customer=i % 3) for i in range(60)]
    landing, out, ck = local_dir(spark, "land"), local_dir(spark, "out"), local_dir(spark, "ck")
    write_events(landing, evs)
    orders = S.enrich_stream(S.route_events(S.read_event_files(spark, landing), "order"))
    S.await_all(spark, [S.to_parquet(S.windowed_revenue(orders, "5 minutes"), out, ck)])
    streamed = {(r.window_start, r.order_count, r.total_revenue) for r in spark.read.parquet(out).collect()}
    batch = S.windowed_revenue(S.enrich_stream(S.route_events(spark.read.schema(S.EVENT_SCHEMA).json(landing), "order")),
                               "5 minutes", exact_customers=True)
    watermark = t + dt.timedelta(seconds=37 * 59) - dt.timedelta(minutes=10)
    closed = {(r.window_start, r.order_count, r.total_revenue) for r in batch.collect() if r.window_end <= watermark}
    assert streamed == closed and streamed


def test_silver_writer_is_idempotent(spark):
    t = dt.datetime(2024, 3, 1, 9, 0)
    df = S.enrich_stream(spark.createDataFrame(
        [("order", t.isoformat(), 1, 1, t.isoformat(), "completed", 5.0, "x"),
         ("order", "not a time", 2, 1, "garbage", "completed", 5.0, "x")],
        "event_type string, event_timestamp string, order_id long, customer_id long, order_date string, "
        "status string, total_amount double, source_system string"))
    root = local_dir(spark, "silver")
    write = S.silver_writer(f"{root}/ok", f"{root}/bad")
    write(df, 0)
    write(df, 0)                       # replay of the same batch
    ok, bad = spark.read.parquet(f"{root}/ok"), spark.read.parquet(f"{root}/bad")
    assert ok.count() == 1 and bad.count() == 1
    assert bad.collect()[0].order_id == 2 and bad.collect()[0].order_year is None


def test_kafka_decode(spark):
    raw = spark.createDataFrame([(b"7", json.dumps(order(1, dt.datetime(2024, 1, 1))).encode())], "key binary, value binary")
    r = S.decode_kafka(raw).collect()[0]
    assert r.message_key == "7" and r.order_id == 1 and r.total_amount == 100.0


def run_velocity(spark, waves):
    """orders_in_last_hour by order id, one micro-batch per wave of (id, minute, customer)."""
    t = dt.datetime(2024, 1, 1, 8, 0)
    landing, out, ck = local_dir(spark, "land"), local_dir(spark, "out"), local_dir(spark, "ck")
    for wave in waves:
        write_events(landing, [order(i, t + dt.timedelta(minutes=m), customer=c) for i, m, c in wave])
        orders = S.enrich_stream(S.route_events(S.read_event_files(spark, landing), "order"))
        S.await_all(spark, [S.to_upserts(S.orders_per_second(orders), out, ck)])
    rows = S.enrich_stream(S.route_events(spark.read.schema(S.EVENT_SCHEMA).json(landing), "order"))
    counts = S.velocity(rows, S.current_rows(spark, out, ["customer_id", "second"]))
    return {r.order_id: r.orders_in_last_hour for r in counts.collect()}


def test_velocity(spark):
    rows = [(i, m, c) for i, (m, c) in enumerate([(0, 1), (10, 1), (50, 1), (65, 1), (5, 2), (200, 1)])]
    assert run_velocity(spark, [rows]) == {0: 1, 1: 2, 2: 3, 3: 3, 4: 1, 5: 1}


def test_velocity_with_late_rows_inside_the_watermark(spark):
    first = [(1, 240, 7), (2, 250, 7), (3, 260, 7), (4, 340, 7)]
    second = [(5, 290, 7), (6, 285, 7)]
    want = {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 4}
    assert run_velocity(spark, [first, second]) == want
    assert run_velocity(spark, [[x] for x in sorted(first)] + [[x] for x in second]) == want


def test_unfinished_query_is_an_error(spark):
    landing = local_dir(spark, "land")
    write_events(landing, [order(1, dt.datetime(2024, 1, 1))])
    q = S.to_bronze(S.read_event_files(spark, landing), local_dir(spark, "out"), local_dir(spark, "ck"), available_now=False)
    with pytest.raises(TimeoutError):
        S.await_all(spark, [q], timeout_s=1)
    assert not q.isActive


def test_sources_leave_nothing_out_by_default(spark, monkeypatch):
    seen = {}

    class Reader:
        def __getattr__(self, name):
            return lambda *a, **k: (seen.update(k), seen.update([a] if len(a) == 2 else []), self)[-1]
    monkeypatch.setattr(type(spark), "readStream", property(lambda self: Reader()))
    monkeypatch.setattr(S, "decode_kafka", lambda raw, schema: raw)
    S.read_kafka(spark, "host:1", "orders")
    assert seen["failOnDataLoss"] == "true" and seen["startingOffsets"] == "earliest"
    seen.clear()
    S.read_event_files(spark, "x")
    assert "maxFileAge" not in seen and "maxFilesPerTrigger" not in seen


def closed_orders(spark, window, slide, waves=None, files_per_trigger=None):
    t = dt.datetime(2024, 1, 1, 12, 0)
    evs = [order(i, t + dt.timedelta(seconds=41 * i), amount=10.0 + i, customer=i % 3) for i in range(90)]
    landing, out, ck = local_dir(spark, "land"), local_dir(spark, "out"), local_dir(spark, "ck")
    for i in range(0, 90, 30):
        write_events(landing, evs[i:i + 30])
        time.sleep(0.05)                                   # the file source goes by modification time
    orders = S.enrich_stream(S.route_events(S.read_event_files(spark, landing, max_files_per_trigger=files_per_trigger), "order"))
    S.await_all(spark, [S.to_parquet(S.windowed_revenue(orders, window, slide), out, ck)])
    streamed = {(r.window_start, r.order_count, r.unique_customers) for r in spark.read.parquet(out).collect()}
    batch = S.windowed_revenue(S.enrich_stream(S.route_events(spark.read.schema(S.EVENT_SCHEMA).json(landing), "order")),
                               window, slide, exact_customers=True)
    end = t + dt.timedelta(seconds=41 * 89) - dt.timedelta(minutes=10)
    return streamed, {(r.window_start, r.order_count, r.unique_customers) for r in batch.collect() if r.window_end <= end}


@pytest.mark.parametrize("files", [None, 1])
@pytest.mark.parametrize("window,slide", [("10 minutes", "4 minutes"), ("10 minutes", "5 minutes"), ("5 minutes", None)])
def test_windows_over_one_or_many_micro_batches(spark, window, slide, files):
    streamed, batch = closed_orders(spark, window, slide, files_per_trigger=files)
    assert streamed and streamed == batch


def test_interval_seconds():
    assert S.seconds("10 minutes") == 600 and S.seconds("1 hour 30 minutes") == 5400 and S.seconds("1 second") == 1
    for bad in ("1 month", "soon", "10", "1 hour and more"):
        with pytest.raises(ValueError):
            S.seconds(bad)


def test_memory_table_of_a_few_rows(spark):
    landing, name = local_dir(spark, "land"), f"few_{uuid.uuid4().hex[:8]}"
    write_events(landing, [order(i, dt.datetime(2024, 1, 1)) for i in range(3)])
    S.await_all(spark, [S.to_memory(S.read_event_files(spark, landing), name, checkpoint=local_dir(spark, "ck"))])
    assert sorted(r.order_id for r in spark.table(name).collect()) == [0, 1, 2]


def test_routes_have_their_own_columns(spark):
    df = spark.createDataFrame([], S.EVENT_SCHEMA)
    assert S.route_events(df, "customer_update").columns == [
        "event_type", "event_timestamp", "customer_id", "name", "email", "join_date", "segment", "phone"]
    assert {"discount_percent", "line_total"} <= set(S.route_events(df, "order_item").columns)
    with pytest.raises(ValueError):
        S.route_events(df, "refund")


def test_broken_message_keeps_its_text(spark):
    raw = spark.createDataFrame([(b"1", b"{broken"), (b"2", None)], "key binary, value binary")
    got = {r.message_key: r for r in S.decode_kafka(raw).collect()}
    assert got["1"]._corrupt_record == "{broken" and got["1"].order_id is None and got["2"]._corrupt_record is None


def test_medallion_outputs_match_batch_twins(spark):
    """Bronze feeds Silver, windowed revenue and fraud; each equals its batch twin."""
    from basketry.functions.rules import tpch_rules
    from basketry.operators import fraud as FR
    from basketry.sources.tables import read_table

    rules = tpch_rules().stream_fraud
    landing, root = local_dir(spark, "land"), local_dir(spark, "medallion")
    S.land_events(landing_events(read_table(spark, "/root/testdata/sf0.001", "events")), landing)
    paths = S.run_medallion(spark, landing, root, fraud_rules=rules)
    batch = S.enrich_stream(S.route_events(spark.read.schema(S.EVENT_SCHEMA).json(landing), "order"))

    silver = spark.read.parquet(paths["silver"])
    aside = spark.read.parquet(paths["silver_invalid_dates"])
    assert aside.count() == batch.filter("order_year IS NULL").count() > 0
    assert silver.count() + aside.count() == batch.count()
    streamed_fraud = {(r.order_id, r.fraud_score) for r in spark.read.parquet(paths["fraud"]).collect()}
    batch_fraud = {(r.order_id, r.fraud_score) for r in FR.stream_fraud(batch, rules).collect()}
    assert streamed_fraud == batch_fraud and streamed_fraud
    closed = {(r.window_start, r.order_count, r.unique_customers) for r in
              S.windowed_revenue(batch, "1 minute", exact_customers=True).collect()}
    streamed = {(r.window_start, r.order_count, r.unique_customers) for r in spark.read.parquet(paths["revenue_by_window"]).collect()}
    assert streamed and streamed <= closed
