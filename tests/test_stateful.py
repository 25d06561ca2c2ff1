"""Stateful streams: velocity, item scores, duplicates, sessions - over several micro-batches, against batch twins."""

import datetime as dt

import pytest

from basketry.functions.rules import FraudRules
from basketry.session import shared_dir
from basketry.streaming import orders_stream as S
from basketry.streaming import quality as SQ
from basketry.streaming import stateful as ST

T0 = dt.datetime(2024, 3, 1, 10, 0, 0)
ORDER = "order_id long, customer_id long, event_time timestamp, status string, total_amount double, is_valid_order int"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


class Feed:
    """Waves of rows as a file stream; each wave is a micro-batch of its own."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.path, self.n = spark, schema, shared_dir(spark, "feed"), 0

    def land(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/wave={self.n}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/*")


def state_rows(query):
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])


# ------------------------------------------------------------------ velocity
def velocity_of(spark, waves):
    feed, out, ck = Feed(spark, ORDER), shared_dir(spark, "out"), shared_dir(spark, "ck")
    for wave in waves:
        feed.land(wave)
        q = S.to_upserts(ST.orders_in_last_hour(feed.stream()), out, ck)
        S.await_all(spark, [q])
    return ST.counted_orders(S.current_rows(spark, out, ST.COUNTED_KEYS)), q


def brute_velocity(rows):
    out = []
    for r in rows:
        if r[1] is not None and r[2] is not None:
            s = int(r[2].timestamp() // 1)
            out.append((r[0], r[1], sum(1 for x in rows if x[1] == r[1] and x[2] is not None and s - 3600 <= int(x[2].timestamp() // 1) <= s)))
    return sorted(out, key=str)


def order(i, customer, seconds, status="completed", amount=10.0):
    return (i, customer, None if seconds is None else at(seconds), status, amount, 1)


def test_velocity_counts_late_and_repeated_rows(spark):
    waves = [[order(1, 7, 0), order(2, 7, 3000), order(3, 7, 3600), order(4, 8, 3599), order(None, 7, 3600)],
             [order(5, 7, 3601), order(6, 7, 1800), order(7, None, 100), order(8, 7, None)],        # 6 arrives late
             [order(9, 7, 7200), order(10, 7, 7201), order(11, 7, 3650), order(11, 7, 3650), order(12, 8, 7000)]]
    got, _ = velocity_of(spark, waves)
    rows = [r for w in waves for r in w]
    assert sorted([(r.order_id, r.customer_id, r.orders_in_last_hour) for r in got.collect()], key=str) == brute_velocity(rows)


def test_velocity_keeps_what_rules_need(spark):
    got, _ = velocity_of(spark, [[order(1, 7, 0, "refunded", 123.45), (2, 7, at(1), None, None, None)]])
    rows = {r.order_id: r for r in got.collect()}
    assert (rows[1].status, rows[1].total_amount, rows[1].is_valid_order, rows[1].event_time) == ("refunded", 123.45, 1, at(0))
    assert (rows[2].status, rows[2].total_amount, rows[2].is_valid_order, rows[2].orders_in_last_hour) == (None, None, None, 2)


def test_velocity_state_is_freed(spark):
    waves = [[order(i, i % 5, i * 30) for i in range(100)], [order(1000, 3, 86_400)], [order(1001, 3, 86_401 + 7200)]]
    got, q = velocity_of(spark, waves)
    rows = [r for w in waves for r in w]
    assert sorted([(r.order_id, r.customer_id, r.orders_in_last_hour) for r in got.collect()], key=str) == brute_velocity(rows)
    # the first day's orders are gone: what is left belongs to the two newest orders
    assert state_rows(q) <= 12


def test_velocity_in_a_plain_session(spark):
    """A session with another state store is given the one that custom state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    other = spark.newSession()
    other.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    got, _ = velocity_of(other, [[order(1, 1, 0), order(2, 1, 10)]])
    assert {r.order_id: r.orders_in_last_hour for r in got.collect()} == {1: 1, 2: 2}


def test_velocity_drops_rows_behind_the_watermark(spark):
    got, _ = velocity_of(spark, [[order(1, 1, 0)], [order(2, 1, 20_000)], [order(3, 1, 20_100), order(4, 1, 5)]])
    assert {r.order_id: r.orders_in_last_hour for r in got.collect()} == {1: 1, 2: 1, 3: 2}


def test_velocity_numbers_many_orders_of_one_second(spark):
    got, _ = velocity_of(spark, [[order(i, 1, 0) for i in range(50)], [order(100 + i, 1, 0) for i in range(50)]])
    assert got.count() == 100 and {r.orders_in_last_hour for r in got.collect()} == {100}


def test_velocity_customers_share_state(spark):
    """State rows (and calls per micro-batch) grow with the hours, not with the customers."""
    rows = [order(i, i % 400, i) for i in range(800)]
    got, q = velocity_of(spark, [rows])
    assert sorted([(r.order_id, r.customer_id, r.orders_in_last_hour) for r in got.collect()], key=str) == brute_velocity(rows)
    assert state_rows(q) <= 100

# ------------------------------------------------------------------ item scores
ITEM = "order_id long, event_time timestamp, quantity long"
RULES = FraudRules(total_quantity=((7, 3), (5, 2), (3, 1)), max_item_quantity=((4, 3), (3, 2), (2, 1)))
FIGURES = ["order_id", "total_quantity", "max_item_quantity", "item_count", "quantity_score", "item_score", "items_fraud_score"]


def test_item_scores_on_the_stream(spark):
    orders, items = Feed(spark, ORDER), Feed(spark, ITEM)
    out, ck = shared_dir(spark, "out"), shared_dir(spark, "ck")
    o = [[order(1, 1, 0), order(2, 1, 60), order(3, 2, 120), order(None, 2, 120), order(9, 2, None)], [order(4, 2, 300)],
         [order(99, 9, 9000)]]
    i = [[(1, at(5), 3), (1, at(30), 5), (3, at(-20), 1), (None, at(5), 9), (1, None, 9)], [(2, at(200), 2), (1, at(599), 4), (1, at(601), 50)],
         [(98, at(9000), 1)]]
    for a, b in zip(o, i, strict=True):
        orders.land(a)
        items.land(b)
        q = S.to_parquet(ST.item_scores(orders.stream(), items.stream(), RULES), out, ck)
        S.await_all(spark, [q])
    got = spark.read.parquet(out).select(*FIGURES).collect()
    assert sorted(map(tuple, got)) == [(1, 12, 5, 3, 3, 3, 6), (2, 2, 2, 1, 0, 0, 0), (3, 1, 1, 1, 0, 0, 0), (4, None, None, 0, 0, 0, 0)]
    # only the newest order and item are still held: everything before was evicted
    assert state_rows(q) <= 4
    flat = [r for w in o for r in w]
    twin = ST.item_scores(spark.createDataFrame(flat, ORDER), spark.createDataFrame([r for w in i for r in w], ITEM), RULES)
    assert sorted(map(tuple, twin.filter("order_id < 99").select(*FIGURES).collect())) == sorted(map(tuple, got))


# ------------------------------------------------------------------ duplicates
def test_redeliveries_enter_once(spark):
    schema = "order_id long, event_time timestamp, status string"
    feed, out, ck = Feed(spark, schema), shared_dir(spark, "out"), shared_dir(spark, "ck")
    a, b, c = (1, at(0), "a"), (2, at(300), "b"), (3, None, "c")
    waves = [[a, a, b, c], [b, a, (1, at(0), "changed"), (4, at(900), "d")], [b, (4, at(900), "d"), (5, at(5000), "e")],
             [a, (6, at(5100), "f")], [(7, at(99_999), "g")], [(8, at(100_000), "h")]]
    for wave in waves:
        feed.land(wave)
        q = S.to_parquet(ST.without_redeliveries(feed.stream()), out, ck)
        S.await_all(spark, [q])
    got = sorted([(r.order_id, r.status) for r in spark.read.schema(schema).parquet(out).collect()])
    assert got == [(1, "a"), (1, "changed"), (2, "b"), (3, "c"), (4, "d"), (5, "e"), (6, "f"), (7, "g"), (8, "h")]
    assert state_rows(q) <= 2                               # identities behind the watermark are forgotten
    batch = ST.without_redeliveries(spark.createDataFrame([r for w in waves for r in w], schema))
    assert sorted([(r.order_id, r.status) for r in batch.collect()]) == got


# ------------------------------------------------------------------ sessions
GAPS = {"completed": "10 minutes", "pending": "2 minutes"}


def brute_sessions(rows):
    gap = {"completed": 600, "pending": 120}
    out, by = [], {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            by.setdefault(r[1], []).append(r)
    for customer, mine in by.items():
        mine.sort(key=lambda r: r[2])
        groups = []
        for r in mine:
            end = r[2] + dt.timedelta(seconds=gap.get(r[3], 300))
            if groups and r[2] <= groups[-1][1]:
                groups[-1][1] = max(groups[-1][1], end)
                groups[-1][2].append(r)
            else:
                groups.append([r[2], end, [r]])
        out += [(customer, start, end, len(members), sum(m[3] == "completed" for m in members)) for start, end, members in groups]
    return sorted(out)


def test_sessions_merge_and_close(spark):
    feed, out, ck = Feed(spark, ORDER), shared_dir(spark, "out"), shared_dir(spark, "ck")
    waves = [[order(1, 1, 0), order(2, 1, 590, "pending"), order(3, 1, 800, "other"), order(4, 2, 0, "pending")],
             [order(5, 2, 230, "pending"), order(6, 1, 705, "pending"), order(7, None, 0), order(8, 1, None)],
             [order(9, 2, 119, "pending"), order(10, 1, 2000)],       # 9 fills the gap between 4 and 5
             [order(99, 99, 90_000)]]
    for wave in waves:
        feed.land(wave)
        q = S.to_parquet(ST.customer_sessions(feed.stream(), GAPS, "5 minutes", "30 minutes"), out, ck)
        S.await_all(spark, [q])
    columns = ["customer_id", "session_start", "session_end", "order_count", "completed"]
    got = sorted(map(tuple, spark.read.parquet(out).select(*columns).collect()))
    rows = [r for w in waves[:-1] for r in w]
    assert got == brute_sessions(rows)
    assert state_rows(q) <= 1
    twin = ST.customer_sessions(spark.createDataFrame(rows, ORDER), GAPS, "5 minutes")
    assert sorted(map(tuple, twin.select(*columns).collect())) == got


@pytest.mark.parametrize("schema", [ORDER])
def test_empty_streams(spark, schema):
    feed, out, ck = Feed(spark, schema), shared_dir(spark, "out"), shared_dir(spark, "ck")
    feed.land([])
    S.await_all(spark, [S.to_parquet(ST.customer_sessions(feed.stream(), GAPS), out, ck),
                        S.to_upserts(ST.orders_in_last_hour(feed.stream()), out + "2", ck + "2")])
    assert spark.read.parquet(out).count() == 0


def test_quality_rows_per_micro_batch(spark):
    schema = "event_type string, event_timestamp string, order_id long, customer_id long, total_amount double"
    feed, out, quality, ck = Feed(spark, schema), *(shared_dir(spark, n) for n in ("out", "quality", "ck"))
    t = "2024-03-01T10:00:00.000000"
    waves = [[("order", t, 1, 1, 5.0), ("order", "n/a", None, 1, 0.0)], [("order_item", t, 2, None, None), ("order", t, 3, None, None), (None, None, None, None, -1.0)]]
    for wave in waves:
        feed.land(wave)
        S.await_all(spark, [SQ.to_measured(feed.stream(), out, quality, ck)])
    rows = spark.read.parquet(quality).orderBy("batch_id").collect()
    assert [(r.rows, r.orders, r.missing_order_id, r.missing_customer_id, r.missing_amount, r.amount_not_positive, r.bad_time) for r in rows] == [
        (2, 2, 1, 0, 0, 1, 1), (3, 1, 0, 1, 1, 0, 1)]
    assert {r.metric: r.n for r in SQ.totals(spark, quality).collect()}["rows"] == 5 == spark.read.parquet(out).count()
