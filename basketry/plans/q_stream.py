"""Registered streaming queries.

Streams run with ``trigger(availableNow=True)``: they process everything
landed so far and stop, so each registered query is a finite job.  The feed
(plans/landing.py) lands in waves under the shared checkpoint folder, and every
stream runs once per wave from its checkpoint, over several micro-batches with
out-of-order rows.  Rows that the watermark keeps open are delivered by the
update-mode queries; append mode gives the closed windows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import fraud as FR
from basketry.operators import msglog as ML
from basketry.plans import landing as LD
from basketry.plans.context import context
from basketry.functions.rules import tpch_rules
from basketry.plans.oracle import RULES
from basketry.plans.registry import decimals_to_double, register
from basketry.session import shared_dir
from basketry.sinks import layers as LY
from basketry.sources.tables import read_table
from basketry.streaming import orders_stream as S

ENRICH_COLS = ["order_id", "customer_id", "status", "total_amount", "event_time", "order_date_parsed", "order_year",
               "order_month", "is_completed", "is_valid_order"]
FRAUD = tpch_rules().stream_fraud
PARSED, ENRICHED = LD.SQL_PARSED, LD.SQL_ENRICHED


def batch_orders(spark, path):
    """The landed order events read as a batch (the streams' batch twin)."""
    return S.enrich_stream(S.route_events(spark.read.schema(S.EVENT_SCHEMA).json(path), "order"))


def stream_orders(spark, path):
    return S.enrich_stream(S.route_events(S.read_event_files(spark, path), "order"))


# ------------------------------------------------------------------ A7
@register("stream_file_source", LD.SQL_ALL)
def q_stream_file_source(spark, sf_dir):
    out, ck = shared_dir(spark, "copied"), shared_dir(spark, "ck")
    LD.run_waves(spark, sf_dir, lambda path: [S.to_parquet(S.read_event_files(spark, path), out, ck)])
    return spark.read.schema(S.EVENT_SCHEMA).parquet(out)


# ------------------------------------------------------------------ A8
KAFKA_SQL = """
SELECT CAST(user_id AS VARCHAR) AS message_key, event_type AS message_topic, CAST(user_id % 3 AS INT) AS message_partition,
  event_id AS message_offset, CAST(ts AS TIMESTAMP) AS message_timestamp,
  CASE WHEN event_id % 97 <> 5 THEN event_id END AS order_id, CASE WHEN event_id % 97 <> 5 THEN user_id END AS customer_id,
  CASE WHEN event_id % 97 <> 5 THEN value END AS total_amount, CASE WHEN event_id % 97 <> 5 THEN event_type END AS event_type,
  CASE WHEN event_id % 97 <> 5 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 97 = 5 THEN '{broken ' || event_id END AS corrupt FROM events"""


@register("kafka_decode", KAFKA_SQL,
          note="every 97th message is broken JSON and keeps its text")
def q_kafka_decode(spark, sf_dir):
    log = context(spark, sf_dir).message_log
    value = F.when(F.col("offset") % 97 == 5, F.concat(F.lit("{broken "), F.col("offset").cast("string"))).otherwise(F.col("value"))
    raw = log.select("topic", "partition", "offset", "timestamp", F.col("key").cast("binary").alias("key"),
                     value.cast("binary").alias("value"))
    return S.decode_kafka(raw, ML.ORDER_PAYLOAD).withColumnRenamed(S.CORRUPT, "corrupt")


# ------------------------------------------------------------------ K1 / K3 / K4 batch twins
@register("stream_enrich", ENRICHED)
def q_stream_enrich(spark, sf_dir):
    return decimals_to_double(batch_orders(spark, LD.landed(spark, sf_dir)).select(*ENRICH_COLS))


_WIN_AGG = ("count(*) AS order_count, CAST(CAST(sum(a) AS DECIMAL(38,2)) AS DOUBLE) AS total_revenue, "
            "CAST(CAST(sum(a) / count(a) AS DECIMAL(38,6)) AS DOUBLE) AS avg_order_value, count(DISTINCT customer_id) AS unique_customers")
_COMPLETED = f"(SELECT t, customer_id, a FROM {PARSED} WHERE status = 'completed' AND valid = 1 AND t IS NOT NULL)"


def _tumbling(having: str = "") -> str:
    return f"""
SELECT time_bucket(INTERVAL 1 MINUTE, t) AS window_start, time_bucket(INTERVAL 1 MINUTE, t) + INTERVAL 1 MINUTE AS window_end,
  'completed' AS status, {_WIN_AGG}
FROM {_COMPLETED} GROUP BY 1, 2 {having}"""


def _sliding(window: int, slide: int, closed: bool) -> str:
    """Windows of ``window`` minutes every ``slide`` minutes, aligned to the epoch."""
    having = (f"HAVING ws + INTERVAL {window} MINUTE <= (SELECT max(t) FROM {_COMPLETED}) - INTERVAL 10 MINUTE" if closed else "")
    last = f"CAST(floor(epoch(t) / {60 * slide}) AS BIGINT)"
    first = f"CAST(floor((epoch(t) - {60 * window}) / {60 * slide}) AS BIGINT) + 1"
    return f"""
SELECT ws AS window_start, ws + INTERVAL {window} MINUTE AS window_end, 'completed' AS status, {_WIN_AGG}
FROM (SELECT make_timestamp(n * {60 * slide} * 1000000) AS ws, customer_id, a
      FROM (SELECT unnest(range({first}, {last} + 1)) AS n, customer_id, a FROM {_COMPLETED}))
GROUP BY 1, 2 {having}"""


TUMBLING_SQL = _tumbling()


@register("revenue_by_window", TUMBLING_SQL)
def q_revenue_by_window(spark, sf_dir):
    return S.windowed_revenue(batch_orders(spark, LD.landed(spark, sf_dir)), "1 minute", exact_customers=True)


@register("revenue_sliding", _sliding(10, 5, closed=False))
def q_revenue_sliding(spark, sf_dir):
    return S.windowed_revenue(batch_orders(spark, LD.landed(spark, sf_dir)), "10 minutes", "5 minutes",
                              exact_customers=True)


# ------------------------------------------------------------------ K11
@register("event_type_route", LD.SQL_ITEMS)
def q_event_type_route(spark, sf_dir):
    return S.route_events(spark.read.schema(S.EVENT_SCHEMA).json(LD.landed(spark, sf_dir)), "order_item")


@register("event_type_route_customers", f"SELECT * FROM ({LD.SQL_CUSTOMERS}) WHERE event_type = 'customer_update'")
def q_event_type_route_customers(spark, sf_dir):
    return S.route_events(spark.read.schema(S.EVENT_SCHEMA).json(LD.landed(spark, sf_dir)), "customer_update")


@register("event_type_route_orders", LD.SQL_ORDERS)
def q_event_type_route_orders(spark, sf_dir):
    return S.route_events(spark.read.schema(S.EVENT_SCHEMA).json(LD.landed(spark, sf_dir)), "order")


# ------------------------------------------------------------------ B9 / K6 / K3 streams
def bronze(spark, sf_dir) -> str:
    out, ck = shared_dir(spark, "bronze"), shared_dir(spark, "ck")
    LD.run_waves(spark, sf_dir, lambda path: [S.to_bronze(S.read_event_files(spark, path), out, ck)])
    return out


@register("stream_bronze", LD.SQL_ALL)
def q_stream_bronze(spark, sf_dir):
    return spark.read.schema(S.EVENT_SCHEMA).parquet(bronze(spark, sf_dir))


_SAMT = " ".join(f"WHEN a > {t} THEN {p}" for t, p in RULES.stream_fraud.amount)
FRAUD_SQL = f"""
SELECT order_id, customer_id, order_timestamp, CAST(a AS DOUBLE) AS total_amount, CAST(s AS BIGINT) AS fraud_score, status FROM (
  SELECT order_id, customer_id, t AS order_timestamp, status, a,
    CASE {_SAMT} ELSE 0 END + CASE WHEN status IN ('cancelled', 'refunded') THEN 1 ELSE 0 END AS s
  FROM {PARSED} WHERE valid = 1) WHERE s >= {RULES.stream_fraud.flag_at}"""


@register("stream_fraud", FRAUD_SQL)
def q_stream_fraud(spark, sf_dir):
    out, ck = shared_dir(spark, "fraud"), shared_dir(spark, "ck")
    LD.run_waves(spark, sf_dir, lambda path: [
        S.to_parquet(FR.stream_fraud(stream_orders(spark, path), FRAUD), out, ck)])
    return decimals_to_double(spark.read.parquet(out))


_CLOSED = f"HAVING time_bucket(INTERVAL 1 MINUTE, t) + INTERVAL 1 MINUTE <= (SELECT max(t) FROM {_COMPLETED}) - INTERVAL 10 MINUTE"


@register("stream_revenue_by_window", _tumbling(_CLOSED),
          note="append mode emits windows closed by the 10-minute watermark")
def q_stream_revenue(spark, sf_dir):
    out, ck = shared_dir(spark, "revenue"), shared_dir(spark, "ck")
    LD.run_waves(spark, sf_dir, lambda path: [
        S.to_parquet(S.windowed_revenue(stream_orders(spark, path), "1 minute"), out, ck)])
    return spark.read.parquet(out)


@register("stream_revenue_update", _tumbling(), note="update mode: open windows are served too")
def q_stream_revenue_update(spark, sf_dir):
    """K7: every window as of the last wave, from the upsert table."""
    out, ck = shared_dir(spark, "revenue_parts"), shared_dir(spark, "ck")
    LD.run_waves(spark, sf_dir, lambda path: [S.to_upserts(S.revenue_parts(stream_orders(spark, path)), out, ck)])
    return S.revenue_of_parts(S.current_rows(spark, out, ["window_start", "window_end", "status", "customer_id"]))


def _sliding_stream(spark, sf_dir, window, slide):
    out, ck = shared_dir(spark, "sliding"), shared_dir(spark, "ck")
    LD.run_waves(spark, sf_dir, lambda path: [
        S.to_parquet(S.windowed_revenue(stream_orders(spark, path), window, slide), out, ck)])
    return spark.read.parquet(out)


@register("stream_revenue_sliding", _sliding(10, 5, closed=True),
          note="append mode emits sliding windows closed by the 10-minute watermark")
def q_stream_revenue_sliding(spark, sf_dir):
    """K4 on a stream: 10-minute windows sliding by 5 minutes, exact distinct customers."""
    return _sliding_stream(spark, sf_dir, "10 minutes", "5 minutes")


@register("stream_revenue_sliding_uneven", _sliding(10, 4, closed=True), note="the slide does not divide the window")
def q_stream_revenue_sliding_uneven(spark, sf_dir):
    """K4 with a 4-minute slide: buckets of 2 minutes, which no window edge cuts."""
    return _sliding_stream(spark, sf_dir, "10 minutes", "4 minutes")


# ------------------------------------------------------------------ K5 late data
_MID = "(SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) FROM events)"
_WAVE1 = f"(SELECT * FROM {_COMPLETED} WHERE t >= {_MID})"


@register("late_data_append", f"""
SELECT time_bucket(INTERVAL 1 MINUTE, t) AS window_start, time_bucket(INTERVAL 1 MINUTE, t) + INTERVAL 1 MINUTE AS window_end,
  'completed' AS status, {_WIN_AGG}
FROM {_WAVE1} GROUP BY 1, 2
HAVING time_bucket(INTERVAL 1 MINUTE, t) + INTERVAL 1 MINUTE <= (SELECT max(t) FROM {_WAVE1}) - INTERVAL 10 MINUTE""",
          note="the older second wave arrives behind the watermark and is dropped")
def q_late_data(spark, sf_dir):
    """K5: land the newer half of the events (split at the time midpoint), run;
    land the older half, run again from the same checkpoint.  The old rows are
    behind the watermark: append mode drops them instead of reopening closed
    windows, so the output holds the first wave's closed windows only."""
    ev = read_table(spark, sf_dir, "events")
    mid = ev.select(F.timestamp_micros(F.expr("(min(unix_micros(CAST(ts AS TIMESTAMP))) + "
                                              "max(unix_micros(CAST(ts AS TIMESTAMP)))) div 2"))).scalar()
    landing, out, ck = shared_dir(spark, "late_landing"), shared_dir(spark, "late_out"), shared_dir(spark, "ck")
    t = F.col("ts").cast("timestamp")
    for i, wave in enumerate([ev.filter(t >= mid), ev.filter(t < mid)]):
        S.land_events(LD.landing_events(wave), f"{landing}/wave={i}")
        S.await_all(spark, [S.to_parquet(S.windowed_revenue(stream_orders(spark, f"{landing}/*"), "1 minute"), out, ck)])
    return spark.read.parquet(out)


# ------------------------------------------------------------------ B10 / A10 / K10 / K9 / A9
def silver(spark, sf_dir) -> str:
    root = shared_dir(spark, "silver")
    LD.run_waves(spark, sf_dir, lambda path: [
        S.to_silver(stream_orders(spark, path), f"{root}/orders", f"{root}/orders_invalid_dates", f"{root}/_ck")])
    return root


@register("stream_silver_route", ENRICHED)
def q_stream_silver(spark, sf_dir):
    root = silver(spark, sf_dir)
    return decimals_to_double(LY.silver_union(spark, f"{root}/orders", f"{root}/orders_invalid_dates").select(*ENRICH_COLS))


@register("stream_silver_invalid", f"SELECT * FROM ({ENRICHED}) WHERE order_year IS NULL",
          note="the invalid-date route only")
def q_stream_silver_invalid(spark, sf_dir):
    return decimals_to_double(spark.read.parquet(f"{silver(spark, sf_dir)}/orders_invalid_dates").select(*ENRICH_COLS))


def medallion(spark, sf_dir) -> dict[str, str]:
    root, paths = shared_dir(spark, "medallion"), {}

    def start(landing):
        paths.update(S.run_medallion(spark, landing, root, fraud_rules=FRAUD))
        return []
    LD.run_waves(spark, sf_dir, start)
    return paths


@register("stream_medallion", _tumbling(_CLOSED), note="end-to-end: Bronze ingest, Silver route, windowed revenue, fraud")
def q_stream_medallion(spark, sf_dir):
    return spark.read.parquet(medallion(spark, sf_dir)["revenue_by_window"])


@register("stream_medallion_bronze", LD.SQL_ALL)
def q_stream_medallion_bronze(spark, sf_dir):
    return spark.read.schema(S.EVENT_SCHEMA).parquet(medallion(spark, sf_dir)["bronze"])


@register("stream_medallion_silver", ENRICHED)
def q_stream_medallion_silver(spark, sf_dir):
    paths = medallion(spark, sf_dir)
    return decimals_to_double(LY.silver_union(spark, paths["silver"], paths["silver_invalid_dates"]).select(*ENRICH_COLS))


@register("stream_medallion_fraud", FRAUD_SQL)
def q_stream_medallion_fraud(spark, sf_dir):
    return decimals_to_double(spark.read.parquet(medallion(spark, sf_dir)["fraud"]))


_COUNTED = f"(SELECT order_id, customer_id, t, CAST(floor(epoch(t)) AS BIGINT) AS s FROM {PARSED} WHERE t IS NOT NULL AND customer_id IS NOT NULL)"
VELOCITY_SQL = f"""
SELECT e.order_id, e.customer_id, e.t AS event_time,
  (SELECT count(*) FROM {_COUNTED} x WHERE x.customer_id = e.customer_id AND x.s BETWEEN e.s - 3600 AND e.s) AS orders_in_last_hour
FROM {_COUNTED} e"""


@register("stream_velocity_counters", VELOCITY_SQL, note="native counters on the stream, hours summed in a batch job")
def q_stream_velocity_counters(spark, sf_dir):
    out, ck = shared_dir(spark, "per_second"), shared_dir(spark, "ck")
    path = LD.run_waves(spark, sf_dir, lambda path: [S.to_upserts(S.orders_per_second(stream_orders(spark, path)), out, ck)])
    return S.velocity(batch_orders(spark, path), S.current_rows(spark, out, ["customer_id", "second"]))


@register("latest_bronze", f"""
SELECT event_type, event_timestamp, order_id, customer_id, status FROM ({LD.SQL_ORDERS}) JOIN
  (SELECT order_id, t FROM {PARSED}) USING (order_id)
ORDER BY t DESC NULLS LAST, order_id DESC LIMIT 100""")
def q_latest_bronze(spark, sf_dir):
    """Newest order events of Bronze by event time."""
    rows = S.route_events(spark.read.schema(S.EVENT_SCHEMA).parquet(bronze(spark, sf_dir)), "order")
    rows = rows.withColumn("event_time", S.parse_event_time(F.col("event_timestamp"))).filter("order_id IS NOT NULL")
    return LY.latest_rows(rows, 100, "event_time", "order_id").select(
        "event_type", "event_timestamp", "order_id", "customer_id", "status")


@register("latest_silver_union", f"""
SELECT * FROM ({ENRICHED}) ORDER BY event_time DESC NULLS LAST, order_id DESC NULLS LAST, customer_id DESC NULLS LAST LIMIT 1000""",
          note="one landing, so one processing time; newest by event time")
def q_latest_silver(spark, sf_dir):
    """A10: newest Silver rows across the valid and invalid-date outputs.

    Ordered by processing time, then event time; the processing time itself
    is not returned (it is the run's clock).  The feed lands at once here, so
    all rows have one processing time and SQL can say which are newest.
    """
    path, root = LD.landed(spark, sf_dir), shared_dir(spark, "silver")
    S.await_all(spark, [S.to_silver(stream_orders(spark, path), f"{root}/orders", f"{root}/orders_invalid_dates", f"{root}/_ck")])
    both = LY.silver_union(spark, f"{root}/orders", f"{root}/orders_invalid_dates")
    return LY.latest_rows(both, 1000, "processing_timestamp", "event_time", "order_id", "customer_id").select(*ENRICH_COLS)
