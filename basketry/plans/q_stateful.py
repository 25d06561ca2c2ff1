"""Registered stateful streams (K9, K12, L3 on the stream) and routed input.

The feed of plans/landing.py arrives in waves; where an output waits for the
watermark, a closing wave a month later lets everything out, so SQL over
the whole table says the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions.rules import FraudRules
from basketry.operators import fraud as FR
from basketry.plans import landing as LD
from basketry.plans.context import context
from basketry.plans.oracle import with_base
from basketry.plans.q_stream import FRAUD, FRAUD_SQL, VELOCITY_SQL, stream_orders
from basketry.plans.registry import decimals_to_double, register
from basketry.session import shared_dir
from basketry.sinks import layers as LY
from basketry.sources import checked as CK
from basketry.streaming import orders_stream as S
from basketry.streaming import quality as SQ
from basketry.streaming import stateful as ST

# ------------------------------------------------------------------ K9
def counted(spark, sf_dir):
    out, ck = shared_dir(spark, "counted"), shared_dir(spark, "ck")
    LD.run_waves(spark, sf_dir, lambda path: [S.to_upserts(ST.orders_in_last_hour(stream_orders(spark, path)), out, ck)])
    return ST.counted_orders(S.current_rows(spark, out, ST.COUNTED_KEYS))


@register("stream_velocity", VELOCITY_SQL, note="custom state, every order leaves the stream with its count")
def q_stream_velocity(spark, sf_dir):
    return counted(spark, sf_dir).select("order_id", "customer_id", "event_time", "orders_in_last_hour")


@register("stream_fraud_velocity", f"SELECT f.*, v.orders_in_last_hour FROM ({FRAUD_SQL}) f LEFT JOIN ({VELOCITY_SQL}) v USING (order_id)",
          note="K6 with the stateful count")
def q_stream_fraud_velocity(spark, sf_dir):
    return FR.stream_fraud(counted(spark, sf_dir), FRAUD, "orders_in_last_hour")


# ------------------------------------------------------------------ L3 / E4
#: The feed's items have up to five pieces, two items an order.
ITEM_RULES = FraudRules(total_quantity=((7, 3), (5, 2), (3, 1)), max_item_quantity=((4, 3), (3, 2), (2, 1)))


def stream_items(spark, path):
    items = S.route_events(S.read_event_files(spark, path), "order_item")
    return items.select("order_id", S.parse_event_time(F.col("event_timestamp")).alias("event_time"), "quantity")


@register("stream_fraud_items", f"""
WITH i AS (SELECT order_id, sum(quantity) AS total_quantity, max(quantity) AS max_item_quantity, count(*) AS item_count
  FROM ({LD.SQL_ITEMS}) WHERE order_id IS NOT NULL AND event_timestamp <> 'n/a' GROUP BY order_id
), o AS (
  SELECT order_id, customer_id, t AS event_time, status, CAST(a AS DOUBLE) AS total_amount, CAST(total_quantity AS BIGINT) AS total_quantity,
    CAST(max_item_quantity AS BIGINT) AS max_item_quantity, CAST(coalesce(item_count, 0) AS BIGINT) AS item_count,
    CASE WHEN total_quantity > 7 THEN 3 WHEN total_quantity > 5 THEN 2 WHEN total_quantity > 3 THEN 1 ELSE 0 END AS quantity_score,
    CASE WHEN max_item_quantity > 4 THEN 3 WHEN max_item_quantity > 3 THEN 2 WHEN max_item_quantity > 2 THEN 1 ELSE 0 END AS item_score
  FROM {LD.SQL_PARSED} LEFT JOIN i USING (order_id) WHERE order_id IS NOT NULL AND t IS NOT NULL
) SELECT *, CAST(quantity_score + item_score AS BIGINT) AS items_fraud_score FROM o""",
          note="stream-stream left outer interval join, closed by a later wave")
def q_stream_fraud_items(spark, sf_dir):
    out, ck = shared_dir(spark, "item_scores"), shared_dir(spark, "ck")
    LD.run_waves(spark, sf_dir, lambda path: [
        S.to_parquet(ST.item_scores(stream_orders(spark, path), stream_items(spark, path), ITEM_RULES), out, ck)], closing=True)
    return spark.read.parquet(out)


# ------------------------------------------------------------------ K12
@register("stream_deduplicated", LD.SQL_ALL, note="every eleventh event is delivered up to three times")
def q_stream_deduplicated(spark, sf_dir):
    out, ck = shared_dir(spark, "once"), shared_dir(spark, "ck")

    def start(path):
        events = S.read_event_files(spark, path)
        timed = events.withColumn("event_time", S.parse_event_time(F.col("event_timestamp")))
        return [S.to_bronze(ST.without_redeliveries(timed, keys=events.columns).drop("event_time"), out, ck)]
    LD.run_waves(spark, sf_dir, start, again=True)
    return spark.read.schema(S.EVENT_SCHEMA).parquet(out)


SESSION_GAPS, SESSION_GAP = {"completed": "12 hours", "pending": "2 hours"}, "5 hours"


@register("stream_sessions", f"""
WITH e AS (
  SELECT event_id, customer_id, t, status, a,
    t + CASE status WHEN 'completed' THEN INTERVAL 12 HOUR WHEN 'pending' THEN INTERVAL 2 HOUR ELSE INTERVAL 5 HOUR END AS until
  FROM {LD.SQL_PARSED} WHERE t IS NOT NULL AND customer_id IS NOT NULL
), m AS (
  SELECT *, max(until) OVER (PARTITION BY customer_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_until FROM e
), n AS (
  SELECT *, sum(CASE WHEN open_until IS NULL OR t > open_until THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY t, event_id) AS session FROM m
)
SELECT customer_id, min(t) AS session_start, max(until) AS session_end, count(*) AS order_count, count_if(status = 'completed') AS completed,
  min(t) AS first_order, max(t) AS last_order, CAST(sum(a) AS DOUBLE) AS total_amount FROM n GROUP BY customer_id, session""",
          note="gaps by status, closed by a later wave")
def q_stream_sessions(spark, sf_dir):
    out, ck = shared_dir(spark, "sessions"), shared_dir(spark, "ck")
    LD.run_waves(spark, sf_dir, lambda path: [
        S.to_parquet(ST.customer_sessions(stream_orders(spark, path), SESSION_GAPS, SESSION_GAP), out, ck)], closing=True)
    return spark.read.parquet(out)


# ------------------------------------------------------------------ A7 / K11: routes
TYPES = list(S.EVENT_COLUMNS)
_ODD = "event_type = 'order' AND order_id IS NOT NULL AND order_id % 61 IN (3, 7, 11, 13, 17)"
_ROUTES = f"""
SELECT coalesce(CASE WHEN {_ODD} THEN CASE order_id % 61 WHEN 11 THEN 'other' WHEN 17 THEN 'other' ELSE 'quarantine' END END, event_type) AS route,
  CASE WHEN {_ODD} THEN CASE order_id % 61 WHEN 3 THEN 'broken record' WHEN 7 THEN 'value of another type' WHEN 11 THEN 'unknown event type'
    WHEN 13 THEN 'surplus fields' WHEN 17 THEN 'no event type' END END AS cause,
  CASE WHEN {_ODD} THEN CASE order_id % 61 WHEN 3 THEN '{{broken ' || order_id WHEN 7 THEN '{{"event_type":"order","order_id":"x' || order_id || '"}}'
    WHEN 11 THEN '{{"event_type":"refund","order_id":' || order_id || '}}'
    WHEN 13 THEN '{{"event_type":"order","order_id":' || order_id || ',"colour":"red"}}' WHEN 17 THEN '{{"order_id":' || order_id || '}}' END END AS record_text,
  CASE WHEN NOT coalesce({_ODD}, false) THEN order_id END AS order_id, CASE WHEN NOT coalesce({_ODD}, false) THEN customer_id END AS customer_id,
  CASE WHEN NOT coalesce({_ODD}, false) THEN item_id END AS item_id
FROM ({LD.SQL_ALL})"""


def routes(spark, sf_dir) -> str:
    out, ck = shared_dir(spark, "routes"), shared_dir(spark, "ck")
    LD.run_line_waves(spark, sf_dir, lambda path: [
        CK.to_routes(CK.read_event_lines(spark, path, S.EVENT_SCHEMA, TYPES), out, ck)])
    return out


@register("stream_routes", _ROUTES, note="every line of the feed has one route; rejected ones keep their text")
def q_stream_routes(spark, sf_dir):
    path, columns = routes(spark, sf_dir), ["order_id", "customer_id", "item_id"]
    out = None
    for route in [*TYPES, CK.OTHER, CK.QUARANTINE]:
        rows, kept = CK.read_route(spark, path, S.EVENT_SCHEMA, route), route in TYPES
        rows = rows.select(F.lit(route).alias("route"), *[(F.lit(None).cast("string") if kept else F.col(c)).alias(c) for c in (CK.CAUSE, CK.TEXT)],
                           *[(F.col(c) if kept else F.lit(None).cast("long")).alias(c) for c in columns])
        out = rows if out is None else out.unionByName(rows)
    return out


@register("stream_routes_orders", f"SELECT * FROM ({LD.SQL_ORDERS}) WHERE order_id IS NULL OR order_id % 61 NOT IN (3, 7, 11, 13, 17)",
          note="the sound orders, all columns")
def q_stream_routes_orders(spark, sf_dir):
    rows = CK.read_route(spark, routes(spark, sf_dir), S.EVENT_SCHEMA, "order")
    return rows.select(*S.EVENT_COLUMNS["order"])


# ------------------------------------------------------------------ P1 on the stream
@register("stream_quality", f"""
WITH e AS (SELECT *, event_type = 'order' AS o FROM ({LD.SQL_ALL}))
SELECT 'rows' AS metric, count(*) AS n FROM e UNION ALL SELECT 'orders', count_if(o) FROM e
UNION ALL SELECT 'missing_order_id', count_if(o AND order_id IS NULL) FROM e UNION ALL SELECT 'missing_customer_id', count_if(o AND customer_id IS NULL) FROM e
UNION ALL SELECT 'missing_amount', count_if(o AND total_amount IS NULL) FROM e UNION ALL SELECT 'amount_not_positive', count_if(o AND total_amount <= 0) FROM e
UNION ALL SELECT 'bad_time', count_if(event_timestamp = 'n/a') FROM e""",
          note="measured while the micro-batches are written, added up over them")
def q_stream_quality(spark, sf_dir):
    out, quality, ck = (shared_dir(spark, n) for n in ("measured", "stream_quality", "ck"))
    LD.run_waves(spark, sf_dir, lambda path: [SQ.to_measured(S.read_event_files(spark, path), out, quality, ck)])
    return SQ.totals(spark, quality)


# ------------------------------------------------------------------ A1 - A3: files
CSV = {**LY._CSV, "header": "false"}


def csv_lines(df, key: str):
    """CSV lines of the rows; some have a field too many or too few, or a text where a number belongs."""
    row = F.to_csv(F.struct(*df.columns), {k: v for k, v in CSV.items() if k != "header"})
    text, r = F.col(key).cast("string"), F.col(key) % 61
    line = (F.when(r == 3, F.concat(F.lit("x"), text, F.lit("," * (len(df.columns) - 1))))
            .when(r == 7, F.concat(text, F.lit("," * (len(df.columns) - 1)), F.lit(",surplus"))).when(r == 11, F.concat(text, F.lit(",short"))))
    return df.select(F.coalesce(line, row).alias("value"))


def _csv_rejects(table: str, key: str, width: int) -> str:
    commas = "," * (width - 1)
    return with_base(f"""
SELECT CASE {key} % 61 WHEN 3 THEN 'x' || {key} || '{commas}' WHEN 7 THEN {key} || '{commas},surplus' ELSE {key} || ',short' END AS record_text,
  CASE {key} % 61 WHEN 3 THEN 'value of another type' WHEN 7 THEN 'surplus fields' ELSE 'missing fields' END AS cause
FROM {table} WHERE {key} % 61 IN (3, 7, 11)""")


def landed_csv(spark, df, schema, key):
    path = shared_dir(spark, "csv")
    csv_lines(df, key).write.text(path)
    return CK.land_csv(spark, path, schema, CSV, shared_dir(spark, "landed"))


@register("scan_csv_orders_rejects", _csv_rejects("raw_orders", "order_id", 7))
def q_csv_orders_rejects(spark, sf_dir):
    return CK.rejected(landed_csv(spark, context(spark, sf_dir).raw_orders, LY.ORDERS_SCHEMA, "order_id"))


@register("scan_csv_orders_sound", with_base("""
SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount) FROM raw_orders WHERE order_id % 61 NOT IN (3, 7, 11)"""))
def q_csv_orders_sound(spark, sf_dir):
    return decimals_to_double(CK.sound(landed_csv(spark, context(spark, sf_dir).raw_orders, LY.ORDERS_SCHEMA, "order_id")))


@register("scan_csv_items_rejects", _csv_rejects("raw_items", "item_id", 8))
def q_csv_items_rejects(spark, sf_dir):
    return CK.rejected(landed_csv(spark, context(spark, sf_dir).raw_items, LY.ITEMS_SCHEMA, "item_id"))


def landed_customers(spark, sf_dir):
    rows = context(spark, sf_dir).raw_customers
    text, r = F.col("customer_id").cast("string"), F.col("customer_id") % 61
    line = (F.when(r == 3, F.concat(F.lit("{broken "), text)).when(r == 7, F.concat(F.lit('{"customer_id":'), text, F.lit(',"age":"old"}')))
            .when(r == 11, F.concat(F.lit('{"customer_id":'), text, F.lit(',"colour":"red"}'))))
    path = shared_dir(spark, "json")
    rows.select(F.coalesce(line, F.to_json(F.struct(*rows.columns))).alias("value")).write.text(path)
    return CK.land_json(spark, path, LY.CUSTOMERS_SCHEMA, shared_dir(spark, "landed"))


@register("scan_json_customers_rejects", with_base("""
SELECT CASE customer_id % 61 WHEN 3 THEN '{broken ' || customer_id WHEN 7 THEN '{"customer_id":' || customer_id || ',"age":"old"}'
    ELSE '{"customer_id":' || customer_id || ',"colour":"red"}' END AS record_text,
  CASE customer_id % 61 WHEN 3 THEN 'broken record' WHEN 7 THEN 'value of another type' ELSE 'surplus fields' END AS cause
FROM raw_customers WHERE customer_id % 61 IN (3, 7, 11)"""))
def q_json_rejects(spark, sf_dir):
    return CK.rejected(landed_customers(spark, sf_dir))


@register("scan_json_customers_sound", with_base(
    "SELECT * FROM raw_customers WHERE customer_id IS NULL OR customer_id % 61 NOT IN (3, 7, 11)"))
def q_json_sound(spark, sf_dir):
    return CK.sound(landed_customers(spark, sf_dir))
