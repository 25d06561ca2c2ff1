"""Registered queries of compaction, sketches, the as-of dimension and the offset source."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import asof as AS
from basketry.operators import msglog as ML
from basketry.operators import sketches as SK
from basketry.plans import landing as LD
from basketry.plans.context import context
from basketry.plans.oracle import with_base
from basketry.plans.q_stream import ENRICH_COLS, ENRICHED, KAFKA_SQL, TUMBLING_SQL, batch_orders, stream_orders
from basketry.plans.registry import decimals_to_double, register
from basketry.session import shared_dir
from basketry.sinks import compaction as CP
from basketry.sources import message_log as LOG
from basketry.streaming import orders_stream as S

# ------------------------------------------------------------------ K7 / B10: compaction
PARTS = ["window_start", "window_end", "status", "customer_id"]


@register("stream_revenue_compacted", TUMBLING_SQL, note="the upsert table is folded after every wave but the last")
def q_revenue_compacted(spark, sf_dir):
    out, ck = shared_dir(spark, "revenue_parts"), shared_dir(spark, "ck")

    def start(path):
        CP.compact(spark, out, PARTS)
        return [S.to_upserts(S.revenue_parts(stream_orders(spark, path)), out, ck)]
    LD.run_waves(spark, sf_dir, start)
    return S.revenue_of_parts(CP.current_rows(spark, out, PARTS))


@register("stream_silver_compacted", ENRICHED, note="micro-batches folded into segments, a few files per month")
def q_silver_compacted(spark, sf_dir):
    root = shared_dir(spark, "silver")
    routes = {f"{root}/orders": ["order_year", "order_month"], f"{root}/orders_invalid_dates": []}

    def start(path):
        for route, partition in routes.items():
            CP.compact_appends(spark, route, partition)
        return [S.to_silver(stream_orders(spark, path), *routes, f"{root}/_ck")]
    LD.run_waves(spark, sf_dir, start)
    valid, invalid = (CP.appended_rows(spark, route) for route in routes)
    return decimals_to_double(valid.unionByName(invalid, allowMissingColumns=True).select(*ENRICH_COLS))


# ------------------------------------------------------------------ sketches
def order_sketches(spark, sf_dir):
    """Valid orders and their sketched rows by day and status."""
    orders = context(spark, sf_dir).orders_clean.filter(F.col("is_valid_order") == 1).select(
        "customer_id", "order_date_cleaned", "order_year", "order_month", "status_cleaned", "total_amount_cleaned")
    return orders, SK.sketched(orders, "order_date_cleaned", "order_year", "order_month", "status_cleaned", amount="total_amount_cleaned")


@register("sketch_customers_monthly", with_base("""
SELECT order_year, order_month, count(*) AS row_count, CAST(CAST(sum(total_amount_cleaned) AS DECIMAL(38,2)) AS DOUBLE) AS revenue,
  count(DISTINCT customer_id) AS customers, true AS within_bound
FROM orders_clean WHERE is_valid_order = 1 GROUP BY order_year, order_month"""),
          note="months rolled up from daily sketches; the estimate is held against the exact count")
def q_sketch_customers(spark, sf_dir):
    orders, parts = order_sketches(spark, sf_dir)
    month = ["order_year", "order_month"]
    guess = SK.figures(SK.rolled_up(parts, *month)).withColumnRenamed("customers", "guess")
    exact = orders.groupBy(*month).agg(F.countDistinct("customer_id").alias("customers"))
    return guess.join(exact, month).select(*month, "row_count", "revenue", "customers", (
        F.abs(F.col("guess") - F.col("customers")) <= F.lit(SK.hll_error()) * F.col("customers")).alias("within_bound"))


@register("sketch_amount_quantiles", with_base("""
SELECT status_cleaned, q AS quantile, count(*) AS row_count, true AS within_bound
FROM orders_clean, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) AS quantiles(q)
WHERE is_valid_order = 1 GROUP BY status_cleaned, q"""),
          note="quartiles per status merged from daily sketches; their ranks are held against the exact ones")
def q_sketch_quantiles(spark, sf_dir):
    orders, parts = order_sketches(spark, sf_dir)
    box = SK.figures(SK.rolled_up(parts, "status_cleaned")).select("status_cleaned", F.posexplode("amount_quantiles").alias("i", "x"))
    box = box.select("status_cleaned", F.element_at(F.array(*[F.lit(q) for q in SK.QUARTILES]), F.col("i") + 1).alias("quantile"), "x")
    ranks = (orders.join(box, "status_cleaned").groupBy("status_cleaned", "quantile")
             .agg(F.count(F.lit(1)).cast("long").alias("row_count"), F.avg((F.col("total_amount_cleaned") < F.col("x")).cast("double")).alias("low"),
                  F.avg((F.col("total_amount_cleaned") <= F.col("x")).cast("double")).alias("high")))
    # a sketch of n values cannot be closer than one of them
    slack = F.lit(SK.kll_error()) + 1 / F.col("row_count")
    return ranks.select("status_cleaned", "quantile", "row_count", (
        (F.col("low") - slack <= F.col("quantile")) & (F.col("quantile") <= F.col("high") + slack)).alias("within_bound"))


@register("stream_sketches", f"""
SELECT status, count(*) AS row_count, CAST(CAST(sum(a) AS DECIMAL(38,2)) AS DOUBLE) AS revenue, count(DISTINCT customer_id) AS customers,
  true AS within_bound FROM {LD.SQL_PARSED} WHERE valid = 1 AND t IS NOT NULL GROUP BY status""",
          note="sketches as stream state, one row per day and status; statuses are merged from them")
def q_stream_sketches(spark, sf_dir):
    out, ck = shared_dir(spark, "sketches"), shared_dir(spark, "ck")

    def start(path):
        orders = stream_orders(spark, path).filter((F.col("is_valid_order") == 1) | (F.col("order_id") == -1))
        days = SK.sketched(orders.withWatermark("event_time", "10 minutes"), F.window("event_time", "1 day").alias("w"), "status")
        return [S.to_parquet(days, out, ck)]
    landed = LD.run_waves(spark, sf_dir, start, closing=True)
    guess = SK.figures(SK.rolled_up(spark.read.parquet(out), "status")).withColumnRenamed("customers", "guess")
    orders = batch_orders(spark, landed).filter((F.col("is_valid_order") == 1) & F.col("event_time").isNotNull())
    exact = orders.groupBy("status").agg(F.countDistinct("customer_id").alias("customers"))
    return guess.join(exact, "status").select("status", "row_count", "revenue", "customers", (
        F.abs(F.col("guess") - F.col("customers")) <= F.lit(SK.hll_error()) * F.col("customers")).alias("within_bound"))


# ------------------------------------------------------------------ E1: as-of dimension
@register("fact_orders_asof", f"""
WITH c AS (
  SELECT DISTINCT customer_id, CAST(event_timestamp AS TIMESTAMP) AS known_since, name, email, segment
  FROM ({LD.SQL_CUSTOMERS}) WHERE event_timestamp <> 'n/a' AND customer_id IS NOT NULL
)
SELECT o.order_id, o.customer_id, o.t AS event_time, o.status, CAST(o.a AS DOUBLE) AS total_amount, c.known_since, c.name, c.email, c.segment
FROM {LD.SQL_PARSED} o LEFT JOIN c ON c.customer_id = o.customer_id AND c.known_since <= o.t
QUALIFY row_number() OVER (PARTITION BY o.event_id ORDER BY c.known_since DESC NULLS LAST, c.name DESC NULLS LAST,
  c.email DESC NULLS LAST, c.segment DESC NULLS LAST) = 1""",
          note="orders with the customer as known at the order's time; a signup's own order counts its change")
def q_fact_orders_asof(spark, sf_dir):
    path = LD.landed(spark, sf_dir)
    orders = batch_orders(spark, path).select("order_id", "customer_id", "event_time", "status", "total_amount")
    events = spark.read.schema(S.EVENT_SCHEMA).json(path).filter(F.col("event_type").isin("customer_create", "customer_update"))
    changes = events.select("customer_id", S.parse_event_time(F.col("event_timestamp")).alias("changed_at"), "name", "email", "segment")
    return decimals_to_double(AS.fact_orders_asof(orders, changes))


# ------------------------------------------------------------------ A8: offset source
@register("log_stream", KAFKA_SQL, note="the message log as an offset-based stream, in three deliveries, limited per micro-batch")
def q_log_stream(spark, sf_dir):
    log, path = context(spark, sf_dir).message_log, shared_dir(spark, "log")
    out, ck = shared_dir(spark, "decoded"), shared_dir(spark, "ck")
    value = F.when(F.col("offset") % 97 == 5, F.concat(F.lit("{broken "), F.col("offset").cast("string"))).otherwise(F.col("value"))
    log = log.withColumn("value", value)
    ends = log.agg(F.min("offset").alias("lo"), F.max("offset").alias("hi")).first()
    cut = [ends.lo or 0, *[(ends.lo or 0) + ((ends.hi or 0) - (ends.lo or 0)) * i // 3 for i in (1, 2)], (ends.hi or 0) + 1]
    for lo, hi in zip(cut, cut[1:], strict=False):
        LOG.write_log(log.filter((F.col("offset") >= lo) & (F.col("offset") < hi)), path)
        stream = S.decode_kafka(LOG.read_log(spark, path, "decoder", maxOffsetsPerTrigger=str(max(1, (hi - lo) // 2))), ML.ORDER_PAYLOAD)
        query = S.to_parquet(stream.withColumnRenamed(S.CORRUPT, "corrupt"), out, ck, available_now=False, interval="0 seconds")
        try:
            query.processAllAvailable()
            LOG.commit_processed(query, path, "decoder")
        finally:
            query.stop()
    return spark.read.parquet(out)
