"""Registered dashboard (M1-M15) and message-log (M19-M25, G5) queries with oracle SQL."""

from __future__ import annotations

from basketry.operators import fraud as FR
from basketry.operators import live as L
from basketry.operators import model as M
from basketry.operators import msglog as ML
from basketry.plans.context import context
from basketry.plans.oracle import avg2, money_sum, with_base
from basketry.plans.registry import decimals_to_double, register
from basketry.plans import feed
from basketry.plans import landing as LD
from basketry.sources.tables import read_table


def ctx(spark, sf_dir):
    return context(spark, sf_dir)


def events(c):
    return FR.enrich_order_events(c.order_events)


def gold_months(c):
    return M.gold_customer_months(c.orders_clean, c.customers_clean, c.as_of, c.rules.rfm)


LATEST = "(SELECT max(event_time) FROM events_enriched)"


# ------------------------------------------------------------------ M1, M2, M4, M5, M7
@register("live_kpis", with_base(f"""
SELECT count(*) AS total_orders, CAST({money_sum('total_amount')} AS DOUBLE) AS total_revenue,
  count_if(event_time >= {LATEST} - INTERVAL 60 MINUTE) AS recent_orders,
  CAST(coalesce({money_sum(f"CASE WHEN event_time >= {LATEST} - INTERVAL 60 MINUTE THEN total_amount END")}, 0) AS DOUBLE) AS recent_revenue,
  CASE WHEN count(*) > 0 THEN {avg2(money_sum('total_amount'), 'count(*)')} ELSE 0.0 END AS avg_order_value,
  count(DISTINCT customer_id) AS unique_customers, count_if(status = 'completed') AS completed_orders,
  CAST(CASE WHEN count(*) > 0 THEN round(CAST(CAST(count_if(status = 'completed') AS DECIMAL(20,0)) * 100 / count(*) AS DECIMAL(38,6)), 2)
       ELSE 0 END AS DOUBLE) AS completion_rate
FROM events_enriched"""))
def q_live_kpis(spark, sf_dir):
    return L.live_kpis(events(ctx(spark, sf_dir)))


@register("orders_5min", with_base(f"""
SELECT time_bucket(INTERVAL 5 MINUTE, event_time) AS bucket_start, count(*) AS orders,
  CAST({money_sum('total_amount')} AS DOUBLE) AS revenue
FROM events_enriched WHERE event_time >= {LATEST} - INTERVAL 120 MINUTE GROUP BY 1"""))
def q_orders_5min(spark, sf_dir):
    return L.orders_per_bucket(events(ctx(spark, sf_dir)), "5 minutes", 120)


@register("amount_histogram", with_base("""
SELECT bin, lo + bin * (hi - lo) / 30 AS bin_start, lo + (bin + 1) * (hi - lo) / 30 AS bin_end, count(*) AS count
FROM (SELECT CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(floor((x - lo) / (hi - lo) * 30), 29) END AS BIGINT) AS bin, lo, hi
      FROM (SELECT CAST(total_amount AS DOUBLE) AS x FROM events_enriched WHERE total_amount IS NOT NULL),
           (SELECT min(CAST(total_amount AS DOUBLE)) AS lo, max(CAST(total_amount AS DOUBLE)) AS hi FROM events_enriched))
GROUP BY bin, lo, hi"""))
def q_amount_histogram(spark, sf_dir):
    return L.histogram(events(ctx(spark, sf_dir)), "total_amount", 30)


_HIST = """
SELECT bin, lo + bin * (hi - lo) / 10 AS bin_start, lo + (bin + 1) * (hi - lo) / 10 AS bin_end, count(*) AS count
FROM (SELECT CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(floor((x - lo) / (hi - lo) * 10), 9) END AS BIGINT) AS bin, lo, hi
      FROM scores, (SELECT min(x) AS lo, max(x) AS hi FROM scores))
GROUP BY bin, lo, hi"""


@register("fraud_score_histogram", with_base(_HIST, """
scores AS (SELECT CAST(s AS DOUBLE) AS x FROM (
  SELECT CASE WHEN total_amount > 200.0 THEN 4 WHEN total_amount > 120.0 THEN 3 WHEN total_amount > 80.0 THEN 2 ELSE 0 END
    + CASE WHEN status IN ('cancelled', 'refunded') THEN 1 ELSE 0 END AS s FROM events_enriched WHERE is_valid_order = 1) WHERE s >= 3)"""))
def q_fraud_score_histogram(spark, sf_dir):
    """M4: flagged orders by fraud score, 10 bins."""
    c = ctx(spark, sf_dir)
    return L.histogram(FR.stream_fraud(events(c), c.rules.stream_fraud), "fraud_score", 10)


@register("amount_box_by_status", with_base("""
SELECT status, min(x) AS min, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median,
  round(quantile_cont(x, 0.75), 6) AS q3,
  max(x) AS max
FROM (SELECT status, CAST(total_amount AS DOUBLE) AS x FROM events_enriched) GROUP BY status"""))
def q_amount_box(spark, sf_dir):
    return L.box_by_group(events(ctx(spark, sf_dir)), "status", "total_amount")


# ------------------------------------------------------------------ M8-M11 (Gold)
GOLD_MONTHS_CTE = """gold_months AS (SELECT m.*, r.value_segment FROM named_months m JOIN rfm_seg r USING (customer_id))"""
FILTER_YEARS, FILTER_SEGMENTS = [1996, 1997, 1998], ["Premium", "Regular", "Bronze"]


@register("gold_filtered_kpis", with_base(f"""
SELECT CAST(coalesce(CAST(sum(revenue) AS DECIMAL(38,2)), 0) AS DOUBLE) AS revenue, CAST(coalesce(sum(orders), 0) AS BIGINT) AS orders,
  count(DISTINCT customer_id) AS customers,
  CASE WHEN coalesce(sum(orders), 0) > 0 THEN {avg2('CAST(sum(revenue) AS DECIMAL(38,2))', 'sum(orders)')} ELSE 0.0 END AS avg_order_value
FROM gold_months WHERE order_year IN (1996, 1997, 1998) AND customer_segment IN ('Premium', 'Regular', 'Bronze')
  AND value_segment IN ('high_value', 'medium_value')""", GOLD_MONTHS_CTE))
def q_gold_filtered_kpis(spark, sf_dir):
    return L.gold_filtered_kpis(gold_months(ctx(spark, sf_dir)), FILTER_YEARS, FILTER_SEGMENTS,
                                ["high_value", "medium_value"])


@register("gold_monthly_trend", with_base("""
SELECT printf('%d-%02d', order_year, order_month) AS year_month, CAST(CAST(sum(revenue) AS DECIMAL(38,2)) AS DOUBLE) AS revenue
FROM gold_months GROUP BY 1 ORDER BY 1""", GOLD_MONTHS_CTE))
def q_gold_monthly_trend(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return L.gold_monthly_trend(M.gold_segment_monthly(c.orders_clean, c.customers_clean, c.as_of, c.rules.rfm, exact=True))


@register("gold_segment_revenue", with_base("""
SELECT customer_segment, CAST(CAST(sum(revenue) AS DECIMAL(38,2)) AS DOUBLE) AS revenue FROM gold_months GROUP BY 1
ORDER BY revenue DESC, customer_segment""", GOLD_MONTHS_CTE))
def q_gold_segment_revenue(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return L.gold_segment_revenue(M.gold_segment_monthly(c.orders_clean, c.customers_clean, c.as_of, c.rules.rfm, exact=True))


@register("gold_value_segment", with_base("""
SELECT value_segment, CAST(rev AS DOUBLE) AS revenue, customers, CAST(rev AS DOUBLE) / CAST(sum(rev) OVER () AS DOUBLE) AS revenue_share
FROM (SELECT value_segment, CAST(sum(revenue) AS DECIMAL(38,2)) AS rev, count(DISTINCT customer_id) AS customers
      FROM gold_months GROUP BY 1)""", GOLD_MONTHS_CTE))
def q_gold_value_segment(spark, sf_dir):
    return L.gold_value_segment(gold_months(ctx(spark, sf_dir)))


# ------------------------------------------------------------------ M14, M15
@register("customer_event_kpis", f"""
SELECT count(*) AS total_events, count(DISTINCT customer_id) AS unique_customers, count_if(event_type = 'customer_create') AS creates,
  count_if(event_type = 'customer_update') AS updates FROM ({LD.SQL_CUSTOMERS})""")
def q_customer_event_kpis(spark, sf_dir):
    return L.customer_event_kpis(LD.landing_events(read_table(spark, sf_dir, "events")))


@register("customer_segment_counts", with_base(
    "SELECT segment_cleaned AS segment, count(*) AS customers FROM customers_clean GROUP BY 1"))
def q_customer_segment_counts(spark, sf_dir):
    return L.segment_counts(ctx(spark, sf_dir).customers_clean)


@register("item_kpis", with_base("""
SELECT count(*) AS item_rows, count(DISTINCT order_id) AS unique_orders, CAST(sum(quantity_cleaned) AS BIGINT) AS total_quantity,
  CAST(sum(CAST(round(line_total_calculated * 1000000) AS BIGINT)) AS DOUBLE) / 1000000.0 AS total_value FROM items_clean"""))
def q_item_kpis(spark, sf_dir):
    return L.item_kpis(ctx(spark, sf_dir).items_clean)


@register("category_stats", with_base(f"""
SELECT p.category_cleaned AS category, CAST(sum(i.quantity_cleaned) AS BIGINT) AS units,
  CAST({money_sum('i.price_cleaned')} AS DOUBLE) AS price_sum, count(*) AS items
FROM items_clean i LEFT JOIN product_dim p USING (product_id) GROUP BY 1"""))
def q_category_stats(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return L.category_stats(c.items_clean, M.product_dim(c.products_clean))


# ------------------------------------------------------------------ message log
LOG_CTE = """
message_log AS (
  SELECT event_type AS topic, CAST(user_id % 3 AS INTEGER) AS "partition", event_id AS "offset", CAST(user_id AS VARCHAR) AS "key",
    CAST(ts AS TIMESTAMP) AS "timestamp", event_id AS order_id, user_id AS customer_id, value AS total_amount, event_type,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
commits AS (
  SELECT 'realtime' AS group_id, topic, "partition", "offset" + 1 AS committed_offset, "timestamp" AS updated_at FROM message_log
  UNION ALL
  SELECT 'batch', topic, "partition", CAST(floor("offset" / 100) * 100 AS BIGINT), "timestamp" FROM message_log),
topic_cfg AS (
  SELECT CASE topic WHEN 'signup' THEN 'audit' ELSE topic END AS topic_name, count(DISTINCT "partition") AS partitions,
    CAST(CASE topic WHEN 'purchase' THEN 720 WHEN 'error' THEN 168 WHEN 'click' THEN 24 WHEN 'view' THEN 48
         ELSE 168 END AS BIGINT) AS retention_hours
  FROM message_log GROUP BY topic),
stats AS (
  SELECT topic, "partition", count(*) AS message_count, min("offset") AS earliest_offset, max("offset") AS latest_offset
  FROM message_log GROUP BY 1, 2),
committed AS (
  SELECT group_id, topic, "partition", committed_offset, updated_at FROM (
    SELECT *, row_number() OVER (PARTITION BY group_id, topic, "partition" ORDER BY updated_at DESC, committed_offset DESC) AS rn
    FROM commits) WHERE rn = 1)"""


def log(c):
    return c.message_log


@register("topic_stats", with_base("SELECT * FROM stats", LOG_CTE))
def q_topic_stats(spark, sf_dir):
    return ML.topic_stats(log(ctx(spark, sf_dir)))


@register("topic_status", with_base("""
SELECT t.topic_name, t.partitions, t.retention_hours, CAST(coalesce(s.messages, 0) AS BIGINT) AS messages,
  CASE WHEN coalesce(s.messages, 0) > 0 THEN 'active' ELSE 'empty' END AS status
FROM topic_cfg t LEFT JOIN (SELECT topic, sum(message_count) AS messages FROM stats GROUP BY 1) s ON t.topic_name = s.topic""", LOG_CTE))
def q_topic_status(spark, sf_dir):
    lg = log(ctx(spark, sf_dir))
    return ML.topic_status(feed.topics_from(lg), ML.topic_stats(lg))


@register("log_incremental_read", with_base("""
SELECT topic, "partition", "offset", "key", "timestamp", order_id, customer_id, total_amount, event_type, k
FROM message_log WHERE topic = 'purchase' AND "partition" = 0 AND "offset" >= 0 ORDER BY "offset" LIMIT 100""", LOG_CTE))
def q_log_incremental_read(spark, sf_dir):
    return ML.incremental_read(log(ctx(spark, sf_dir)), "purchase", 0, 0, 100)


@register("log_last_messages", with_base("""
SELECT topic, "partition", "offset", "key", "timestamp" FROM message_log
ORDER BY "timestamp" DESC, "offset" DESC, topic, "partition" LIMIT 50""", LOG_CTE))
def q_log_last_messages(spark, sf_dir):
    return ML.last_messages(log(ctx(spark, sf_dir)), 50).select("topic", "partition", "offset", "key", "timestamp")


@register("committed_offsets", with_base("SELECT * FROM committed", LOG_CTE))
def q_committed_offsets(spark, sf_dir):
    return ML.committed_offsets(feed.consumer_commits_from(log(ctx(spark, sf_dir))))


@register("consumer_lag", with_base("""
SELECT c.group_id, c.topic, c."partition", c.committed_offset, s.latest_offset,
  CAST(greatest(0, s.latest_offset + 1 - c.committed_offset) AS BIGINT) AS lag
FROM committed c LEFT JOIN stats s USING (topic, "partition")""", LOG_CTE))
def q_consumer_lag(spark, sf_dir):
    lg = log(ctx(spark, sf_dir))
    return ML.consumer_lag(ML.topic_stats(lg), ML.committed_offsets(feed.consumer_commits_from(lg)))


@register("log_retention", with_base("""
SELECT m.topic, m."partition", m."offset", m."timestamp" FROM message_log m LEFT JOIN topic_cfg t ON m.topic = t.topic_name
WHERE t.retention_hours IS NULL OR m."timestamp" >= (SELECT max("timestamp") FROM message_log) - to_hours(t.retention_hours)""", LOG_CTE))
def q_log_retention(spark, sf_dir):
    lg = log(ctx(spark, sf_dir))
    return ML.retained(lg, feed.topics_from(lg)).select("topic", "partition", "offset", "timestamp")


@register("message_rates", with_base("""
SELECT topic, "partition", minute, CAST(total AS BIGINT) AS messages_total,
  CASE WHEN epoch(minute) - epoch(fm) > 0 THEN CAST(total - ft AS DOUBLE) / (epoch(minute) - epoch(fm)) * 60 ELSE 0 END AS messages_per_minute
FROM (SELECT *, first_value(total) OVER w AS ft, first_value(minute) OVER w AS fm
      FROM (SELECT *, sum(n) OVER (PARTITION BY topic, "partition" ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
            FROM (SELECT topic, "partition", date_trunc('minute', "timestamp") AS minute, count(*) AS n FROM message_log GROUP BY 1, 2, 3))
      WINDOW w AS (PARTITION BY topic, "partition" ORDER BY minute ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))""", LOG_CTE))
def q_message_rates(spark, sf_dir):
    return ML.message_rates(log(ctx(spark, sf_dir)), 10)


@register("fraud_timeline", with_base(f"""
SELECT event_time AS order_timestamp, CAST(s AS BIGINT) AS fraud_score, CAST(total_amount AS DOUBLE) AS total_amount FROM (
  SELECT event_time, total_amount, CASE WHEN total_amount > 200.0 THEN 4 WHEN total_amount > 120.0 THEN 3
    WHEN total_amount > 80.0 THEN 2 ELSE 0 END + CASE WHEN status IN ('cancelled', 'refunded') THEN 1 ELSE 0 END AS s
  FROM events_enriched WHERE is_valid_order = 1) WHERE s >= 3"""))
def q_fraud_timeline(spark, sf_dir):
    """M7: (time, score, amount) points of the stream fraud scores."""
    c = ctx(spark, sf_dir)
    return decimals_to_double(FR.stream_fraud(events(c), c.rules.stream_fraud)
                              .select("order_timestamp", "fraud_score", "total_amount"))
