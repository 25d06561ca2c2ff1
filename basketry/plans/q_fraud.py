"""Registered fraud queries (G2, G4, F15, L3, L4, L6, L7, M6, M16, M17, H2, W8) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import fraud as FR
from basketry.plans.context import RetailContext, context
from basketry.plans.oracle import RULES, money_sum, with_base
from basketry.plans.registry import decimals_to_double, register

FR_RULES = RULES.fraud
SF_RULES = RULES.stream_fraud


def ctx(spark, sf_dir):
    return context(spark, sf_dir)


def events(c: RetailContext):
    return FR.enrich_order_events(c.order_events)


def _ladder_sql(col, steps, op=">"):
    return "CASE " + " ".join(f"WHEN {col} {op} {t} THEN {p}" for t, p in steps) + " ELSE 0 END"


DAYS_CTE = """
valid_orders AS (SELECT order_id, customer_id, order_date_cleaned, total_amount_cleaned FROM orders_clean WHERE is_valid_order = 1),
with_days AS (
  SELECT *, CAST(date_diff('day', lag(order_date_cleaned) OVER (PARTITION BY customer_id ORDER BY order_date_cleaned, order_id),
                 order_date_cleaned) AS BIGINT) AS days_since_last_order
  FROM valid_orders),
item_stats AS (
  SELECT order_id, CAST(sum(quantity_cleaned) AS BIGINT) AS total_quantity, count(item_id) AS item_count,
    CAST(max(quantity_cleaned) AS BIGINT) AS max_item_quantity
  FROM items_clean WHERE quantity_cleaned IS NOT NULL GROUP BY order_id)"""

_risk = "CASE " + " ".join(f"WHEN fraud_score >= {t} THEN '{lab}'" for t, lab in FR_RULES.risk_levels) + \
        f" ELSE '{FR_RULES.low_label}' END"
FRAUD_CTE = DAYS_CTE + f""",
scored AS (
  SELECT d.*, s.total_quantity, s.max_item_quantity,
    {_ladder_sql('d.total_amount_cleaned', FR_RULES.amount)} AS a,
    {_ladder_sql('d.days_since_last_order', FR_RULES.velocity_days, '<')} AS v,
    {_ladder_sql('s.total_quantity', FR_RULES.total_quantity)} AS q,
    {_ladder_sql('s.max_item_quantity', FR_RULES.max_item_quantity)} AS i
  FROM with_days d LEFT JOIN item_stats s USING (order_id)),
fraud AS (
  SELECT order_id, customer_id, order_date_cleaned, CAST(total_amount_cleaned AS DOUBLE) AS total_amount_cleaned,
    total_quantity, max_item_quantity, CAST(a + v + q + i AS BIGINT) AS fraud_score,
    CASE WHEN v >= 2 AND a >= 2 THEN 'Velocity + High Value' WHEN v >= 3 THEN 'Velocity Fraud'
         WHEN a >= 3 THEN 'High Value Fraud' WHEN q >= 2 THEN 'Bulk Purchase Fraud'
         WHEN i >= 2 THEN 'Suspicious Quantity' ELSE 'Mixed Pattern' END AS fraud_type,
    {_risk.replace('fraud_score', '(a + v + q + i)')} AS risk_level,
    (a + v + q + i) >= {FR_RULES.flag_at} AS potential_fraud
  FROM scored)"""


@register("days_since_last_order", with_base("SELECT order_id, customer_id, order_date_cleaned, days_since_last_order FROM with_days", DAYS_CTE))
def q_days_since(spark, sf_dir):
    o = ctx(spark, sf_dir).orders_clean.filter(F.col("is_valid_order") == 1).select("order_id", "customer_id", "order_date_cleaned")
    return FR.days_since_last_order(o)


@register("order_item_stats", with_base("SELECT * FROM item_stats", DAYS_CTE))
def q_item_stats(spark, sf_dir):
    return FR.order_item_stats(ctx(spark, sf_dir).items_clean)


@register("fraud_orders", with_base("SELECT * FROM fraud WHERE potential_fraud", FRAUD_CTE))
def q_fraud_orders(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return decimals_to_double(FR.fraud_orders(c.orders_clean, c.items_clean, c.rules.fraud))


@register("top_fraud_orders", with_base("""
SELECT order_id, customer_id, fraud_score, fraud_type, risk_level FROM fraud WHERE potential_fraud
ORDER BY fraud_score DESC, order_id LIMIT 10""", FRAUD_CTE))
def q_top_fraud(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return FR.top_fraud(FR.fraud_orders(c.orders_clean, c.items_clean, c.rules.fraud), 10) \
        .select("order_id", "customer_id", "fraud_score", "fraud_type", "risk_level")


@register("orders_last_hour", with_base("""
SELECT e.event_id, e.customer_id, e.event_time,
  (SELECT count(*) FROM order_events x WHERE x.customer_id = e.customer_id
     AND floor(epoch(x.event_time)) BETWEEN floor(epoch(e.event_time)) - 3600 AND floor(epoch(e.event_time))) AS orders_in_last_hour
FROM order_events e"""))
def q_orders_last_hour(spark, sf_dir):
    e = ctx(spark, sf_dir).order_events.select("event_id", "customer_id", "event_time")
    return FR.orders_in_last_hour(e)


_samt = _ladder_sql("total_amount", SF_RULES.amount)
_sstat = f"CASE WHEN status IN ('cancelled', 'refunded') THEN {SF_RULES.status_points} ELSE 0 END"


@register("fraud_stream_rules", with_base(f"""
SELECT order_id, customer_id, event_time AS order_timestamp, CAST(total_amount AS DOUBLE) AS total_amount,
  CAST({_samt} + {_sstat} AS BIGINT) AS fraud_score, status
FROM events_enriched WHERE is_valid_order = 1 AND {_samt} + {_sstat} >= {SF_RULES.flag_at}"""))
def q_fraud_stream_rules(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return decimals_to_double(FR.stream_fraud(events(c), c.rules.stream_fraud))


@register("fraud_summary", with_base(f"""
SELECT count(*) AS alerts, count_if(s >= 5) AS high_risk, CAST({money_sum('total_amount')} AS DOUBLE) AS flagged_amount,
  CAST(round(CAST(avg(CAST(s AS DECIMAL(20,0))) AS DECIMAL(38,6)), 4) AS DOUBLE) AS avg_score, max(s) AS max_score
FROM (SELECT total_amount, CAST({_samt} + {_sstat} AS BIGINT) AS s FROM events_enriched WHERE is_valid_order = 1)
WHERE s >= {SF_RULES.flag_at}"""))
def q_fraud_summary(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return FR.fraud_summary(FR.stream_fraud(events(c), c.rules.stream_fraud))


_t_hi, _p_hi, _r_hi = SF_RULES.alert_amount[0]
_t_el, _p_el, _r_el = SF_RULES.alert_amount[1]
ALERT_CTE = f"""
alert_base AS (
  SELECT *, CASE WHEN total_amount > {_t_hi} THEN {_p_hi} WHEN total_amount > {_t_el} THEN {_p_el} ELSE 0 END
            + CASE WHEN status IN ('cancelled', 'refunded') THEN {SF_RULES.status_points} ELSE 0 END AS score,
    list_filter([CASE WHEN total_amount > {_t_hi} THEN '{_r_hi}' WHEN total_amount > {_t_el} THEN '{_r_el}' END,
                 CASE WHEN status IN ('cancelled', 'refunded') THEN 'Suspicious order status' END], lambda x: x IS NOT NULL) AS reasons
  FROM events_enriched WHERE is_valid_order = 1),
alerts AS (
  SELECT 'FRAUD_' || CAST(order_id AS VARCHAR) AS alert_id, order_id, customer_id, event_time AS event_timestamp,
    CAST(score AS BIGINT) AS fraud_score, CASE WHEN score >= {SF_RULES.high_risk_at} THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level,
    reasons, CAST(total_amount AS DOUBLE) AS total_amount, status, score >= {SF_RULES.high_risk_at} AS requires_review
  FROM alert_base WHERE score >= {SF_RULES.flag_at})"""


def alerts_df(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return decimals_to_double(FR.fraud_alerts(events(c), c.rules.stream_fraud))


@register("fraud_alerts_reasons", with_base(
    "SELECT * EXCLUDE (reasons), array_to_string(reasons, '; ') AS reasons_text FROM alerts", ALERT_CTE))
def q_fraud_alerts(spark, sf_dir):
    a = alerts_df(spark, sf_dir)
    return a.withColumn("reasons_text", F.array_join("reasons", "; ")).drop("reasons")


@register("alert_kpis", with_base("""
SELECT count(*) AS total_alerts, count_if(risk_level = 'HIGH') AS high_risk_alerts, count_if(requires_review) AS requires_review,
  CAST(round(CAST(avg(CAST(fraud_score AS DECIMAL(20,0))) AS DECIMAL(38,6)), 4) AS DOUBLE) AS avg_fraud_score FROM alerts""", ALERT_CTE))
def q_alert_kpis(spark, sf_dir):
    return FR.alert_kpis(alerts_df(spark, sf_dir))


@register("alert_risk_counts", with_base("SELECT risk_level, count(*) AS alerts FROM alerts GROUP BY 1", ALERT_CTE))
def q_alert_risk_counts(spark, sf_dir):
    return FR.risk_counts(alerts_df(spark, sf_dir))


@register("alert_reason_counts", with_base(
    "SELECT reason, count(*) AS occurrences FROM (SELECT unnest(reasons) AS reason FROM alerts) GROUP BY 1", ALERT_CTE))
def q_alert_reason_counts(spark, sf_dir):
    return FR.reason_counts(alerts_df(spark, sf_dir))


@register("alerts_high_priority", with_base(
    "SELECT alert_id, order_id, customer_id, fraud_score, risk_level, total_amount FROM alerts WHERE requires_review", ALERT_CTE))
def q_alerts_high_priority(spark, sf_dir):
    return FR.high_priority(alerts_df(spark, sf_dir)).select(
        "alert_id", "order_id", "customer_id", "fraud_score", "risk_level", "total_amount")


_alt_reasons = (f"list_filter([CASE WHEN total_amount > {_t_hi} THEN 'High transaction amount' END, "
                "CASE WHEN status IN ('cancelled', 'refunded') THEN 'Suspicious order status' END], lambda x: x IS NOT NULL)")


@register("fraud_alert_score_alt", with_base(f"""
SELECT order_id, customer_id, CAST(total_amount AS DOUBLE) AS total_amount, status, array_to_string(r, '; ') AS reasons_text,
  CAST(s AS BIGINT) AS fraud_score, CASE WHEN s >= {SF_RULES.alt_high_at} THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level,
  s >= {SF_RULES.alt_high_at} AS requires_review
FROM (SELECT *, least(5, greatest(3, CAST(floor(CAST(total_amount AS DOUBLE) / {SF_RULES.alt_unit}) AS BIGINT)) + len(r) - 1) AS s
      FROM (SELECT *, CASE WHEN len({_alt_reasons}) > 0 THEN {_alt_reasons} ELSE ['Suspicious pattern'] END AS r
            FROM events_enriched WHERE is_valid_order = 1))"""))
def q_fraud_alert_score_alt(spark, sf_dir):
    c = ctx(spark, sf_dir)
    a = decimals_to_double(FR.fraud_alert_score_alt(events(c), c.rules.stream_fraud))
    return a.withColumn("reasons_text", F.array_join("reasons", "; ")).drop("reasons")
