"""Registered batch queries: cleaning, model, reports (with oracle SQL)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from basketry.operators import analytics as A
from basketry.operators import model as M
from basketry.plans.context import RetailContext, context
from basketry.plans.oracle import avg2, money_sum, with_base
from basketry.plans.registry import decimals_to_double, register


def ctx(spark: SparkSession, sf_dir: str) -> RetailContext:
    return context(spark, sf_dir)


# ------------------------------------------------------------------ F2
@register("monthly_revenue", with_base(f"""
SELECT order_year, order_month, CAST({money_sum('total_amount_cleaned')} AS DOUBLE) AS monthly_revenue
FROM completed GROUP BY order_year, order_month ORDER BY order_year, order_month"""))
def q_monthly_revenue(spark, sf_dir):
    return A.monthly_revenue(ctx(spark, sf_dir).orders_clean)


# ------------------------------------------------------------------ F8 (flagship)
GOLD_SQL = with_base("""
SELECT m.order_year, m.order_month, m.customer_segment, r.value_segment,
  CAST(CAST(sum(m.revenue) AS DECIMAL(38,2)) AS DOUBLE) AS revenue,
  CAST(sum(m.orders) AS BIGINT) AS order_count, CAST(count(*) AS BIGINT) AS customer_count
FROM named_months m JOIN rfm_seg r USING (customer_id)
GROUP BY ALL""")


@register("gold_segment_monthly", GOLD_SQL)
def q_gold(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return M.gold_segment_monthly(c.orders_clean, c.customers_clean, c.as_of, c.rules.rfm)


# ------------------------------------------------------------------ F1 / E1
@register("customer_metrics", with_base(f"""
SELECT p.customer_id, CAST(p.total_orders AS BIGINT) AS total_orders, CAST(p.rev AS DOUBLE) AS total_revenue,
  CAST(round(p.avg_dec, 2) AS DOUBLE) AS avg_order_value, d.join_date_cleaned AS join_date, d.segment_cleaned AS segment,
  CAST(date_diff('day', d.join_date_cleaned, (SELECT as_of FROM as_of_t)) AS BIGINT) AS tenure_days
FROM (SELECT customer_id, count(order_id) AS total_orders, {money_sum('total_amount_cleaned')} AS rev,
        CAST({money_sum('total_amount_cleaned')} / count(order_id) AS DECIMAL(38,6)) AS avg_dec FROM completed GROUP BY customer_id) p
JOIN (SELECT * FROM customer_dim WHERE customer_id IS NOT NULL) d USING (customer_id)"""))
def q_customer_metrics(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return M.customer_metrics(c.orders_clean, c.customers_clean, c.as_of)


# ------------------------------------------------------------------ H1
@register("top_customers", with_base(f"""
SELECT customer_id, CAST(rev AS DOUBLE) AS total_revenue, CAST(n AS BIGINT) AS total_orders
FROM (SELECT customer_id, count(*) AS n, {money_sum('total_amount_cleaned')} AS rev FROM completed
      WHERE customer_id IN (SELECT customer_id FROM customer_dim) GROUP BY customer_id)
ORDER BY total_revenue DESC, customer_id LIMIT 10"""))
def q_top_customers(spark, sf_dir):
    c = ctx(spark, sf_dir)
    m = M.customer_metrics(c.orders_clean, c.customers_clean, c.as_of)
    return A.top_customers(m, 10).select("customer_id", "total_revenue", "total_orders")


# ------------------------------------------------------------------ F7 / L1
@register("customer_rfm", with_base("""
SELECT customer_id, CAST(monetary AS DOUBLE) AS monetary, CAST(frequency AS BIGINT) AS frequency,
  last_order_date, recency_days, value_segment FROM rfm_seg"""))
def q_customer_rfm(spark, sf_dir):
    c = ctx(spark, sf_dir)
    r = M.customer_rfm(c.orders_clean, c.customers_clean, c.as_of, c.rules.rfm)
    return r.select("customer_id", F.col("monetary").cast("double"), F.col("frequency").cast("long"),
                    "last_order_date", "recency_days", "value_segment")


# ------------------------------------------------------------------ W5
@register("rfm_high_value", with_base("""
SELECT customer_id, CAST(monetary AS DOUBLE) AS monetary, CAST(frequency AS BIGINT) AS frequency,
  last_order_date, recency_days, value_segment FROM rfm_seg WHERE value_segment = 'high_value'
ORDER BY monetary DESC, customer_id"""))
def q_rfm_high_value(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return A.rfm_high_value(M.customer_rfm(c.orders_clean, c.customers_clean, c.as_of, c.rules.rfm))


# ------------------------------------------------------------------ F3
@register("segment_analysis", with_base(f"""
SELECT customer_segment, CAST(rev AS DOUBLE) AS total_revenue, CAST(n AS BIGINT) AS order_count,
  {avg2('rev', 'n')} AS avg_order_value
FROM (SELECT customer_segment, CAST(sum(revenue) AS DECIMAL(38,2)) AS rev, sum(orders) AS n FROM named_months GROUP BY 1)
ORDER BY total_revenue DESC, customer_segment"""))
def q_segment_analysis(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return A.segment_analysis(c.orders_clean, c.customers_clean)


# ------------------------------------------------------------------ F4 / M3
@register("status_distribution", with_base("""
SELECT status_cleaned AS status, count(*) AS order_count FROM orders_clean GROUP BY 1 ORDER BY order_count DESC, status"""))
def q_status_distribution(spark, sf_dir):
    return A.status_distribution(ctx(spark, sf_dir).orders_clean)


# ------------------------------------------------------------------ E3 + F5
@register("category_performance", with_base("""
SELECT product_category, CAST(((sum(CAST(round(line_total * 1000000) AS BIGINT)) + 5000) // 10000) AS DOUBLE) / 100.0 AS category_revenue, CAST(sum(quantity) AS BIGINT) AS units_sold
FROM fact WHERE is_completed = 1 GROUP BY 1 ORDER BY category_revenue DESC, product_category"""))
def q_category_performance(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return A.category_revenue(c.orders_clean, c.customers_clean, c.items_clean, c.products_clean)


@register("fact_orders_enhanced", with_base("""
SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount, CAST(unit_price AS DOUBLE) AS unit_price,
                  CAST(line_total AS DOUBLE) AS line_total) FROM fact"""))
def q_fact_enhanced(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return decimals_to_double(M.fact_orders_enhanced(c.orders_clean, c.customers_clean, c.items_clean, c.products_clean))


# ------------------------------------------------------------------ F6
@register("overall_revenue", with_base(f"""
SELECT CAST(rev AS DOUBLE) AS total_revenue, CAST(n AS BIGINT) AS total_orders,
  CASE WHEN n > 0 THEN {avg2('rev', 'n')} END AS avg_order_value
FROM (SELECT {money_sum('total_amount_cleaned')} AS rev, count(*) AS n FROM completed)"""))
def q_overall_revenue(spark, sf_dir):
    return A.overall_revenue(ctx(spark, sf_dir).orders_clean)


# ------------------------------------------------------------------ G1 / L2
ANOMALY_CTE = f"""
monthly AS (SELECT order_year, order_month, CAST({money_sum('total_amount_cleaned')} AS DOUBLE) AS monthly_revenue
            FROM completed GROUP BY 1, 2),
lagged AS (SELECT *, lag(monthly_revenue) OVER (ORDER BY order_year, order_month) AS prev_month_revenue,
                  lag(order_year * 12 + order_month) OVER (ORDER BY order_year, order_month) AS prev_idx FROM monthly)"""


@register("revenue_anomalies", with_base("""
SELECT order_year, order_month, monthly_revenue, prev_month_revenue,
  (prev_month_revenue - monthly_revenue) / prev_month_revenue AS revenue_drop_pct
FROM lagged WHERE (prev_month_revenue - monthly_revenue) / prev_month_revenue >= 0.2""", ANOMALY_CTE))
def q_revenue_anomalies(spark, sf_dir):
    return A.revenue_anomalies(A.monthly_revenue(ctx(spark, sf_dir).orders_clean), 0.2)


@register("revenue_anomalies_calendar", with_base("""
SELECT order_year, order_month, monthly_revenue, prev_month_revenue,
  (prev_month_revenue - monthly_revenue) / prev_month_revenue AS revenue_drop_pct
FROM (SELECT order_year, order_month, monthly_revenue,
        CASE WHEN prev_idx = order_year * 12 + order_month - 1 THEN prev_month_revenue END AS prev_month_revenue FROM lagged)
WHERE (prev_month_revenue - monthly_revenue) / prev_month_revenue >= 0.2""", ANOMALY_CTE))
def q_revenue_anomalies_calendar(spark, sf_dir):
    return A.revenue_anomalies(A.monthly_revenue(ctx(spark, sf_dir).orders_clean), 0.2, calendar=True)


# ------------------------------------------------------------------ W1-W4
@register("flt_invalid_dates", with_base("""
SELECT order_id, order_date, order_date_cleaned FROM orders_clean
WHERE order_date_cleaned IS NULL OR order_date_cleaned > DATE '1998-01-01'"""))
def q_invalid_dates(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return A.invalid_dates(c.orders_clean, "1998-01-01").select("order_id", "order_date", "order_date_cleaned")


@register("flt_invalid_emails", with_base("""
SELECT customer_id, email FROM raw_customers
WHERE email IS NULL OR NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')"""))
def q_invalid_emails(spark, sf_dir):
    return A.invalid_emails(ctx(spark, sf_dir).raw_customers).select("customer_id", "email")


@register("flt_negative_amounts", with_base("""
SELECT order_id, customer_id, CAST(total_amount AS DOUBLE) AS total_amount FROM raw_orders WHERE total_amount < 0"""))
def q_negative_amounts(spark, sf_dir):
    return decimals_to_double(A.negative_amounts(ctx(spark, sf_dir).raw_orders).select("order_id", "customer_id", "total_amount"))


@register("valid_order_rate", with_base("""
SELECT count(*) AS total_orders, CAST(sum(is_valid_order) AS BIGINT) AS valid_orders,
  CAST(round(CAST(avg(CAST(is_valid_order AS DECIMAL(10,0))) AS DECIMAL(38,6)) * 100, 2) AS DOUBLE) AS valid_pct
FROM orders_clean"""))
def q_valid_order_rate(spark, sf_dir):
    return A.valid_order_rate(ctx(spark, sf_dir).orders_clean)
