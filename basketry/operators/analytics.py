"""Revenue reports, filters and top-k.

All reports run on cleaned columns (status, dates, amounts) - never on the
raw spellings - and on order grain for order measures.  Monetary sums are
exact decimals, cast to double only in the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions import money
from basketry.functions import vocab as V
from basketry.operators.cleaning import as_of_column
from basketry.operators.model import completed_orders, customer_months, named_customers, product_dim

AVG_SCALE = T.DecimalType(38, 6)


def _avg2(total, count):
    """Average rounded half-up to cents, computed from an exact decimal sum."""
    return F.round((total / count).cast(AVG_SCALE), 2).cast("double")


def monthly_revenue(orders_clean: DataFrame) -> DataFrame:
    """revenue of valid completed orders per (year, month), ordered."""
    return (completed_orders(orders_clean).groupBy("order_year", "order_month")
            .agg(money.money_sum("total_amount_cleaned").alias("monthly_revenue"))
            .select("order_year", "order_month", F.col("monthly_revenue").cast("double"))
            .orderBy("order_year", "order_month"))


def segment_analysis(orders_clean: DataFrame, customers_clean: DataFrame) -> DataFrame:
    """revenue, order count and average order value per customer segment
    (order grain, named customers), by revenue descending."""
    dim = named_customers(customers_clean).select("customer_id", F.col("segment_cleaned").alias("customer_segment"))
    months = customer_months(completed_orders(orders_clean)).join(dim, "customer_id", "inner")
    agg = (months.groupBy("customer_segment")
           .agg(money.cents_to_decimal(F.sum("revenue_c")).alias("rev"), F.sum("orders").alias("n")))
    return (agg.select("customer_segment", F.col("rev").cast("double").alias("total_revenue"),
                       F.col("n").cast("long").alias("order_count"),
                       _avg2(F.col("rev"), F.col("n")).alias("avg_order_value"))
            .orderBy(F.desc("total_revenue"), "customer_segment"))


def status_distribution(orders_clean: DataFrame) -> DataFrame:
    """Orders per cleaned status."""
    return (orders_clean.groupBy(F.col("status_cleaned").alias("status"))
            .agg(F.count(F.lit(1)).alias("order_count"))
            .orderBy(F.desc("order_count"), "status"))


def category_performance(fact: DataFrame) -> DataFrame:
    """completed line revenue (line totals, not order totals) and units per category."""
    return (fact.filter(F.col("is_completed") == 1)
            .groupBy("product_category")
            .agg(F.sum(money.micros("line_total")).alias("_micros"),
                 F.sum("quantity").cast("long").alias("units_sold"))
            # half-up to cents with exact long division, then to a double
            .select("product_category", (F.expr("(_micros + 5000) div 10000") / F.lit(100.0)).alias("category_revenue"),
                    "units_sold")
            .orderBy(F.desc("category_revenue"), "product_category"))


def category_revenue(orders_clean: DataFrame, customers_clean: DataFrame, items_clean: DataFrame,
                     products_clean: DataFrame) -> DataFrame:
    """F5 from Silver tables: the same report as ``category_performance`` of the fact, without building the fact.

    Lines of completed orders of named customers are summed per product before
    the product's category is joined, so a hot product is one row per task.
    """
    orders = orders_clean.filter((F.col("is_valid_order") == 1) & (F.col("is_completed") == 1)).select("order_id", "customer_id")
    orders = orders.join(named_customers(customers_clean).select("customer_id"), "customer_id", "left_semi")
    items = (items_clean.filter(F.col("quantity_cleaned").isNotNull() & F.col("price_cleaned").isNotNull())
             .select("order_id", "product_id", F.col("quantity_cleaned").alias("quantity"),
                     money.micros("line_total_calculated").alias("_micros")))
    per_product = (orders.join(items, "order_id", "left").groupBy("product_id")
                   .agg(F.sum("_micros").alias("_micros"), F.sum("quantity").alias("units")))
    return (per_product.join(product_dim(products_clean).select("product_id", F.col("category_cleaned").alias("product_category")),
                             "product_id", "left")
            .groupBy("product_category").agg(F.sum("_micros").alias("_micros"), F.sum("units").cast("long").alias("units_sold"))
            .select("product_category", (F.expr("(_micros + 5000) div 10000") / F.lit(100.0)).alias("category_revenue"), "units_sold")
            .orderBy(F.desc("category_revenue"), "product_category"))


def overall_revenue(orders_clean: DataFrame) -> DataFrame:
    """one-row revenue summary of valid completed orders."""
    o = completed_orders(orders_clean)
    agg = o.agg(money.money_sum("total_amount_cleaned").alias("rev"), F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("rev").cast("double").alias("total_revenue"),
                      F.col("n").cast("long").alias("total_orders"),
                      F.when(F.col("n") > 0, _avg2(F.col("rev"), F.col("n"))).alias("avg_order_value"))


def revenue_anomalies(monthly: DataFrame, drop_threshold: float = 0.2, calendar: bool = False) -> DataFrame:
    """G1 + L2: months whose revenue fell by >= threshold versus the previous month.

    ``calendar=False`` compares with the previous *row* (the rule book);
    ``calendar=True`` compares only with the immediately preceding calendar
    month, so gaps are not compared across.  The window is global, which is
    fine: its input is already one row per month.
    """
    idx = F.col("order_year") * 12 + F.col("order_month")
    w = Window.orderBy("order_year", "order_month")
    prev = F.lag("monthly_revenue").over(w)
    if calendar:
        prev = F.when(F.lag(idx).over(w) == idx - 1, prev)
    m = monthly.withColumn("prev_month_revenue", prev)
    rev, prv = F.col("monthly_revenue").cast("double"), F.col("prev_month_revenue").cast("double")
    m = m.withColumn("revenue_drop_pct", F.try_divide(prv - rev, prv))
    return (m.filter(F.col("revenue_drop_pct") >= drop_threshold)
            .select("order_year", "order_month", "monthly_revenue", "prev_month_revenue", "revenue_drop_pct"))


def top_customers(metrics: DataFrame, n: int = 10) -> DataFrame:
    """H1: top-n customers by revenue (customer id breaks ties)."""
    return metrics.orderBy(F.desc("total_revenue"), "customer_id").limit(n)


def rfm_high_value(rfm: DataFrame) -> DataFrame:
    """High-value customers, most valuable first."""
    return (rfm.filter(F.col("value_segment") == "high_value")
            .select("customer_id", F.col("monetary").cast("double"), F.col("frequency").cast("long"),
                    "last_order_date", "recency_days", "value_segment")
            .orderBy(F.desc("monetary"), "customer_id"))


# ------------------------------------------------------------------ quality filters
def invalid_dates(orders_clean: DataFrame, as_of) -> DataFrame:
    """Orders whose date is missing, unparseable, or after ``as_of``."""
    d = F.col("order_date_cleaned")
    return orders_clean.filter(d.isNull() | (d > as_of_column(as_of)))


def invalid_emails(customers: DataFrame) -> DataFrame:
    """Customers with a missing or malformed email."""
    return customers.filter(F.col("email").isNull() | ~F.col("email").rlike(V.EMAIL_PATTERN))


def negative_amounts(orders: DataFrame) -> DataFrame:
    """Orders with an amount below zero."""
    return orders.filter(F.col("total_amount") < 0)


def valid_order_rate(orders_clean: DataFrame) -> DataFrame:
    """Valid orders and their share of all orders (one row)."""
    return orders_clean.agg(
        F.count(F.lit(1)).cast("long").alias("total_orders"),
        F.sum("is_valid_order").cast("long").alias("valid_orders"),
        F.round(F.avg(F.col("is_valid_order").cast(T.DecimalType(10, 0))).cast(AVG_SCALE) * 100, 2)
        .cast("double").alias("valid_pct"))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """H6: the first ``n`` rows of a report (a LIMIT; rows stay on the cluster)."""
    return df.limit(n)


def show_report(title: str, df: DataFrame, n: int = 20) -> None:
    """H7: print a titled report; only ``n`` rows reach the driver."""
    print(f"\n=== {title} ===")
    df.show(n, truncate=False)
