"""Live and Gold dashboard metrics (M1-M11, M14, M15), computed on Spark.

Every metric is an aggregate over the *whole* layer - not over the newest
thousand rows pulled to the driver - and the dashboard only renders the
small result.  ``as_of`` defaults to the newest event time (a scalar
subquery), so "last hour" is reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions import money
from basketry.operators.model import MONEY_SUM
from basketry.operators.quantiles import exact_quantiles

PCT = T.DecimalType(38, 6)


def _avg2(total: Column, count: Column) -> Column:
    return F.round((total / count).cast(PCT), 2).cast("double")


def latest_time(events: DataFrame, ts: str = "event_time") -> Column:
    return events.select(F.max(ts)).scalar()


def live_kpis(events: DataFrame, as_of: Column | None = None, recent_minutes: int = 60) -> DataFrame:
    """M1: totals, last-hour totals, AOV, unique customers, completion count and rate (one row)."""
    as_of = as_of if as_of is not None else latest_time(events)
    recent = F.col("event_time") >= as_of - F.expr(f"INTERVAL {recent_minutes} MINUTES")
    agg = events.agg(
        F.count(F.lit(1)).alias("n"),
        money.money_sum("total_amount").alias("rev"),
        F.count_if(recent).alias("recent_orders"),
        money.money_sum(F.when(recent, F.col("total_amount"))).alias("recent_rev"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.count_if(F.col("status") == "completed").alias("completed"))
    n = F.col("n")
    return agg.select(
        n.cast("long").alias("total_orders"), F.col("rev").cast("double").alias("total_revenue"),
        F.col("recent_orders").cast("long"), F.coalesce(F.col("recent_rev"), F.lit(0)).cast("double").alias("recent_revenue"),
        F.when(n > 0, _avg2(F.col("rev"), n)).otherwise(F.lit(0.0)).alias("avg_order_value"),
        F.col("unique_customers").cast("long"), F.col("completed").cast("long").alias("completed_orders"),
        F.when(n > 0, F.round((F.col("completed").cast(T.DecimalType(20, 0)) * 100 / n).cast(PCT), 2))
        .otherwise(F.lit(0)).cast("double").alias("completion_rate"))


def orders_per_bucket(events: DataFrame, bucket: str = "5 minutes", lookback_minutes: int = 120,
                      as_of: Column | None = None) -> DataFrame:
    """M2: order count and revenue per time bucket over the look-back period."""
    as_of = as_of if as_of is not None else latest_time(events)
    recent = events.filter(F.col("event_time") >= as_of - F.expr(f"INTERVAL {lookback_minutes} MINUTES"))
    return (recent.groupBy(F.window("event_time", bucket).alias("w"))
            .agg(F.count(F.lit(1)).cast("long").alias("orders"),
                 money.money_sum("total_amount").cast("double").alias("revenue"))
            .select(F.col("w.start").alias("bucket_start"), "orders", "revenue"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """M4: equal-width histogram between min and max (max falls in the last bin).

    Bounds come from one scalar aggregate; the binning itself is a narrow
    projection followed by a partial aggregation, so it scales with the data.
    """
    x = F.col(column).cast("double")
    bounds = df.select(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()  # one pass for both
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    width = hi - lo
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) / width * F.lit(bins)), F.lit(bins - 1))).cast("long")
    counted = df.filter(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("count"))
    return counted.select("bin", (lo + F.col("bin") * width / F.lit(bins)).alias("bin_start"),
                          (lo + (F.col("bin") + 1) * width / F.lit(bins)).alias("bin_end"), "count")


def box_by_group(df: DataFrame, group: str, column: str) -> DataFrame:
    """M5: five-number summary per group (exact quartiles, linear interpolation).

    Exact in bounded memory (``quantiles.exact_quantiles``).  Quartiles of cent values have at most 4 decimals; rounding the
    interpolated double to 6 places removes interpolation rounding noise,
    so the value is the exact one whatever the interpolation formula.
    """
    return exact_quantiles(df, column, [0, 0.25, 0.5, 0.75, 1], [group]).select(
        group, F.col("q")[0].alias("min"), F.round(F.col("q")[1], 6).alias("q1"), F.round(F.col("q")[2], 6).alias("median"),
        F.round(F.col("q")[3], 6).alias("q3"), F.col("q")[4].alias("max"))


# ------------------------------------------------------------------ Gold dashboards
def gold_filtered_kpis(customer_months: DataFrame, years: list[int] | None = None,
                       segments: list[str] | None = None, value_segments: list[str] | None = None) -> DataFrame:
    """M8: revenue, orders, distinct customers and AOV for the selected Gold slice.

    Distinct customers come from the customer-month grain, so a customer in
    several selected Gold rows is counted once.
    """
    df = customer_months
    if years is not None:
        df = df.filter(F.col("order_year").isin(years))
    if segments is not None:
        df = df.filter(F.col("customer_segment").isin(segments))
    if value_segments is not None:
        df = df.filter(F.col("value_segment").isin(value_segments))
    agg = df.agg(money.cents_to_decimal(F.sum("revenue_c")).alias("rev"), F.sum("orders").alias("n"),
                 F.countDistinct("customer_id").alias("customers"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return agg.select(F.coalesce(F.col("rev").cast("double"), F.lit(0.0)).alias("revenue"),
                      n.cast("long").alias("orders"), F.col("customers").cast("long"),
                      F.when(n > 0, _avg2(F.col("rev"), n)).otherwise(F.lit(0.0)).alias("avg_order_value"))


def gold_monthly_trend(gold: DataFrame) -> DataFrame:
    """M9: revenue per 'yyyy-MM' label."""
    label = F.format_string("%d-%02d", F.col("order_year"), F.col("order_month"))
    return (gold.groupBy(label.alias("year_month")).agg(F.sum("revenue").cast(MONEY_SUM).cast("double").alias("revenue"))
            .orderBy("year_month"))


def gold_segment_revenue(gold: DataFrame) -> DataFrame:
    """Revenue per customer segment, largest first."""
    return (gold.groupBy("customer_segment").agg(F.sum("revenue").cast(MONEY_SUM).alias("rev"))
            .select("customer_segment", F.col("rev").cast("double").alias("revenue"))
            .orderBy(F.desc("revenue"), "customer_segment"))


def gold_value_segment(customer_months: DataFrame) -> DataFrame:
    """Revenue, distinct customers and revenue share per value segment."""
    agg = (customer_months.groupBy("value_segment")
           .agg(money.cents_to_decimal(F.sum("revenue_c")).alias("rev"), F.countDistinct("customer_id").alias("customers")))
    total = F.sum("rev").over(Window.partitionBy()).cast(MONEY_SUM)  # <= 3 rows
    return agg.select("value_segment", F.col("rev").cast("double").alias("revenue"), F.col("customers").cast("long"),
                      (F.col("rev").cast("double") / total.cast("double")).alias("revenue_share"))


# ------------------------------------------------------------------ entity dashboards
def customer_event_kpis(events: DataFrame) -> DataFrame:
    """Customer events, distinct customers, creates and updates by event type (other types are left out)."""
    kind = F.col("event_type")
    return events.filter(kind.isin("customer_create", "customer_update")).agg(
        F.count(F.lit(1)).cast("long").alias("total_events"), F.countDistinct("customer_id").cast("long").alias("unique_customers"),
        F.count_if(kind == "customer_create").cast("long").alias("creates"),
        F.count_if(kind == "customer_update").cast("long").alias("updates"))


def segment_counts(customers_clean: DataFrame) -> DataFrame:
    """Customer records per cleaned segment."""
    return customers_clean.groupBy(F.col("segment_cleaned").alias("segment")).agg(
        F.count(F.lit(1)).cast("long").alias("customers"))


def item_kpis(items_clean: DataFrame) -> DataFrame:
    """Item rows, distinct orders, units and value (one row)."""
    return items_clean.agg(
        F.count(F.lit(1)).cast("long").alias("item_rows"), F.countDistinct("order_id").cast("long").alias("unique_orders"),
        F.sum("quantity_cleaned").cast("long").alias("total_quantity"),
        (F.sum(money.micros("line_total_calculated")) / F.lit(1_000_000.0)).alias("total_value"))


def category_stats(items_clean: DataFrame, product_dim: DataFrame) -> DataFrame:
    """Units, summed unit price and item count per product category."""
    # per product first: a hot product is one row per task when it is shuffled
    per_product = items_clean.groupBy("product_id").agg(
        F.sum("quantity_cleaned").alias("units"), money.sum_cents("price_cleaned").alias("c"), F.count(F.lit(1)).alias("items"))
    joined = per_product.join(product_dim.select("product_id", "category_cleaned"), "product_id", "left")
    return (joined.groupBy(F.col("category_cleaned").alias("category"))
            .agg(F.sum("units").cast("long").alias("units"),
                 money.cents_to_decimal(F.sum("c")).cast("double").alias("price_sum"),
                 F.sum("items").cast("long").alias("items")))
