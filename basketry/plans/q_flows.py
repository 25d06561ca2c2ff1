"""Registered end-to-end flow (P2), legacy fact (E2), filter values (I3) and recent orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import cleaning as C
from basketry.operators import cleaning as CL
from basketry.operators import fraud as FR
from basketry.operators import model as M
from basketry.plans.context import context
from basketry.plans.flows import latest_orders, run_batch_medallion
from basketry.plans.incremental import GoldStore
from basketry.plans.oracle import dedup_first, parse_date, with_base
from basketry.plans.q_batch import GOLD_SQL
from basketry.plans import q_clean, q_fraud, q_quality  # noqa: F401  (their SQL is the layers' oracle)
from basketry.plans.registry import REGISTRY, decimals_to_double, register
from basketry.session import shared_dir


def ctx(spark, sf_dir):
    return context(spark, sf_dir)


def lake(spark, sf_dir):
    c = ctx(spark, sf_dir)
    raw = {"orders": c.raw_orders, "customers": c.raw_customers, "order_items": c.raw_items, "products": c.raw_products}
    return run_batch_medallion(spark, raw, shared_dir(spark, "medallion"), c.rules)


@register("medallion_gold", GOLD_SQL)
def q_medallion_gold(spark, sf_dir):
    """The whole batch run; returns the Gold table as written to the lake."""
    return spark.read.parquet(lake(spark, sf_dir)["gold/customer_segment_monthly"])


def _layer(name: str, path: str, twin: str, schema: str | None = None) -> None:
    """Registers what the batch run wrote to ``path``, against the SQL of the query that computes the same."""
    def build(spark, sf_dir):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return decimals_to_double(reader.parquet(lake(spark, sf_dir)[path]))
    register(name, REGISTRY[twin].sql, note=f"as written by the batch run to {path}")(build)


_layer("medallion_fact", "silver/fact_orders", "fact_orders_enhanced",
       "order_id long, customer_id long, customer_name string, customer_segment string, order_date date, order_year long, "
       "order_month long, status string, total_amount double, product_id long, product_name string, product_category string, "
       "quantity long, unit_price double, line_total double, is_completed int, customer_data_quality double, "
       "line_calc_valid boolean, product_active boolean")
_layer("medallion_customers", "silver/customers", "clean_customers")
_layer("medallion_fraud", "gold/potential_fraud_orders", "fraud_orders")
_layer("medallion_quality", "quality/dq_summary", "dq_summary")
_layer("medallion_rfm", "gold/customer_rfm", "customer_rfm")


_LC = dedup_first("(SELECT customer_id, name, segment FROM raw_customers)", "customer_id", ["customer_id", "name", "segment"])
_LP = dedup_first("(SELECT product_id, product_name, category FROM raw_products)", "product_id",
                  ["product_id", "product_name", "category"])


@register("fact_orders", with_base(f"""
SELECT o.order_id, o.customer_id, c.name AS customer_name, c.segment AS customer_segment, o.order_date,
  CAST(year(o.d) AS BIGINT) AS order_year, CAST(month(o.d) AS BIGINT) AS order_month, o.status, o.total_amount,
  i.product_id, p.product_name, p.category AS product_category, i.quantity,
  CASE WHEN o.status = 'completed' THEN 1 ELSE 0 END AS is_completed
FROM (SELECT *, {parse_date('order_date')} AS d FROM orders_dedup) o
LEFT JOIN ({_LC}) c ON o.customer_id = c.customer_id
LEFT JOIN raw_items i ON o.order_id = i.order_id
LEFT JOIN ({_LP}) p ON i.product_id = p.product_id"""))
def q_fact_orders(spark, sf_dir):
    """The raw-column fact (item grain, de-duplicated dims)."""
    c = ctx(spark, sf_dir)
    orders = M.dedup_keep_first(c.raw_orders, ["order_id"]).withColumn("order_date_parsed", C.parse_date("order_date"))
    enriched = CL.enrich_orders(orders, "order_date_parsed", "status")
    return M.fact_orders_legacy(enriched, c.raw_customers, c.raw_items, c.raw_products)


@register("distinct_filter_values", with_base("SELECT DISTINCT status_cleaned AS status FROM orders_clean ORDER BY status"))
def q_distinct_filter_values(spark, sf_dir):
    """The values offered by a status filter box."""
    return ctx(spark, sf_dir).orders_clean.select(F.col("status_cleaned").alias("status")).distinct().orderBy("status")


@register("recent_orders_filtered", with_base("""
SELECT order_id, customer_id, event_time, status, total_amount FROM events_enriched
WHERE status = 'completed' AND total_amount >= 100 ORDER BY event_time DESC, order_id DESC LIMIT 100"""))
def q_recent_orders_filtered(spark, sf_dir):
    """Newest completed orders of at least 100, first 100."""
    ev = FR.enrich_order_events(ctx(spark, sf_dir).order_events)
    return latest_orders(ev, "completed", 100, 100).select("order_id", "customer_id", "event_time", "status",
                                                          "total_amount")


# ------------------------------------------------------------------ P2 / F8: incremental
@register("gold_incremental", GOLD_SQL, note="three deliveries; the last only brings copies of orders delivered before")
def q_gold_incremental(spark, sf_dir):
    c = context(spark, sf_dir)
    store, replay = GoldStore(spark, shared_dir(spark, "gold_store"), c.rules), F.col("source_system") == "replay"
    customers = c.customers_clean
    for name, part in (("first", ~replay & (F.col("order_id") % 10 < 7)), ("second", ~replay & (F.col("order_id") % 10 >= 7)), ("copies", replay)):
        store.deliver(name, c.raw_orders.filter(part), customers)
    return store.gold()
