"""End-to-end batch flows (P1, P2): quality suite and the Bronze -> Silver -> Gold run.

Each layer is written and the next layer reads the written data, as a
scheduled medallion job does; the writes also cut the plan lineage, so a
lost executor re-reads a layer instead of recomputing from the raw feed.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import cleaning as C
from basketry.functions.rules import RuleSet, tpch_rules
from basketry.operators import analytics as A
from basketry.operators import cleaning as CL
from basketry.operators import fraud as FR
from basketry.operators import model as M
from basketry.operators import quality as Q
from basketry.operators.model import dedup_keep_first
from basketry.sinks import layers as LY

# What the driver may build for broadcasts: rows of a joined table, and repeated order ids
BROADCAST_ROWS, BROADCAST_KEYS = 100_000, 500_000


@dataclass
class MedallionPaths:
    root: str

    def __getitem__(self, name: str) -> str:
        return f"{self.root}/{name}"


def quality_suite(orders: DataFrame, customers: DataFrame, items: DataFrame, products: DataFrame,
                  as_of) -> dict[str, DataFrame]:
    """P1 over tables that are already there: the quality reports, one aggregate pass each; dates after ``as_of`` are invalid."""
    dated = CL.standardize_dates(orders, "order_date")
    tables = {"orders": orders, "customers": customers, "order_items": items, "products": products}
    return {
        "dq_summary": Q.quality_summary(tables),
        "referential_integrity": Q.referential_integrity(orders, customers, items, products),
        "null_counts_orders": Q.null_counts(orders),
        "duplicate_order_ids": Q.duplicate_keys(orders, "order_id"),
        "duplicate_customer_ids": Q.duplicate_keys(customers, "customer_id"),
        "order_date_range": Q.date_range(dated, "order_date_cleaned"),
        "invalid_dates": A.invalid_dates(dated, as_of),
        "invalid_emails": A.invalid_emails(customers),
        "negative_amounts": A.negative_amounts(orders),
    }


def together(spark: SparkSession, *jobs: Callable[[], object]) -> None:
    """Runs independent jobs at the same time: while one waits for its last tasks, the others fill the cluster.

    All are waited for; the first failure is raised.
    """
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    for job in running:
        job.result()


def counted(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most ``rows`` rows, to be joined: broadcast if they are few, else both sides are shuffled and merged.

    Without the hint Spark takes a layer's compressed files, cut down to the columns read, for its size; that is many times too
    small, and AQE does not take a broadcast back that saves a shuffle.  The driver would build tables of millions of rows, several at once.
    """
    return df.hint("broadcast" if rows <= BROADCAST_ROWS else "merge")


def write_bronze_measured(spark: SparkSession, raw: dict[str, DataFrame], root: str) -> tuple[dict[str, str], dict[str, dict]]:
    """Bronze as ``layers.write_bronze`` writes it; also what the quality reports need of every row, measured on the way."""
    paths, seen = {n: f"{root}/bronze/{n}" for n in raw}, {}

    def write(name: str) -> None:
        dates = {"order_date": C.parse_date("order_date")} if name == "orders" else None
        seen[name] = LY.write_measured(raw[name], paths[name], Q.write_metrics(raw[name], dates))
    together(spark, *[partial(write, name) for name in raw])
    return paths, seen


def write_order_keys(spark: SparkSession, orders: DataFrame, p: MedallionPaths) -> DataFrame | None:
    """Counts the rows of each order id once, for the reports and for the de-duplication; returns the ids that repeat (F10), to be
    broadcast, or None if they are too many for that."""
    LY.write_parquet(Q.key_counts(orders, "order_id"), p["quality/order_keys"])
    many = spark.read.parquet(p["quality/order_keys"]).filter(F.col("row_count") > 1)
    seen = LY.write_measured(many, p["quality/duplicate_order_ids"], {"rows": F.count(F.lit(1))})
    return F.broadcast(spark.read.parquet(p["quality/duplicate_order_ids"])) if seen["rows"] <= BROADCAST_KEYS else None


def write_quality(spark: SparkSession, bronze: dict[str, DataFrame], seen: dict[str, dict], p: MedallionPaths, as_of) -> None:
    """The quality reports.  What a report needs of each row was measured while Bronze was written, and the rows of each
    order id were counted for Silver (``write_order_keys``); beyond that, orders are read for their customers and for the rows
    that reports list."""
    orders, customers = bronze["orders"], bronze["customers"]

    def keys() -> None:
        known = spark.read.parquet(p["quality/order_keys"])
        distinct = {n: Q.row_count(known) if n == "orders" else Q.distinct_count(df, Q.id_column(df)) for n, df in bronze.items()}
        summary = [Q.measured_summary(n, bronze[n].columns, seen[n], df) for n, df in distinct.items()]
        linked = [counted(bronze[n], seen[n]["rows"]) for n in ("orders", "customers", "order_items", "products")]
        links = Q.referential_integrity(*linked, counted(known, seen["orders"]["rows"]))
        together(spark, lambda: LY.write_parquet(reduce(DataFrame.unionByName, summary), p["quality/dq_summary"]),
                 lambda: LY.write_parquet(links, p["quality/referential_integrity"]))

    def listed() -> None:
        dated = CL.standardize_dates(orders, "order_date")
        # one mention of the parsed date: the filter goes below the projection, where each mention would parse the text anew
        odd = ~F.coalesce(F.col("order_date_cleaned") <= as_of, F.lit(False)) | (F.col("total_amount") < 0)
        LY.write_parquet(dated.filter(odd), p["quality/odd_orders"])
        rows = spark.read.parquet(p["quality/odd_orders"])
        LY.write_parquet(A.invalid_dates(rows, as_of), p["quality/invalid_dates"])
        LY.write_parquet(A.negative_amounts(rows).select(*orders.columns), p["quality/negative_amounts"])

    together(spark, keys, listed,
             lambda: LY.write_parquet(Q.measured_null_counts(spark, orders.columns, seen["orders"]), p["quality/null_counts_orders"]),
             lambda: LY.write_parquet(Q.measured_date_range(spark, "order_date", seen["orders"]), p["quality/order_date_range"]),
             lambda: LY.write_parquet(Q.duplicate_keys(customers, "customer_id"), p["quality/duplicate_customer_ids"]),
             lambda: LY.write_parquet(A.invalid_emails(customers), p["quality/invalid_emails"]))


def run_batch_medallion(spark: SparkSession, raw: dict[str, DataFrame], root: str,
                        rules: RuleSet | None = None) -> MedallionPaths:
    """Raw -> Bronze -> quality reports -> Silver -> Gold and exports; tables that do not need each other at the same time."""
    rules = rules or tpch_rules()
    p = MedallionPaths(root)
    # Bronze: the feeds as delivered
    paths, seen = write_bronze_measured(spark, raw, root)
    schemas = {"orders": LY.ORDERS_SCHEMA, "customers": LY.CUSTOMERS_SCHEMA, "order_items": LY.ITEMS_SCHEMA, "products": LY.PRODUCTS_SCHEMA}
    bronze = {n: spark.read.schema(s).parquet(paths[n]) for n, s in schemas.items()}
    # Silver orders first: de-duplicated once, read by everything below, and the source of as_of
    clean = partial(CL.clean_dated_orders, rules=rules.cleaning)

    def orders() -> None:
        once = dedup_keep_first(bronze["orders"], ["order_id"], repeated=write_order_keys(spark, bronze["orders"], p))
        dated = CL.enrich_dates(CL.standardize_dates(once, "order_date"), "order_date_cleaned")
        LY.write_partitioned(dated, p["silver/orders"], then=clean)

    together(spark, orders,
             lambda: LY.write_parquet(CL.clean_items(bronze["order_items"], rules.cleaning), p["silver/order_items"]),
             lambda: LY.write_parquet(CL.clean_products(bronze["products"], rules.cleaning), p["silver/products"]))
    typed = CL.clean_orders(bronze["orders"], rules.cleaning).schema                 # of the partition columns too
    s_orders = spark.read.schema(typed).parquet(p["silver/orders"])
    newest = s_orders.select(F.max(F.when(F.col("is_valid_order") == 1, F.col("order_date_cleaned")))).first()[0]
    as_of = F.lit(newest).cast("date")
    # P1 reports beside the rest of Silver: cleaned customers, and the reports of orders alone
    together(spark, lambda: write_quality(spark, bronze, seen, p, as_of),
             lambda: LY.write_parquet(CL.clean_customers(bronze["customers"], as_of, rules.cleaning), p["silver/customers"]),
             lambda: LY.write_parquet(A.monthly_revenue(s_orders), p["gold/monthly_revenue"]),
             lambda: LY.write_parquet(A.status_distribution(s_orders), p["gold/status_distribution"]),
             lambda: LY.write_parquet(A.overall_revenue(s_orders), p["gold/overall_revenue"]))
    # joins go by the rows counted in Bronze: Silver has no more
    s_orders = counted(s_orders, seen["orders"]["rows"])
    s_customers, s_items, s_products = (counted(spark.read.parquet(p[f"silver/{n}"]), seen[n]["rows"])
                                        for n in ("customers", "order_items", "products"))
    fact = M.fact_orders_by_month(s_orders, s_customers, s_items, s_products)

    # facts partitioned by year/month, and what reads them; exports: the Gold table is small (one file), fraud keeps its partitioning
    def facts() -> None:
        LY.write_partitioned(fact, p["silver/fact_orders"], met=True)
        LY.write_parquet(A.category_performance(spark.read.schema(fact.schema).parquet(p["silver/fact_orders"])), p["gold/category_performance"])

    def gold() -> None:
        LY.write_parquet(M.gold_segment_monthly(s_orders, s_customers, as_of, rules.rfm), p["gold/customer_segment_monthly"])
        LY.write_csv_export(spark.read.parquet(p["gold/customer_segment_monthly"]), p["exports/gold_customer_segment_monthly_csv"])

    def fraud() -> None:
        LY.write_parquet(FR.fraud_orders(s_orders, s_items, rules.fraud), p["gold/potential_fraud_orders"])
        LY.write_csv_export(spark.read.parquet(p["gold/potential_fraud_orders"]), p["exports/potential_fraud_orders"], single_file=False)

    together(spark, facts, gold, fraud,
             lambda: LY.write_parquet(M.customer_metrics(s_orders, s_customers, as_of), p["silver/customer_metrics"]),
             lambda: LY.write_parquet(M.customer_rfm(s_orders, s_customers, as_of, rules.rfm), p["gold/customer_rfm"]),
             lambda: LY.write_parquet(A.segment_analysis(s_orders, s_customers), p["gold/segment_analysis"]),
             lambda: LY.write_parquet(A.revenue_anomalies(spark.read.parquet(p["gold/monthly_revenue"]), 0.2), p["gold/revenue_anomalies"]))
    return p


def latest_orders(orders: DataFrame, status: str | None, min_amount: float | None, n: int) -> DataFrame:
    """Newest orders, optionally of one status and above an amount (top-n)."""
    df = orders
    if status is not None:
        df = df.filter(F.col("status") == status)
    if min_amount is not None:
        df = df.filter(F.col("total_amount") >= min_amount)
    return df.orderBy(F.desc("event_time"), F.desc("order_id")).limit(n)
