"""Registered source/sink round trips.

Each query writes through the sink under the session's shared checkpoint
folder (``spark.checkpoint.dir``), then returns the data read back through
the matching source, so the oracle checks what actually landed on storage.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators import fraud as FR
from basketry.operators import model as M
from basketry.plans.context import context
from basketry.plans.q_batch import GOLD_SQL
from basketry.plans.q_fraud import FRAUD_CTE
from basketry.plans.oracle import with_base
from basketry.plans.registry import decimals_to_double, register
from basketry.session import shared_dir
from basketry.sinks import layers as LY


def ctx(spark, sf_dir):
    return context(spark, sf_dir)



@register("scan_csv_orders", with_base("SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount) FROM raw_orders"))
def q_scan_csv_orders(spark, sf_dir):
    c = ctx(spark, sf_dir)
    path = shared_dir(spark, "orders_csv")
    c.raw_orders.write.mode("overwrite").options(**LY._CSV).csv(path)
    return decimals_to_double(LY.read_orders_csv(spark, path))


@register("scan_csv_items", with_base("""
SELECT * REPLACE (CAST(price AS DOUBLE) AS price, CAST(discount_percent AS DOUBLE) AS discount_percent,
  CAST(tax_amount AS DOUBLE) AS tax_amount, CAST(line_total AS DOUBLE) AS line_total) FROM raw_items"""))
def q_scan_csv_items(spark, sf_dir):
    c = ctx(spark, sf_dir)
    path = shared_dir(spark, "items_csv")
    c.raw_items.write.mode("overwrite").options(**LY._CSV).csv(path)
    return decimals_to_double(LY.read_items_csv(spark, path))


@register("scan_json_customers", with_base("SELECT * FROM raw_customers"))
def q_scan_json_customers(spark, sf_dir):
    c = ctx(spark, sf_dir)
    path = shared_dir(spark, "customers_json")
    c.raw_customers.write.mode("overwrite").json(path)
    return LY.read_customers_json(spark, path)


@register("scan_parquet_products", with_base(
    "SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price, CAST(cost AS DOUBLE) AS cost) FROM raw_products"))
def q_scan_parquet_products(spark, sf_dir):
    c = ctx(spark, sf_dir)
    path = shared_dir(spark, "products_parquet")
    c.raw_products.write.mode("overwrite").parquet(path)
    return decimals_to_double(LY.read_products_parquet(spark, path))


@register("bronze_roundtrip", with_base("""
SELECT 'orders' AS table_name, count(*) AS row_count FROM raw_orders UNION ALL
SELECT 'customers', count(*) FROM raw_customers UNION ALL
SELECT 'order_items', count(*) FROM raw_items UNION ALL
SELECT 'products', count(*) FROM raw_products"""))
def q_bronze_roundtrip(spark, sf_dir):
    c = ctx(spark, sf_dir)
    paths = LY.write_bronze(shared_dir(spark, "lake"), {"orders": c.raw_orders, "customers": c.raw_customers,
                                                         "order_items": c.raw_items, "products": c.raw_products})
    frames = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
              for n, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _bronze(name: str, table: str, schema: T.StructType, frame: str) -> None:
    """B1: one raw table, written to Bronze and read back with its declared schema, all rows and columns."""
    def build(spark, sf_dir):
        paths = LY.write_bronze(shared_dir(spark, "lake"), {table: getattr(ctx(spark, sf_dir), frame)})
        return decimals_to_double(spark.read.schema(schema).parquet(paths[table]))
    register(name, with_base(f"SELECT * FROM {frame}"))(build)


_bronze("bronze_orders", "orders", LY.ORDERS_SCHEMA, "raw_orders")
_bronze("bronze_customers", "customers", LY.CUSTOMERS_SCHEMA, "raw_customers")
_bronze("bronze_order_items", "order_items", LY.ITEMS_SCHEMA, "raw_items")
_bronze("bronze_products", "products", LY.PRODUCTS_SCHEMA, "raw_products")


SILVER_SCHEMA = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("status_cleaned", T.StringType()),
                              T.StructField("total_amount_cleaned", T.DoubleType()),
                              T.StructField("order_year", T.LongType()), T.StructField("order_month", T.LongType())])


@register("silver_partition_roundtrip", with_base("""
SELECT order_id, status_cleaned, CAST(total_amount_cleaned AS DOUBLE) AS total_amount_cleaned, order_year, order_month
FROM orders_clean"""))
def q_silver_roundtrip(spark, sf_dir):
    c = ctx(spark, sf_dir)
    path = LY.write_partitioned(c.orders_clean.select("order_id", "status_cleaned", "total_amount_cleaned",
                                                      "order_year", "order_month"), shared_dir(spark, "silver_orders"))
    return decimals_to_double(spark.read.schema(SILVER_SCHEMA).parquet(path))


@register("gold_roundtrip", GOLD_SQL)
def q_gold_roundtrip(spark, sf_dir):
    c = ctx(spark, sf_dir)
    path = LY.write_parquet(M.gold_segment_monthly(c.orders_clean, c.customers_clean, c.as_of, c.rules.rfm),
                            shared_dir(spark, "gold"))
    return spark.read.parquet(path)


GOLD_CSV_SCHEMA = T.StructType([
    T.StructField("order_year", T.LongType()), T.StructField("order_month", T.LongType()),
    T.StructField("customer_segment", T.StringType()), T.StructField("value_segment", T.StringType()),
    T.StructField("revenue", T.DoubleType()), T.StructField("order_count", T.LongType()),
    T.StructField("customer_count", T.LongType())])


@register("export_csv_roundtrip", GOLD_SQL)
def q_export_csv(spark, sf_dir):
    c = ctx(spark, sf_dir)
    gold = M.gold_segment_monthly(c.orders_clean, c.customers_clean, c.as_of, c.rules.rfm)
    path = LY.write_csv_export(gold.select(*GOLD_CSV_SCHEMA.fieldNames()), shared_dir(spark, "gold_csv"), single_file=True)
    return LY.read_csv_export(spark, path, GOLD_CSV_SCHEMA)


FRAUD_CSV_SCHEMA = T.StructType([
    T.StructField("order_id", T.LongType()), T.StructField("customer_id", T.LongType()),
    T.StructField("order_date_cleaned", T.DateType()), T.StructField("total_amount_cleaned", T.DoubleType()),
    T.StructField("total_quantity", T.LongType()), T.StructField("max_item_quantity", T.LongType()),
    T.StructField("fraud_score", T.LongType()), T.StructField("fraud_type", T.StringType()),
    T.StructField("risk_level", T.StringType()), T.StructField("potential_fraud", T.BooleanType())])


@register("scan_csv_export", with_base("SELECT * FROM fraud WHERE potential_fraud", FRAUD_CTE))
def q_fraud_export(spark, sf_dir):
    """B5 + A11: fraud orders exported as CSV (kept partitioned - it is not a
    small aggregate) and read back from all part files."""
    c = ctx(spark, sf_dir)
    fraud = decimals_to_double(FR.fraud_orders(c.orders_clean, c.items_clean, c.rules.fraud))
    path = LY.write_csv_export(fraud, shared_dir(spark, "fraud_csv"), single_file=False)
    return LY.read_csv_export(spark, path, FRAUD_CSV_SCHEMA)


@register("layer_freshness", "SELECT unnest(['bronze', 'silver', 'gold']) AS layer, true AS has_files, true AS written_now",
          note="file counts and modification times depend on the run, so the result tells what must hold of them")
def q_layer_freshness(spark, sf_dir):
    recent = F.col("last_modified") > F.current_timestamp() - F.expr("INTERVAL 1 DAY")
    return _freshness(spark, sf_dir).select("layer", (F.col("files") > 0).alias("has_files"), recent.alias("written_now"))


def _freshness(spark, sf_dir):
    c = ctx(spark, sf_dir)
    root = shared_dir(spark, "lake")
    bronze = LY.write_bronze(root, {"orders": c.raw_orders})
    silver = LY.write_partitioned(c.orders_clean.select("order_id", "order_year", "order_month"), f"{root}/silver/orders")
    gold = LY.write_parquet(M.gold_segment_monthly(c.orders_clean, c.customers_clean, c.as_of, c.rules.rfm),
                            f"{root}/gold/segment_monthly")
    return LY.layer_freshness(spark, {"bronze": bronze["orders"], "silver": silver, "gold": gold})
