"""Registered cleaning queries (C1-C14) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import cleaning as C
from basketry.operators import cleaning as CL
from basketry.plans.context import context
from basketry.plans.oracle import (RULES, clean_email, clean_name, clean_phone, clean_segment, clean_status,
                                   in_range, parse_bool, parse_date, with_base)
from basketry.plans.registry import decimals_to_double, register


def ctx(spark, sf_dir):
    return context(spark, sf_dir)


@register("clean_names", with_base(f"SELECT customer_id, name, {clean_name('name')} AS name_cleaned FROM raw_customers"))
def q_clean_names(spark, sf_dir):
    return CL.clean_names(ctx(spark, sf_dir).raw_customers.select("customer_id", "name"))


@register("clean_emails", with_base(f"SELECT customer_id, email, {clean_email('email')} AS email_cleaned FROM raw_customers"))
def q_clean_emails(spark, sf_dir):
    return CL.clean_emails(ctx(spark, sf_dir).raw_customers.select("customer_id", "email"))


@register("clean_dates", with_base(f"""
SELECT order_id, order_date, {parse_date('order_date')} AS order_date_cleaned FROM raw_orders
UNION ALL
SELECT customer_id, join_date, {parse_date('join_date')} FROM raw_customers"""))
def q_clean_dates(spark, sf_dir):
    c = ctx(spark, sf_dir)
    o = CL.standardize_dates(c.raw_orders.select("order_id", "order_date"), "order_date")
    cu = CL.standardize_dates(c.raw_customers.select("customer_id", "join_date"), "join_date")
    return o.union(cu)


@register("clean_status", with_base(f"SELECT order_id, status, {clean_status('status')} AS status_cleaned FROM raw_orders"))
def q_clean_status(spark, sf_dir):
    return CL.clean_status(ctx(spark, sf_dir).raw_orders.select("order_id", "status"))


@register("clean_segments", with_base(f"SELECT customer_id, segment, {clean_segment('segment')} AS segment_cleaned FROM raw_customers"))
def q_clean_segments(spark, sf_dir):
    return CL.clean_segments(ctx(spark, sf_dir).raw_customers.select("customer_id", "segment"))


@register("clean_booleans", with_base(f"""
SELECT customer_id AS id, marketing_opt_in AS raw_value, {parse_bool('marketing_opt_in')} AS value_cleaned FROM raw_customers
UNION ALL
SELECT product_id, is_active, {parse_bool('is_active')} FROM raw_products"""))
def q_clean_booleans(spark, sf_dir):
    c = ctx(spark, sf_dir)
    a = c.raw_customers.select(F.col("customer_id").alias("id"), F.col("marketing_opt_in").alias("raw_value"))
    b = c.raw_products.select(F.col("product_id").alias("id"), F.col("is_active").alias("raw_value"))
    return a.union(b).withColumn("value_cleaned", C.parse_boolean("raw_value"))


@register("clean_numeric", with_base(f"""
SELECT item_id, quantity, {in_range('quantity', *RULES.cleaning.item_quantity)} AS quantity_cleaned,
  CAST(price AS DOUBLE) AS price, CAST({in_range('price', *RULES.cleaning.item_price)} AS DOUBLE) AS price_cleaned
FROM raw_items"""))
def q_clean_numeric(spark, sf_dir):
    c = ctx(spark, sf_dir)
    r = c.rules.cleaning
    df = c.raw_items.select("item_id", "quantity", "price")
    df = CL.clean_numeric(df, "quantity", *r.item_quantity)
    return decimals_to_double(CL.clean_numeric(df, "price", *r.item_price))


@register("clean_phones", with_base(f"SELECT customer_id, phone, {clean_phone('phone')} AS phone_cleaned FROM raw_customers"))
def q_clean_phones(spark, sf_dir):
    return CL.clean_phones(ctx(spark, sf_dir).raw_customers.select("customer_id", "phone"))


@register("dq_row_score", with_base("SELECT customer_id, data_quality_score FROM customers_clean"))
def q_dq_row_score(spark, sf_dir):
    return ctx(spark, sf_dir).customers_clean.select("customer_id", "data_quality_score")


@register("enrich_orders", with_base(f"""
SELECT order_id, CAST(year(d) AS BIGINT) AS order_year, CAST(month(d) AS BIGINT) AS order_month,
  CASE WHEN status = 'completed' THEN 1 ELSE 0 END AS is_completed
FROM (SELECT order_id, status, {parse_date('order_date')} AS d FROM raw_orders)"""))
def q_enrich_orders(spark, sf_dir):
    df = ctx(spark, sf_dir).raw_orders.select("order_id", "status", C.parse_date("order_date").alias("d"))
    return CL.enrich_orders(df, "d", "status").select("order_id", "order_year", "order_month", "is_completed")


ORDER_OUT = ["order_id", "customer_id", "order_date", "status", "total_amount", "source_system", "last_updated", "order_date_cleaned",
             "status_cleaned", "total_amount_cleaned", "order_year", "order_month", "is_completed", "is_valid_order"]


@register("clean_orders", with_base(f"""
SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount, CAST(total_amount_cleaned AS DOUBLE) AS total_amount_cleaned)
FROM orders_clean"""))
def q_clean_orders(spark, sf_dir):
    return decimals_to_double(ctx(spark, sf_dir).orders_clean.select(*ORDER_OUT))


@register("clean_customers", with_base("SELECT * FROM customers_clean"))
def q_clean_customers(spark, sf_dir):
    return ctx(spark, sf_dir).customers_clean


@register("clean_items", with_base("""
SELECT * REPLACE (CAST(price AS DOUBLE) AS price, CAST(discount_percent AS DOUBLE) AS discount_percent,
  CAST(tax_amount AS DOUBLE) AS tax_amount, CAST(line_total AS DOUBLE) AS line_total, CAST(price_cleaned AS DOUBLE) AS price_cleaned,
  CAST(discount_percent_cleaned AS DOUBLE) AS discount_percent_cleaned, CAST(subtotal_calculated AS DOUBLE) AS subtotal_calculated,
  CAST(discount_amount_calculated AS DOUBLE) AS discount_amount_calculated, CAST(line_total_calculated AS DOUBLE) AS line_total_calculated)
FROM items_clean"""))
def q_clean_items(spark, sf_dir):
    return decimals_to_double(ctx(spark, sf_dir).items_clean)


@register("clean_products", with_base("""
SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price, CAST(cost AS DOUBLE) AS cost,
  CAST(unit_price_cleaned AS DOUBLE) AS unit_price_cleaned, CAST(cost_cleaned AS DOUBLE) AS cost_cleaned)
FROM products_clean"""))
def q_clean_products(spark, sf_dir):
    return decimals_to_double(ctx(spark, sf_dir).products_clean)
