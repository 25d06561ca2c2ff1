"""Registered data-quality queries (F9-F16, E6, E7, G3, L8, M12, M13) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import analytics as A
from basketry.operators import quality as Q
from basketry.operators.model import dedup_keep_first
from basketry.plans.context import RetailContext, context
from basketry.plans.oracle import with_base
from basketry.plans.registry import decimals_to_double, register
from basketry.sources.tables import read_table


def ctx(spark, sf_dir):
    return context(spark, sf_dir)


# raw table -> (column, is_text) in column order (for the SQL oracle)
RAW_SCHEMAS = {
    "orders": ("raw_orders", [("order_id", 0), ("customer_id", 0), ("order_date", 1), ("status", 1),
                              ("total_amount", 0), ("source_system", 1), ("last_updated", 1)]),
    "customers": ("raw_customers", [("customer_id", 0), ("name", 1), ("email", 1), ("join_date", 1), ("segment", 1),
                                    ("phone", 1), ("age", 0), ("marketing_opt_in", 1), ("address", 1), ("last_login", 1)]),
    "order_items": ("raw_items", [("item_id", 0), ("order_id", 0), ("product_id", 0), ("quantity", 0), ("price", 0),
                                  ("discount_percent", 0), ("tax_amount", 0), ("line_total", 0)]),
    "products": ("raw_products", [("product_id", 0), ("product_name", 1), ("category", 1), ("subcategory", 1),
                                  ("unit_price", 0), ("cost", 0), ("is_active", 1), ("created_date", 1), ("weight_kg", 0), ("supplier_id", 0)]),
}


def _miss(c, text):
    return f"({c} IS NULL OR {c} = '')" if text else f"{c} IS NULL"


def _pct_sql(n, rows):
    return f"CASE WHEN {rows} > 0 THEN round(CAST(CAST({n} AS DECIMAL(20,0)) * 100 / {rows} AS DECIMAL(38,6)), 2) ELSE 0 END"


def _column_report_sql():
    parts = []
    for table, (view, cols) in RAW_SCHEMAS.items():
        for c, text in cols:
            parts.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name, count_if({_miss(c, text)}) AS null_count, "
                         f"CAST({_pct_sql(f'count_if({_miss(c, text)})', 'count(*)')} AS DOUBLE) AS null_percentage FROM {view}")
    return "\nUNION ALL\n".join(parts)


def _summary_sql():
    parts = []
    for table, (view, cols) in RAW_SCHEMAS.items():
        idc = next(c for c, _ in cols if "id" in c)
        comp = " + ".join(f"(100 - {_pct_sql(f'count_if({_miss(c, t)})', 'count(*)')})" for c, t in cols)
        parts.append(
            f"SELECT '{table}' AS table_name, count(*) AS total_rows, CAST({len(cols)} AS BIGINT) AS total_columns, "
            f"CAST(count(*) - count(DISTINCT {idc}) - max(CASE WHEN {idc} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_rows, "
            f"CAST(CASE WHEN count(*) > 0 THEN round(CAST(({comp}) / {len(cols)} AS DECIMAL(38,6)), 2) ELSE 0 END AS DOUBLE) AS completeness_score "
            f"FROM {view}")
    return "\nUNION ALL\n".join(parts)


def raw_tables(c: RetailContext):
    return {"orders": c.raw_orders, "customers": c.raw_customers, "order_items": c.raw_items,
            "products": c.raw_products}


@register("null_counts", with_base("SELECT " + ", ".join(
    f"count_if({c} IS NULL) AS {c}" for c, _ in RAW_SCHEMAS["orders"][1]) + " FROM raw_orders"))
def q_null_counts(spark, sf_dir):
    return Q.null_counts(ctx(spark, sf_dir).raw_orders)


@register("nan_counts", "SELECT count_if(isnan(l_quantity)) AS l_quantity, count_if(isnan(l_extendedprice)) AS l_extendedprice, "
          "count_if(isnan(l_discount)) AS l_discount, count_if(isnan(l_tax)) AS l_tax FROM lineitem")
def q_nan_counts(spark, sf_dir):
    return Q.nan_counts(read_table(spark, sf_dir, "lineitem"))


@register("duplicate_keys", with_base(
    "SELECT customer_id, count(*) AS row_count FROM raw_customers GROUP BY customer_id HAVING count(*) > 1"))
def q_duplicate_keys(spark, sf_dir):
    return Q.duplicate_keys(ctx(spark, sf_dir).raw_customers, "customer_id")


@register("date_range", with_base("SELECT min(order_date_cleaned) AS earliest, max(order_date_cleaned) AS latest FROM orders_clean"))
def q_date_range(spark, sf_dir):
    return Q.date_range(ctx(spark, sf_dir).orders_clean, "order_date_cleaned")


@register("dq_column_report", with_base(_column_report_sql()))
def q_dq_column_report(spark, sf_dir):
    from functools import reduce
    from pyspark.sql import DataFrame
    return reduce(DataFrame.unionByName, [Q.column_report(df, t) for t, df in raw_tables(ctx(spark, sf_dir)).items()])


@register("dq_summary", with_base(_summary_sql()))
def q_dq_summary(spark, sf_dir):
    return Q.quality_summary(raw_tables(ctx(spark, sf_dir)))


@register("dq_overview", with_base(f"""
SELECT CAST(sum(total_rows) AS BIGINT) AS total_rows,
  CAST(round(CAST(avg(CAST(completeness_score AS DECIMAL(10,2))) AS DECIMAL(38,6)), 2) AS DOUBLE) AS avg_completeness,
  CAST(sum(duplicate_rows) AS BIGINT) AS duplicate_rows, count(*) AS tables,
  CAST((SELECT count(*) FROM orders_clean WHERE order_date_cleaned IS NULL OR order_date_cleaned > DATE '1998-01-01')
    + (SELECT count(*) FROM raw_customers WHERE email IS NULL OR NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$'))
    + (SELECT count(*) FROM raw_orders WHERE total_amount < 0) AS BIGINT) AS invalid_rows
FROM ({_summary_sql()})"""))
def q_dq_overview(spark, sf_dir):
    c = ctx(spark, sf_dir)
    invalid = (Q.row_count(A.invalid_dates(c.orders_clean, "1998-01-01")).union(Q.row_count(A.invalid_emails(c.raw_customers)))
               .union(Q.row_count(A.negative_amounts(c.raw_orders))))
    return Q.quality_overview(Q.quality_summary(raw_tables(c)), invalid)


@register("referential_integrity", with_base("""
SELECT 'orders_missing_customers' AS check_name, count(*) AS orphan_count FROM raw_orders o
  WHERE o.customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw_customers c WHERE c.customer_id = o.customer_id)
UNION ALL
SELECT 'order_items_missing_orders', count(*) FROM raw_items i
  WHERE i.order_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw_orders o WHERE o.order_id = i.order_id)
UNION ALL
SELECT 'order_items_missing_products', count(*) FROM raw_items i
  WHERE i.product_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw_products p WHERE p.product_id = i.product_id)"""))
def q_referential_integrity(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return Q.referential_integrity(c.raw_orders, c.raw_customers, c.raw_items, c.raw_products)


@register("quarantine_orders", with_base("""
SELECT order_id, customer_id, source_system,
  NOT (customer_id IS NOT NULL AND EXISTS (SELECT 1 FROM raw_customers c WHERE c.customer_id = o.customer_id)) AS quarantined
FROM raw_orders o"""))
def q_quarantine(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return Q.quarantine_split(c.raw_orders.select("order_id", "customer_id", "source_system"), c.raw_customers,
                              "customer_id")


ITEM_COLS = ["item_id", "order_id", "product_id", "quantity", "price", "discount_percent", "tax_amount", "line_total"]


@register("flag_duplicates", with_base("""
SELECT * REPLACE (CAST(price AS DOUBLE) AS price, CAST(discount_percent AS DOUBLE) AS discount_percent,
  CAST(tax_amount AS DOUBLE) AS tax_amount, CAST(line_total AS DOUBLE) AS line_total)
FROM (SELECT *, row_number() OVER (PARTITION BY order_id, item_id ORDER BY product_id NULLS FIRST, quantity NULLS FIRST,
        price NULLS FIRST, discount_percent NULLS FIRST, tax_amount NULLS FIRST, line_total NULLS FIRST) > 1 AS is_duplicate
      FROM raw_items)"""))
def q_flag_duplicates(spark, sf_dir):
    return decimals_to_double(Q.flag_duplicates(ctx(spark, sf_dir).raw_items, ["order_id", "item_id"]))


@register("dedup_keep_first", with_base("""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY name NULLS FIRST, email NULLS FIRST,
  join_date NULLS FIRST, segment NULLS FIRST, phone NULLS FIRST, age NULLS FIRST, marketing_opt_in NULLS FIRST, address NULLS FIRST, last_login NULLS FIRST) AS rn
  FROM raw_customers) WHERE rn = 1""".replace("SELECT * FROM (SELECT *,", "SELECT * EXCLUDE (rn) FROM (SELECT *,")))
def q_dedup_keep_first(spark, sf_dir):
    return dedup_keep_first(ctx(spark, sf_dir).raw_customers, ["customer_id"])


@register("iqr_outliers", with_base("""
SELECT order_id, CAST(total_amount_cleaned AS DOUBLE) AS total_amount,
  coalesce(CAST(total_amount_cleaned AS DOUBLE) < q1 - 1.5 * (q3 - q1) OR CAST(total_amount_cleaned AS DOUBLE) > q3 + 1.5 * (q3 - q1), false) AS is_outlier
FROM orders_clean, (SELECT round(quantile_cont(CAST(total_amount_cleaned AS DOUBLE), 0.25), 6) AS q1,
                           round(quantile_cont(CAST(total_amount_cleaned AS DOUBLE), 0.75), 6) AS q3
                    FROM orders_clean WHERE total_amount_cleaned IS NOT NULL)"""))
def q_iqr_outliers(spark, sf_dir):
    o = ctx(spark, sf_dir).orders_clean.select("order_id", "total_amount_cleaned")
    return (Q.iqr_outliers(o, "total_amount_cleaned", 1.5, "is_outlier")
            .select("order_id", F.col("total_amount_cleaned").cast("double").alias("total_amount"), "is_outlier"))


CLEAN_PAIRS = [("name", "name_cleaned"), ("email", "email_cleaned"), ("join_date", "join_date_cleaned"),
               ("phone", "phone_cleaned"), ("marketing_opt_in", "marketing_opt_in_cleaned")]


@register("cleaning_impact", with_base("\nUNION ALL\n".join(
    f"SELECT 'customers' AS table_name, '{raw}' AS column_name, count(*) AS total_rows, "
    f"count_if({raw} IS NULL OR {raw} = '') AS missing_before, count_if({clean} IS NULL"
    + (f" OR {clean} = ''" if clean != "join_date_cleaned" and clean != "marketing_opt_in_cleaned" else "")
    + ") AS missing_after FROM customers_clean" for raw, clean in CLEAN_PAIRS)))
def q_cleaning_impact(spark, sf_dir):
    return Q.cleaning_impact(ctx(spark, sf_dir).customers_clean, CLEAN_PAIRS, "customers")


def _impact_sql(table, view, pairs, text):
    """Missing before and after cleaning; ``text`` has the columns whose empty string counts as missing."""
    def miss(c):
        return f"{c} IS NULL" + (f" OR {c} = ''" if c in text else "")
    return "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, '{raw}' AS column_name, count(*) AS total_rows, count_if({miss(raw)}) AS missing_before, "
        f"count_if({miss(clean)}) AS missing_after FROM {view}" for raw, clean in pairs)


IMPACT = {
    "orders": ("orders_clean", [("order_date", "order_date_cleaned"), ("status", "status_cleaned"), ("total_amount", "total_amount_cleaned")],
               {"order_date", "status", "status_cleaned"}),
    "order_items": ("items_clean", [("quantity", "quantity_cleaned"), ("price", "price_cleaned"),
                                    ("discount_percent", "discount_percent_cleaned")], set()),
    "products": ("products_clean", [("product_name", "product_name_cleaned"), ("category", "category_cleaned"),
                                    ("unit_price", "unit_price_cleaned"), ("cost", "cost_cleaned"), ("is_active", "is_active_cleaned"),
                                    ("created_date", "created_date_cleaned"), ("weight_kg", "weight_kg_cleaned")],
                 {"product_name", "product_name_cleaned", "category", "category_cleaned", "is_active", "created_date"}),
}


@register("cleaning_impact_tables", with_base("\nUNION ALL\n".join(_impact_sql(t, *args) for t, args in IMPACT.items())))
def q_cleaning_impact_tables(spark, sf_dir):
    """Orders, items and products besides customers."""
    c = ctx(spark, sf_dir)
    frames = {"orders": c.orders_clean, "order_items": c.items_clean, "products": c.products_clean}
    out = [Q.cleaning_impact(df, IMPACT[t][1], t) for t, df in frames.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])
