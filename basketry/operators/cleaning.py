"""Table-level cleaning and enrichment.

Each composite is one ``withColumns`` projection over the column rules in
``basketry.functions.cleaning``: a narrow, shuffle-free stage that Catalyst
fuses with the scan.  ``as_of`` replaces ``current_date()`` so results do
not depend on the day the job runs; pass a date, or a Column such as
``orders_as_of(df)`` (a scalar subquery evaluated once per query).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions import cleaning as C
from basketry.functions import money
from basketry.functions.rules import CleaningRules

def as_of_column(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, (_dt.date, str)):
        return F.lit(str(as_of)).cast("date")
    return F.current_date()


def orders_as_of(orders: DataFrame, rules: CleaningRules = CleaningRules()) -> Column:
    """Latest date among valid order records, as a scalar subquery.

    Computed on the order feed as delivered (no de-duplication needed: a
    re-delivered record carries its order's date), so it is a scan with a
    partial max - it does not repeat the de-duplication shuffle.
    """
    o = clean_orders(orders, rules)
    # a conditional max, not a filter: a filter would be pushed below the
    # projection and evaluate the date parsing twice
    return o.select(F.max(F.when(F.col("is_valid_order") == 1, F.col("order_date_cleaned")))).scalar()


def clean_names(df: DataFrame, column: str = "name") -> DataFrame:
    return df.withColumn(f"{column}_cleaned", C.clean_name(column))


def clean_emails(df: DataFrame, column: str = "email") -> DataFrame:
    return df.withColumn(f"{column}_cleaned", C.clean_email(column))


def standardize_dates(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    return df.withColumn(output or f"{column}_cleaned", C.parse_date(column))


def clean_status(df: DataFrame, column: str = "status") -> DataFrame:
    return df.withColumn(f"{column}_cleaned", C.clean_status(column))


def clean_segments(df: DataFrame, column: str = "segment") -> DataFrame:
    return df.withColumn(f"{column}_cleaned", C.clean_segment(column))


def clean_booleans(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    return df.withColumn(output or f"{column}_cleaned", C.parse_boolean(column))


def clean_numeric(df: DataFrame, column: str, lo=None, hi=None, output: str | None = None) -> DataFrame:
    return df.withColumn(output or f"{column}_cleaned", C.in_range(column, lo, hi))


def clean_phones(df: DataFrame, column: str = "phone", output: str | None = None) -> DataFrame:
    return df.withColumn(output or f"{column}_cleaned", C.clean_phone(column))


def quality_score(df: DataFrame, required: list[str], output: str = "data_quality_score") -> DataFrame:
    return df.withColumn(output, C.completeness_score(required, dict(df.dtypes)))


def enrich_orders(df: DataFrame, date_col: str = "order_date", status_col: str = "status") -> DataFrame:
    """order_year, order_month, is_completed on already-typed columns."""
    return enrich_dates(df, date_col).withColumn("is_completed", F.when(F.col(status_col) == "completed", 1).otherwise(0))


def enrich_dates(df: DataFrame, date_col: str) -> DataFrame:
    return df.withColumns({"order_year": F.year(date_col).cast("long"), "order_month": F.month(date_col).cast("long")})


def valid_order(order_id: Column, customer_id: Column, order_date: Column, amount: Column) -> Column:
    """One validity predicate shared by batch and stream (1/0)."""
    return F.when(order_id.isNotNull() & customer_id.isNotNull() & order_date.isNotNull()
                  & amount.isNotNull() & (amount > 0), 1).otherwise(0)


def clean_orders(df: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """C11: dates, status, amount range, then year/month/is_completed/is_valid_order."""
    return clean_dated_orders(standardize_dates(df, "order_date"), rules)


def clean_dated_orders(df: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """C11 for orders whose date is parsed already (``order_date_cleaned``)."""
    lo, hi = rules.order_amount
    df = df.withColumns({
        "status_cleaned": C.clean_status("status"),
        "total_amount_cleaned": C.in_range("total_amount", lo, hi),
    })
    return enrich_orders(df, "order_date_cleaned", "status_cleaned").withColumn(
        "is_valid_order", valid_order(F.col("order_id"), F.col("customer_id"), F.col("order_date_cleaned"), F.col("total_amount_cleaned")))


CUSTOMER_REQUIRED = ["customer_id", "name_cleaned", "email_cleaned", "join_date_cleaned"]


def clean_customers(df: DataFrame, as_of=None, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Names, emails, join date, segment, opt-in, phone, quality score, tenure, age."""
    df = df.withColumns({
        "name_cleaned": C.clean_name("name"),
        "email_cleaned": C.clean_email("email"),
        "join_date_cleaned": C.parse_date("join_date"),
        "segment_cleaned": C.clean_segment("segment"),
        "marketing_opt_in_cleaned": C.parse_boolean("marketing_opt_in"),
        "phone_cleaned": C.clean_phone("phone"),
    })
    lo, hi = rules.age
    return df.withColumns({
        "data_quality_score": C.completeness_score(CUSTOMER_REQUIRED, dict(df.dtypes)),
        "tenure_days": F.datediff(as_of_column(as_of), F.col("join_date_cleaned")).cast("long"),
        "age_valid": C.in_range("age", lo, hi),
    })


def clean_items(df: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """C13 + L9: range-clean quantity/price/discount, recompute the line total.

    subtotal = qty x price; discount = subtotal x pct / 100 (0 when unknown);
    line total = subtotal - discount + tax (tax 0 when unknown);
    calculation_matches = |given - computed| < 0.01 (False when either is null).
    Computed in integer cents / micro-units, so it is exact and fast.
    """
    df = df.withColumns({
        "quantity_cleaned": C.in_range("quantity", *rules.item_quantity),
        "price_cleaned": C.in_range("price", *rules.item_price),
        "discount_percent_cleaned": C.in_range("discount_percent", *rules.item_discount),
    })
    qty, price = F.col("quantity_cleaned"), F.col("price_cleaned")
    # staged named columns: each intermediate is computed once per row
    df = df.withColumns({
        "_sub_c": F.when(qty.isNotNull() & price.isNotNull(), qty.cast("long") * money.cents(price)),
        "_pct_h": money.nearest_long(F.col("discount_percent_cleaned") * 100),   # hundredths of a percent
        "_tax_c": F.coalesce(money.cents("tax_amount"), F.lit(0).cast("long")),
    })
    sub_c = F.col("_sub_c")
    df = df.withColumn("_disc_u", F.when(sub_c.isNotNull() & F.col("_pct_h").isNotNull(), sub_c * F.col("_pct_h"))
                       .otherwise(F.lit(0).cast("long")))
    df = df.withColumn("_line_u", F.when(sub_c.isNotNull(), sub_c * 10000 - F.col("_disc_u") + F.col("_tax_c") * 10000))
    given_u = money.cents("line_total") * 10000
    return df.withColumns({
        "subtotal_calculated": money.from_cents(sub_c),
        "discount_amount_calculated": money.from_micros("_disc_u"),
        "line_total_calculated": money.from_micros("_line_u"),
        "calculation_matches": F.when(F.col("line_total").isNotNull() & sub_c.isNotNull(),
                                      F.abs(given_u - F.col("_line_u")) < 10000).otherwise(F.lit(False)),
    }).drop("_sub_c", "_pct_h", "_tax_c", "_disc_u", "_line_u")


def clean_products(df: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """C14: price/cost/weight ranges, active flag, created date, name, category, margin."""
    df = df.withColumns({
        "unit_price_cleaned": C.in_range("unit_price", *rules.product_price),
        "cost_cleaned": C.in_range("cost", *rules.product_price),
        "weight_kg_cleaned": C.in_range("weight_kg", *rules.product_weight),
        "is_active_cleaned": C.parse_boolean("is_active"),
        "created_date_cleaned": C.parse_date("created_date"),
        "product_name_cleaned": C.product_name("product_name"),
        "category_cleaned": C.category_from_text("category"),
    })
    p, c = F.col("unit_price_cleaned"), F.col("cost_cleaned")
    pc, cc = money.cents(p), money.cents(c)
    margin = (pc - cc).cast(T.DecimalType(20, 0)) * 100 / pc.cast(T.DecimalType(20, 0))   # exact, half-up below
    return df.withColumns({
        "margin_percent": F.when(p.isNotNull() & c.isNotNull() & (p > 0),
                                 F.round(margin.cast(T.DecimalType(38, 6)), 2)).cast("double"),
        "price_cost_valid": F.when(p.isNotNull() & c.isNotNull(), c <= p),
    })
