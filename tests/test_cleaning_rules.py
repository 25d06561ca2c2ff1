"""Column rules on literal frames holding the dirty values the feeds carry."""
import datetime as dt

from pyspark.sql import functions as F

from basketry.functions import cleaning as C
from basketry.operators import cleaning as CL


def one_col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_names(spark):
    vals = ["  Smith,  John ", "Mr. John Smith", "Ms.Jane Doe", "Dr. Who", "Unknown", "N/A", "tbd", "TEST USER",
            "", None, "José O'Neil", "single"]
    got = one_col(spark, vals, C.clean_name)
    assert got == ["Smith, John", "John Smith", "Jane Doe", "Who", None, None, None, None, None, None,
                   "José O'Neil", "single"]
    assert one_col(spark, ["mary  ann"], lambda c: C.clean_name(c, title_case=True)) == ["Mary Ann"]


def test_emails(spark):
    vals = [None, "notanemail", "user@", "@domain.com", "user..name@domain.com", "user@domain",
            "user name@domain.com", "", "N/A", "TBD", "User@Example.COM", " pad@example.com"]
    got = one_col(spark, vals, C.clean_email)
    assert got == [None, None, None, None, "user..name@domain.com", None, None, None, None, None,
                   "user@example.com", None]


def test_dates(spark):
    vals = ["2024-01-15", "01/15/2024", "15-01-2024", "20240115", "January 15, 2024", None, "2024-13-45",
            "2023-02-30", "2024-01-15 10:00:00", "garbage"]
    got = one_col(spark, vals, C.parse_date)
    d = dt.date(2024, 1, 15)
    assert got == [d, d, d, d, d, None, None, None, None, None]


def test_status(spark):
    vals = ["Completed", " COMPLETE ", "canceled", "CANCELLED", "processing", "Pending", "delivered", "SHIPPED",
            "returned", "Refunded", "error", "FAILED", "unknwon", "", None, "On Hold"]
    got = one_col(spark, vals, C.clean_status)
    assert got == ["completed", "completed", "cancelled", "cancelled", "pending", "pending", "shipped", "shipped",
                   "refunded", "refunded", "failed", "failed", "unknown", "unknown", "unknown", "on hold"]


def test_segments(spark):
    vals = ["vip", "Gold ", "premium", "Standard", "basic", "SILVER", "regular", "New", "bronze", "Inactive",
            " Churned ", "Prospect", None, "", "Unknown", "TBD", "N/A"]
    got = one_col(spark, vals, C.clean_segment)
    assert got == ["Premium", "Premium", "Premium", "Regular", "Regular", "Regular", "Regular", "Bronze", "Bronze",
                   "Inactive", "Churned", "Prospect", "Unknown", "Unknown", "Unknown", "Unknown", "Unknown"]


def test_booleans(spark):
    vals = ["True", "false", "Yes", "no", "Y", "n", "1", "0", "Active", "INACTIVE", "", None, "maybe", "t", "F"]
    got = one_col(spark, vals, C.parse_boolean)
    assert got == [True, False, True, False, True, False, True, False, True, False, None, None, None, True, False]


def test_numeric_range(spark):
    got = one_col(spark, [None, -5, 0, 1, 50, 100, 101], lambda c: C.in_range(c, 1, 100), "int")
    assert got == [None, None, None, 1, 50, 100, None]
    assert one_col(spark, [-1, 7], lambda c: C.in_range(c, None, 5), "int") == [-1, None]


def test_phones(spark):
    vals = ["+1-555-123-4567", "555.123.4567", "(555) 123-4567", "5551234567", "123-456-7890", None, "", "N/A",
            "Unknown", "123-4567", "15551234567"]
    got = one_col(spark, vals, C.clean_phone)
    p = "+1-555-123-4567"
    assert got == [p, p, p, p, None, None, None, None, None, None, p]


def test_quality_score(spark):
    df = spark.createDataFrame([(1, "a", "x@y.com", dt.date(2020, 1, 1)), (2, None, "", None), (None, " ", None, None)],
                               "customer_id int, name_cleaned string, email_cleaned string, join_date_cleaned date")
    req = ["customer_id", "name_cleaned", "email_cleaned", "join_date_cleaned"]
    got = [r[0] for r in CL.quality_score(df, req).select("data_quality_score").collect()]
    assert got == [100.0, 25.0, 0.0]


def test_category_and_product_name(spark):
    vals = ["electronics", "HOME_KITCHEN", "Kitchen", "sports", "Books", "Tech", "", None, "Unknown", " Media "]
    got = one_col(spark, vals, C.category_from_text)
    assert got == ["Electronics", "Home & Kitchen", "Home & Kitchen", "Sports & Outdoors", "Books", "Tech", "Other",
                   "Other", "Other", "Media"]
    assert one_col(spark, ["  lamp ", "TBD", None], C.product_name) == ["lamp", "Unknown Product", "Unknown Product"]


def test_items_line_totals(spark):
    rows = [(1, 10, 5, 2, 10.0, 10.0, 1.0, 19.0),
            (2, 10, 5, 2, 10.0, None, None, 25.0),
            (3, 10, 5, 0, 10.0, 10.0, None, None),
            (4, 10, 5, 3, -1.0, 150.0, None, 1.0),
            (5, 10, 5, 3, 19.99, 12.5, 0.07, 52.54)]
    df = spark.createDataFrame(rows, "item_id long, order_id long, product_id long, quantity long, price double, "
                                     "discount_percent double, tax_amount double, line_total double")
    out = {r.item_id: r for r in CL.clean_items(df).collect()}
    assert out[1].line_total_calculated == 19.0 and out[1].calculation_matches is True
    assert out[2].discount_amount_calculated == 0.0 and out[2].line_total_calculated == 20.0
    assert out[2].calculation_matches is False
    assert out[3].quantity_cleaned is None and out[3].line_total_calculated is None and out[3].calculation_matches is False
    assert out[4].price_cleaned is None and out[4].discount_percent_cleaned is None
    # 3 x 19.99 = 59.97; 12.5 % = 7.49625; + 0.07 -> 52.54375 (exact, not 52.543749999...)
    assert out[5].subtotal_calculated == 59.97 and out[5].discount_amount_calculated == 7.49625
    assert out[5].line_total_calculated == 52.54375 and out[5].calculation_matches is True


def test_products_margin(spark):
    rows = [(1, "a", "book", "b", 100.0, 60.0, "yes", "2020-01-01", 1.0),
            (2, "b", "x", "b", 0.0, 1.0, "0", "bad", 2000.0),
            (3, "c", "x", "b", 50.0, 80.0, None, None, None)]
    df = spark.createDataFrame(rows, "product_id long, product_name string, category string, subcategory string, "
                                     "unit_price double, cost double, is_active string, created_date string, "
                                     "weight_kg double")
    out = {r.product_id: r for r in CL.clean_products(df).collect()}
    assert out[1].margin_percent == 40.0 and out[1].price_cost_valid is True and out[1].category_cleaned == "Books"
    assert out[2].margin_percent is None and out[2].weight_kg_cleaned is None and out[2].is_active_cleaned is False
    assert out[3].price_cost_valid is False and out[3].margin_percent == -60.0
