"""Retail model derived from the driver tables.

The library's operators work on four raw retail tables (orders, customers,
order items, products), an order-event stream and a message log.  The test
cluster ships TPC-H-like tables instead, so this module maps them onto the
retail model with plain projections - no join, no shuffle - so the mapping
costs one narrow stage whatever the data size.

Real retail feeds are dirty (mixed date layouts, status spellings, sentinel
names, bad phones, negative amounts, orphan keys, re-delivered rows).  To give
the cleaners real work, each raw column takes a *deterministic* dirty variant
chosen from the row key, so any engine can reproduce the raw tables exactly.
Re-delivered duplicate rows come from exploding a per-row list of copies
(one scan, no filter) - the tables only ever grow, nothing is dropped.

Money columns are doubles with at most two decimals, as the feeds deliver
them; every derived amount is computed in whole cents (integer arithmetic)
and only then divided by 100, so any engine reproduces it bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.money import div_half_up, nearest_long
from basketry.functions.vocab import DATE_FORMATS
from basketry.sources.tables import read_table

MONEY = T.DoubleType()

# Output layouts used to render dirty date text (Spark pattern letters).
RENDER_FORMATS = DATE_FORMATS


def _pick(selector: Column, choices: list[Column | str | None], default=None) -> Column:
    """CASE selector WHEN 0 THEN choices[0] ... ELSE default (choices may be literals)."""
    expr = None
    for i, ch in enumerate(choices):
        val = ch if isinstance(ch, Column) else F.lit(ch)
        expr = F.when(selector == i, val) if expr is None else expr.when(selector == i, val)
    if default is not None:
        expr = expr.otherwise(default if isinstance(default, Column) else F.lit(default))
    return expr


def _render_date(d: Column, selector: Column) -> Column:
    return _pick(selector, [F.date_format(d, f) for f in RENDER_FORMATS])


# ---------------------------------------------------------------- orders
def orders_from(orders: DataFrame) -> DataFrame:
    """orders(order_id, customer_id, order_date, status, total_amount, source_system)."""
    k = F.col("o_orderkey")
    r = k % 101
    d = F.col("o_orderdate").cast("date")
    cust = (F.when(r == 7, F.lit(None).cast("long"))
            .when(r == 13, -1 - F.col("o_custkey"))          # orphan: no such customer
            .otherwise(F.col("o_custkey")))
    order_date = (F.when(r == 19, F.lit(None).cast("string"))
                  .when(r == 23, F.lit("1996-17-40"))
                  .when(r == 29, F.lit("1997-02-31"))         # impossible day
                  .otherwise(_render_date(d, k % 5)))
    v = k % 4
    by_state = (F.when(F.col("o_orderstatus") == "F", _pick(v, ["completed", "Completed", "COMPLETE", " completed "]))
                .when(F.col("o_orderstatus") == "O", _pick(v, ["pending", "PENDING", "Pending ", "pending"]))
                .otherwise(_pick(v, ["processing", "Processing", "shipped", "SHIPPED"])))
    status = (F.when(r == 31, F.lit(None).cast("string"))
              .when(r == 37, F.lit(""))
              .when(r == 41, F.lit("on its way"))
              .when(r == 43, F.lit("Refunded"))
              .when(r == 47, F.lit("RETURNED"))
              .when(r == 53, F.lit("canceled"))
              .when(r == 59, F.lit("Failed"))
              .when(r == 61, F.lit("on hold"))
              .otherwise(by_state))
    price = F.col("o_totalprice")
    amount = (F.when(r == 67, F.lit(None).cast(MONEY))
              .when(r == 71, -price)
              .when(r == 73, F.lit(0.0))
              .otherwise(price))
    at = F.col("o_orderdate")
    updated = _pick(k % 5, [F.lit(None).cast("string"), F.date_format(at, "yyyy-MM-dd HH:mm:ss"),
                            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(at, "MM/dd/yyyy"),
                            F.unix_timestamp(at.cast("timestamp")).cast("string")])
    # copy 1 = a re-delivery of the order: same id, lower-case status, replay source
    copies = F.array_compact(F.array(F.lit(0), F.when(k % 211 == 5, F.lit(1))))
    base = orders.select(
        F.explode(copies).alias("_copy"),
        k.alias("order_id"), cust.alias("customer_id"), order_date.alias("order_date"),
        status.alias("status"), amount.cast(MONEY).alias("total_amount"),
        _pick(k % 3, ["web", "mobile", "store"]).alias("source_system"), updated.alias("last_updated"),
    )
    replay = F.col("_copy") == 1
    return base.select(
        "order_id", "customer_id", "order_date",
        F.when(replay, F.lit("completed")).otherwise(F.col("status")).alias("status"),
        "total_amount",
        F.when(replay, F.lit("replay")).otherwise(F.col("source_system")).alias("source_system"), "last_updated")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_from(read_table(spark, sf_dir, "orders"))


# ---------------------------------------------------------------- customers
def customers_from(customer: DataFrame) -> DataFrame:
    """customers(customer_id, name, email, join_date, segment, phone, age, marketing_opt_in)."""
    k = F.col("c_custkey")
    n = F.col("c_name")
    # stage the shared pieces once per row (named columns are not re-inlined)
    customer = customer.withColumns({
        "_local": F.lower(F.regexp_replace(n, "#", ".")),
        "_a": (200 + k % 800).cast("string"),
        "_e": (100 + (k * 7) % 900).cast("string"),
        "_l": (1000 + (k * 13) % 9000).cast("string"),
    }).withColumn("_good", F.concat(F.col("_local"), F.lit("@example.com")))
    name = _pick(k % 13, [None, "", "N/A", F.concat(F.lit("Mr. "), n), F.concat(F.lit("Ms.  "), n),
                          F.concat(F.lit("  "), F.upper(n), F.lit("  ")), F.lower(n),
                          F.regexp_replace(n, "#", "  #"), "Unknown"], n)
    local, good = F.col("_local"), F.col("_good")
    email = _pick(k % 17, [None, "no at sign", "nobody@", "@nowhere.org", F.concat(F.lit(" "), good),
                           F.upper(good), "N/A", "", F.concat(local, F.lit("@host"))], good)
    jd = F.date_add(F.lit("1992-01-01").cast("date"), ((k * 37) % 2400).cast("int"))
    join_date = F.when(k % 6 == 5, F.lit(None).cast("string")).otherwise(_render_date(jd, k % 6))
    seg_map = (F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("Premium"))
               .when(F.col("c_mktsegment") == "BUILDING", F.lit("Regular"))
               .when(F.col("c_mktsegment") == "FURNITURE", F.lit("Standard"))
               .when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("Bronze"))
               .when(F.col("c_mktsegment") == "MACHINERY", F.lit("Gold"))
               .otherwise(F.col("c_mktsegment")))
    segment = (F.when(k % 29 == 1, F.lit("vip ")).when(k % 29 == 2, F.lit(""))
               .when(k % 29 == 3, F.lit(None).cast("string")).when(k % 29 == 4, F.lit("N/A"))
               .when(k % 29 == 5, F.lit("Churned")).when(k % 29 == 6, F.lit("new"))
               .when(k % 29 == 7, F.lit("SILVER")).otherwise(seg_map))
    a, e, ln = F.col("_a"), F.col("_e"), F.col("_l")
    phone = _pick(k % 11, [
        F.concat(F.lit("+1-"), a, F.lit("-"), e, F.lit("-"), ln),
        F.concat(a, F.lit("."), e, F.lit("."), ln),
        F.concat(F.lit("("), a, F.lit(") "), e, F.lit("-"), ln),
        F.concat(a, e, ln),
        "123-456-7890", None, "", "N/A", "Unknown",
        F.concat(e, F.lit("-"), ln),
        F.concat(a, F.lit("-"), e, F.lit("-"), ln),
    ])
    age = (F.when(k % 53 == 0, 150 + k % 50).when(k % 31 == 0, F.lit(None).cast("long"))
           .otherwise(k % 91 - 5))
    opt_in = _pick(k % 12, ["True", "False", "Yes", "No", "Y", "N", "1", "0", "Active", "Inactive", "", None])
    # copy 1 = the customer re-entered (upper-case name, promoted segment);
    # copy 2 = a record that lost its id
    copies = F.array_compact(F.array(F.lit(0), F.when(k % 97 == 1, F.lit(1)), F.when(k % 197 == 3, F.lit(2))))
    base = customer.select(
        F.explode(copies).alias("_copy"),
        k.alias("customer_id"), name.alias("name"), email.alias("email"), join_date.alias("join_date"),
        segment.alias("segment"), phone.alias("phone"), age.cast("long").alias("age"),
        opt_in.alias("marketing_opt_in"),
        F.when(k % 7 != 0, F.concat(F.lit("No. "), k.cast("string"), F.lit(" Main Street"))).alias("address"),
        F.when(k % 9 != 0, F.date_format(F.date_add(F.lit("1998-01-01").cast("date"), (k % 200).cast("int")), "yyyy-MM-dd"))
        .alias("last_login"),
    )
    copy = F.col("_copy")
    return base.select(
        F.when(copy == 2, F.lit(None).cast("long")).otherwise(F.col("customer_id")).alias("customer_id"),
        F.when(copy == 1, F.upper(F.col("name"))).otherwise(F.col("name")).alias("name"),
        "email", "join_date",
        F.when(copy == 1, F.lit("Gold")).otherwise(F.col("segment")).alias("segment"),
        "phone", "age", "marketing_opt_in", "address", "last_login")


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers_from(read_table(spark, sf_dir, "customer"))


# ---------------------------------------------------------------- order items
def items_from(lineitem: DataFrame) -> DataFrame:
    """order_items(item_id, order_id, product_id, quantity, price, discount_percent, tax_amount, line_total).

    Unit price = extended price / quantity truncated to whole cents; tax and
    line total are rounded half up to cents from exact integer products.
    """
    o, ln = F.col("l_orderkey"), F.col("l_linenumber")
    q = F.col("l_quantity").cast("long")
    ext_c = nearest_long(F.col("l_extendedprice") * 100)
    staged = lineitem.select(
        (o * 8 + ln).alias("item_id"), o.alias("order_id"), F.col("l_partkey").alias("product_id"),
        ((o + ln) % 89).alias("_r"), q.alias("_q"),
        F.floor(ext_c / q).cast("long").alias("_unit_c"),
        nearest_long(F.col("l_discount") * 100).alias("_dp"),          # whole percent
        div_half_up(ext_c * (100 - nearest_long(F.col("l_discount") * 100))
                    * nearest_long(F.col("l_tax") * 100), 10000).alias("_tax_c"))
    r, q, unit_c, dp, tax_c = (F.col(c) for c in ("_r", "_q", "_unit_c", "_dp", "_tax_c"))
    # line = subtotal - subtotal * pct / 100 + tax, in cents (half up)
    staged = staged.withColumn("_correct_c", div_half_up(q * unit_c * (100 - dp) + tax_c * 100, 100))
    correct_c = F.col("_correct_c")
    cents = lambda c: c / F.lit(100.0)
    return staged.select(
        "item_id", "order_id", "product_id",
        F.when(r == 0, F.lit(None).cast("long")).when(r == 1, F.lit(0).cast("long"))
         .when(r == 2, -q).otherwise(q).alias("quantity"),
        F.when(r == 3, F.lit(None).cast(MONEY)).when(r == 4, -cents(unit_c)).otherwise(cents(unit_c)).alias("price"),
        F.when(r == 5, F.lit(None).cast(MONEY)).when(r == 6, F.lit(-5.0)).when(r == 7, F.lit(150.0))
         .otherwise(dp.cast("double")).alias("discount_percent"),
        F.when(r == 8, F.lit(None).cast(MONEY)).otherwise(cents(tax_c)).alias("tax_amount"),
        F.when(r == 9, F.lit(None).cast(MONEY)).when(r == 10, cents(correct_c + 100))
         .otherwise(cents(correct_c)).alias("line_total"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_from(read_table(spark, sf_dir, "lineitem"))


# ---------------------------------------------------------------- products
def products_from(part: DataFrame) -> DataFrame:
    """products(product_id, product_name, category, subcategory, unit_price, cost, is_active, created_date, weight_kg)."""
    k = F.col("p_partkey")
    nm = F.col("p_name")
    part = part.withColumn("_r_c", nearest_long(F.col("p_retailprice") * 100))
    r_c = F.col("_r_c")
    r = r_c / F.lit(100.0)
    name = _pick(k % 19, [None, "", "TBD", F.concat(F.lit("  "), nm)], nm)
    category = _pick(k % 23, [None, "", "Unknown", "electronics", "kitchen things", "Home", "sports", "Books",
                              "Gadget", "Music"], F.col("p_type"))
    unit_price = _pick(k % 31, [F.lit(None).cast(MONEY), F.lit(0.0), -r, F.lit(250000.0)], r)
    cost_at = lambda pct: div_half_up(r_c * pct, 100) / F.lit(100.0)  # noqa: E731  (pct of price, cents half up)
    cost = _pick(k % 37, [F.lit(None).cast(MONEY), cost_at(F.lit(125)), F.lit(-1.0)], cost_at(40 + k % 30))
    weight = _pick(k % 41, [F.lit(None).cast("double"), F.lit(-1.0), F.lit(5000.0)], F.col("p_size") * 0.5)
    active = _pick(k % 10, ["True", "False", "Yes", "No", "Active", "Inactive", "1", "0", "", None])
    cd = F.date_add(F.lit("2015-01-01").cast("date"), (k % 3000).cast("int"))
    created = _pick(k % 4, [F.date_format(cd, "yyyy-MM-dd"), F.date_format(cd, "MM/dd/yyyy"),
                            F.date_format(cd, "dd-MM-yyyy"), F.date_format(cd, "yyyy-MM-dd HH:mm:ss")])
    # copy 1 = the product re-entered with an upper-case name; copy 2 = lost its id
    copies = F.array_compact(F.array(F.lit(0), F.when(k % 89 == 1, F.lit(1)), F.when(k % 211 == 2, F.lit(2))))
    base = part.select(
        F.explode(copies).alias("_copy"),
        k.alias("product_id"), name.alias("product_name"), category.alias("category"),
        F.col("p_brand").alias("subcategory"), unit_price.cast(MONEY).alias("unit_price"),
        cost.cast(MONEY).alias("cost"), active.alias("is_active"), created.alias("created_date"),
        weight.cast("double").alias("weight_kg"), F.when(k % 43 != 0, k % 100 + 1).alias("supplier_id"),
    )
    copy = F.col("_copy")
    return base.select(
        F.when(copy == 2, F.lit(None).cast("long")).otherwise(F.col("product_id")).alias("product_id"),
        F.when(copy == 1, F.upper(F.col("product_name"))).otherwise(F.col("product_name")).alias("product_name"),
        "category", "subcategory", "unit_price", "cost", "is_active", "created_date", "weight_kg", "supplier_id")


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products_from(read_table(spark, sf_dir, "part"))


# ---------------------------------------------------------------- events
# Order-event status by event type (the event table has no order status).
EVENT_STATUS = [("purchase", "completed"), ("error", "cancelled"), ("click", "pending"),
                ("view", "shipped"), ("signup", "refunded")]


def order_events_from(events: DataFrame) -> DataFrame:
    """Order events: (event_id, order_id, customer_id, event_time, order_date, status, total_amount, k)."""
    status = None
    for et, st in EVENT_STATUS:
        status = F.when(F.col("event_type") == et, F.lit(st)) if status is None else status.when(F.col("event_type") == et, F.lit(st))
    return events.select(
        F.col("event_id"),
        F.col("event_id").alias("order_id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("ts").cast("date").alias("order_date"),
        status.alias("status"),
        F.col("value").alias("total_amount"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_events_from(read_table(spark, sf_dir, "events"))


def message_log_from(events: DataFrame) -> DataFrame:
    """Message log: (topic, partition, offset, key, value, timestamp).

    topic = event type, partition = user id mod 3, offset = event id (strictly
    increasing within a partition, as a broker assigns), value = JSON payload.
    """
    payload = F.to_json(F.struct(
        F.col("event_id").alias("order_id"), F.col("user_id").alias("customer_id"),
        F.col("value").alias("total_amount"), F.col("event_type"),
        F.get_json_object("props", "$.k").cast("long").alias("k")))
    return events.select(
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 3).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("user_id").cast("string").alias("key"),
        payload.alias("value"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_log_from(read_table(spark, sf_dir, "events"))


def consumer_commits_from(log: DataFrame) -> DataFrame:
    """Offset commits of two consumer groups: one commits after every message,
    one commits in blocks of 100 offsets (so it lags)."""
    every = log.select(F.lit("realtime").alias("group_id"), "topic", "partition",
                       (F.col("offset") + 1).alias("committed_offset"), F.col("timestamp").alias("updated_at"))
    blocks = log.select(F.lit("batch").alias("group_id"), "topic", "partition",
                        (F.floor(F.col("offset") / 100) * 100).cast("long").alias("committed_offset"),
                        F.col("timestamp").alias("updated_at"))
    return every.unionByName(blocks)


def consumer_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumer_commits_from(message_log(spark, sf_dir))


# Topic retention (hours) by topic name; unknown topics keep 7 days.
RETENTION_HOURS = [("purchase", 24 * 30), ("error", 24 * 7), ("click", 24), ("view", 48), ("signup", 24 * 14)]


def topics_from(log: DataFrame) -> DataFrame:
    """Topic configuration: one row per topic seen in the log, but for ``signup``, which nobody configured, and one for
    ``audit``, to which nobody has written."""
    hours = None
    for t, h in RETENTION_HOURS:
        hours = F.when(F.col("topic") == t, F.lit(h)) if hours is None else hours.when(F.col("topic") == t, F.lit(h))
    seen = log.withColumn("topic", F.when(F.col("topic") == "signup", "audit").otherwise(F.col("topic")))
    return (seen.groupBy("topic").agg(F.countDistinct("partition").alias("partitions"))
            .select(F.col("topic").alias("topic_name"), F.col("partitions").cast("long"),
                    hours.otherwise(F.lit(168)).cast("long").alias("retention_hours")))
