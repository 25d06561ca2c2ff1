"""Incremental Gold (P2, F8): a delivery of orders changes what it touches, nothing else.

Kept tables under one root, all partitioned so that an update overwrites whole
partitions and leaves the others' files alone:

* ``first``: the first copy of each order id as delivered (what de-duplication
  keeps), by blocks of ids.  New copies meet only the blocks of their ids.
* ``orders``: cleaned orders, by order month.
* ``months``: customer-month partials of completed orders, and ``dates``, the newest valid order date, by order month.
* ``totals``: per customer the sums over its months and its place in Gold
  (segment, value segment), by blocks of customers.
* ``gold``: the Gold rows, by order month.

A delivery is applied in steps.  Each is computed from the kept tables, written
to the delivery's journal and copied from there over the partitions it touches,
so a step that died half-way is done again from its journal with the same
result, and a delivery that is repeated changes nothing:

1. ``changes``: old and new first copy of every order that is new or changes;
2. ``first`` and ``orders`` for the touched blocks and months;
3. ``months`` and ``dates`` for the touched months;
4. ``totals`` of customers with changed orders, and of those whose value segment
   changes because the newest order date has moved or the customer table has;
5. ``gold`` for the touched months and the months of customers that moved
   to another segment.

The driver sees the touched partitions' names (a row per month or block).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions import money
from basketry.functions.rules import RuleSet, tpch_rules
from basketry.operators import cleaning as CL
from basketry.operators import model as M
from basketry.sinks.compaction import MARK, _folder
from basketry.sinks.layers import ORDERS_SCHEMA

MONTH = ["order_year", "order_month"]


_TYPES = {"long": T.LongType(), "date": T.DateType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType()}


def _fields(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in text.split(","))])


MONTHS = _fields("customer_id long, revenue_c long, orders long, last_order_date date, order_year long, order_month long")
DATES = _fields("newest date, order_year long, order_month long")
TOTALS = _fields("customer_id long, revenue_c long, orders long, last_order_date date, named boolean, customer_segment string, "
                 "value_segment string, customer_block long")
GOLD = _fields("customer_segment string, value_segment string, revenue double, order_count long, customer_count long, "
               "order_year long, order_month long")


@dataclass
class GoldStore:
    """The kept tables under ``root``; ``id_block`` and ``customer_block`` are how many ids a block has."""

    spark: SparkSession
    root: str
    rules: RuleSet = field(default_factory=tpch_rules)
    id_block: int = 1_000_000
    customer_block: int = 1_000_000

    def __post_init__(self) -> None:
        self.first = T.StructType([*ORDERS_SCHEMA.fields, T.StructField("id_block", T.LongType())])
        self.orders = T.StructType([f for f in self._clean(self.spark.createDataFrame([], ORDERS_SCHEMA)).schema
                                    if f.name not in MONTH] + [T.StructField(m, T.LongType()) for m in MONTH])

    # -------------------------------------------------------------- storage
    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _there(self, name: str) -> bool:
        fs, folder = _folder(self.spark, self._path(name))
        return fs.exists(folder)

    def table(self, name: str, schema: T.StructType, partitions: list[tuple] | None = None, keys: list[str] | None = None) -> DataFrame:
        """A kept table; with ``partitions`` only those (pruned in the scan)."""
        if not self._there(name):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self._path(name))
        return rows if partitions is None else rows.filter(_in(partitions, keys))

    def _staged(self, delivery: str, name: str, df: DataFrame) -> DataFrame:
        """``df`` as the delivery's journal has it: written once, read from then on."""
        path = f"journal/{delivery}/{name}"
        if not self._there(f"{path}/{MARK}"):
            df.write.mode("overwrite").parquet(self._path(path))
        return self.spark.read.schema(df.schema).parquet(self._path(path))

    def _replace(self, name: str, staged: DataFrame, schema: T.StructType, keys: list[str], touched: list[tuple]) -> None:
        """The touched partitions of a table become the staged rows; those without rows any more are removed."""
        staged = staged.select(*schema.fieldNames())
        (staged.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*keys).parquet(self._path(name)))
        filled = {tuple(r) for r in staged.select(*keys).distinct().collect()}
        for values in touched:
            if values not in filled:
                folder = "/".join(f"{k}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for k, v in zip(keys, values, strict=True))
                fs, gone = _folder(self.spark, f"{self._path(name)}/{folder}")
                fs.delete(gone, True)

    # -------------------------------------------------------------- one delivery
    def deliver(self, delivery: str, orders: DataFrame, customers_clean: DataFrame) -> None:
        """Applies the rows of ``orders`` (as delivered) under the name ``delivery``; ``customers_clean`` as it is now.

        Deliveries come one after the other; one that failed is repeated, under its name, before the next.
        """
        if self._there(f"journal/{delivery}/done/{MARK}"):
            return
        changes = self._staged(delivery, "changes", self._changes(orders))
        months = self._orders(delivery, changes)
        self._months(delivery, months)
        moved = self._totals(delivery, changes, customers_clean)
        self._gold(delivery, months, moved)
        self.spark.createDataFrame([(delivery,)], "delivery string").write.mode("overwrite").parquet(
            self._path(f"journal/{delivery}/done"))

    def _changes(self, orders: DataFrame) -> DataFrame:
        """(order_id, old, new): the first copy before and after, of orders where they differ."""
        new = M.dedup_keep_first(orders.select(*ORDERS_SCHEMA.fieldNames()), ["order_id"])
        blocks = _distinct(new.select(_block("order_id", self.id_block).alias("id_block")))
        kept = self.table("first", self.first, blocks, ["id_block"]).drop("id_block")
        before = kept.alias("l").join(new.select("order_id").alias("r"), F.expr("l.order_id <=> r.order_id"), "left_semi")
        after = M.dedup_keep_first(before.unionByName(new), ["order_id"])
        row = F.struct(*ORDERS_SCHEMA.fieldNames())
        both = (after.select(F.col("order_id").alias("id"), row.alias("new")).alias("l")
                .join(before.select(F.col("order_id").alias("id"), row.alias("old")).alias("r"), F.expr("l.id <=> r.id"), "left"))
        return both.select(F.col("l.id").alias("order_id"), "old", "new").filter(~F.col("old").eqNullSafe(F.col("new")))

    def _orders(self, delivery: str, changes: DataFrame) -> list[tuple]:
        """Replaces the first copies and the cleaned orders; returns the touched months."""
        fresh = changes.select("new.*").withColumn("id_block", _block("order_id", self.id_block))
        blocks = _distinct(fresh.select("id_block"))
        gone = changes.select("order_id")
        kept = self.table("first", self.first, blocks, ["id_block"]).alias("l").join(
            gone.alias("r"), F.expr("l.order_id <=> r.order_id"), "left_anti")
        first = self._staged(delivery, "first", kept.unionByName(fresh).select(*self.first.fieldNames()))

        # both versions of the changed orders, cleaned in one pass: the new ones are kept, the months of both are touched
        both = changes.select(F.explode(F.array(F.struct(F.col("new").alias("row"), F.lit(True).alias("kept")),
                                                F.struct(F.col("old").alias("row"), F.lit(False).alias("kept")))).alias("v"))
        both = both.filter("v.row IS NOT NULL").select("v.row.*", "v.kept")
        versions = self._staged(delivery, "versions", self._clean(both))
        months, cleaned = _distinct(versions.select(*MONTH)), versions.filter("kept").drop("kept")
        rest = self.table("orders", self.orders, months, MONTH).alias("l").join(
            gone.alias("r"), F.expr("l.order_id <=> r.order_id"), "left_anti")
        orders = self._staged(delivery, "orders", rest.unionByName(cleaned).select(*self.orders.fieldNames()))
        self._replace("first", first, self.first, ["id_block"], blocks)
        self._replace("orders", orders, self.orders, MONTH, months)
        return months

    def _months(self, delivery: str, months: list[tuple]) -> None:
        orders = self.table("orders", self.orders, months, MONTH)
        partials = M.customer_months(M.completed_orders(orders))
        dates = orders.filter(F.col("is_valid_order") == 1).groupBy(*MONTH).agg(F.max("order_date_cleaned").alias("newest"))
        self._replace("months", self._staged(delivery, "months", partials.select(*MONTHS.fieldNames())), MONTHS, MONTH, months)
        self._replace("dates", self._staged(delivery, "dates", dates.select(*DATES.fieldNames())), DATES, MONTH, months)

    def _totals(self, delivery: str, changes: DataFrame, customers_clean: DataFrame) -> DataFrame:
        """Replaces totals and places; returns (customer_id, old, new) of the customers where they differ."""
        as_of = self.table("dates", DATES).agg(F.max("newest")).first()[0]
        old = self.table("totals", TOTALS)
        touched = (changes.select("old.customer_id").union(changes.select("new.customer_id"))
                   .filter("customer_id IS NOT NULL").distinct())
        sums = (self.table("months", MONTHS).join(touched, "customer_id", "left_semi").groupBy("customer_id")
                .agg(F.sum("revenue_c").alias("revenue_c"), F.sum("orders").alias("orders"), F.max("last_order_date").alias("last_order_date")))
        same = old.join(touched, "customer_id", "left_anti").select(*sums.columns)
        dim = M.named_customers(customers_clean).select("customer_id", F.col("segment_cleaned").alias("customer_segment"),
                                                        F.lit(True).alias("named"))
        recency = F.datediff(F.lit(as_of).cast("date"), F.col("last_order_date"))
        place = M.value_segment(money.cents_to_decimal("revenue_c"), recency, self.rules.rfm)
        now = (same.unionByName(sums).join(dim, "customer_id", "left")
               .withColumns({"named": F.coalesce("named", F.lit(False)), "value_segment": place,
                             "customer_block": _block("customer_id", self.customer_block)}).select(*TOTALS.fieldNames()))
        row = F.struct(*TOTALS.fieldNames())
        both = (now.select("customer_id", row.alias("new")).join(old.select("customer_id", row.alias("old")), "customer_id", "full"))
        moved = self._staged(delivery, "moved", both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("customer_id", "old", "new"))
        blocks = _distinct(moved.select(_block("customer_id", self.customer_block).alias("customer_block")))
        rest = self.table("totals", TOTALS, blocks, ["customer_block"]).join(moved.select("customer_id"), "customer_id", "left_anti")
        content = rest.unionByName(moved.filter("new IS NOT NULL").select("new.*"))
        self._replace("totals", self._staged(delivery, "totals", content.select(*TOTALS.fieldNames())), TOTALS, ["customer_block"], blocks)
        return moved

    def _gold(self, delivery: str, months: list[tuple], moved: DataFrame) -> None:
        partials = self.table("months", MONTHS)
        place = ["named", "customer_segment", "value_segment"]
        other = moved.filter(~F.struct(*[f"old.{c}" for c in place]).eqNullSafe(F.struct(*[f"new.{c}" for c in place])))
        further = partials.join(other.select("customer_id"), "customer_id", "left_semi").select(*MONTH).distinct()
        further = self._staged(delivery, "gold_months", further)
        touched = sorted({*months, *_distinct(further)}, key=str)
        rows = (self.table("months", MONTHS, touched, MONTH)
                .join(self.table("totals", TOTALS).filter("named").select("customer_id", "customer_segment", "value_segment"), "customer_id"))
        gold = (rows.groupBy(*MONTH, "customer_segment", "value_segment")
                .agg(money.cents_to_decimal(F.sum("revenue_c")).cast("double").alias("revenue"), F.sum("orders").cast("long").alias("order_count"),
                     F.count(F.lit(1)).cast("long").alias("customer_count")))
        self._replace("gold", self._staged(delivery, "gold", gold.select(*GOLD.fieldNames())), GOLD, MONTH, touched)

    def gold(self) -> DataFrame:
        """The Gold table as of the last delivery."""
        return self.table("gold", GOLD)

    def _clean(self, orders: DataFrame) -> DataFrame:
        return CL.clean_orders(orders, self.rules.cleaning)


def _block(column: str, size: int) -> Column:
    return F.floor(F.col(column) / size).cast("long")


def _distinct(df: DataFrame) -> list[tuple]:
    """The distinct rows: names of partitions, of which there are few."""
    return [tuple(r) for r in df.distinct().collect()]


def _in(partitions: list[tuple], keys: list[str]) -> Column:
    """Whether a row lies in one of the partitions; a condition on partition columns only, so other files are not read."""
    out = F.lit(False)
    for values in partitions:
        one = F.lit(True)
        for k, v in zip(keys, values, strict=True):
            one = one & (F.col(k).isNull() if v is None else F.col(k) == v)
        out = out | one
    return out
