"""As-of dimension: what was known of a customer when the order came.

An order meets the customer's last change at or before its time.  A window over
a customer's whole history would put a hot customer's orders into one task, so
time is cut into blocks:

1. per customer and block, the last change in it is one row;
2. each block takes over the newest of those rows from earlier blocks, by a
   window over at most one row per block of a customer;
3. inside a block, orders and changes are merged by time, starting from what
   the block took over.

The block length bounds a task's group: a customer with a third of all orders is spread over the blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(rows: DataFrame, changes: DataFrame, key: str, time: str, change_time: str, values: list[str],
              block_seconds: int = 86_400, since: str = "known_since") -> DataFrame:
    """``rows`` with the ``values`` of the key's last change at or before the row's time, and that change's time.

    Several changes of one key and time count in the order of their values (nulls first): the largest is the last.
    Changes without a key or a time are none; a row without a key or a time, or before the first change,
    gets nulls.  Every row of ``rows`` is returned once.
    """
    block = lambda t: F.floor(F.unix_timestamp(t) / block_seconds).cast("long")      # noqa: E731
    # a micro-second count is exact and, unlike a map or a struct of mixed types, ordered in every engine
    change = F.struct(F.unix_micros(change_time).alias("at"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    known = (changes.filter(F.col(key).isNotNull() & F.col(change_time).isNotNull())
             .select(F.col(key).alias("k"), block(change_time).alias("b"), change.alias("c")).distinct())

    timed = rows.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    untimed = rows.filter(F.col(key).isNull() | F.col(time).isNull())
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    ours = timed.select(F.col(key).alias("k"), block(time).alias("b"), F.unix_micros(time).alias("t"), row.alias("row"))

    # what a block starts with: one row per customer and block that has changes or orders
    ends = known.groupBy("k", "b").agg(F.max("c").alias("c"))
    blocks = (ends.unionByName(ours.select("k", "b").distinct().withColumn("c", F.lit(None).cast(ends.schema["c"].dataType)))
              .groupBy("k", "b").agg(F.max("c").alias("c")))
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    start = blocks.withColumn("start", F.max("c").over(before)).filter(F.col("start").isNotNull()).select("k", "b", "start")

    # inside a block: changes stand before rows of the same time
    kind = known.schema["c"].dataType
    merged = (known.select("k", "b", F.col("c.at").alias("t"), F.lit(0).alias("side"), "c", F.lit(None).cast(ours.schema["row"].dataType).alias("row"))
              .unionByName(start.select("k", "b", F.lit(None).cast("long").alias("t"), F.lit(0).alias("side"), F.col("start").alias("c"),
                                        F.lit(None).cast(ours.schema["row"].dataType).alias("row")))
              .unionByName(ours.select("k", "b", "t", F.lit(1).alias("side"), F.lit(None).cast(kind).alias("c"), "row")))
    upto = Window.partitionBy("k", "b").orderBy(F.col("t").asc_nulls_first(), "side").rowsBetween(Window.unboundedPreceding, 0)
    # changes come in time order and carry their time first, so the largest so far is the last
    found = merged.withColumn("last", F.max("c").over(upto)).filter(F.col("side") == 1)
    out = found.select("row.*", F.timestamp_micros("last.at").alias(since),
                       *[F.col(f"last.v{i}").alias(v) for i, v in enumerate(values)])
    rest = untimed.select("*", F.lit(None).cast("timestamp").alias(since),
                          *[F.lit(None).cast(changes.schema[v].dataType).alias(v) for v in values])
    return out.unionByName(rest)


def fact_orders_asof(orders: DataFrame, changes: DataFrame, block_seconds: int = 86_400) -> DataFrame:
    """Orders with the customer's name, email and segment as they were at the order's time."""
    return asof_join(orders, changes, "customer_id", "event_time", "changed_at", ["name", "email", "segment"], block_seconds)
