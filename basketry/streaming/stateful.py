"""Stateful operators over the order-event stream (K9, K12, L3 / E4 on the stream).

* ``orders_in_last_hour``: velocity inside the stream.  Custom state
  (``applyInPandasWithState``) whose key is a bucket of customers *and an hour*: every
  order goes to its own hour and, as a count only, to the next one, so no key holds
  more than two hours of orders and a customer with a third of all orders is
  spread over the hours.  A call per key costs milliseconds, so customers share keys.
  An event-time timeout at the hour's end clears the key once the watermark has passed it.
* ``item_scores``: interval join of two watermarked streams (orders and their
  items), left outer, then one aggregate per order.  Both sides' state is
  dropped once no partner can arrive any more.
* ``without_redeliveries``: duplicates are remembered for the watermark's length only.
* ``customer_sessions``: merging session windows with a gap that depends on the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from basketry.functions import money
from basketry.functions.rules import FraudRules
from basketry.operators.fraud import ladder
from basketry.session import SCALE_CONF

HOUR = 3600


# ------------------------------------------------------------------ K9: velocity
#: What an order brings along, so that rules can be applied to the counted row.  Its id travels as text: pandas would
#: turn a column of longs with a null into doubles.
ORDER_FIELDS = {"order_id": T.StringType(), "micros": T.LongType(), "status": T.StringType(), "total_amount": T.DoubleType(),
                "is_valid_order": T.IntegerType()}
COUNTED = T.StructType([T.StructField("customer_id", T.LongType()), T.StructField("second", T.LongType()),
                        T.StructField("place", T.LongType()), *[T.StructField(n, t) for n, t in ORDER_FIELDS.items()],
                        T.StructField("orders_in_last_hour", T.LongType())])

#: A row as state keeps it; a copy for the next hour needs its customer and second only.
PACKED = pa.schema([("customer_id", pa.int64()), ("second", pa.int64()), ("own", pa.bool_()), ("order_id", pa.string()), ("micros", pa.int64()),
                    ("status", pa.string()), ("total_amount", pa.float64()), ("is_valid_order", pa.int32())])
#: State of a key (bucket, hour): the orders of the hour and of the hour before, in the order in which they came.
STATE = T.StructType([T.StructField("packed", T.BinaryType())])


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PACKED) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def counted(rows: pa.Table, known: int) -> pd.DataFrame:
    """The own orders within an hour after a row of their customer that is new (not of the first ``known``), with their counts."""
    second = rows["second"].to_numpy()
    number = np.unique(rows["customer_id"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    # customers lie so far apart on one axis that no hour reaches from one to the next
    at = number * (4 * HOUR) + (second - second.min())
    own = np.flatnonzero(rows["own"].to_numpy())
    order = np.argsort(at[own], kind="stable")
    line = at[own][order]
    place = np.empty(len(own), np.int64)              # the orders of one customer and second are numbered as they came
    place[order] = np.arange(len(own)) - np.searchsorted(line, line, "left")

    def in_hour(seen: np.ndarray) -> np.ndarray:
        seen = np.sort(seen)
        return np.searchsorted(seen, at[own], "right") - np.searchsorted(seen, at[own] - HOUR, "left")

    touched = np.flatnonzero(in_hour(at[known:]))
    out = rows.take(pa.array(own[touched]))
    new = {"place": place[touched], "orders_in_last_hour": in_hour(at)[touched].astype(np.int64)}
    return pd.DataFrame({n: new[n] if n in new else pd.array(out[n].to_pandas(), "Int32") if n == "is_valid_order" else out[n].to_pandas()
                         for n in COUNTED.names})


def count_orders(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts per order, sent again when an order that arrives later changes them."""
    if state.hasTimedOut:
        state.remove()
        return
    known = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else PACKED.empty_table()
    all_rows = pa.concat_tables([known, *[pa.Table.from_pandas(f, PACKED, preserve_index=False, nthreads=1) for f in rows]])
    state.update((packed(all_rows),))
    state.setTimeoutTimestamp((int(key[1]) + 1) * HOUR * 1000)
    out = counted(all_rows, len(known))
    if len(out):
        yield out


def need_rocksdb(spark: SparkSession) -> None:
    """Custom state of whole hours belongs in RocksDB, not in the executors' heap; sets it where the session has another provider."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name) != SCALE_CONF[name]:
        spark.conf.set(name, SCALE_CONF[name])


def orders_in_last_hour(orders: DataFrame, watermark: str = "1 hour", buckets: int = 16) -> DataFrame:
    """K9: every order with its customer's orders in the hour up to and including its second; update mode.

    (customer_id, second, place) names a row: ``place`` numbers the orders of one customer and second.  A row is sent
    when its order arrives and again whenever a later arrival inside the watermark changes its count, so the newest
    row of a name is right.  Rows without a customer or a time are not counted; rows behind the watermark are dropped.
    The customers of an hour are dealt over ``buckets`` keys: more of them for more cores, but a checkpoint needs those it
    was started with.
    """
    need_rocksdb(orders.sparkSession)
    hour = F.floor(F.unix_timestamp("event_time") / HOUR).cast("long")
    src = (orders.filter(F.col("event_time").isNotNull() & F.col("customer_id").isNotNull()).withWatermark("event_time", watermark)
           .select("customer_id", "event_time", F.unix_timestamp("event_time").alias("second"), F.col("order_id").cast("string").alias("order_id"),
                   F.unix_micros("event_time").alias("micros"), "status", F.col("total_amount").cast("double").alias("total_amount"),
                   F.col("is_valid_order").cast("int").alias("is_valid_order"),
                   F.explode(F.array(F.struct(hour.alias("hour"), F.lit(True).alias("own")),
                                     F.struct((hour + 1).alias("hour"), F.lit(False).alias("own")))).alias("b"))
           .select(F.pmod(F.xxhash64("customer_id"), F.lit(buckets)).alias("bucket"), "b.hour", "b.own", "event_time", "customer_id",
                   "second", *ORDER_FIELDS))
    return src.groupBy("bucket", "hour").applyInPandasWithState(count_orders, COUNTED, STATE, "update", "EventTimeTimeout")


#: The name of a counted row in the upsert table.
COUNTED_KEYS = ["customer_id", "second", "place"]


def counted_orders(rows: DataFrame) -> DataFrame:
    """The current counted rows as orders with their id and event time."""
    return rows.withColumns({"order_id": F.col("order_id").cast("long"), "event_time": F.timestamp_micros("micros")}).drop("micros")


# ------------------------------------------------------------------ L3 / E4: item scores
def item_scores(orders: DataFrame, items: DataFrame, rules: FraudRules = FraudRules(), within: str = "10 minutes",
                watermark: str = "10 minutes") -> DataFrame:
    """Each order with what its items of the time around it add up to, and their scores; append mode on streams.

    ``items`` has order_id, event_time and quantity.  An order leaves the stream when the watermark says that no item
    can come any more: with the sum, the largest and the number of its items, or without any.  Rows of either
    side without an order id or a time cannot be joined and are left out (``enrich_stream`` routes them aside).
    """
    left = orders.filter(F.col("order_id").isNotNull() & F.col("event_time").isNotNull()) \
        .select("order_id", "customer_id", "event_time", "status", "total_amount")
    right = items.filter(F.col("order_id").isNotNull() & F.col("event_time").isNotNull()) \
        .select(F.col("order_id").alias("item_order_id"), F.col("event_time").alias("item_time"), "quantity")
    if orders.isStreaming:
        left, right = left.withWatermark("event_time", watermark), right.withWatermark("item_time", watermark)
    near = (F.col("item_time") >= F.col("event_time") - F.expr(f"INTERVAL {within}")) & \
           (F.col("item_time") <= F.col("event_time") + F.expr(f"INTERVAL {within}"))
    joined = left.join(right, (F.col("order_id") == F.col("item_order_id")) & near, "leftOuter")
    out = (joined.groupBy("event_time", "order_id", "customer_id", "status", "total_amount")
           .agg(F.sum("quantity").cast("long").alias("total_quantity"), F.max("quantity").cast("long").alias("max_item_quantity"),
                F.count("item_order_id").cast("long").alias("item_count")))
    return out.withColumns({"quantity_score": ladder(F.col("total_quantity"), rules.total_quantity),
                            "item_score": ladder(F.col("max_item_quantity"), rules.max_item_quantity)}) \
              .withColumn("items_fraud_score", (F.col("quantity_score") + F.col("item_score")).cast("long"))


# ------------------------------------------------------------------ K12: duplicates and sessions
def without_redeliveries(events: DataFrame, time: str = "event_time", watermark: str = "10 minutes",
                         keys: list[str] | None = None) -> DataFrame:
    """Events without later deliveries of the same row; state is kept for the watermark's length only.

    Rows are the same if ``keys`` (by default all columns) are, as two 64-bit hashes.  A re-delivery that comes when
    the watermark has passed its time is dropped as late, so it enters once as well.  Rows without a time pass: no
    watermark could ever forget them.
    """
    keys = keys or events.columns
    named = events.withColumns({"_k1": F.xxhash64(*keys), "_k2": F.xxhash64(F.lit(1), *keys)})
    timed = named.filter(F.col(time).isNotNull())
    timed = timed.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["_k1", "_k2"]) if events.isStreaming \
        else timed.dropDuplicates(["_k1", "_k2"])
    return timed.unionByName(named.filter(F.col(time).isNull())).drop("_k1", "_k2")


def session_gap(gaps: dict[str, str], otherwise: str, status: str = "status") -> Column:
    """How long a session stays open after a row, by its status."""
    out = None
    for name, gap in gaps.items():
        out = F.when(F.col(status) == name, gap) if out is None else out.when(F.col(status) == name, gap)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def customer_sessions(orders: DataFrame, gaps: dict[str, str], otherwise: str = "30 minutes",
                      watermark: str = "10 minutes") -> DataFrame:
    """Sessions of a customer's orders: a row keeps its session open for the gap of its status.

    Sessions merge when a row fills the gap between them, also one that arrives late.  On a stream (append mode) a
    session is sent when the watermark has passed its end.  Rows without a customer or a time have no session.
    """
    src = orders.filter(F.col("event_time").isNotNull() & F.col("customer_id").isNotNull())
    if orders.isStreaming:
        src = src.withWatermark("event_time", watermark)
    return (src.groupBy(F.session_window("event_time", session_gap(gaps, otherwise)).alias("w"), "customer_id")
            .agg(F.count(F.lit(1)).cast("long").alias("order_count"), F.min("event_time").alias("first_order"),
                 F.max("event_time").alias("last_order"),
                 F.count_if(F.col("status") == "completed").cast("long").alias("completed"),
                 money.sum_cents("total_amount").alias("total_c"))
            .select("customer_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "order_count",
                    "completed", "first_order", "last_order", money.from_cents("total_c").alias("total_amount")))
