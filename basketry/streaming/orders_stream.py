"""Structured Streaming over order events.

Design
------
* One ingest query lands the raw stream in Bronze with the parquet file sink
  (exactly-once through its commit log).  Downstream queries read Bronze as a
  file stream, so no query deletes or re-reads the landing directory behind
  another one's back.
* Nothing is left out in silence: waiting has no time limit unless the caller
  sets one, and then an unfinished query is an error; sources have no age
  limit, start at the earliest offset and fail on lost data.
* Event time is parsed without inventing values: an unparseable timestamp
  stays null and its row goes to the invalid-date route.
* Windowed aggregates use a watermark and run in append mode (final windows)
  or in update mode into an upsert table that also serves the open windows;
  complete mode would keep every window in state.
* ``foreachBatch`` writes are idempotent: each micro-batch overwrites its own
  ``batch_id=<n>`` directory, so a replayed batch replaces itself.
* Timestamps in the landed JSON carry microseconds; the parse ladder tries
  an ISO cast first.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from basketry.functions import cleaning as C
from basketry.functions import money
from basketry.operators.cleaning import valid_order

# Columns of each event type.  All types share the landing directory and are
# told apart by ``event_type``; its schema is the union of their columns.
_L, _S, _D = T.LongType(), T.StringType(), T.DoubleType()
EVENT_COLUMNS: dict[str, dict[str, T.DataType]] = {
    "order": {"event_type": _S, "event_timestamp": _S, "order_id": _L, "customer_id": _L, "order_date": _S,
              "status": _S, "total_amount": _D, "source_system": _S},
    "order_item": {"event_type": _S, "event_timestamp": _S, "item_id": _L, "order_id": _L, "product_id": _L,
                   "quantity": _L, "price": _D, "discount_percent": _D, "line_total": _D},
    "customer_update": {"event_type": _S, "event_timestamp": _S, "customer_id": _L, "name": _S, "email": _S,
                        "join_date": _S, "segment": _S, "phone": _S},
}
EVENT_COLUMNS["customer_create"] = EVENT_COLUMNS["customer_update"]
EVENT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in
                             {n: t for cols in EVENT_COLUMNS.values() for n, t in cols.items()}.items()])

# Extra layouts tried after the ISO cast, in order.
EVENT_TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss"]
STREAM_DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd"]


# ------------------------------------------------------------------ sources
def land_events(events: DataFrame, path: str) -> None:
    """Write event rows (of ``EVENT_SCHEMA``) as the JSON-lines files that a producer would drop into the directory."""
    events.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_event_files(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA,
                     max_files_per_trigger: int | None = None, max_file_age: str | None = None) -> DataFrame:
    """Streaming JSON directory source with a declared schema.

    No ``latestFirst`` and no ``cleanSource`` - several consumers must be able
    to read the same landing directory.  ``max_file_age`` makes the source
    ignore older files, so it is only set on request.
    """
    reader = spark.readStream.schema(schema)
    if max_file_age:
        reader = reader.option("maxFileAge", max_file_age)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


CORRUPT = "_corrupt_record"


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: T.StructType = EVENT_SCHEMA,
               **options: str) -> DataFrame:
    """Messages of a topic, decoded.

    Reads from the earliest offset and fails when offsets are gone; ``options``
    override (``startingOffsets``, ``failOnDataLoss``, ``maxOffsetsPerTrigger``,
    security).  Needs the spark-sql-kafka connector on the classpath; it is not
    bundled here, so only ``decode_kafka`` is tested.
    """
    settings = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest",
                "failOnDataLoss": "true", **options}
    return decode_kafka(spark.readStream.format("kafka").options(**settings).load(), schema)


def decode_kafka(raw: DataFrame, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """A8 decode: where a message came from, its key, its typed fields, and the text of one that is no such JSON.

    ``message_timestamp`` and the like are prefixed, so payload fields keep their names.
    """
    envelope = [F.col(c).alias(f"message_{c}") for c in ("topic", "partition", "offset", "timestamp") if c in raw.columns]
    with_text = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col("value").cast("string"), with_text, {"columnNameOfCorruptRecord": CORRUPT})
    return (raw.select(F.col("key").cast("string").alias("message_key"), *envelope, parsed.alias("payload"))
            .select("message_key", *[f"message_{c}" for c in ("topic", "partition", "offset", "timestamp")
                                     if c in raw.columns], "payload.*"))


def route_events(stream: DataFrame, event_type: str) -> DataFrame:
    """One event type out of the shared landing stream, with its own columns."""
    if event_type not in EVENT_COLUMNS:
        raise ValueError(f"unknown event type {event_type!r}; known: {sorted(EVENT_COLUMNS)}")
    return stream.filter(F.col("event_type") == event_type).select(*EVENT_COLUMNS[event_type])


# ------------------------------------------------------------------ transforms
def parse_event_time(c: Column) -> Column:
    return F.coalesce(c.try_cast("timestamp"), *[F.try_to_timestamp(c, F.lit(f)) for f in EVENT_TIME_FORMATS])


def enrich_stream(orders: DataFrame) -> DataFrame:
    """K1: processing time, event time, order date, year/month, completion and validity.

    Unlike the literal rule there are no default year/month: a row whose
    dates do not parse keeps nulls and is routed to the invalid-date output.
    """
    order_date = F.coalesce(parse_event_time(F.col("order_date")).cast("date"),
                            C.parse_date("order_date", STREAM_DATE_FORMATS))
    df = orders.withColumns({
        "processing_timestamp": F.current_timestamp(),
        "event_time": parse_event_time(F.col("event_timestamp")),
        "order_date_parsed": order_date,
    })
    return df.withColumns({
        "order_year": F.coalesce(F.year("order_date_parsed"), F.year("event_time")).cast("long"),
        "order_month": F.coalesce(F.month("order_date_parsed"), F.month("event_time")).cast("long"),
        "is_completed": F.when(F.col("status") == "completed", 1).otherwise(0),
        "is_valid_order": valid_order(F.col("order_id"), F.col("customer_id"), F.col("order_date_parsed"),
                                      F.col("total_amount")),
    })


UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def seconds(interval: str) -> int:
    """Seconds of an interval such as ``10 minutes`` or ``1 hour 30 minutes``."""
    parts = re.findall(r"(\d+)\s+([a-z]+?)s?\b", interval.lower())
    if not parts or re.sub(r"\d+\s+[a-z]+\s*", "", interval.lower()).strip() or any(u not in UNIT_SECONDS for _, u in parts):
        raise ValueError(f"not a fixed interval of whole seconds: {interval!r}")
    return sum(int(n) * UNIT_SECONDS[u] for n, u in parts)


def windowed_revenue(orders: DataFrame, window: str = "1 minute", slide: str | None = None,
                     watermark: str = "10 minutes", exact_customers: bool = False) -> DataFrame:
    """K3/K4: revenue per (event-time window, status) for valid completed orders.

    Distinct customers: streams do not support distinct aggregates, so a
    tumbling-window stream counts them exactly with two chained aggregations
    (per customer, then per window; append mode propagates the watermark);
    sliding windows use ``approx_count_distinct`` unless ``exact_customers``
    is requested on a batch frame.  Money sums are exact cent sums.
    """
    src = orders.filter((F.col("is_valid_order") == 1) & (F.col("status") == "completed"))
    if orders.isStreaming:
        src = src.withWatermark("event_time", watermark)
    w = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    if orders.isStreaming and slide is None:
        per_customer = (src.groupBy(w.alias("w"), "status", "customer_id")
                        .agg(F.count("order_id").alias("n"), money.sum_cents("total_amount").alias("c")))
        agg = (per_customer.groupBy(F.window(F.window_time("w"), window).alias("w"), "status")
               .agg(F.sum("n").cast("long").alias("order_count"), F.sum("c").alias("total_c"),
                    F.count(F.lit(1)).cast("long").alias("unique_customers")))
    elif orders.isStreaming:
        # buckets that no window edge cuts, per customer -> the sliding windows
        # covering each bucket, per customer (a customer once per window) -> per window
        bucket = f"{math.gcd(seconds(window), seconds(slide))} seconds"
        buckets = (src.groupBy(F.window("event_time", bucket).alias("b"), "status", "customer_id")
                   .agg(F.count("order_id").alias("n"), money.sum_cents("total_amount").alias("c")))
        per_customer = (buckets.groupBy(F.window(F.window_time("b"), window, slide).alias("w"), "status", "customer_id")
                        .agg(F.sum("n").alias("n"), F.sum("c").alias("c")))
        agg = (per_customer.groupBy("w", "status")
               .agg(F.sum("n").cast("long").alias("order_count"), F.sum("c").alias("total_c"),
                    F.count(F.lit(1)).cast("long").alias("unique_customers")))
    else:
        customers = F.countDistinct("customer_id") if exact_customers else F.approx_count_distinct("customer_id")
        agg = (src.groupBy(w.alias("w"), "status")
               .agg(F.count("order_id").cast("long").alias("order_count"),
                    money.sum_cents("total_amount").alias("total_c"),
                    customers.cast("long").alias("unique_customers")))
    return (agg.withColumns({"total_revenue": money.from_cents("total_c"),
                             "avg_order_value": (money.cents_to_decimal("total_c") / F.col("order_count"))
                             .cast(money.AVG_DEC).cast("double")})
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status",
                    "order_count", "total_revenue", "avg_order_value", "unique_customers"))


def revenue_parts(orders: DataFrame, window: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """K7: (window, status, customer) counts and cents, one aggregation, for update mode.

    ``revenue_of_parts`` sums the current parts; a customer is one row per
    window, so distinct customers are exact and a hot window is many rows.
    """
    src = orders.filter((F.col("is_valid_order") == 1) & (F.col("status") == "completed")).withWatermark("event_time", watermark)
    return (src.groupBy(F.window("event_time", window).alias("w"), "status", "customer_id")
            .agg(F.count("order_id").alias("n"), money.sum_cents("total_amount").alias("c"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status", "customer_id", "n", "c"))


def revenue_of_parts(parts: DataFrame) -> DataFrame:
    agg = (parts.groupBy("window_start", "window_end", "status")
           .agg(F.sum("n").cast("long").alias("order_count"), F.sum("c").alias("total_c"),
                F.count(F.lit(1)).cast("long").alias("unique_customers")))
    return agg.select("window_start", "window_end", "status", "order_count", money.from_cents("total_c").alias("total_revenue"),
                      (money.cents_to_decimal("total_c") / F.col("order_count")).cast(money.AVG_DEC).cast("double")
                      .alias("avg_order_value"), "unique_customers")


# ------------------------------------------------------------------ K9: velocity
def orders_per_second(orders: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """K9 state: orders per customer and second, for update mode.

    A native aggregate: map-side partial counts, one counter per customer and
    second in state until the watermark passes it, whatever order rows arrive
    in.  Rows without a customer or a time are not counted.
    """
    src = orders.filter(F.col("event_time").isNotNull() & F.col("customer_id").isNotNull())
    return (src.withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", "1 second").alias("w"), "customer_id").agg(F.count(F.lit(1)).alias("n"))
            .select("customer_id", F.unix_timestamp("w.start").alias("second"), "n"))


def velocity(orders: DataFrame, per_second: DataFrame) -> DataFrame:
    """K9: each order's number of orders of the same customer in the hour up to it, from the current counters."""
    from basketry.operators.fraud import last_hour_counts
    src = orders.filter(F.col("event_time").isNotNull() & F.col("customer_id").isNotNull())
    counts = last_hour_counts(per_second, "customer_id", "second", "n", "orders_in_last_hour")
    return (src.withColumn("second", F.unix_timestamp("event_time")).join(counts, ["customer_id", "second"])
            .select("order_id", "customer_id", "event_time", "orders_in_last_hour"))


# ------------------------------------------------------------------ sinks
def to_bronze(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True,
              interval: str = "30 seconds") -> StreamingQuery:
    """File sink (exactly-once) into the Bronze directory."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.outputMode("append").start()


def silver_writer(silver_path: str, invalid_path: str):
    """foreachBatch function routing rows with null partition keys aside.

    Each batch overwrites ``batch_id=<n>`` under both outputs, so a replay
    after a failure rewrites the same files instead of appending duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            keyed = F.col("order_year").isNotNull() & F.col("order_month").isNotNull()
            (batch.filter(keyed).hint("rebalance", "order_year", "order_month")       # a file per month, not per task and month
             .write.mode("overwrite").partitionBy("order_year", "order_month")
             .parquet(f"{silver_path}/batch_id={batch_id}"))
            batch.filter(~keyed).write.mode("overwrite").parquet(f"{invalid_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()
    return write


def to_silver(stream: DataFrame, silver_path: str, invalid_path: str, checkpoint: str,
              available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
    w = stream.writeStream.foreachBatch(silver_writer(silver_path, invalid_path)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
               available_now: bool = True, interval: str = "10 seconds") -> StreamingQuery:
    """Append-mode parquet sink for aggregates and alerts."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.outputMode(mode).start()


def to_console(stream: DataFrame, mode: str = "append", interval: str = "10 seconds") -> StreamingQuery:
    """Console sink for debugging."""
    return (stream.writeStream.format("console").outputMode(mode).option("truncate", "false")
            .trigger(processingTime=interval).start())


def to_memory(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """In-memory table sink (small results, tests and notebooks)."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    return w.start()


def to_upserts(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True,
               interval: str = "10 seconds") -> StreamingQuery:
    """K7: update-mode sink; every micro-batch overwrites its own ``batch_id=<n>`` directory with the rows it changed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def current_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The upsert table as of now: per key the row of the newest micro-batch."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in keys and c != "batch_id"]
    newest = F.max(F.struct("batch_id", *values)).alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[f"newest.{c}" for c in values])


def await_all(spark: SparkSession, queries: list[StreamingQuery], timeout_s: float | None = None) -> None:
    """Wait until every query has ended; a failure in any of them is raised, not lost.

    There is no time limit by default.  A query that outlives ``timeout_s`` is
    stopped and reported as an error, since its output is incomplete.
    """
    for q in queries:
        done = q.awaitTermination(timeout_s) if timeout_s is not None else q.awaitTermination()
        exc = q.exception()
        if exc is not None:
            raise RuntimeError(f"stream {q.name or q.id} failed: {exc}")
        if timeout_s is not None and not done:
            for open_query in queries:
                open_query.stop()
            raise TimeoutError(f"stream {q.name or q.id} did not finish within {timeout_s} s; its output is incomplete")


# ------------------------------------------------------------------ K10
def run_medallion(spark: SparkSession, landing: str, root: str, window: str = "1 minute",
                  watermark: str = "10 minutes", available_now: bool = True, fraud_rules=None,
                  max_files_per_trigger: int | None = None) -> dict[str, str]:
    """Ingest once into Bronze, then Silver routing, windowed revenue and
    fraud alerts read Bronze as their stream.  Returns the output paths."""
    from basketry.functions.rules import StreamFraudRules
    from basketry.operators.fraud import stream_fraud
    paths = {k: f"{root}/{k}" for k in ("bronze", "silver", "silver_invalid_dates", "revenue_by_window", "fraud")}
    ck = f"{root}/_checkpoints"
    ingest = to_bronze(read_event_files(spark, landing, max_files_per_trigger=max_files_per_trigger), paths["bronze"], f"{ck}/bronze", available_now)
    if available_now:
        await_all(spark, [ingest])
    else:
        ingest.processAllAvailable()  # Bronze exists before its readers start
    bronze = spark.readStream.schema(EVENT_SCHEMA).parquet(paths["bronze"])
    orders = enrich_stream(route_events(bronze, "order"))
    q_silver = to_silver(orders, paths["silver"], paths["silver_invalid_dates"], f"{ck}/silver", available_now)
    q_rev = to_parquet(windowed_revenue(orders, window, None, watermark), paths["revenue_by_window"],
                       f"{ck}/revenue", "append", available_now)
    q_fraud = to_parquet(stream_fraud(orders, fraud_rules or StreamFraudRules()),
                         paths["fraud"], f"{ck}/fraud", "append", available_now)
    if available_now:
        await_all(spark, [q_silver, q_rev, q_fraud])
    return paths
