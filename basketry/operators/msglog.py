"""Message-log analytics (M19-M25, G5) over a (topic, partition, offset, ...) table.

The broker itself (storage, offset assignment, consumer groups) is not
rebuilt; these operators answer the monitoring questions over a message-log
table, all as distributed aggregates and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Payload of order messages (``value`` column, JSON).
ORDER_PAYLOAD = T.StructType([
    T.StructField("order_id", T.LongType()), T.StructField("customer_id", T.LongType()),
    T.StructField("total_amount", T.DoubleType()), T.StructField("event_type", T.StringType()),
    T.StructField("k", T.LongType()),
])


def topic_stats(log: DataFrame) -> DataFrame:
    """Per (topic, partition) message count, earliest and latest offset."""
    return log.groupBy("topic", "partition").agg(
        F.count(F.lit(1)).cast("long").alias("message_count"),
        F.min("offset").alias("earliest_offset"), F.max("offset").alias("latest_offset"))


def topic_status(topics: DataFrame, stats: DataFrame) -> DataFrame:
    """Per topic total messages and 'active' / 'empty' label."""
    per_topic = stats.groupBy("topic").agg(F.sum("message_count").cast("long").alias("messages"))
    joined = topics.join(per_topic, topics.topic_name == per_topic.topic, "left")
    msgs = F.coalesce(F.col("messages"), F.lit(0)).cast("long")
    return joined.select("topic_name", "partitions", "retention_hours", msgs.alias("messages"),
                         F.when(msgs > 0, "active").otherwise("empty").alias("status"))


def decode(log: DataFrame, schema: T.StructType = ORDER_PAYLOAD) -> DataFrame:
    """Payload fields plus envelope metadata (topic, partition, offset, key, timestamp)."""
    return log.select("topic", "partition", "offset", "key", "timestamp",
                      F.from_json("value", schema).alias("v")).select(
        "topic", "partition", "offset", "key", "timestamp", "v.*")


def incremental_read(log: DataFrame, topic: str, partition: int, from_offset: int, limit: int) -> DataFrame:
    """The next ``limit`` messages of one partition at or after ``from_offset``, decoded."""
    part = log.filter((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= from_offset))
    return decode(part.orderBy("offset").limit(limit))


def last_messages(log: DataFrame, limit: int, topic: str | None = None) -> DataFrame:
    """Newest ``limit`` messages, optionally of one topic."""
    df = log if topic is None else log.filter(F.col("topic") == topic)
    return df.orderBy(F.desc("timestamp"), F.desc("offset"), "topic", "partition").limit(limit)


def committed_offsets(commits: DataFrame) -> DataFrame:
    """Last committed offset per (group, topic, partition) - last write wins
    (ties on time broken by the larger offset)."""
    # time and offset as one fixed-width number, so the maximum is a hash aggregate
    size = F.lit("1" + "0" * 19).cast("decimal(20,0)")
    both = F.unix_micros("updated_at").cast("decimal(18,0)") * size + F.col("committed_offset").cast("decimal(19,0)")
    last = commits.groupBy("group_id", "topic", "partition").agg(F.max(both.cast("decimal(38,0)")).alias("last"))
    return last.select("group_id", "topic", "partition", (F.col("last") % size).cast("long").alias("committed_offset"),
                       F.timestamp_micros(F.floor(F.col("last") / size).cast("long")).alias("updated_at"))


def consumer_lag(stats: DataFrame, committed: DataFrame) -> DataFrame:
    """Per (group, topic, partition): next offset to write minus committed offset."""
    joined = committed.join(stats, ["topic", "partition"], "left")
    lag = F.greatest(F.lit(0), F.col("latest_offset") + 1 - F.col("committed_offset"))
    return joined.select("group_id", "topic", "partition", "committed_offset", "latest_offset",
                         lag.cast("long").alias("lag"))


def retained(log: DataFrame, topics: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Messages still inside their topic's retention period at ``as_of``
    (default: newest message time).  Messages of a topic without a retention
    period are kept.  Write the result with overwrite to apply it."""
    as_of = as_of if as_of is not None else log.select(F.max("timestamp")).scalar()
    cfg = topics.select(F.col("topic_name").alias("topic"), "retention_hours")
    keep = F.col("timestamp") >= as_of - F.make_interval(hours=F.col("retention_hours").cast("int"))
    return log.join(cfg, "topic", "left").filter(F.col("retention_hours").isNull() | keep).drop("retention_hours")


def message_rates(log: DataFrame, samples: int = 10) -> DataFrame:
    """Per (topic, partition) and minute, messages per minute over the last
    ``samples`` one-minute snapshots ((last - first cumulative count) / seconds x 60;
    0 for a single snapshot).

    The windows run over per-minute snapshots, so a group is bounded by the
    number of minutes, not by message volume.
    """
    minute = F.date_trunc("minute", F.col("timestamp"))
    snap = log.groupBy("topic", "partition", minute.alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    by_time = Window.partitionBy("topic", "partition").orderBy("minute")
    snap = snap.withColumn("total", F.sum("n").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    last_k = by_time.rowsBetween(-(samples - 1), 0)
    first_total, first_min = F.first("total").over(last_k), F.first("minute").over(last_k)
    secs = F.unix_timestamp("minute") - F.unix_timestamp(first_min)
    return snap.select("topic", "partition", "minute", F.col("total").cast("long").alias("messages_total"),
                       F.when(secs > 0, (F.col("total") - first_total) / secs * 60).otherwise(0.0)
                       .alias("messages_per_minute"))
