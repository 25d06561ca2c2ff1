"""Quality of a stream, micro-batch by micro-batch (P1, F9 on the stream).

The figures are measured while a micro-batch is written, not by reading it
again; each micro-batch has one row of them beside its data, under its own
number, so a replayed micro-batch replaces both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basketry.sinks.layers import write_measured
from basketry.streaming.orders_stream import parse_event_time


def event_metrics() -> dict[str, Column]:
    """What is counted of order events: rows, orders, and the orders' missing ids and amounts, bad times and amounts."""
    order = F.col("event_type") == "order"
    return {"rows": F.count(F.lit(1)), "orders": F.count_if(order),
            "missing_order_id": F.count_if(order & F.col("order_id").isNull()),
            "missing_customer_id": F.count_if(order & F.col("customer_id").isNull()),
            "missing_amount": F.count_if(order & F.col("total_amount").isNull()),
            "amount_not_positive": F.count_if(order & (F.col("total_amount") <= 0)),
            "bad_time": F.count_if(parse_event_time(F.col("event_timestamp")).isNull())}


def to_measured(stream: DataFrame, path: str, quality_path: str, checkpoint: str, metrics: dict[str, Column] | None = None,
                available_now: bool = True, interval: str = "30 seconds") -> StreamingQuery:
    """Writes each micro-batch to ``path/batch_id=<n>`` and its figures to ``quality_path/batch_id=<n>``."""
    metrics = metrics or event_metrics()

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = write_measured(batch, f"{path}/batch_id={batch_id}", metrics)
        row = batch.sparkSession.createDataFrame([tuple(seen[n] for n in metrics)], ", ".join(f"{n} long" for n in metrics))
        row.write.mode("overwrite").parquet(f"{quality_path}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def totals(spark: SparkSession, quality_path: str) -> DataFrame:
    """(metric, n) over all micro-batches."""
    rows = spark.read.parquet(quality_path).drop("batch_id")
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns]).unpivot([], rows.columns, "metric", "n")
