"""Exact quantiles in bounded memory.

Distinct values are counted (partial aggregation), dealt out by value range and
written once, with the number of their range; there are as many ranges as
shuffle partitions, so they grow with the cluster.  The ranges' totals, a row
per range, say in which of them an order statistic lies; only those ranges are
ranked, by a window.  No task holds all distinct values, and no exact
percentile buffer is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import materialised


def exact_quantiles(df: DataFrame, column: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., q): the quantiles at ``probs`` of the non-null values, by linear interpolation between order statistics.

    Groups without a value are left out; without ``by`` an empty table gives no row.
    """
    by = by or []
    named = {f"__g{i}": F.col(c) for i, c in enumerate(by)}
    if not by:                                           # a column of the written table, so the windows below have a key
        named = {"__all": F.lit(0)}
    keys = list(named)
    counts = (df.select(*[c.alias(k) for k, c in named.items()], F.col(column).cast("double").alias("__x"))
              .filter(F.col("__x").isNotNull()).groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__n")))
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialised(counts.repartitionByRange(pieces, *keys, "__x").withColumn("__piece", F.spark_partition_id()),
                          "quantile-counts")

    # the ranges' totals: a row per key and range
    per_key = Window.partitionBy(*keys)
    totals = placed.groupBy(*keys, "__piece").agg(F.sum("__n").alias("__m")).withColumns({
        "__before": F.coalesce(F.sum("__m").over(per_key.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "__total": F.sum("__m").over(per_key)})
    # order statistics floor and ceil of (total - 1) * p, counted from 0, and the way between them
    want = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    asked = totals.select("*", want.alias("__w")).withColumn("__at", (F.col("__total") - 1) * F.col("__w.p"))
    low, high = F.floor("__at"), F.ceil("__at")

    def within(first: Column, n: Column) -> Column:
        return ((first <= low) & (low < first + n)) | ((first <= high) & (high < first + n))
    asked = asked.filter(within(F.col("__before"), F.col("__m")))

    # the asked ranges' values with the number of values before them, then the asked ones
    inside = Window.partitionBy(*keys, "__piece").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    ranges = asked.select(*keys, "__piece").distinct()
    values = _same_range(placed, ranges, keys, "left_semi").withColumn("__first", F.sum("__n").over(inside) - F.col("__n"))
    found = _same_range(values, asked.select(*keys, "__piece", "__before", "__w", "__at"), keys, "inner").filter(
        within(F.col("__before") + F.col("__first"), F.col("__n")))
    part = found.groupBy(*keys, F.col("__w.i").alias("__i")).agg(
        F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.first(F.col("__at") - low).alias("__f"))
    value = F.struct("__i", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias("v"))
    out = part.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(value)), lambda s: s["v"]).alias("q"))       # one entry per prob
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=False)], "q")


def _same_range(values: DataFrame, ranges: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on the range's number and the keys, null equal to null."""
    right = ranges.withColumnsRenamed({k: f"{k}_r" for k in [*keys, "__piece"]})
    on = F.col("__piece") == F.col("__piece_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_r"))
    return values.join(right, on, how).drop(*[f"{k}_r" for k in [*keys, "__piece"]])
