"""Data-quality operators.

Reports are DataFrames, never driver-side dicts: each table's report is one
aggregate pass (``count_if`` per column), reshaped with ``unpivot``.

Scale notes
-----------
* ``flag_duplicates`` avoids ``row_number`` over the key: a window sorts a
  whole key group inside one task, so a key holding a third of the rows
  would stall one executor.  It aggregates instead (partial aggregation
  collapses copies map-side) and joins per-key firsts back, a join AQE can
  split when skewed.
* Orphan counts pre-aggregate the referencing side by key before the
  anti-join, so a hot key is one row by the time it is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators.quantiles import exact_quantiles

PCT = T.DecimalType(38, 6)


def _missing(df: DataFrame, c: str) -> Column:
    """Null, or the empty string for text columns (no '' test on typed columns)."""
    dtype = dict(df.dtypes)[c]
    col = F.col(f"`{c}`")
    return (col.isNull() | (col == "")) if dtype == "string" else col.isNull()


def null_counts(df: DataFrame) -> DataFrame:
    """one row, null count per column (``count_if`` is 0, not null, on empty input)."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def nan_counts(df: DataFrame) -> DataFrame:
    """F16: NaN count per floating-point column (one row)."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:                                    # one row without columns
        return df.sparkSession.range(1).select()
    return df.agg(*[F.count_if(F.isnan(F.col(f"`{c}`"))).alias(c) for c in floats])


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Per key (null is one too) its rows, row_count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """keys occurring more than once (a null key is a key too)."""
    return key_counts(df, key).filter(F.col("row_count") > 1)


def date_range(df: DataFrame, column: str) -> DataFrame:
    """earliest and latest value of a date column (one row)."""
    return df.agg(F.min(column).alias("earliest"), F.max(column).alias("latest"))


def _pct(part: Column, total: Column) -> Column:
    """Half-up 2-decimal percentage from exact integer counts."""
    return F.when(total > 0, F.round((part.cast(T.DecimalType(20, 0)) * 100 / total).cast(PCT), 2)).otherwise(F.lit(0))


def column_report(df: DataFrame, table: str) -> DataFrame:
    """F12 (columns): per column null-or-blank count and percentage, long format."""
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(_missing(df, c)).alias(c) for c in df.columns])
    long = agg.unpivot("__rows", df.columns, "column_name", "null_count")
    return long.select(F.lit(table).alias("table_name"), "column_name",
                       F.col("null_count").cast("long"),
                       _pct(F.col("null_count"), F.col("__rows")).cast("double").alias("null_percentage"))


def id_column(df: DataFrame) -> str | None:
    """The first column whose name contains ``id``."""
    return next((c for c in df.columns if "id" in c.lower()), None)


def table_summary(df: DataFrame, table: str) -> DataFrame:
    """F12/F13/F14 (table): rows, columns, duplicate ids, completeness - one pass.

    duplicate_rows = rows - distinct values of the first column whose name
    contains ``id`` (null counted as one value, as ``distinct()`` does);
    completeness = mean over columns of (100 - null%) to 2 places.
    """
    cols, key = df.columns, id_column(df)
    aggs = [F.count(F.lit(1)).alias("__rows")] + [F.count_if(_missing(df, c)).alias(f"__m{i}") for i, c in enumerate(cols)]
    if key:
        k = F.col(f"`{key}`")
        aggs.append((F.countDistinct(k) + F.coalesce(F.max(F.when(k.isNull(), 1).otherwise(0)), F.lit(0))).alias("__distinct"))
    return _summary(df.agg(*aggs), table, len(cols), key is not None)


def _summary(agg: DataFrame, table: str, columns: int, has_key: bool) -> DataFrame:
    """The summary row of ``__rows``, the missing values ``__m<i>`` of each column and the ``__distinct`` keys (null is one)."""
    rows = F.col("__rows")
    pcts = [_pct(F.col(f"__m{i}"), rows) for i in range(columns)]
    completeness = reduce(lambda a, b: a + b, [(F.lit(100) - p) for p in pcts]) / F.lit(columns)
    dup = (rows - F.col("__distinct")) if has_key else F.lit(0)
    return agg.select(
        F.lit(table).alias("table_name"), rows.cast("long").alias("total_rows"),
        F.lit(columns).cast("long").alias("total_columns"), dup.cast("long").alias("duplicate_rows"),
        F.when(rows > 0, F.round(completeness.cast(PCT), 2)).otherwise(F.lit(0)).cast("double").alias("completeness_score"))


# ------------------------------------------------------------------ measured while writing
def write_metrics(df: DataFrame, dates: dict[str, Column] | None = None) -> dict[str, Column]:
    """What a table's reports need of each row, as aggregates that a write can measure on the way.

    Rows; per column its nulls and its missing values; earliest and latest of the ``dates``.
    """
    out = {"rows": F.count(F.lit(1))}
    for i, c in enumerate(df.columns):
        out[f"null{i}"] = F.count_if(F.col(f"`{c}`").isNull())
        out[f"missing{i}"] = F.count_if(_missing(df, c))
    for name, d in (dates or {}).items():
        out[f"first_{name}"], out[f"last_{name}"] = F.min(d), F.max(d)
    return out


def measured_null_counts(spark: SparkSession, columns: list[str], seen: dict) -> DataFrame:
    """F9 from a write's metrics."""
    return spark.createDataFrame([tuple(seen[f"null{i}"] for i in range(len(columns)))],
                                 T.StructType([T.StructField(c, T.LongType()) for c in columns]))


def measured_date_range(spark: SparkSession, name: str, seen: dict) -> DataFrame:
    """F11 from a write's metrics."""
    return spark.createDataFrame([(seen[f"first_{name}"], seen[f"last_{name}"])], "earliest date, latest date")


def measured_summary(table: str, columns: list[str], seen: dict, distinct: DataFrame) -> DataFrame:
    """F13 from a write's metrics and the one-row frame ``distinct`` (its column n: distinct keys, null is one)."""
    counts = {"__rows": seen["rows"], **{f"__m{i}": seen[f"missing{i}"] for i in range(len(columns))}}
    agg = distinct.select(F.col("n").alias("__distinct"), *[F.lit(v).cast("long").alias(k) for k, v in counts.items()])
    return _summary(agg, table, len(columns), True)


def distinct_count(df: DataFrame, key: str) -> DataFrame:
    """One row, n: the distinct values of a key, null counted as one."""
    return df.select(key).distinct().agg(F.count(F.lit(1)).alias("n"))


def quality_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """one summary row per table."""
    return reduce(DataFrame.unionByName, [table_summary(df, name) for name, df in tables.items()])


def quality_overview(summary: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """Totals across tables - rows, mean completeness, duplicate rows, and the rows of ``invalid`` (column n) added up."""
    out = summary.agg(
        F.sum("total_rows").cast("long").alias("total_rows"),
        F.round(F.avg(F.col("completeness_score").cast(T.DecimalType(10, 2))).cast(PCT), 2).cast("double").alias("avg_completeness"),
        F.sum("duplicate_rows").cast("long").alias("duplicate_rows"),
        F.count(F.lit(1)).cast("long").alias("tables"))
    if invalid is None:
        return out
    return out.withColumn("invalid_rows", invalid.select(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).scalar())


def row_count(df: DataFrame) -> DataFrame:
    """One row, n: the number of rows."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def orphan_count(child: DataFrame, parent: DataFrame, key: str, check: str) -> DataFrame:
    """E6 (one check): child rows whose non-null key has no parent row."""
    per_key = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    orphans = per_key.join(parent.select(key), key, "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("orphan_count")) \
        .select(F.lit(check).alias("check_name"), "orphan_count")


def referential_integrity(orders: DataFrame, customers: DataFrame, items: DataFrame,
                          products: DataFrame, order_ids: DataFrame | None = None) -> DataFrame:
    """Orders without customer, items without order, items without product; ``order_ids`` are the ids of the orders, if known."""
    return (orphan_count(orders, customers, "customer_id", "orders_missing_customers")
            .unionByName(orphan_count(items, orders if order_ids is None else order_ids, "order_id", "order_items_missing_orders"))
            .unionByName(orphan_count(items, products, "product_id", "order_items_missing_products")))


def quarantine_split(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Tag each child row as matched or quarantined (no parent / null key).

    One left join against the parent's distinct keys (so it cannot fan out)
    replaces a semi-join plus an anti-join; write the two routes with a
    ``filter`` on ``quarantined``.
    """
    keys = parent.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("__hit", F.lit(True))
    return (child.join(keys, key, "left")
            .withColumn("quarantined", F.col("__hit").isNull()).drop("__hit"))


def flag_duplicates(df: DataFrame, keys: list[str], flag: str = "is_duplicate") -> DataFrame:
    """Per key, the first row in ascending order of all columns gets
    False, every other row (including extra identical copies) True.

    Same result as ``row_number() over (partition by keys order by all) > 1``,
    computed with aggregates: distinct rows with their multiplicity, each
    key's first row, a join, and an explode back to the original row count.
    """
    cols = df.columns
    rest = [c for c in cols if c not in keys]
    # copies are counted per input task, so one row stands for no more copies than a task has read
    copies = df.withColumn("__task", F.spark_partition_id()).groupBy(*cols, "__task").agg(F.count(F.lit(1)).alias("__n"))
    firsts = copies.groupBy(*keys).agg(F.min(F.struct(*rest, "__task")).alias("__first"))
    tagged = _join_null_safe(copies, firsts, keys)
    is_first = F.struct(*[F.col(c) for c in [*rest, "__task"]]).eqNullSafe(F.col("__first"))
    exploded = tagged.withColumn("__is_first", is_first).withColumn(
        "__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return exploded.select(*cols, (~(F.col("__is_first") & (F.col("__i") == 1))).alias(flag))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join where null keys match null keys (a null key is one group)."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(r, cond, "left").drop(*[f"__r_{k}" for k in keys])


def quantiles(df: DataFrame, column: str, probs: list[float], exact: bool = True, accuracy: int = 10000) -> Column:
    """Scalar-subquery Column holding ``array<double>`` of quantiles.

    ``exact`` uses linear interpolation between order statistics (the SQL
    ``quantile_cont``) in bounded memory; ``exact=False`` uses a sketch
    (``percentile_approx``), one pass with a rank error of 1 / ``accuracy``.
    """
    if exact:
        return exact_quantiles(df, column, probs).scalar()
    return df.select(F.percentile_approx(F.col(column).cast("double"), [float(p) for p in probs], accuracy)).scalar()


def iqr_outliers(df: DataFrame, column: str, multiplier: float = 1.5, flag: str | None = None,
                 exact: bool = True) -> DataFrame:
    """Flag values outside [Q1 - m*IQR, Q3 + m*IQR] (nulls are not outliers)."""
    q = quantiles(df.filter(F.col(column).isNotNull()), column, [0.25, 0.75], exact)
    q1, q3 = F.round(q.getItem(0), 6), F.round(q.getItem(1), 6)   # exact for cent values
    iqr = q3 - q1
    x = F.col(column).cast("double")
    out = (x < q1 - F.lit(multiplier) * iqr) | (x > q3 + F.lit(multiplier) * iqr)
    return df.withColumn(flag or f"{column}_is_outlier", F.coalesce(out, F.lit(False)))


def cleaning_impact(raw_clean: DataFrame, pairs: list[tuple[str, str]], table: str) -> DataFrame:
    """before/after counts per cleaned column - raw missing vs cleaned missing."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, (raw, clean) in enumerate(pairs):
        aggs += [F.count_if(_missing(raw_clean, raw)).alias(f"__r{i}"), F.count_if(_missing(raw_clean, clean)).alias(f"__c{i}")]
    agg = raw_clean.agg(*aggs)
    rows = [F.struct(F.lit(raw).alias("column_name"), F.col(f"__r{i}").cast("long").alias("missing_before"),
                     F.col(f"__c{i}").cast("long").alias("missing_after")) for i, (raw, _c) in enumerate(pairs)]
    return (agg.select(F.col("__rows").cast("long").alias("total_rows"), F.explode(F.array(*rows)).alias("r"))
            .select(F.lit(table).alias("table_name"), "r.column_name", "total_rows", "r.missing_before", "r.missing_after"))
