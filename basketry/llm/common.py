"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the contracts: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "lz4") -> DataFrame:
    """``df`` as a table in the cluster's shared folder, read back.

    Cuts lineage in a way that survives lost executors, and gives the planner
    a leaf of known size: a join on it is broadcast if it is small, else both
    sides are plain exchanges, whose skewed partitions AQE splits.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_key(*cols: Column) -> list[Column]:
    """128 bits over the columns, never null; equal rows share it."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(1), *cols).alias("k2")]


def without(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str = "left_anti") -> DataFrame:
    """The rows of ``docs`` whose row key (of id and text) is not in ``keys`` (k1, k2); columns of any name are kept.

    ``keys`` is a written table, so it is counted from file footers: up to ``BROADCAST_KEYS`` keys (16 MB of longs) are
    broadcast and no text moves; beyond that the join shuffles both sides, with the same result.
    """
    small = keys.count() <= BROADCAST_KEYS
    k1, k2 = row_key(F.col(id_col), text_or_empty(text_col))
    names = [free_name(docs, "k1"), free_name(docs, "k2")]
    keys = keys.select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1]))
    return docs.join(F.broadcast(keys) if small else keys, (k1 == F.col(names[0])) & (k2 == F.col(names[1])), how)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores if ``df`` has a column of that name (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
