"""Small tables for the operators' tests."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, an extra column named like an internal one."""
    rows = [(1, None, "a", 7), (2, "", None, None), (None, "One line\nand another", "x", 1), (3, "word " * 30_000, "b", 2),
            (3, "word " * 30_000, "b", 2), (4, "A b\tc\nA b c\n", "c", 3), (5, "a B c\na b c \n", None, 4),
            (6, "\n\n", "k1", 5), (7, "é" * 5000, "fp", 6), (8, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, k1 string, row long").withColumn("quality", F.lit(1.5))
