"""Line dedup: lines that many documents share are dropped everywhere.

Lines are exploded, normalised and hashed to 128 bits; a line's document
count is taken over each row's distinct lines, so one pre-aggregated shuffle of
fixed-width rows does it, however often a line occurs.  Only (row key,
position) of dropped lines travel back; a document's remaining lines are put
together by position from its own text.  Everything is DataFrame functions.

Defined results: a null or empty text is one empty line; a row is a document,
so repeated rows count and are returned one by one; a null id is kept.  Other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import LOWER, SPACES, UPPER, row_key, text_or_empty, written


def _line_keys(text: Column) -> Column:
    """The normalised lines of a text, in order: A-Z lower-cased, stripped."""
    return F.transform(F.split(F.translate(text, UPPER, LOWER), "\n"), lambda x: F.btrim(x, F.lit(SPACES)))


def _hash(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text") -> DataFrame:
    """(h1, h2, n_docs) of every normalised line in at least ``min_docs`` rows."""
    lines = docs.select(F.explode(F.array_distinct(_line_keys(text_or_empty(text_col)))).alias("line"))
    return (lines.where(F.length("line") >= min_chars).select(*_hash(F.col("line")))
            .groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept_text) for every row of ``docs``."""
    base = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    base = base.select(id_col, "text", *row_key(F.col(id_col), F.col("text")))
    frequent = written(frequent_lines(base, min_docs, min_chars, "text").drop("n_docs"), "frequent-lines")
    lines = base.select("k1", "k2", F.posexplode(_line_keys(F.col("text"))).alias("pos", "line"))
    gone = (lines.where(F.length("line") >= min_chars).select("k1", "k2", "pos", *_hash(F.col("line")))
            .join(frequent, ["h1", "h2"], "left_semi")
            .groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone")))
    out = base.join(written(gone, "dropped-lines"), ["k1", "k2"], "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return out.select(id_col, n_lines.cast("long").alias("n_lines"),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
