"""Exact dedup by content-defined chunk recipes.

A text is cut where a multiplicative hash of the last 8 bytes ends in zeros,
so equal stretches give equal chunks wherever they stand.  A chunk's
identifier is its XXH64; it is verified when all chunks of the corpus that
carry it agree in SHA-256 (compared as four words, pre-aggregated per task).
A document becomes its recipe, the ordered list of identifiers; a recipe with
an unverified identifier carries the chunks' full SHA-256 besides, so recipes
are equal exactly if the texts are.  Recipes (8 bytes a chunk) are grouped;
the texts themselves are read once and never shuffled.

Defined results: a null text counts as empty, whose recipe is empty; of equal
texts the row with the largest id stays (null is smaller than any id), of
rows that tie in that, one; a row is a document.  Other columns of the input
are ignored by ``duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import free_name, row_key, text_or_empty, without, written

BITS = 10                      # a cut every 1024 bytes on average
LEAST, MOST = 128, 1 << 16     # bounds of a chunk's bytes (the last one may be shorter)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def chunks(raw: bytes) -> list[bytes]:
    """The content-defined chunks of a text; joined, they are the text."""
    n = len(raw)
    if n <= LEAST:
        return [raw] if n else []
    words = np.ndarray((n - 7,), "<u8", raw, strides=(1,))
    at, cuts = 0, []
    for cut in (np.flatnonzero((words * FACTOR) >> np.uint64(64 - BITS) == 0) + 8).tolist():
        while cut - at > MOST:
            cuts.append(at := at + MOST)
        if cut - at >= LEAST:
            cuts.append(at := cut)
    while n - at > MOST:
        cuts.append(at := at + MOST)
    return [raw[i:j] for i, j in zip([0, *cuts], [*cuts, n], strict=True) if j > i]


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, sha, ids, proof) of every row: the text's SHA-256, its chunks' XXH64 and SHA-256 words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha, ids, proof, ends = [], [], [], [0]
            for raw in b.column(3):
                raw = raw.as_py()
                sha.append(hashlib.sha256(raw).digest())
                for c in chunks(raw):
                    ids.append(xxhash.xxh64_intdigest(c))
                    proof.append(hashlib.sha256(c).digest())
                ends.append(len(ids))
            at = np.array(ends, np.int32)
            yield pa.RecordBatch.from_arrays([
                *b.columns[:3], pa.array(sha, pa.binary()),
                pa.ListArray.from_arrays(pa.array(at), pa.array(np.array(ids, np.uint64).view(np.int64))),
                pa.ListArray.from_arrays(pa.array(4 * at), pa.array(np.frombuffer(b"".join(proof), np.int64))),
            ], [id_col, "k1", "k2", "sha", "ids", "proof"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col), *row_key(F.col(id_col), text), text.cast("binary").alias("raw"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, k1 long, k2 long, sha binary, ids array<long>, proof array<long>")


def unverified(table: DataFrame) -> DataFrame:
    """(id): identifiers that stand for chunks of different SHA-256."""
    one = F.transform("ids", lambda h, i: F.struct(h.alias("id"), F.slice("proof", 4 * i + 1, 4).alias("p")))
    chunk = table.select(F.explode(one).alias("c")).select("c.id", *[F.get("c.p", F.lit(j)).alias(f"p{j}")
                                                                     for j in range(4)])
    seen = chunk.groupBy("id").agg(*[f(f"p{j}").alias(f"{n}{j}") for j in range(4)
                                     for n, f in (("lo", F.min), ("hi", F.max))])
    return seen.where(" or ".join(f"lo{j} <> hi{j}" for j in range(4))).select("id")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, keep_id, group_size, kept, sha) of every row."""
    table = written(recipes(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "recipes")
    doubtful = written(unverified(table), "unverified-chunks")
    flagged = written(table.select("row", F.explode("ids").alias("id")).join(doubtful, "id", "left_semi")
                      .select("row").distinct().withColumn("flag", F.lit(True)), "unverified-recipes")
    table = (table.join(flagged, "row", "left")
             .withColumn("proof", F.when(F.col("flag"), F.col("proof")).otherwise(F.array().cast("array<long>"))))
    groups = (table.groupBy("ids", "proof")
              .agg(F.max(F.struct(F.col(id_col).alias("id"), (-F.col("row")).alias("row"))).alias("best"),
                   F.count("*").alias("n"))
              .where("n > 1").select("ids", "proof", F.col("best.id").alias("best_id"),
                                     (-F.col("best.row")).alias("best_row"), "n"))
    out = table.join(written(groups, "copies"), ["ids", "proof"], "left")
    alone = F.col("n").isNull()
    return out.select(
        id_col, "k1", "k2", F.when(alone, F.col(id_col)).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"), "sha")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one ``duplicates`` keeps."""
    rows = written(duplicates(docs, id_col, text_col).select("k1", "k2", "kept", "group_size"), "duplicates")
    keys = rows.where("group_size > 1").groupBy("k1", "k2").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    keys = written(keys, "copy-keys")
    twins = keys.where("kept and n > 1")
    if twins.isEmpty():
        return without(docs, keys.where("not kept"), id_col, text_col)
    names = [free_name(docs, "k1"), free_name(docs, "k2")]
    one = without(docs, twins, id_col, text_col, "left_semi").withColumns(
        dict(zip(names, row_key(F.col(id_col), text_or_empty(text_col)), strict=True)))
    one = one.dropDuplicates(names).drop(*names)
    return without(docs, keys.where("not kept or n > 1"), id_col, text_col).unionByName(one)
