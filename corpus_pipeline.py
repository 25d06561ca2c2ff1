"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet in the shared folder and read back as
the next one's documents.  All but the last return the columns of documents.

1. toxicity: documents that the noisy-or model predicts toxic go.  Rows whose
   id the labels hold outside the held-out fold train it.
2. exact dedup: of equal texts the row with the largest id stays.
3. SimHash near dedup: of the documents whose fingerprints (three words, 2
   bits) are connected, the one with the smallest id stays; a row without an
   id is kept.
4. decontamination: documents in which a benchmark item is found go.
5. BPE: ids and decoded text of what is left, with their digests.

Defined results: a null or empty text is a document without a toxic sentence or
a benchmark item; of several, exact dedup keeps one.  Repeated rows are exact
copies: the one with the largest id stays, of equal ids one.  Labels and benchmark rows that are null or empty teach and match
nothing.  Columns that documents have besides the usual ones stay up to the
last stage.  An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from basketry.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, width=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokenise),
]

#: SQL can express neither a trained model nor XXH64 fingerprints nor BPE; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
