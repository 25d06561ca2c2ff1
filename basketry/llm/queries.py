"""The registered queries of the training-data operators, with their DuckDB SQL.

Every query applies its operator, with production parameters, to its whole
table and derives the contract's columns from the operator's rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import (bpe, decontaminate, exact_dedup, html_text, language, multi_index, prefix_trie, quality,
                          simhash, toxicity, url_filter, whitening)
from basketry.llm.common import fold, table
from basketry.llm.line_dedup import drop_frequent_lines


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d
), k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10
)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN k.line END, chr(10) ORDER BY k.pos), ''))
         AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.rid
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "windows", "n_windows", "coverage", "verbatim", "first", "last")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), out="score")
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: The contract's rules: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


OP6_SQL = """
WITH r(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), u AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), j AS (
  SELECT p.*, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC NULLS LAST) AS place
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM j WHERE place = 1
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def bpe_digests(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = html_text.extract(pages, html_text.learn(pages), out="text")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.predict(docs, language.profiles(docs))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "language.lang_pred", "language.score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "toxicity.score", "toxicity.predicted",
                      "toxicity.offending")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
              ORDER BY i) AS entries FROM range(256) AS numbers(i)
), o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT),
                         lambda a, b: xor(a >> 8, entries[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o), crc_table
), turns AS (
  SELECT c.conv_id, 0 AS part, o.pos, role, text FROM c JOIN o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1 AS part, o.pos, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h
), s AS (
  SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY part, pos) FILTER (WHERE part IS NOT NULL), []) AS seq
  FROM c LEFT JOIN turns ON turns.conv_id = c.conv_id GROUP BY c.conv_id
), p AS (
  SELECT conv_id, len(seq) AS whole, unnest(range(len(seq) + 1)) AS depth, seq FROM s
), n AS (
  SELECT seq[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE whole = depth), '')) AS ends_sha256
  FROM p GROUP BY seq[1:depth], depth
), k AS (
  SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN depth = 0 THEN 0
              ELSE (n_convs - 1) * len(regexp_extract_all(n.prefix[depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM n LEFT JOIN k ON n.prefix = k.prefix
), up AS (
  SELECT prefix[1:above] AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT m.*, unnest(range(depth + 1)) AS above FROM m) GROUP BY 1
)
SELECT m.conv_id, m.depth, parent.conv_id AS parent_conv_id, m.n_convs, m.n_children, up.n_leaves::BIGINT AS n_leaves,
       up.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN up ON m.prefix = up.prefix
LEFT JOIN n AS parent ON m.depth > 0 AND parent.depth = m.depth - 1 AND parent.prefix = m.prefix[1:m.depth - 1]
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows)
    error = whitening.identity_error(rows, model)
    return whitening.whiten(rows, model).select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation",
                                                "whitened", "explained", F.lit(error).alias("identity_error"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return multi_index.search(multi_index.build(rows, k=20), rows.where(F.col("vec_id") % 20 == 0))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_bpe": op7_bpe,
    "op8_html_extraction": op8_html_extraction,
    "op9_language": op9_language,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}
ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op6_url_filter": OP6_SQL,
    "op11_prefix_trie": OP11_SQL,
}
