"""BPE encoding and decoding over a distinct-word table.

White space never crosses a token of this kind of vocabulary, so a text's ids
are its words' ids in order.  Texts are split once, in blocks of whole
documents: a block holds its distinct words and each document's words as
positions in that list.  A block sends one compressed word list per bucket of
the word hash, as a shuffle's map task does per reducer; in the bucket each
distinct word is encoded once, whatever the number of its occurrences, and the
ids go back to the block.  There they are joined to the documents by position
and decoded through the id-to-piece table (as many rows as the vocabulary).
The texts themselves are read once and never shuffled, and a word that makes
up a third of a corpus is one entry per block.

Blocks are written to the shared folder, bucketed by block, so both uses see
the same ones and the documents' half is joined where it lies, without a shuffle.
Every step streams: a worker holds one block or one bucket's word cache, both
of bounded size (one document longer than a block is a block of its own).

Defined results: a null text is empty and has no ids; a row is a document and
repeated rows are returned one by one; a null id is kept.  Other columns of the
input are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.common import shuffle_partitions, text_or_empty
from basketry.session import shared_dir

BLOCK_WORDS, BLOCK_DOCS = 4_000_000, 200_000
ENCODE_WORDS = 4_000             # words encoded at a time: an encoding has tokens, offsets and masks besides its ids
CACHE_WORDS = 1_000_000          # a bucket's cache starts anew beyond it
OUT_WORDS = 100_000              # documents leave in batches of about so many words
#: str.split() also splits at these four, which are no white space to the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class Numbers(dict):
    """Word to position, in order of first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def words_of(text: str) -> list[str]:
    return [w for w in WHITE.split(text) if w] if SEPARATORS.search(text) else text.split()


def _packed(a: np.ndarray) -> bytes:
    """Byte planes, compressed: the high bytes of small numbers are zeros."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T
    return zstandard.ZstdCompressor(level=5).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def _blocks(buckets: int, id_type: pa.DataType):
    """Splits batches of (id, text) into blocks: a row of documents and a row of words for each bucket."""
    names = ["part", "block", "bucket", "data", "places", "ids", "n_words"]

    def block(ids: list, counts: list[int], places: list[np.ndarray], words: Numbers) -> pa.RecordBatch:
        name, all_places = uuid.uuid4().hex, np.concatenate([*places, np.empty(0, np.int32)])
        order = np.argsort(-np.bincount(all_places, minlength=len(words)), kind="stable")    # frequent words first:
        rank = np.empty(len(order), np.int32)                                               # small numbers, few bytes
        rank[order] = np.arange(len(order), dtype=np.int32)
        listed = list(words)
        words = [listed[i] for i in order.tolist()]
        keys = [zlib.crc32(w.encode()) % buckets for w in words]
        lists: dict[int, list[str]] = {}
        for k, w in zip(keys, words, strict=True):
            lists.setdefault(k, []).append(w)
        pack = zstandard.ZstdCompressor(level=9).compress
        rows = [("docs", name, None, _packed(np.array(keys, np.int32)),
                 _packed(rank[all_places]), ids, counts)]
        rows += [("words", name, k, pack(" ".join(v).encode()), None, None, None) for k, v in lists.items()]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(id_type),
                 pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, places, words, total = [], [], [], Numbers(), 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = words_of(text.as_py())
                if ids and (total + len(found) > BLOCK_WORDS or len(ids) >= BLOCK_DOCS):
                    yield block(ids, counts, places, words)
                    ids, counts, places, words, total = [], [], [], Numbers(), 0
                ids.append(doc)
                counts.append(len(found))
                places.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                total += len(found)
        if ids:
            yield block(ids, counts, places, words)
    return run


def _encode(tokenizer):
    """Word lists to their ids, each distinct word encoded once: (block, bucket, data), data = counts and ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark gives this worker one core
        encoder, known = Tokenizer.from_str(tokenizer.value), {}
        for b in batches:
            out = []
            for row in b.column(2):
                words = row.as_py()
                words = zstandard.ZstdDecompressor().decompress(words).decode().split(" ")
                if len(known) + len(words) > CACHE_WORDS:
                    known = {}
                new = [w for w in words if w not in known]
                for i in range(0, len(new), ENCODE_WORDS):
                    some = new[i:i + ENCODE_WORDS]
                    for w, e in zip(some, encoder.encode_batch(some, add_special_tokens=False), strict=True):
                        known[w] = np.array(e.ids, np.uint32).tobytes()
                ids = [known[w] for w in words]
                counts = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                out.append(_packed(np.concatenate([np.array([len(ids)], np.uint32), counts, np.frombuffer(b"".join(ids), np.uint32)])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())],
                                             ["block", "bucket", "data"])
    return run


def _assemble(pieces, id_name: str, id_type: pa.DataType):
    """A block's documents and its words' ids to (id, n_tokens, ids, decoded)."""
    def documents(row: dict, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = _unpacked(row["data"], "<i4")
        starts, sizes, flat, at = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [], 0
        order = np.argsort(keys, kind="stable")             # a bucket's words stand in the order of their positions
        edges = np.searchsorted(keys[order], np.arange(keys.max(initial=-1) + 2))
        for got in row["found"] or []:
            a = _unpacked(got["data"], "<u4")
            n, mine = int(a[0]), order[edges[got["bucket"]]:edges[got["bucket"] + 1]]
            if n != len(mine):
                raise ValueError(f"block {row['block']}: {n} encoded words for {len(mine)} positions")
            sizes[mine] = a[1:n + 1]
            starts[mine] = at + np.cumsum(sizes[mine]) - sizes[mine]
            flat.append(a[n + 1:])
            at += len(flat[-1])
        if sum(len(order[edges[g["bucket"]]:edges[g["bucket"] + 1]]) for g in row["found"] or []) != len(keys):
            raise ValueError(f"block {row['block']}: words without ids")
        flat = np.concatenate([*flat, np.empty(0, np.uint32)])
        places, counts = _unpacked(row["places"], "<i4"), np.array(row["n_words"], np.int64)
        ends = np.cumsum(counts)
        first = 0
        while first < len(counts):
            base = ends[first] - counts[first]
            last = max(first + 1, int(np.searchsorted(ends, base + OUT_WORDS, "right")))
            p = places[base:ends[last - 1]]
            n = sizes[p]
            upto = np.r_[0, np.cumsum(n)]
            ids = flat[np.repeat(starts[p] - upto[:-1], n) + np.arange(upto[-1])].astype("<u4")
            cut = upto[np.r_[0, ends[first:last] - base]].tolist()
            text = table[ids].tolist()
            raw = [ids[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)]
            decoded = [" ".join(text[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"][first:last], id_type), pa.array(np.diff(cut), pa.int64()),
                 pa.array(raw, pa.binary()), pa.array(decoded, pa.string())], [id_name, "n_tokens", "ids", "decoded"])
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(pieces.value, object)
        for b in batches:
            for i in range(b.num_rows):
                yield from documents(b.slice(i, 1).to_pylist()[0], table)
    return run


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row.

    ids are the tokenizer's ids of the whole text without special tokens added, as little-endian unsigned 32-bit
    integers; decoded is what the ids stand for, special tokens included.  ``tokenizer_path`` is a file of the
    tokenizers library, readable on the driver, without truncation, padding or decoder.
    """
    from tokenizers import Tokenizer

    spark: SparkSession = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    vocab = Tokenizer.from_str(model)
    pieces = spark.sparkContext.broadcast([vocab.id_to_token(i) or "" for i in range(vocab.get_vocab_size(True))])
    model = spark.sparkContext.broadcast(model)

    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    kind, id_type = rows.schema[id_col].dataType.simpleString(), _arrow_type(rows, id_col)
    buckets, path = shuffle_partitions(spark), shared_dir(spark, "bpe-blocks")
    schema = (f"part string, block string, bucket int, data binary, places binary, ids array<{kind}>, "
              "n_words array<int>")
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    (rows.mapInArrow(_blocks(buckets, id_type), schema).write.option("compression", "uncompressed").option("path", path)
     .partitionBy("part").bucketBy(buckets, "block").saveAsTable(name))
    blocks = spark.table(name)
    found = (blocks.where("part = 'words'").select("block", "bucket", "data").repartition(buckets, "bucket")
             .mapInArrow(_encode(model), "block string, bucket int, data binary")
             .groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("found")))
    return (blocks.where("part = 'docs'").select("block", "data", "places", "ids", "n_words")
            .join(found, "block", "left")
            .mapInArrow(_assemble(pieces, id_col, id_type), f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string"))


def _arrow_type(df: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[col].dataType)
