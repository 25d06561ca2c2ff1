"""SimHash near-dedup by anchor-point covering.

The anchors are the words of the perfect Hamming code of length 63: every
63-bit string lies within covering radius 1 of one anchor.  Two fingerprints
that differ in at most 2 bits have a string between them within 1 bit of
either, so that string's anchor is within 1 + 1 = 2 bits of both.  Replicating
a fingerprint to all anchors within 2 bits - 32 of them, or 1 for an anchor
itself - makes every linked pair meet at one anchor at least (bit 0 stands
outside the code and only counts in the comparison).  That is the covering
radius plus half the threshold from both sides, instead of plus the whole
threshold from one side (652 anchors).

Distinct fingerprints meet, copies don't: at most 2 * (1 + 63 + 1953) = 4034
strings lie within 2 bits of an anchor, whatever the input, so a group is
bounded by the geometry.  Within it only a spanning forest of links is
emitted.  Components run over written tables (components.py).

Defined results: a null or empty text has the fingerprint 0 and is linked like
any other; a row is a document, repeated rows are returned one by one; a row
with a null id takes part and gets the component's smallest id, null if no
member has one.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import row_key, shuffle_partitions, text_or_empty, without, written
from basketry.llm.components import components

THRESHOLD = 2
BLOCK = 1 << 16


def fingerprint(raw: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is set if it is in over half the shingles' XXH64."""
    words = raw.lower().split()          # bytes: A-Z only, and exactly the six white-space characters
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        spans = [(0, len(joined))]
    else:
        lens = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lens + 1) - 1
        spans = list(zip((ends - lens)[:n - width + 1].tolist(), ends[width - 1:].tolist(), strict=True))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(spans), BLOCK):   # a very long text takes bounded memory
        part = spans[at:at + BLOCK]
        h = np.fromiter((digest(joined[i:j], 42) for i, j in part), np.uint64, len(part))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, fp) of every row; fp is the fingerprint as a signed long, k1 and k2 the row's key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(raw.as_py(), width) for raw in b.column(3)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp.view(np.int64))], [id_col, "k1", "k2", "fp"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col), *row_key(F.col(id_col), text), text.cast("binary").alias("raw"))
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, k1 long, k2 long, fp long"
    return rows.mapInArrow(run, schema)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, anchor) for every Hamming code word within 2 bits of each uint64 fingerprint.

    Bit i stands at position i of the code; the exclusive or of the set bits'
    positions is the syndrome s, and flipping the bits i and i ^ s gives a code
    word for every i.
    """
    s = np.zeros(len(fp), np.uint64)
    for j in range(6):
        mask = np.uint64(sum(1 << i for i in range(64) if i >> j & 1))
        s |= (np.bitwise_count(fp & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(j)
    i = np.arange(64, dtype=np.uint64)[None, :]
    other = s[:, None] ^ i
    flips = (np.uint64(1) << i) ^ (np.uint64(1) << other)
    rows, cols = np.nonzero((i < other) | ((s[:, None] == 0) & (i == 0)))
    return rows, (fp[rows] ^ flips[rows, cols]) & ~np.uint64(1)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fp), BLOCK):
            part = fp[at:at + BLOCK]
            rows, anchor = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part[rows].view(np.int64))],
                                             ["anchor", "fp"])


def forest(fp: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links between the fingerprints of one anchor."""
    out, free = [], np.arange(len(fp))
    while len(free):
        todo, free = [free[0]], free[1:]
        while todo and len(free):
            near = np.bitwise_count(fp[free] ^ fp[x := todo.pop()]) <= threshold
            out += [(x, y) for y in free[near]]
            todo += list(free[near])
            free = free[~near]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of one anchor; the rows come sorted by anchor."""
    held_a, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(a: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(a)])
        two = starts[sizes == 2]
        two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= THRESHOLD] if len(two) else two
        x, y = [f[two]], [f[two + 1]] if len(two) else [f[:0]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            pairs = np.array(forest(f[s:s + n]), np.int64).reshape(-1, 2)
            x.append(f[s + pairs[:, 0]])
            y.append(f[s + pairs[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (x, y)], ["a", "b"])

    for b in batches:
        a = np.r_[held_a, b.column(0).to_numpy()]
        f = np.r_[held_f, b.column(1).to_numpy().view(np.uint64)]
        whole = int(np.searchsorted(a, a[-1])) if len(a) else 0      # the last run may go on: at most 4034 rows
        held_a, held_f = a[whole:], f[whole:]
        yield links(a[:whole], f[:whole])
    yield links(held_a, held_f)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp) within 2 bits of each other."""
    spark = fps.sparkSession
    return (fps.select("fp").mapInArrow(_replicate, "anchor long, fp long")
            .repartition(shuffle_partitions(spark), "anchor").sortWithinPartitions("anchor", "fp")
            .mapInArrow(_compare, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, fp, component_id): component_id is the smallest id reachable over links of at most 2 bits."""
    prints = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    fps = written(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct-fingerprints")
    linked = written(components(links(fps)).withColumnRenamed("node", "fp").join(fps, "fp"), "linked")
    best = written(linked.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    linked = linked.join(best, "root").select("fp", "component_id")
    ids = fps.join(written(linked, "linked"), "fp", "left").select("fp", F.coalesce("component_id", "first")
                                                                  .alias("component_id"))
    return prints.join(written(ids, "fingerprint-components"), "fp").select(id_col, "k1", "k2", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near-duplicates of a component's smallest id (rows without an id are kept)."""
    groups = near_duplicates(docs, width, id_col, text_col)
    gone = written(groups.where(F.col(id_col) != F.col("component_id")).select("k1", "k2").distinct(), "near-copies")
    return without(docs, gone, id_col, text_col)
