"""Approximate nearest neighbours by an inverted multi-index.

A vector's two halves are quantised separately: a cell is a pair of centroids,
one of each half, and an inverted list holds the cell's vectors.  A query takes
its distances to both halves' centroids (minus the inner product, as the
largest inner product is nearest), and a heap over the two sorted lists yields
the centroid pairs by rising summed distance until the visited lists hold
enough vectors; these are scored with their original vectors.

* Equal vectors are one entry with its ``k + 1`` smallest ids, all that a
  result of ``k`` can ever name, so a vector that makes up a third of the table
  is one entry and eats nothing of a query's budget.
* How many vectors to visit is measured, not set: a bounded sample of the
  queries is answered by brute force over all rows, and the visited share is
  the one that holds ``TARGET`` of their true neighbours (``share``).
* The lists lie in shards of about ``SHARD`` entries, in the order of their
  cells; a larger cell is split over several.  Queries come in blocks of about
  ``BLOCK``.  A task meets one shard with one block and scores the visited cells only, one
  matrix product a cell, keeping what can still be among the best.
* The centroids are fitted on ``SAMPLE`` vectors, every row is indexed.

Defined results: rows whose id is null or whose vector is null, zero, holds null
or non-finite entries or has another length than most vectors (of equally
frequent lengths the smaller) take no part; repeated rows count once; rows of
the query's own id are no candidates; ties go to the smaller id; scores are
sums from left to right in double precision.  An empty table gives an empty
result.  Other columns of the inputs are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import shuffle_partitions, written

CENTROIDS = 64                 # per half: 4,096 cells
SAMPLE = 16_384                # vectors that the centroids are fitted on
STEPS = 12
TARGET = 0.96                  # share of the sampled queries' true neighbours to be visited
SAMPLE_QUERIES = 256
SHARD = 32_768
BLOCK = 16_384
BUFFER = 2_000_000             # scored pairs held before the worse ones go


# ------------------------------------------------------------------ vectors
def dimension(df: DataFrame, vec_col: str) -> int:
    """The most frequent length of a vector (of equally frequent ones the smallest; 0 for no vectors)."""
    row = (df.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count()
           .orderBy(F.desc("count"), "d").first())
    return row.d if row else 0


def usable(vec_col: str, dim: int):
    """Whether a vector has ``dim`` entries, all finite; null counts as false."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))      # noqa: E731
    return F.coalesce((F.size(vec_col) == dim) & F.forall(vec_col, number), F.lit(False))


def vectors(df: DataFrame, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The rows that take part, once each: (id long, vec array<double>)."""
    part = df.where(F.col(id_col).isNotNull() & usable(vec_col, dim) & F.exists(vec_col, lambda x: x != 0))
    # adding 0.0 turns -0.0 into 0.0, so equal vectors are equal in every bit
    return part.select(F.col(id_col).cast("long").alias("id"),
                       F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec")).distinct()


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


# ------------------------------------------------------------------ index
@dataclass
class Index:
    """Entries (cell, shard, vec, ids), written; the centroids of both halves; entries and first shard of each cell."""

    entries: DataFrame
    centres: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray
    rows: np.ndarray           # ids that a cell's entries hold
    first: np.ndarray
    pieces: np.ndarray
    dim: int
    k: int

    @property
    def total(self) -> int:
        return int(self.sizes.sum())


def centroids(sample: np.ndarray, count: int, steps: int = STEPS) -> np.ndarray:
    """Lloyd's centroids of the sample's rows, started from distinct rows; fewer if there are fewer rows."""
    start = np.unique(sample, axis=0)
    centres = start[np.random.default_rng(7).permutation(len(start))[:count]].copy()
    for _ in range(steps):
        near = nearest(sample, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (rows @ centres.T), axis=1) if len(centres) else np.empty(0, np.int64)


def _assign(centres: tuple[np.ndarray, np.ndarray], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = dim // 2
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), dim)
                cell = nearest(x[:, :half], centres[0]) * len(centres[1]) + nearest(x[:, half:], centres[1])
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *b.columns], ["cell", "vec", "ids"])
    return run


def build(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
          centroid_count: int = CENTROIDS, sample: int = SAMPLE, shard: int = SHARD) -> Index:
    """The index of all rows of ``df`` for results of up to ``k`` neighbours."""
    spark, dim = df.sparkSession, dimension(df, vec_col)
    order = Window.partitionBy("vec").orderBy("id")
    units = (vectors(df, dim, id_col, vec_col).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
             .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    units = written(units, "distinct-vectors")
    rows = units.orderBy(F.xxhash64("vec")).limit(sample).select("vec").toArrow()      # at most ``sample`` rows
    some, half = matrix(rows.column(0).combine_chunks(), dim) if rows.num_rows else np.empty((0, dim)), dim // 2
    centres = (centroids(some[:, :half], centroid_count), centroids(some[:, half:], centroid_count))
    cells = len(centres[0]) * len(centres[1])

    lists = written(units.mapInArrow(_assign(centres, dim), "cell int, vec array<double>, ids array<long>"), "inverted-lists")
    sizes, held = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for r in lists.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("m")).collect():   # a row a cell
        sizes[r.cell], held[r.cell] = r.n, r.m
    pieces = np.maximum(1, -(-sizes // shard))
    before = np.cumsum(np.where(pieces > 1, 0, sizes)) - np.where(pieces > 1, 0, sizes)
    small = before // shard                                # small cells fill common shards, a large one has its own
    first = np.where(pieces > 1, small.max(initial=0) + 1 + np.cumsum(np.where(pieces > 1, pieces, 0)) - pieces, small)
    where = spark.createDataFrame([(int(c), int(first[c]), int(pieces[c])) for c in np.flatnonzero(sizes)],
                                  "cell int, first int, pieces int")
    entries = lists.join(F.broadcast(where), "cell").select(
        "cell", (F.col("first") + F.pmod(F.xxhash64("vec"), F.col("pieces")).cast("int")).alias("shard"), "vec", "ids")
    return Index(entries, centres, sizes, held, first, pieces, dim, k)


# ------------------------------------------------------------------ traversal
def traverse(near: np.ndarray, far: np.ndarray) -> Iterator[int]:
    """The pairs of both lists' places by rising sum of distances: a heap over the sorted lists (cell numbers)."""
    a, b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    x, y, ai, bi = near[a].tolist(), far[b].tolist(), a.tolist(), b.tolist()
    width, reached = len(bi), [0] * len(ai)               # reached[i]: pairs (i, 0 .. reached - 1) were yielded
    heap = [(x[0] + y[0], 0, 0)] if x and y else []
    while heap:
        _, i, j = heapq.heappop(heap)
        yield ai[i] * width + bi[j]
        reached[i] = j + 1
        # a pair enters when both its neighbours towards the start are out
        if i + 1 < len(ai) and reached[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < width and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))


def distances(index: Index, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = index.dim // 2
    return -(index.centres[0] @ q[:half]), -(index.centres[1] @ q[half:])


def visited(index: Index, q: np.ndarray, budget: int) -> list[int]:
    """The non-empty cells up to ``budget`` entries, at least ``k + 1`` rows where there are so many."""
    out, entries, rows = [], 0, 0
    for cell in traverse(*distances(index, q)):
        if n := int(index.sizes[cell]):
            out.append(cell)
            entries, rows = entries + n, rows + int(index.rows[cell])
            if entries >= budget and rows > index.k:
                break
    return out


def _plan(index: Index, budget: int):
    """Batches of (id, qk, block, vec) to one row per query and shard that it visits, with the visited cells."""
    bare = Index(None, index.centres, index.sizes, index.rows, index.first, index.pieces, index.dim, index.k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, shards, cells = [], [], []
            for row, q in enumerate(matrix(b.column(3), bare.dim) if b.num_rows else []):
                by: dict[int, list[int]] = {}
                for cell in visited(bare, q, budget):
                    for piece in range(int(bare.pieces[cell])):
                        by.setdefault(int(bare.first[cell]) + piece, []).append(cell)
                take += [row] * len(by)
                shards += by.keys()
                cells += by.values()
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int32()), *[c.take(at) for c in b.columns], pa.array(cells, pa.list_(pa.int32()))],
                ["shard", "id", "qk", "block", "vec", "cells"])
    return run


# ------------------------------------------------------------------ scoring
class Best:
    """Pairs of query and entry that can still be among a query's ``count`` best."""

    def __init__(self, queries: int, count: int, slack: float) -> None:
        self.least, self.count, self.slack = np.full(queries, -np.inf), count, slack
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, query: np.ndarray, entry: np.ndarray, score: np.ndarray) -> None:
        """Scores of ``entry`` (rows) by ``query`` (columns)."""
        e, q = np.nonzero(score >= self.least[query])
        self.parts.append((query[q], entry[e], score[e, q]))
        self.held += len(q)
        if self.held > BUFFER:
            self.pairs()

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        q, e, s = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        order = np.lexsort((-s, q))
        q, e, s = q[order], e[order], s[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        full = starts[np.diff(np.r_[starts, len(q)]) >= self.count]
        self.least[q[full]] = s[full + self.count - 1] - self.slack       # rounding of the matrix product
        keep = s >= self.least[q]
        self.parts, self.held = [(q[keep], e[keep], s[keep])], int(keep.sum())
        return q[keep], e[keep]


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from left to right: the same for equal vectors wherever they lie."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def _score(dim: int, k: int):
    """One shard and one block of queries to the block's best candidates in the shard: (query_id, qk, vec_id, score)."""
    def run(ours: pa.Table, queries: pa.Table) -> pa.Table:
        ours, queries = ours.combine_chunks(), queries.combine_chunks()
        if not ours.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "qk": pa.array([], pa.int64()),
                             "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ours = ours.take(pa.array(np.argsort(ours["cell"].to_numpy(), kind="stable")))
        x, q = matrix(_one(ours["vec"]), dim), matrix(_one(queries["vec"]), dim)
        names, starts = np.unique(ours["cell"].to_numpy(), return_index=True)
        ends = np.r_[starts[1:], len(x)]
        cells = _one(queries["cells"])
        who = np.repeat(np.arange(len(q)), np.diff(cells.offsets.to_numpy()))
        place = np.searchsorted(names, cells.flatten().to_numpy())
        known = (place < len(names)) & (names[np.minimum(place, len(names) - 1)] == cells.flatten().to_numpy())
        who, place = who[known], place[known]              # a piece of a split cell may be empty
        order = np.argsort(place, kind="stable")
        who, edges = who[order], np.searchsorted(place[order], np.arange(len(names) + 1))
        size = float(np.abs(x).max(initial=0) * np.abs(q).max(initial=0)) * dim
        best = Best(len(q), k + 1, size * dim * 1e-15)
        for c in range(len(names)):
            asking = who[edges[c]:edges[c + 1]]
            for at in range(0, len(asking), 4096):
                some = asking[at:at + 4096]
                for lo in range(starts[c], ends[c], 1024):
                    hi = min(ends[c], lo + 1024)
                    best.add(some, np.arange(lo, hi), x[lo:hi] @ q[some].T)
        a, e = best.pairs()
        score = exact(q[a], x[e]) if len(a) else np.empty(0)
        ids = _one(ours["ids"])
        n = np.diff(ids.offsets.to_numpy())[e]
        at = np.repeat(ids.offsets.to_numpy()[:-1][e] - np.cumsum(n) + n, n) + np.arange(n.sum())
        a, score = np.repeat(a, n), np.repeat(score, n)
        vec_id, query_id = ids.values.to_numpy()[at], queries["id"].to_numpy()[a]
        other = vec_id != query_id
        a, score, vec_id = a[other], score[other], vec_id[other]
        order = np.lexsort((vec_id, -score, a))
        a, score, vec_id = a[order], score[order], vec_id[order]
        first = np.searchsorted(a, a)                      # where the row's query starts
        keep = np.arange(len(a)) - first < k
        a, score, vec_id = a[keep], score[keep], vec_id[keep]
        return pa.table({"query_id": queries["id"].to_numpy()[a], "qk": queries["qk"].to_numpy()[a], "vec_id": vec_id,
                         "score": score})
    return run


def _one(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


# ------------------------------------------------------------------ depth and search
def _brute(q: np.ndarray, ids: np.ndarray, dim: int, k: int):
    """Batches of entries to a partition's best for each of a few queries: (query, cell, score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, cell = np.full((len(q), 0), 0.0), np.zeros((len(q), 0), np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            s = q @ matrix(b.column(1), dim).T
            own = b.column(2)                              # an entry with the query's id alone is no candidate
            alone = np.diff(own.offsets.to_numpy()) == 1
            lone = np.where(alone, own.values.to_numpy()[own.offsets.to_numpy()[:-1]], -1)
            s[(ids[:, None] == lone[None, :]) & alone[None, :]] = -np.inf
            c = np.broadcast_to(b.column(0).to_numpy(zero_copy_only=False), s.shape)
            score, cell = np.concatenate([score, s], 1), np.concatenate([cell, c], 1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, cell = np.take_along_axis(score, best, 1), np.take_along_axis(cell, best, 1)
        n = np.isfinite(score)
        query = np.broadcast_to(np.arange(len(q))[:, None], score.shape)
        yield pa.RecordBatch.from_arrays([pa.array(query[n], pa.int64()), pa.array(cell[n], pa.int32()), pa.array(score[n])],
                                         ["query", "cell", "score"])
    return run


def share(index: Index, queries: DataFrame, target: float = TARGET, sample: int = SAMPLE_QUERIES) -> float:
    """The share of the entries to visit so that ``target`` of the true neighbours of ``sample`` queries are visited.

    ``queries`` is (id, vec).  The sampled queries' neighbours are found by brute force over all entries, so the share
    follows the data; the driver gets ``sample`` x k cells.
    """
    rows = queries.orderBy(F.xxhash64("vec", "id")).limit(sample).toArrow()
    if not rows.num_rows or not index.total:
        return 1.0
    q, ids = matrix(rows.column(1).combine_chunks(), index.dim), rows.column(0).to_numpy()
    order = Window.partitionBy("query").orderBy(F.desc("score"), "cell")
    true = (index.entries.select("cell", "vec", "ids")
            .mapInArrow(_brute(q, ids, index.dim, index.k), "query long, cell int, score double")
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= index.k).select("query", "cell").collect())
    cells: dict[int, list[int]] = {}
    for r in true:
        cells.setdefault(r.query, []).append(r.cell)
    needed: list[int] = []
    for i, wanted in cells.items():
        order, at, upto = {}, 0, 0
        for at, cell in enumerate(traverse(*distances(index, q[i]))):
            upto += int(index.sizes[cell])
            order[cell] = upto
        needed += [order[c] for c in wanted]
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] / index.total if needed else 1.0


def search(index: Index, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the index's ``k`` nearest found for every row of ``queries``."""
    asked = written(vectors(queries, index.dim, id_col, vec_col), "query-vectors")
    budget = int(np.ceil(share(index, asked, target) * index.total))
    blocks = max(1, -(-asked.count() // block))
    asked = asked.select("id", F.xxhash64("vec").alias("qk"), F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int").alias("block"),
                         "vec")
    # a query's traversal is far more work than its row is long, so the rows are spread before it
    asked = asked.repartition(shuffle_partitions(asked.sparkSession), "id", "qk")
    planned = asked.mapInArrow(_plan(index, budget), "shard int, id long, qk long, block int, vec array<double>, cells array<int>")
    entries = index.entries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = (entries.groupBy("shard", "block").cogroup(planned.groupBy("shard", "block"))
             .applyInArrow(_score(index.dim, index.k), "query_id long, qk long, vec_id long, score double"))
    order = Window.partitionBy("query_id", "qk").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= index.k)
            .select("query_id", "rank", "vec_id", "score"))


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of ``true`` (query_id, vec_id) in ``found``."""
    got = true.join(found.select("query_id", "vec_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    row = got.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits")).first()
    return row.hits / row.n if row.n else 1.0
