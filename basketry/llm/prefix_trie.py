"""Conversation prefix trie: ternary search trees over turn ids, one per range shard.

1. Turns (role, text) are a dictionary: every distinct turn gets one id, so a
   conversation is a list of ids, and texts are not moved with it.
2. Equal conversations are one sequence with the number and the smallest id of
   its members; the digest of their ids is streamed over the sorted ids.
3. The distinct sequences are dealt out by range in the order of their ids.
   A shard's sequences go into a ternary search tree, the median first, then
   the medians of both halves, so the search at each turn is balanced.  One
   iterative traversal, children before parents, adds up members, leaves and
   savings.
4. A node is whole in its shard unless it lies on the path of the shard's first
   or last sequence; only those two paths can go on in a neighbour.  They leave
   the shard as sequences that carry, at every node, what hangs below it and is
   already counted.  ``FAN`` neighbouring shards' paths make the next round's
   shard and are merged by the same tree, until one shard is left, which has no neighbours.
5. A node's parent may be such a boundary node; the parent's id is joined by its
   prefix digest once it is known.

A task holds the trees of one shard of about ``SHARD`` turns (a longer
sequence is never cut) or the two paths of ``FAN`` shards.  A turn, a first turn or a
whole conversation that is shared by a third of all conversations is one
dictionary entry, one node or one sequence.

Defined results: null role or text is empty; turns are ordered by turn number
(null first), then role, text; repeated rows are turns each; rows without a conversation id take
no part.  An empty table gives an empty result (a trie without members has no root).  Other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import shuffle_partitions, text_or_empty, written

SHARD = 100_000                # turns of a shard's distinct sequences, about
FAN = 32                       # shards whose boundary paths make one shard of the next round
NO_ENDS = hashlib.sha256(b"").hexdigest()
NOBODY = 2 ** 63 - 1
#: A node on its way: what is known of it besides the paths through it.
COUNTS = ["n", "least", "leaves", "kids", "saved"]


# ------------------------------------------------------------------ conversations as sequences of turn ids
def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv, pos, sha, words): a conversation's turns from 0, by turn number (null first), role and text."""
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), text_or_empty(role).alias("role"),
        text_or_empty(text).alias("text"))
    sha = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "turn")
    return (rows.withColumn("pos", F.row_number().over(order).cast("long") - 1)
            .select("conv", "pos", sha.alias("sha"), F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words")))


def encoded(turns: DataFrame) -> DataFrame:
    """(conv, pos, id, words) with dictionary ids; equal turns share one.  Both join sides are written tables."""
    turns = written(turns, "turns")
    names = written(turns.select("sha").distinct().withColumn("id", F.monotonically_increasing_id()), "turn-dictionary")
    return written(turns.join(names, "sha").select("conv", "pos", "id", "words"), "encoded-turns")


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """(conv, ids, words) of every conversation c: the first h turns of conversation c - c % group, then its own from
    the h-th on; h = crc32(decimal c) % heads."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h")
    pairs = F.array_sort(F.collect_list(F.struct("pos", "id", "words")))
    own = (turns.select("*", h).groupBy("conv", "h")
           .agg(F.array_sort(F.collect_list(F.when(F.col("pos") >= F.col("h"), F.struct("pos", "id", "words")))).alias("own")))
    first = (turns.where(F.col("pos") < heads - 1).where(F.col("conv") % group == 0)
             .groupBy(F.col("conv").alias("base")).agg(pairs.alias("head")))
    head = F.slice(F.coalesce("head", F.slice("own", 1, 0)), 1, F.col("h").cast("int"))
    out = (own.withColumn("base", F.col("conv") - F.col("conv") % group).join(first, "base", "left")
           .select("conv", F.concat(head, "own").alias("all")))
    return out.select("conv", F.col("all.id").alias("ids"), F.col("all.words").alias("words"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, conv) sorted to (k1, k2, n, least, ends): ids are hashed as they stream by."""
    key, sha, n, least = None, None, 0, 0
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        done = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)]
        return pa.RecordBatch.from_arrays(done, ["k1", "k2", "n", "least", "ends"])

    for b in batches:
        k1, k2, conv = (b.column(i).to_pylist() for i in range(3))
        for now, c in zip(zip(k1, k2, strict=True), conv, strict=True):
            if now != key:
                if key is not None:
                    out.append((*key, n, least, sha.hexdigest()))
                key, sha, n, least = now, hashlib.sha256(str(c).encode()), 1, c
            else:
                sha.update(b"," + str(c).encode())
                n += 1
        if len(out) > 10_000:
            yield batch()
            out = []
    if key is not None:
        out.append((*key, n, least, sha.hexdigest()))
    if out:
        yield batch()


def sequences(conversations: DataFrame) -> DataFrame:
    """Distinct sequences (conv, ids, words) -> (ids, words, n, least, ends), their members counted and digested."""
    spark = conversations.sparkSession
    keyed = written(conversations.select("*", F.xxhash64("ids").alias("k1"), F.xxhash64(F.lit(1), "ids").alias("k2")), "sequences")
    members = (keyed.select("k1", "k2", "conv").repartition(shuffle_partitions(spark), "k1", "k2")
               .sortWithinPartitions("k1", "k2", "conv")
               .mapInArrow(_digests, "k1 long, k2 long, n long, least long, ends string"))
    # the smallest member brings the sequence: one row per sequence, so copies are not moved
    return written(members.join(keyed.select(F.col("conv").alias("least"), "ids", "words"), "least")
                   .select("ids", "words", "n", "least", "ends"), "distinct-sequences")


# ------------------------------------------------------------------ one shard
class Tree:
    """A ternary search tree of sequences; a node stands for one prefix, 0 is the root."""

    def __init__(self) -> None:
        self.key, self.lo, self.eq, self.hi = [0], [0], [0], [0]
        self.parent, self.depth, self.words = [0], [0], [0]

    def insert(self, ids: list[int], words: list[int]) -> list[int]:
        """The nodes of the sequence's prefixes, from the root on."""
        key, lo, eq, hi = self.key, self.lo, self.eq, self.hi
        path, at = [0], 0
        for depth, (x, w) in enumerate(zip(ids, words, strict=True), 1):
            node, link, owner = eq[at], eq, at
            while node and key[node] != x:                # 0 is the root, so no node below another
                link, owner = (lo, node) if x < key[node] else (hi, node)
                node = link[owner]
            if not node:
                node = link[owner] = len(key)
                key.append(x)
                lo.append(0)
                eq.append(0)
                hi.append(0)
                self.parent.append(at)
                self.depth.append(depth)
                self.words.append(w)
            path.append(node)
            at = node
        return path


def median_first(count: int) -> list[int]:
    """0 .. count - 1 with the middle first, then the middles of both halves, and so on."""
    out, parts = [], [(0, count)]
    for lo, hi in parts:                                   # the list grows while it is read
        if lo < hi:
            mid = (lo + hi) // 2
            out.append(mid)
            parts += [(lo, mid), (mid + 1, hi)]
    return out


def prefix_digests(ids: list[int]) -> list[bytes]:
    """128 bits for each prefix of the sequence, the empty one first."""
    h, out = hashlib.blake2b(digest_size=16), []
    out.append(h.digest())
    for x in ids:
        h.update(int(x).to_bytes(8, "little", signed=True))
        out.append(h.copy().digest())
    return out


def shard_nodes(rows: list[dict], whole: bool, named: bool) -> tuple[list[dict], list[dict]]:
    """(finished nodes, boundary paths) of one shard's sequences, given in their order.

    A row has ids, words and, for every prefix, ``COUNTS`` and ends: what is already counted below that prefix.
    ``whole`` says that the shard has no neighbours, so every node is finished; ``named`` that its nodes may be asked
    for as parents, as all of a round after the first are.
    """
    tree, paths = Tree(), {}
    for i in median_first(len(rows)):
        paths[i] = tree.insert(rows[i]["ids"], rows[i]["words"])
    size = len(tree.key)
    n, least, leaves, kids, saved = [0] * size, [NOBODY] * size, [0] * size, [0] * size, [0] * size
    ends: list[str | None] = [None] * size
    for i, row in enumerate(rows):
        for node, a, b, c, d, e, f in zip(paths[i], *(row[k] for k in COUNTS), row["ends"], strict=True):
            n[node] += a
            least[node] = min(least[node], b)
            leaves[node] += c
            kids[node] += d
            saved[node] += e
            ends[node] = f or ends[node]
    mine = [(n[i], least[i], leaves[i], kids[i], saved[i]) for i in range(size)]      # before the sums over the tree
    edge = {} if whole else dict.fromkeys([*paths[0], *paths[len(rows) - 1]])

    # parents are created before their children, so falling numbers visit children first
    below = [list(x) for x in mine]                        # of boundary nodes: what hangs below, without their paths
    finished = []
    for node in range(size - 1, -1, -1):
        if node in edge:
            continue
        if not kids[node]:
            leaves[node] = 1
        saved[node] += (n[node] - 1) * tree.words[node]
        finished.append(node)
        if node:
            up = tree.parent[node]
            to = below[up] if up in edge else None
            if to is not None:
                to[0] += n[node]
                to[1] = min(to[1], least[node])
                to[2] += leaves[node]
                to[3] += 1
                to[4] += saved[node]
            else:
                n[up] += n[node]
                least[up] = min(least[up], least[node])
                leaves[up] += leaves[node]
                kids[up] += 1
                saved[up] += saved[node]

    names: dict[int, bytes] = {}
    for i in range(len(rows)) if named else (0, len(rows) - 1):
        names.update(zip(paths[i], prefix_digests(rows[i]["ids"]), strict=True))
    out = []
    for node in finished:
        up = tree.parent[node]
        inside = node and up not in edge
        out.append({"name": names[node] if named else None, "conv": least[node], "depth": tree.depth[node],
                    "parent": least[up] if inside else None, "parent_name": names[up] if node and not inside else None,
                    "n": n[node], "kids": kids[node], "leaves": leaves[node], "saved": saved[node], "ends": ends[node] or NO_ENDS})
    boundary, told = [], set()
    for i in () if whole else dict.fromkeys((0, len(rows) - 1)):
        path = paths[i]
        state = [below[x] if x not in told else [0, NOBODY, 0, 0, 0] for x in path]
        boundary.append({"ids": rows[i]["ids"], "words": rows[i]["words"],
                         **{k: [s[j] for s in state] for j, k in enumerate(COUNTS)},
                         "ends": [ends[x] if x not in told else None for x in path]})
        told.update(path)
    return out, boundary


# ------------------------------------------------------------------ all shards
PATH = ("struct<ids: array<long>, words: array<long>, n: array<long>, least: array<long>, leaves: array<long>, kids: array<long>, "
        "saved: array<long>, ends: array<string>>")
NODE = ("name binary, conv long, depth long, parent long, parent_name binary, n long, kids long, leaves long, saved long, "
        "ends string")
SCHEMA = f"part long, place int, path {PATH}, {NODE}"


def _table(part: int, nodes: list[dict], boundary: list[dict]) -> pa.Table:
    longs, text = pa.list_(pa.int64()), pa.string()
    path = pa.struct([(k, longs) for k in ("ids", "words", *COUNTS)] + [("ends", pa.list_(text))])
    schema = pa.schema([("part", pa.int64()), ("place", pa.int32()), ("path", path), ("name", pa.binary()), ("conv", pa.int64()),
                        ("depth", pa.int64()), ("parent", pa.int64()), ("parent_name", pa.binary()), ("n", pa.int64()),
                        ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", text)])
    rows = nodes + [{"part": part, "place": i, "path": b} for i, b in enumerate(boundary)]
    return pa.Table.from_pylist(rows, schema)


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range shard: (ids, words, n, least, ends), sorted by ids."""
    from pyspark import TaskContext
    rows = []
    for b in batches:
        for r in b.to_pylist():
            zeros = [0] * len(r["ids"])
            rows.append({"ids": r["ids"], "words": r["words"], "n": [*zeros, r["n"]], "least": [NOBODY] * len(zeros) + [r["least"]],
                         "leaves": [*zeros, 0], "kids": [*zeros, 0], "saved": [*zeros, 0], "ends": [None] * len(zeros) + [r["ends"]]})
    if rows:
        yield from _table(TaskContext.get().partitionId(), *shard_nodes(rows, whole=False, named=False)).to_batches()


def _next_round(whole: bool):
    def run(key, rows):
        rows = rows.sort_by([("part", "ascending"), ("place", "ascending")])
        paths = rows["path"].to_pylist()
        return _table(key[0].as_py(), *shard_nodes(paths, whole=whole, named=True))
    return run


def trie(sequences_: DataFrame, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the
    distinct sequences (ids, words, n, least, ends)."""
    turns = sequences_.agg(F.sum(F.size("ids")).alias("turns")).first().turns or 0
    shards = max(1, -(-turns // shard))
    done = written(sequences_.select("ids", "words", "n", "least", "ends").repartitionByRange(shards, "ids")
                   .sortWithinPartitions("ids").mapInArrow(_first_round, SCHEMA), "trie-shards")
    nodes = done.where("path IS NULL")
    while (top := done.where("path IS NOT NULL").agg(F.max("part").alias("top")).first().top) is not None:
        paths = done.where("path IS NOT NULL").select("part", "place", "path")
        done = written(paths.groupBy(F.expr(f"part div {fan}").alias("group")).applyInArrow(_next_round(top < fan), SCHEMA),
                       "trie-boundaries")
        nodes = nodes.unionByName(done.where("path IS NULL"))
    known = nodes.where("parent_name IS NULL")
    names = nodes.where("name IS NOT NULL").select(F.col("name").alias("parent_name"), F.col("conv").alias("of"))
    asked = nodes.where("parent_name IS NOT NULL").join(names, "parent_name").withColumn("parent", F.col("of")).drop("of")
    return known.unionByName(asked).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                group: int = 20, heads: int = 4, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """The trie of all rebuilt conversations, one row per node."""
    turns = encoded(ordered_turns(conversations, conv, turn, role, text))
    return trie(sequences(rebuilt(turns, group, heads)), shard, fan)
