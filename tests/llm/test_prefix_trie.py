import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from basketry.llm import prefix_trie as T
from basketry.llm.queries import op11_prefix_trie
from tests.llm.helpers import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The nodes of the trie from (conv_id, turn, role, text), by lists of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in built.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(p[-1][1].split()) if p else 0          # bytes split at the contract's white space
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def same(out, rows):
    assert Counter(map(tuple, out.collect())) == brute(rows)


def made(seed, convs=400):
    """Conversations that share first turns, passages and whole texts, one far longer than the rest."""
    rng, rows = random.Random(seed), []
    for c in range(convs):
        n = 700 if c == 33 else rng.randint(0, 9)
        common = rng.random() < 0.4
        for turn in range(n):
            text = f"turn {turn}" if common else f"turn {turn} {rng.randint(0, 2)} a\tb c"
            rows.append((c, turn, "user" if turn % 2 else "assistant", text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shard", "fan"), [(100_000, 32), (40, 2), (7, 3)])
def test_matches_brute_force_over_any_shards(spark, shard, fan):
    rows = made(5)
    same(T.prefix_trie(spark.createDataFrame(rows, SCHEMA), shard=shard, fan=fan), rows)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(op11_prefix_trie(spark, SF), rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "", ""), (1, 0, "user", "x " * 50_000), (None, 0, "user", "a"), (2, 0, "user", "a"),
            (2, 0, "user", "a"), (2, 0, "bot", "a"), (22, 1, None, "é ü"), (20, 5, "user", "same"), (40, 5, "user", "same"),
            (23, 0, "a", "only one turn"), (-7, 0, "user", "a"), (-7, 1, "user", "\n\t ")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("clash")).withColumn("n", F.lit(None).cast("int"))
    same(T.prefix_trie(df), rows)
    same(T.prefix_trie(df, shard=2, fan=2), rows)


def test_empty_table(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert T.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


def test_shared_by_a_third(spark):
    """A third of the conversations are one text, another third share their first turn."""
    rows = [(c, t, "user", f"{t}" if c % 3 == 0 else f"{t if t == 0 else c * 10 + t}" if c % 3 == 1 else f"{c} {t}")
            for c in range(900) for t in range(4)]
    same(T.prefix_trie(spark.createDataFrame(rows, SCHEMA), shard=200, fan=2), rows)


def test_tree_is_balanced_by_medians():
    tree, order = T.Tree(), T.median_first(1023)
    assert sorted(order) == list(range(1023))
    for i in order:
        tree.insert([i], [1])

    def height(node):
        return 0 if not node else 1 + max(height(tree.lo[node]), height(tree.hi[node]))
    assert height(tree.eq[0]) == 10
