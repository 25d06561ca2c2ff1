import numpy as np
import xxhash
from pyspark.sql import functions as F

from basketry.llm import simhash as S
from basketry.llm.components import components
from tests.llm.helpers import docs_of, documents, edge_docs


def brute_fingerprint(text, width=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
             .translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """doc index -> smallest id reachable over links of at most 2 bits."""
    group = list(range(len(prints)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i
    for i, (_, x) in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j][1]).bit_count() <= 2:
                group[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(prints):
        best.setdefault(find(i), []).append(doc)
    return [min((d for d in best[find(i)] if d is not None), default=None) for i in range(len(prints))]


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
    want = sorted(((p[0], p[1], c) for p, c in zip(prints, brute_components(prints), strict=True)), key=str)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == want
    return want


def test_matches_brute_force(spark):
    want = check(documents(spark))
    assert len({c for _, _, c in want}) < len(want)


def test_edge_rows(spark):
    check(edge_docs(spark))


def test_empty_table(spark):
    assert S.near_duplicates(docs_of(spark, [])).collect() == []
    assert S.keep_one(docs_of(spark, [])).collect() == []


def test_same_hash_as_sparks(spark):
    texts = ["", "a", "abc def ghi", "é" * 40, "the of and " * 9]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    for r in got:
        assert r.h % 2**64 == xxhash.xxh64_intdigest(r.t.encode(), 42)


def test_linked_fingerprints_share_an_anchor():
    rng = np.random.default_rng(0)
    x = np.r_[rng.integers(0, 2**64, 200, np.uint64), np.uint64(0)]
    rows, anchor = S.anchors(x)
    for i, v in enumerate(x):
        mine = {int(a) for a in anchor[rows == i]}
        assert len(mine) in (1, 32)
        for a, b in rng.integers(0, 64, (60, 2)):
            near = np.array([v ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b))], np.uint64)
            assert mine & {int(a) for a in S.anchors(near)[1]}


def test_chain_and_star_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in components(docs_of(spark, [*chain, *star, (5, 5), (None, 3)], "a long, b long"))
           .collect()}
    assert len(got) == 361
    assert len({got[i] for i in range(61)}) == 1 and len({got[1000 + i] for i in range(300)}) == 1


def test_chain_of_fingerprints_is_one_component(spark):
    fps = [0]
    for i in range(0, 60, 2):
        fps.append(fps[-1] ^ (3 << i))
    link = S.links(docs_of(spark, [(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long"))
    assert len({r.root for r in components(link).collect()}) == 1


def test_keep_one_keeps_columns_and_ids_without_copies(spark):
    docs = edge_docs(spark)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and 8 not in ids and 1 in ids
