import hashlib
import random
from collections import Counter

from basketry.llm import common as C
from basketry.llm import exact_dedup as E
from tests.llm.helpers import docs_of, documents, edge_docs


def brute(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    out = []
    for text in {t for _, t in rows}:
        ids = [d for d, t in rows if t == text]
        keep = max((d for d in ids if d is not None), default=None)
        left = 1
        for d in ids:
            kept = d == keep and left == 1
            left -= kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def got(docs):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.sha.hex()) for r in E.duplicates(docs).collect())


def test_matches_brute_force(spark):
    assert got(documents(spark)) == brute(documents(spark))


def test_edge_rows(spark):
    docs = edge_docs(spark)
    assert got(docs) == brute(docs)
    kept = E.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["8", "None", "3", "4", "5", "6", "7"])


def test_copies_beyond_the_broadcast_bound(spark, monkeypatch):
    few = sorted(map(str, E.keep_one(edge_docs(spark)).collect()))
    monkeypatch.setattr(C, "BROADCAST_KEYS", 0)
    kept = E.keep_one(edge_docs(spark))
    assert "strategy=broadcast" not in kept._jdf.queryExecution().logical().toString()
    assert sorted(map(str, kept.collect())) == few


def test_empty_table(spark):
    assert E.duplicates(docs_of(spark, [])).collect() == []
    assert E.keep_one(docs_of(spark, [])).collect() == []


def test_chunks_join_to_the_text_and_follow_content():
    rng = random.Random(1)
    body = bytes(rng.randrange(256) for _ in range(60_000))
    for raw in (b"", b"x", b"a" * 200_000, body, body[:E.LEAST], b"".join([b"\0" * 9] * 5000)):
        assert b"".join(E.chunks(raw)) == raw
        assert all(len(c) <= E.MOST for c in E.chunks(raw))
    moved = E.chunks(b"some words in front " + body)
    assert len(set(moved) & set(E.chunks(body))) > 0.9 * len(E.chunks(body))


def test_identifier_of_two_chunks_is_unverified(spark):
    rows = [(1, 0, [7, 8], [1, 1, 1, 1, 2, 2, 2, 2]), (2, 1, [7, 8], [1, 1, 1, 1, 2, 2, 2, 3]), (3, 2, [7], [1, 1, 1, 1])]
    table = spark.createDataFrame(rows, "doc_id long, row long, ids array<long>, proof array<long>")
    assert [r.id for r in E.unverified(table).collect()] == [8]


def test_texts_with_a_forged_identifier_stay_apart(spark, monkeypatch):
    class Same:
        @staticmethod
        def xxh64_intdigest(_):
            return 1
    monkeypatch.setattr(E, "xxhash", Same)
    docs = docs_of(spark, [(1, "one"), (2, "two"), (3, "one")])
    assert {(r.doc_id, r.keep_id) for r in E.duplicates(docs).collect()} == {(1, 3), (2, 2), (3, 3)}
