import unicodedata
import zlib
from collections import Counter

from basketry.llm import language as L
from tests.llm.helpers import SF, docs_of, documents, edge_docs


def letters(text):
    """Runs of characters of Unicode category L."""
    return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text).split()


def brute_profile(text):
    count = Counter()
    for w in letters(text.lower()):
        count.update(L.grams(w))
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:L.SIZE]]


def brute_nearest(text, langs):
    mine = brute_profile(text)
    if not mine or not langs:
        return "und", 0.0
    off, lang = min((sum(abs(i - r[g]) if g in r else L.SIZE for i, g in enumerate(mine)), x) for x, r in langs.items())
    return lang, 1 - off / (L.SIZE * len(mine))


def check(docs, langs):
    for r in L.predict(docs, langs).collect():
        lang, score = brute_nearest(r.text or "", langs)
        assert r.language.lang_pred == lang and abs(r.language.score - score) < 1e-9


def test_profiles_match_brute_force(spark):
    docs = documents(spark)
    langs = L.profiles(docs)
    text = {}
    for r in docs.collect():
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            text[r.lang] = text.get(r.lang, "") + "\n" + (r.text or "")
    assert langs == {x: {g: i for i, g in enumerate(brute_profile(t))} for x, t in text.items()}
    check(docs, langs)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    out = [r for r in L.predict(docs, L.profiles(docs)).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.language.lang_pred == r.lang for r in out) >= 0.97 * len(out)


def test_edges(spark, monkeypatch):
    langs = L.profiles(documents(spark))
    docs = edge_docs(spark).withColumnRenamed("k1", "score")
    check(docs, langs)
    got = {r.doc_id: r.language for r in L.predict(docs, langs).collect()}
    assert {tuple(got[i]) for i in (1, 2, 6, 8)} == {("und", 0.0)}
    check(docs, {})
    assert L.predict(docs_of(spark, []), langs).collect() == []
    schema = "doc_id long, text string, lang string"
    assert L.profiles(docs_of(spark, [], schema)) == {}
    assert L.profiles(docs_of(spark, [(1, "abc", None), (2, None, "xx"), (5, "12 34", "yy")], schema)) == {}
    tie = {"b": {"a": 0}, "a": {"a": 0}}
    check(docs_of(spark, [(1, "a"), (2, "A a b"), (3, "ñ 12")]), tie)
    monkeypatch.setattr(L, "WORDS", 3)
    check(documents(spark).limit(30), langs)


def test_numbers_are_no_letters(spark):
    langs = {"de": {"a": 0, "b": 1}}
    rows = [(1, "½ ² ① Ⅷ ٣ 12"), (2, "a² b"), (3, "ªº")]
    got = {r.doc_id: r.language.lang_pred for r in L.predict(docs_of(spark, rows), langs).collect()}
    assert got == {1: "und", 2: "de", 3: "de"}


def test_every_language_is_learned(spark):
    """600 languages of two documents each, with letters of their own."""
    rows = [(i, " ".join(chr(0x4E00 + (i % 600) * 7 + j) * (j + 1) for j in range(7)), f"l{i % 600}") for i in range(1200)]
    docs = docs_of(spark, rows, "doc_id long, text string, lang string")
    langs = L.profiles(docs)
    learned = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}
    assert langs.keys() == learned and len(learned) > 570
    right = [r.language.lang_pred == r.lang for r in L.predict(docs, langs).collect() if r.lang in learned]
    assert all(right)


def test_sample_per_language(spark):
    rows = [(i, f"w{'ab'[i % 2]}", "many" if i % 10 else "few") for i in range(2000)]
    some = L.profiles(docs_of(spark, rows, "doc_id long, text string, lang string"), sample=100)
    assert some.keys() == {"many", "few"} and "w" in some["few"]
