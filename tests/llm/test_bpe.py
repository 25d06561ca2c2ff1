import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from basketry.llm import bpe
from tests.llm.helpers import docs_of, documents, edge_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(docs):
    t = Tokenizer.from_file(PATH)
    out = []
    for r in docs.select("doc_id", "text").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        out.append((r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    return Counter(out)


def got(docs):
    return Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode(docs, PATH).collect())


def test_matches_the_library(spark):
    assert got(documents(spark)) == brute(documents(spark))


def test_edge_rows(spark):
    docs = edge_docs(spark)
    assert got(docs) == brute(docs)


def test_odd_texts(spark):
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|startoftext|>", "a<|endoftext|>b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　",
             "é", " ́", "Å", "İI", "ΣΣ", "it's", "'S", "don't", "1234", "٣", "--!", "\U0001f600",
             "가", " ", "\n", "The", "​", "﻿", "ß", " ", "\x00", "</w>", "_x_"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(400)]
    assert got(docs_of(spark, rows)) == brute(docs_of(spark, rows))


def test_white_space_is_the_tokenizers():
    normal = Tokenizer.from_file(PATH).normalizer
    for c in [*map(chr, range(0xd800)), *map(chr, range(0xe000, 0x10000))]:
        white = normal.normalize_str(f"a{c}b") == "a b"
        assert white == (bpe.words_of(f"a{c}b") == ["a", "b"]) == (bpe.words_of(f"a{c}b\x1f") == ["a", "b\x1f"]), hex(ord(c))


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 50)
    monkeypatch.setattr(bpe, "OUT_WORDS", 7)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    docs = documents(spark).limit(40)
    assert got(docs) == brute(docs)


def test_empty_table(spark):
    assert bpe.encode(docs_of(spark, []), PATH).collect() == []


def test_lost_words_are_an_error():
    class Pieces:
        value = ["a"]
    import pyarrow as pa
    row = {"block": "b", "data": bpe._packed(np.array([0, 1], np.int32)), "places": bpe._packed(np.array([0, 1], np.int32)),
           "ids": [1], "n_words": [2], "found": []}
    with pytest.raises(ValueError):
        list(bpe._assemble(Pieces, "doc_id", pa.int64())([pa.RecordBatch.from_pylist([row])]))


def test_encodings_of_a_bucket_are_not_held_at_once(monkeypatch):
    """Words are encoded a few thousand at a time, whatever the bucket's size, with the same ids."""
    import tokenizers
    real, sizes = tokenizers.Tokenizer, []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        @classmethod
        def from_str(cls, text):
            return cls(real.from_str(text))

        def encode_batch(self, words, **how):
            sizes.append(len(words))
            return self.inner.encode_batch(words, **how)

    path = public_tokenizers.path("word_bpe_49k.json")
    words = [f" word{i}" for i in range(10_000)]
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    value = type("Shared", (), {"value": open(path, encoding="utf-8").read()})()
    data = zstandard.ZstdCompressor().compress(" ".join(w[1:] for w in words).encode())
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([data], pa.binary())], ["block", "bucket", "words"])
    got = bpe._unpacked(next(bpe._encode(value)(iter([batch])))["data"][0].as_py(), "<u4")
    want = [e.ids for e in real.from_file(path).encode_batch([w[1:] for w in words], add_special_tokens=False)]
    assert got.tolist() == [len(words), *map(len, want), *[i for e in want for i in e]]
    assert max(sizes) <= 4_000
