import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from basketry.llm import toxicity
from tests.llm.helpers import SF, documents, edge_docs
from tests.llm.test_simhash import brute_components, brute_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(text):
    return " ".join((text or "").split())


def brute_run(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = [r for r in rows if model.score(r[1])[0] < 0.5]
    best = {}
    for doc, text in rows:
        best[text] = max(doc, best.get(text, doc))
    rows = [r for r in rows if best[r[1]] == r[0]]
    prints = [(doc, brute_fingerprint(text)) for doc, text in rows]
    rows = [r for r, c in zip(rows, brute_components(prints), strict=True) if r[0] == c]
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(i in plain(r[1]) for i in items)]
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for doc, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        out.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return Counter(out)


def test_run_matches_brute_force(spark):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, SF).collect())
    want = brute_run(spark)
    assert got == want and 0 < len(want) < documents(spark).count()


def test_stages_keep_columns_and_take_any_rows(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "bpe"]
    odd = edge_docs(spark).selectExpr("doc_id", "text", "k1 AS lang", "cast(row AS string) AS source", "row AS n_chars")
    for docs in (odd, odd.limit(0)):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == COLUMNS
            assert out.count() <= docs.count()
        out = P.STAGES[-1][1](spark, docs, SF)
        assert out.count() == docs.count()
        assert [(len(r.ids) == 4 * r.n_tokens) for r in out.collect()] == [True] * docs.count()
