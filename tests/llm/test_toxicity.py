import math
import random

from basketry.llm import toxicity as T
from tests.llm.helpers import SF, docs_of, documents, edge_docs

LABELS = "doc_id long, toxic int"


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("a", "eko", "imu", "orama")]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randrange(1, 40))]
        bad = rng.random() < 0.3
        if bad:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(["vilest", "rotter"])
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_learns_and_locates(spark):
    rows, labels = corpus()
    docs, labels_t = docs_of(spark, rows), docs_of(spark, labels, LABELS)
    model = T.train(docs, labels_t)
    assert set(model.weights) >= {"vilest", "rotter"}
    wrong = 0
    for r in T.score(docs, model).collect():
        wrong += r.toxicity.predicted != labels[r.doc_id][1]
        assert 0 <= r.toxicity.score <= 1
        for s in r.toxicity.offending:
            assert {"vilest", "rotter"} & set(r.text[s.start:s.end].split())
    assert wrong <= 4


def test_noisy_or_by_hand():
    m = T.Model(-3.0, {"bad": 4.0, "worse": 1.0})
    def p(z):
        return 1 / (1 + math.exp(-z))
    got, spans = m.score("Fine day. Bad worse bad! And\nworse")
    assert abs(got - (1 - (1 - p(-3)) ** 2 * (1 - p(2)) * (1 - p(-2)))) < 1e-12
    assert [(s["start"], s["end"]) for s in spans] == [(9, 23)]
    assert abs(m.score("One. Two.")[0] - (1 - (1 - p(-3)) ** 2)) < 1e-12
    assert m.score("") == (0.0, []) and m.score("..!\n?") == (0.0, [])


def test_given_labels(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    model = T.train(docs, labels)
    out = {r.doc_id: r.toxicity.predicted for r in T.score(docs, model).collect()}
    rows = [r for r in labels.collect() if r.toxic is not None]
    assert sum(out[r.doc_id] != r.toxic for r in rows) <= 0.1 * len(rows)


def test_edge_rows(spark):
    docs = edge_docs(spark)
    rows, labels = corpus()
    model = T.train(docs_of(spark, rows), docs_of(spark, [*labels, (None, 1), (3, None)], LABELS))
    out = T.score(docs, model).collect()
    assert len(out) == docs.count()
    assert all(r.toxicity.score == 0 for r in out if not (r.text or "").strip("\n"))
    docs = docs.withColumnRenamed("row", "toxicity")
    kept = T.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_without_labels(spark):
    docs = edge_docs(spark)
    model = T.train(docs, docs_of(spark, [], LABELS))
    assert {r.toxicity.score for r in T.score(docs, model).collect()} == {0.0}
    model = T.train(docs_of(spark, []), docs_of(spark, [(1, 1), (2, 0)], LABELS))
    assert T.score(docs_of(spark, []), model).collect() == []


def test_length_alone_adds_nothing(spark):
    rows, labels = corpus()
    model = T.train(docs_of(spark, rows), docs_of(spark, labels, LABELS))
    short, _ = model.score("mild day.")
    for n in (1_000, 50_000):
        score, spans = model.score("mild day. " * n)
        assert score == short < 0.1 and not spans
    assert model.score("mild day. " * 50_000 + "the vilest one.")[0] >= 0.5


def brute_fit(rows):
    """The same likelihood by loops over documents and sentences: chosen features, gradient and steps."""
    pos, neg = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    q, seen = pos / (pos + neg), {}
    bags = [(y, [{f for w in set(T.WORD.findall(x.lower())) for f in T.features(w)} for x in T.SENTENCE.findall(text)]) for y, text in rows]
    for y, bag in bags:
        for f in set().union(*bag):
            k = seen.setdefault(f, [0, 0])
            k[1 - y] += 1
    names = sorted(f for f, (k, m) in seen.items() if k > 2 and (k - q * (k + m)) / math.sqrt((k + m) * q * (1 - q)) > 2.5
                   and T._tail(k, k + m, q) < T.CHANCE)
    theta = dict.fromkeys(names, 0.0) | {1: -4.0, 2: -4.0}              # 1: leak, 2: bias
    m1, m2 = dict.fromkeys(theta, 0.0), dict.fromkeys(theta, 0.0)

    def prob(z):
        return 1 / (1 + math.exp(-z))
    for step in range(1, T.STEPS + 1):
        grad = {k: T.RIDGE * theta[k] / len(names) if k in names else 0.0 for k in theta}
        for y, bag in bags:
            full = [s & theta.keys() for s in bag if s & theta.keys()]
            ps = [prob(theta[2] + sum(theta[f] for f in s)) for s in full]
            none = math.prod(1 - p for p in ps) * (1 - prob(theta[1]) if bag else 1)
            blame = (-none / max(1 - none, 1e-12) if y else 1.0) / len(rows)
            for s, p in zip(full, ps, strict=True):
                grad[2] += blame * p
                for f in s:
                    grad[f] += blame * p
            if bag:
                grad[1] += blame * prob(theta[1])
        for k, g in grad.items():
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
            theta[k] -= T.RATE * (m1[k] / (1 - 0.9 ** step)) / (math.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return names, theta


def test_fit_matches_brute_force(spark):
    rows, labels = corpus(120)
    texts = [(y, t) for (_, t), (_, y) in zip(rows, labels, strict=True)]
    model = T.fit(docs_of(spark, [(y, t) for y, t in texts], "toxic int, text string"))
    names, theta = brute_fit(texts)
    assert sorted(model.weights) == names and len(names) >= 2
    assert abs(model.bias - theta[2]) < 1e-6 and abs(model.leak - theta[1]) < 1e-6
    assert all(abs(model.weights[f] - theta[f]) < 1e-6 for f in names)
    for _, text in texts:                                   # and the scores of whole documents
        bag = [{f for w in T.WORD.findall(x.lower()) for f in T.features(w)} & set(names) for x in T.SENTENCE.findall(text)]
        none = math.prod(1 - 1 / (1 + math.exp(-theta[2] - sum(theta[f] for f in s))) for s in bag if s)
        none *= 1 - 1 / (1 + math.exp(-theta[1])) if bag else 1
        assert abs(model.score(text)[0] - (1 - none)) < 1e-6
