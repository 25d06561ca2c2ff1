"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence's probability is a logistic
function of its words, and a document's is the noisy-or of its sentences:
1 - prod(1 - p).  A word also counts with its first four and five letters, so
inflected and compound forms that training hasn't seen are known by their stems.  Only documents have labels; the noisy-or likelihood gives a
positive document's blame to its likeliest sentences.  Training takes at most
``sample`` labelled rows per class (chosen by a hash of the id), keeps words
that significantly more positive than negative documents have, and fits by
gradient descent.  Scoring is one pass over the whole texts with the fitted
words in each task; offending sentences are located by character offsets.

Defined results: a null or empty text, or one of separators only, has no
sentence and scores 0; without labels of both classes nothing is learned and
everything scores 0; repeated rows are scored one by one (a repeated label
row counts again); a null label is no label.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import fold, free_name, text_or_empty, written

SENTENCE, WORD = re.compile(r"[^.!?\n]+"), re.compile(r"[^\W\d_]+")
SAMPLE = 2000                   # labelled rows per class that the model is fitted on
WORDS = 300_000                 # a worker's cache of words
CHANCE = 1e-3                   # a word is kept if so many positive documents have it by chance only this rarely
STEPS, RATE, RIDGE = 400, 0.1, 1e-3


def features(word: str) -> tuple[str, ...]:
    """A word and its stems."""
    return (word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n))


@dataclass
class Model:
    """Sentence logit = bias + sum of the weights of its distinct features.

    ``leak`` is the logit of all sentences without features together, once a document, so that a text's length alone
    adds nothing; without it each of them has the bias as its logit.
    """

    bias: float = -math.inf
    weights: dict[str, float] = field(default_factory=dict)
    leak: float | None = None

    def sentence(self, found: set[str]) -> float:
        z = self.bias + sum(self.weights[f] for f in found)
        return 0.0 if z == -math.inf else 1 / (1 + math.exp(-max(-700.0, z)))

    def score(self, text: str, known: "Known | None" = None) -> tuple[float, list[dict]]:
        """The document's probability, and its sentences of 0.5 or more."""
        if not self.weights:
            return 0.0, []
        known = Known(self.weights) if known is None else known
        clean = math.log1p(-self.sentence(set())) if self.leak is None else 0.0
        left = 0.0 if self.leak is None or not SENTENCE.search(text) else -math.log1p(math.exp(min(700.0, self.leak)))
        if not any(map(known.__getitem__, set(WORD.findall(text.lower())))):
            return -math.expm1(left + clean * sum(1 for _ in SENTENCE.finditer(text))), []
        spans = []
        for m in SENTENCE.finditer(text):
            found = set().union(*map(known.__getitem__, WORD.findall(m[0].lower())))
            if not found:
                left += clean
                continue
            p = min(self.sentence(found), 1 - 1e-12)
            left += math.log1p(-p)
            if p >= 0.5:
                spans.append({"start": m.start(), "end": m.end(), "score": p})
        return -math.expm1(left), spans


class Known(dict):
    """Word to those of its features that have a weight; starts anew beyond ``WORDS`` words."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > WORDS:
            self.clear()
        self[word] = found = tuple(f for f in features(word) if f in self.weights)
        return found


def _tail(k: int, n: int, q: float) -> float:
    """Probability of at least k successes in n trials (the normal limit beyond 200)."""
    if n > 200:
        return math.erfc((k - 0.5 - n * q) / math.sqrt(2 * n * q * (1 - q))) / 2
    return sum(math.comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(k, n + 1))


def _bag(text: str) -> list[set[str]]:
    """The features of each sentence."""
    return [{f for w in set(WORD.findall(s.lower())) for f in features(w)} for s in SENTENCE.findall(text)]


def chosen(rows: DataFrame) -> list[str]:
    """Features that significantly more positive than negative rows (toxic, text) have."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            seen = Counter((f, y) for y, text in p.itertuples(index=False) for f in set().union(*_bag(text)))
            yield pd.DataFrame([(f, k * y, k * (1 - y)) for (f, y), k in seen.items()], columns=["feature", "pos", "neg"])

    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return []
    q = n[1] / (n[0] + n[1])
    seen = (rows.select("toxic", "text").mapInPandas(run, "feature string, pos long, neg long").groupBy("feature")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    likely = (F.col("pos") - q * (F.col("pos") + F.col("neg"))) / F.sqrt((F.col("pos") + F.col("neg")) * q * (1 - q))
    got = seen.where((F.col("pos") > 2) & (likely > 2.5)).collect()
    return sorted(r["feature"] for r in got if _tail(r["pos"], r["pos"] + r["neg"], q) < CHANCE)


def fit(rows: DataFrame) -> Model:
    """The noisy-or model of labelled rows (toxic, text), which are a bounded sample.

    The driver gets the chosen features and, for each row, whether it has a sentence and the features of those with any.
    """
    names = chosen(rows)
    if not names:
        return Model()
    at = {f: i for i, f in enumerate(names)}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for y, text in p.itertuples(index=False):
                found = [[at[f] for f in s & at.keys()] for s in _bag(text)]
                full = [f for f in found if f]
                out.append((y, int(bool(found)), [i for f in full for i in f], [len(f) for f in full]))
            yield pd.DataFrame(out, columns=["y", "any", "found", "sizes"])

    got = rows.select("toxic", "text").mapInPandas(run, "y int, any int, found array<int>, sizes array<int>").toPandas()
    y, some = got["y"].to_numpy(float), got["any"].to_numpy(float)
    # sentences that have a chosen feature, as sparse rows; the others have one leak term a row
    sizes = [np.array(s, np.int64) for s in got["sizes"]]
    doc = np.repeat(np.arange(len(y)), [len(s) for s in sizes])
    sent = np.repeat(np.arange(len(doc)), np.concatenate(sizes))
    word = np.concatenate([np.array(f, np.int64) for f in got["found"]])
    theta = np.zeros(len(at) + 2)       # weights, leak, bias
    theta[-2:] = -4.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(sent, theta[word], len(doc))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-theta[-2]))
        left = -np.bincount(doc, np.logaddexp(0, z), len(y)) - some * np.logaddexp(0, theta[-2])
        pos = np.maximum(-np.expm1(left), 1e-12)
        blame = np.where(y > 0, -np.exp(left) / pos, 1.0) / len(y)     # d loss / d z = blame * p
        g_sent = blame[doc] * p
        grad = np.r_[np.bincount(word, g_sent[sent], len(at)), (blame * some).sum() * p0, g_sent.sum()]
        grad[:-2] += RIDGE * theta[:-2] / len(at)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        theta -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Model(float(theta[-1]), {f: float(theta[i]) for f, i in at.items()}, float(theta[-2]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
          text_col: str = "text") -> Model:
    """The model of the labelled rows whose fold is not held out (crc32 of the id modulo 5 is not 0)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, 5) != 0))
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64(id_col), id_col).limit(sample) for y in (0, 1)]
    picked = picked[0].union(picked[1]).select(F.col(id_col).alias("sample_id"), F.col("toxic").cast("int"))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(
        F.broadcast(picked), F.col("id") == F.col("sample_id"))
    return fit(written(rows.select("toxic", "text"), "toxicity-sample"))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``out`` (replacing one of that name): score, predicted, offending (start, end, score of sentences)."""
    @F.pandas_udf("score double, predicted int, offending array<struct<start:int,end:int,score:double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Known(model.weights)
        for texts in parts:
            got = [model.score(t, known) for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in got], "predicted": [int(s >= 0.5) for s, _ in got],
                                "offending": [spans for _, spans in got]})

    return docs.withColumn(out, run(text_or_empty(text_col)))


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic."""
    out = free_name(docs, "toxicity")
    return score(docs, model, text_col, out).where(F.col(f"{out}.predicted") == 0).drop(out)
