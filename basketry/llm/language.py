"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent letter n-grams (1 to 3
letters, words padded with a space on both sides), most frequent first; ties
go to the smaller n-gram.  The distance of a document to a language sums, over the
document's profile, how far out of place each n-gram is in the language's
profile (``SIZE`` if it isn't there).  The nearest language wins, ties go to the
smaller name.  The score is 1 - distance / largest possible distance.

Language profiles are counted in Spark over at most ``sample`` rows per
language (chosen by a hash of the id); documents are profiled whole.

Defined results: a text that is null or has no letter is ``und`` with score 0,
also when nothing could be learned; repeated rows are predicted one by one;
rows with a null language train nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import fold, text_or_empty

SAMPLE = 2000           # rows per language that its profile is counted on
SIZE, LONGEST = 300, 3
WORDS = 500_000         # a worker's cache of words
RUN = re.compile(r"[^\W\d_]+")      # letters, and numbers that are no decimal digits


def words(text: str) -> Counter:
    """The text's words, lower-cased: runs of letters (superscripts, fractions and numerals are none)."""
    found = Counter(RUN.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


def grams(word: str) -> list[str]:
    """The word's letters, and the pairs and triples of letters with a space on either side of the word."""
    p = f" {word} "
    return [*word, *[p[i:i + 2] for i in range(len(p) - 1)], *[p[i:i + 3] for i in range(len(p) - 2)]]


class Numbers(dict):
    """N-gram to number; ``codes`` has the n-grams' code points as one integer, in the order of strings."""

    def __init__(self, first: list[str]) -> None:
        super().__init__()
        self.codes = np.zeros(1 << 12, np.int64)
        for g in first:
            self[g]

    def __missing__(self, gram: str) -> int:
        self[gram] = n = len(self)
        if n == len(self.codes):
            self.codes = np.r_[self.codes, self.codes]
        a, b, c = (*map(ord, gram), 0, 0)[:3]
        self.codes[n] = (a << 21 | b) << 21 | c
        return n


class Profiler(dict):
    """Profiles of texts against those of the languages; the dict holds each word's n-gram numbers.

    The languages' n-grams have the first numbers; ``lang`` and ``rank`` list, n-gram by n-gram from ``starts`` on, the
    languages that have it.  All others are ``SIZE`` off any rank.  Starts anew beyond ``WORDS`` words.
    """

    def __init__(self, langs: dict[str, dict[str, int]]) -> None:
        super().__init__()
        self.langs = sorted(langs)
        self.first = sorted({g for ranks in langs.values() for g in ranks})
        number = {g: i for i, g in enumerate(self.first)}
        known = sorted((number[g], i, r) for i, x in enumerate(self.langs) for g, r in langs[x].items())
        gram, self.lang, self.rank = np.array(known, np.int64).reshape(-1, 3).T
        self.starts = np.searchsorted(gram, np.arange(len(self.first) + 1))
        self.numbers = Numbers(self.first)

    def __missing__(self, word: str) -> np.ndarray:
        self[word] = found = np.array(list(map(self.numbers.__getitem__, grams(word))), np.int32)
        return found

    def profile(self, text: str) -> np.ndarray:
        """Numbers of the text's most frequent n-grams, most frequent first, ties by n-gram."""
        found = words(text)
        if not found:
            return np.empty(0, np.int64)
        if len(self) > WORDS:
            self.clear()
            self.numbers = Numbers(self.first)
        numbers = list(map(self.__getitem__, found))
        weight = np.repeat(np.fromiter(found.values(), np.int64, len(found)), list(map(len, numbers)))
        count = np.bincount(np.concatenate(numbers), weight)
        which = np.flatnonzero(count)
        count = count[which]
        if len(which) > SIZE:
            high = count >= np.partition(count, -SIZE)[-SIZE]
            which, count = which[high], count[high]
        return which[np.lexsort((self.numbers.codes[which], -count))[:SIZE]]

    def nearest(self, text: str) -> tuple[str, float]:
        """(language, score) of a text."""
        mine = self.profile(text)
        if not len(mine) or not self.langs:
            return "und", 0.0
        place = np.flatnonzero(mine < len(self.first))
        first, n = self.starts[mine[place]], np.diff(self.starts)[mine[place]]
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        nearer = SIZE - np.abs(self.rank[entry] - np.repeat(place, n))       # than an n-gram that isn't there
        off = SIZE * len(mine) - np.bincount(self.lang[entry], nearer, len(self.langs)).astype(np.int64)
        best = int(np.argmin(off))                            # ties: the smaller name
        return self.langs[best], 1 - float(off[best]) / (SIZE * len(mine))


def profiles(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> dict[str, dict[str, int]]:
    """Language to its profile (n-gram to rank), of rows whose fold is not held out (crc32 of the id modulo 5 is not 0).

    Rows are taken under a hash bound that lets about ``sample`` of a language through.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (fold(id_col, 5) != 0)).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("text"))
    # languages with more rows than the sample: at most one per ``sample`` rows, so the texts need not be shuffled
    share = (rows.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > sample)
             .select("of", (F.lit(sample) / F.col("n")).alias("share")))
    place = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            total: dict[str, Counter] = {}
            for lang, text in p.itertuples(index=False):
                mine = total.setdefault(lang, Counter())
                for w, k in words(text).items():
                    for g in grams(w):
                        mine[g] += k
            yield pd.DataFrame([(x, g, k) for x, c in total.items() for g, k in c.items()], columns=["lang", "gram", "n"])

    counted = (rows.join(F.broadcast(share), F.col("lang") == F.col("of"), "left")
               .where(F.col("share").isNull() | (place < F.col("share"))).select("lang", "text")
               .mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    out: dict[str, dict[str, int]] = {}
    for r in counted.withColumn("rank", rank).where(F.col("rank") < SIZE).collect():      # SIZE rows a language
        out.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    return out


def predict(docs: DataFrame, langs: dict[str, dict[str, int]], text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out`` (replacing one of that name): lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(langs)      # SIZE n-grams a language

    @F.pandas_udf("lang_pred string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        profiler = Profiler(model.value)
        for texts in parts:
            yield pd.DataFrame([profiler.nearest(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn(out, run(text_or_empty(text_col)))
