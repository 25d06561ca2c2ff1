"""Benchmark decontamination by templates.

Texts become canonical tokens: numbers (in digits or words), units (also right
after a number) and names give the typed
placeholders <num>, <unit> and <name>, other words are lower-cased.  Case decides
what a name is, so every text has several forms: a name is a capitalised word that
does not start a sentence, no word at all (copies in other case), or any
capitalised word (names at the start of a sentence).  Only
windows of the same form meet, and an item is found if it is in one form.  Windows of
``WINDOW`` tokens are hashed over the templates, so a question matches its
re-parameterised copies as well as verbatim ones.  Document windows pass a
bitmap of the benchmark's window hashes (64 bits a window and 16 MB at most, so its broadcast is
bounded; it only spares the shuffle rows that cannot match: one in 64 passes by chance up to 2 million windows of
the benchmark, one in 10 at 14 million) and are then
hash-joined with the benchmark windows.  One passage may stand in a third of
all documents: the planner broadcasts the benchmark's windows where they are small,
else it splits the skewed partitions of the documents' side.

A match lies on a diagonal: the same distance between its places in document
and item.  On each diagonal the slots must be consistent: a value of the
item always stands for the same value of the document.  An item is found in a
document if windows on consistent diagonals cover ``COVER`` of its windows, or
``RUN`` consecutive ones match on one diagonal (a long excerpt).

Windows need ``LITERALS`` literal words, else runs of capitals or digits would
match each other; an item shorter than a window is one window of its own width,
down to ``LEAST`` tokens; a still shorter one is found in texts that are nothing else (apart from case and
punctuation).  Defined
results: null or empty texts and placeholder-only ones of ``LEAST`` tokens or more on either side match nothing;
repeated rows of an item count once; a null item id or document id is an id
like any other.  Other columns of the inputs are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import row_key, text_or_empty, without, written

WINDOW, LITERALS, COVER = 8, 4, 0.8
RUN = 25                        # consecutive windows: 32 tokens
LEAST = 5                       # items of fewer tokens match whole texts only
CHARS = 200_000                 # texts of together so many characters are hashed at once
BITS_A_WINDOW, MAX_BITS = 64, 1 << 27        # the bitmap's bits for each window of the benchmark, and at most (16 MB)
NUM, UNIT, NAME, BREAK, SPELLED = (np.uint64(i) for i in (1, 2, 3, 0, 4))
#: Unit words, singular and plural.
UNITS = frozenset("""
mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres
mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds lb lbs
ml l liter liters litre litres gallon gallons cup cups
second seconds minute minutes hour hours day days week weeks month months year years
dollar dollars cent cents euro euros percent mph kmh degree degrees
""".split())
#: Number words; several in a row are one number.
NUMBERS = frozenset("""
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen
""".split())
#: Sentence breaks, numbers with a unit right after them (the unit is the next token), and words.
TOKEN = re.compile(r"[.!?\n:]|\d+(?:[.,]\d+)*(?=(?:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r")(?![^\W_]))"
                   r"|[^\W_]+(?:[.,'’][^\W_]+)*")
P = np.uint64(0x9E3779B97F4A7C15)
WHOLE = 3                       # the form of whole short texts, and their hash's seed


class Codes(dict):
    """Token to a place in ``table``, the hash of its canonical form << 1 | capital bit; placeholders and breaks are small."""

    LIMIT = 300_000

    def __init__(self) -> None:
        super().__init__()
        self.values_, self.table = [], np.empty(0, np.uint64)

    def __missing__(self, token: str) -> int:
        if token in ".!?\n:":
            code = 0
        elif any(c.isdigit() for c in token):
            code = 1 << 1
        elif token.lower() in UNITS:
            code = 2 << 1
        elif token.lower() in NUMBERS:
            code = 4 << 1
        else:
            code = (xxhash.xxh64_intdigest(token.lower()) >> 4 | 8) << 1 | token[0].isupper()
        self[token] = place = len(self)
        self.values_.append(code)
        return place

    def of(self, tokens: list[str]) -> np.ndarray:
        """The tokens' codes; the dictionary starts anew when it has grown beyond ``LIMIT``."""
        if len(self) > self.LIMIT:
            self.clear()
            self.values_, self.table = [], np.empty(0, np.uint64)
        places = np.array([self[t] for t in tokens], np.int64)
        if len(self.table) < len(self.values_):
            self.table = np.r_[self.table, np.array(self.values_[len(self.table):], np.uint64)]
        return self.table[places]


class Powers:
    """The powers of P and of its inverse modulo 2^64, as many as were ever asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, p, np.uint64)]) for p in (P, pow(int(P), -1, 1 << 64)))
        return self.up[:n], self.down[:n]


POWERS = Powers()


@dataclass
class Templates:
    """Canonical tokens of some texts, one after the other, without breaks: ``kinds`` has a row per form (NUM, UNIT,
    NAME or a literal's hash), ``place`` the tokens' places among ``tokens``, ``text`` and ``pos`` their text and place in it;
    ``ends`` is where each text's tokens end."""

    kinds: np.ndarray
    tokens: list[str]
    place: np.ndarray
    text: np.ndarray
    pos: np.ndarray
    ends: np.ndarray

    def slots(self, form: int, at: int, width: int) -> list[str]:
        return [self.value(i) for i in range(at, at + width) if self.kinds[form, i] <= NAME]

    def value(self, i: int) -> str:
        """What stands for a placeholder: its token, or all words of a spelled-out number."""
        at = self.place[i]
        word = self.tokens[at].lower()
        end = at + 1
        while word in NUMBERS and end < self.ends[self.text[i]] and self.tokens[end].lower() in NUMBERS:
            end += 1
        return word if end == at + 1 else " ".join(t.lower() for t in self.tokens[at:end])


def templates(texts: list[str], codes: Codes) -> Templates:
    tokens: list[str] = []
    ends = []
    for text in texts:
        tokens += TOKEN.findall(text)
        ends.append(len(tokens))
    ends = np.array(ends, np.int64)
    raw = codes.of(tokens)
    kind, capital = raw >> np.uint64(1), (raw & np.uint64(1)).astype(bool)
    starts = np.zeros(len(kind), bool)
    starts[1:] = kind[:-1] == BREAK
    starts[np.r_[0, ends[:-1]][np.diff(np.r_[0, ends]) > 0]] = True
    spelled = kind == SPELLED                               # number words after another are part of its number
    within = np.zeros(len(kind), bool)
    within[1:] = spelled[1:] & spelled[:-1]
    within[np.r_[0, ends[:-1]][np.diff(np.r_[0, ends]) > 0]] = False
    kind = np.where(spelled, NUM, kind)
    real = np.flatnonzero((kind != BREAK) & ~within)
    text = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, ends]))[real]
    kind, capital, starts = kind[real], capital[real], starts[real]
    kinds = np.stack([np.where(capital & ~starts, NAME, kind), kind, np.where(capital, NAME, kind)])
    return Templates(kinds, tokens, real, text, np.arange(len(real)) - np.searchsorted(text, text), ends)


def windows(t: Templates, width: int, literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(form, place, hash) of the windows of ``width`` tokens of one text that have enough literals."""
    kinds = t.kinds
    n = kinds.shape[1] - width + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    # a polynomial in P over the window's tokens, modulo 2^64: differences of prefix sums, moved to the window's start
    up, down = POWERS.first(kinds.shape[1])
    sums = np.zeros((len(kinds), kinds.shape[1] + 1), np.uint64)
    np.cumsum(kinds * up, axis=1, out=sums[:, 1:])
    h = sums[:, width:] - sums[:, :-width]
    h *= down[:n]
    h ^= np.arange(1, len(kinds) + 1, dtype=np.uint64)[:, None] << np.uint64(32) | np.uint64(width)
    for shift in (29, 32):
        h ^= h >> np.uint64(shift)
        h *= P
    h ^= h >> np.uint64(31)
    literal = np.pad(np.cumsum(kinds > NAME, axis=1, dtype=np.int32), ((0, 0), (1, 0)))
    enough = literal[:, width:] - literal[:, :-width] >= min(literals, width)
    form, at = np.nonzero(enough & (t.text[:n] == t.text[width - 1:]))
    return form, at, h[form, at]


def whole(t: Templates) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the texts of 1 to LEAST - 1 tokens, whole."""
    n = np.bincount(t.text, minlength=1)
    short = np.flatnonzero((n > 0) & (n < LEAST))
    first = np.searchsorted(t.text, short)
    named = [" ".join(t.tokens[t.place[i]].lower() for i in range(at, at + n[k])) for k, at in zip(short.tolist(), first.tolist(), strict=True)]
    return short, np.array([xxhash.xxh64_intdigest(x, WHOLE) for x in named], np.uint64)


def _items(width: int, literals: int):
    """Batches of (item, ik, text) to one row per window: (item, ik, form, pos, width, n_windows, h, slots)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in batches:
            rows, out = [], [[], [], [], [], [], []]
            for row, text in enumerate(b.column(2)):
                t = templates([text.as_py()], codes)
                w = min(width, len(t.place))
                if w < LEAST:
                    for h in whole(t)[1].view(np.int64).tolist():
                        rows.append(row)
                        for column, value in zip(out, (WHOLE, 0, w, 1, h, []), strict=True):
                            column.append(value)
                    continue
                form, at, h = windows(t, w, literals)
                rows += [row] * len(at)
                for column, values in zip(out, (form.tolist(), at.tolist(), [w] * len(at), np.bincount(form)[form].tolist(),
                                                h.view(np.int64).tolist(), [t.slots(f, i, w) for f, i in
                                                                            zip(form.tolist(), at.tolist(), strict=True)]), strict=True):
                    column += values
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take),
                 *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]],
                ["item", "ik", "form", "pos", "width", "n_windows", "h", "slots"])
    return run


def _documents(widths: list[int], literals: int, bitmap):
    """Batches of (id, k1, k2, text) to the windows that the bitmap lets through: (id, k1, k2, pos, h, slots)."""
    def groups(texts) -> Iterator[tuple[int, list[str]]]:
        """Consecutive texts of together about ``CHARS`` characters, so short ones share the array operations."""
        first, some, size = 0, [], 0
        for row, text in enumerate(texts):
            some.append(text.as_py())
            size += len(some[-1])
            if size >= CHARS:
                yield first, some
                first, some, size = row + 1, [], 0
        if some:
            yield first, some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, bits = Codes(), np.frombuffer(bitmap.value, np.uint8)
        mask = np.uint64(8 * len(bits) - 1)

        def known(h: np.ndarray) -> np.ndarray:
            place = h & mask
            return bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0
        for b in batches:
            rows, pos, hashes, slots = [], [], [], []
            for first, texts in groups(b.column(3)):
                t = templates(texts, codes)
                text, h = whole(t)
                hit = known(h)
                rows += (text[hit] + first).tolist()
                pos += [0] * int(hit.sum())
                hashes += h[hit].view(np.int64).tolist()
                slots += [[]] * int(hit.sum())
                for width in widths:
                    form, at, h = windows(t, width, literals)
                    hit = known(h)
                    form, at = form[hit], at[hit]
                    rows += (t.text[at] + first).tolist()
                    pos += t.pos[at].tolist()
                    hashes += h[hit].view(np.int64).tolist()
                    slots += [t.slots(f, i, width) for f, i in zip(form.tolist(), at.tolist(), strict=True)]
            keys = [b.column(i).take(pa.array(rows, pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(pos, pa.int32()), pa.array(hashes, pa.int64()),
                                              pa.array(slots, pa.list_(pa.string()))],
                                             ["id", "k1", "k2", "pos", "h", "slots"])
    return run


def _bitmap(h: DataFrame) -> bytes:
    """The bitmap of column h: a row per 64 bits reaches the driver, MAX_BITS / 64 at most."""
    size = min(MAX_BITS, max(1 << 16, 1 << (BITS_A_WINDOW * h.count()).bit_length()))
    words = (h.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("p")).groupBy(F.expr("p div 64").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toPandas())
    out = np.zeros(size // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.tobytes()


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text: str = "text", width: int = WINDOW, literals: int = LITERALS,
            cover: float = COVER, run: int = RUN) -> DataFrame:
    """One row per document row and item found in it: (id, k1, k2, item, windows, n_windows, coverage, verbatim,
    first, last).

    windows of the item's n_windows are covered; verbatim says that no slot has another value; first and last are
    the positions of the first and last matching token in the document.
    """
    spark = docs.sparkSession
    text = text_or_empty(item_text)
    items = benchmark.select(F.col(item_col).alias("item"), F.xxhash64(F.col(item_col), text).alias("ik"),
                             text.alias("text")).distinct()
    kind = items.schema["item"].dataType.simpleString()
    items = written(items.mapInArrow(_items(width, literals), f"item {kind}, ik long, form int, pos int, width int, n_windows int, "
                                     "h long, slots array<string>"), "item-windows")
    widths = sorted(r.width for r in items.where(F.col("form") != WHOLE).select("width").distinct().collect())     # LEAST to width
    bitmap = spark.sparkContext.broadcast(_bitmap(items.select("h")))

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), *row_key(F.col(id_col), text), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_documents(widths, literals, bitmap),
                            f"id {kind}, k1 long, k2 long, pos int, h long, slots array<string>")
    ours = items.select("item", "ik", "form", "h", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "width", "n_windows")
    pairs = found.join(ours, "h").select(
        "id", "k1", "k2", "item", "ik", "form", "item_pos", "pos", (F.col("pos") - F.col("item_pos")).alias("diagonal"),
        "width", "n_windows",
        F.arrays_zip("item_slots", "slots").alias("slots"))
    pairs = written(pairs.distinct(), "window-matches")

    on = ["k1", "k2", "ik", "form", "diagonal"]
    values = pairs.select(*on, F.explode("slots").alias("s")).select(*on, "s.item_slots", "s.slots")
    odd = (values.groupBy(*on, "item_slots").agg(F.min("slots").alias("lo"), F.max("slots").alias("hi"))
           .where("lo <> hi").select(*on).distinct())
    good = pairs.join(written(odd, "inconsistent"), on, "left_anti")
    same = F.forall("slots", lambda s: s["item_slots"] == s["slots"])
    order = Window.partitionBy(*on).orderBy("item_pos")
    long = (good.withColumn("island", F.col("item_pos") - F.row_number().over(order)).groupBy(*on, "island").count()
            .where(F.col("count") >= run).select("k1", "k2", "ik", "form", F.lit(True).alias("long")).distinct())
    best = (good.groupBy("id", "k1", "k2", "item", "ik", "form")
            .agg(F.count_distinct("item_pos").alias("windows"), F.max("n_windows").alias("n_windows"),
                 F.bool_and(same).alias("verbatim"), F.min("pos").alias("first"),
                 F.max(F.col("pos") + F.col("width") - 1).alias("last"))
            .withColumn("coverage", F.col("windows") / F.col("n_windows")).join(long, ["k1", "k2", "ik", "form"], "left")
            .where((F.col("coverage") >= cover) | F.col("long")))
    best = (best.groupBy("id", "k1", "k2", "item", "ik").agg(F.max(F.struct(
        "coverage", "verbatim", (-F.col("form")).alias("form"), "windows", "n_windows", "first", "last")).alias("best"))
            .select("id", "k1", "k2", "item", "best.*"))
    return best.select(F.col("id").alias(id_col), "k1", "k2", F.col("item").alias(item_col), "windows", "n_windows",
                       "coverage", "verbatim", "first", "last")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the rows in which an item is found."""
    found = matches(docs, benchmark, id_col, text_col, **params).select("k1", "k2").distinct()
    return without(docs, written(found, "contaminated"), id_col, text_col)
