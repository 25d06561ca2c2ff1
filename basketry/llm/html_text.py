"""Main text of HTML pages by maximum-scoring subsequence.

A page is a sequence of tags and words.  Words score 1, tags negative; Kadane's
linear scan finds the contiguous region of the largest sum, and its blocks are
the main text.  A tag's weight comes from labelled pages, those whose markup names
its article (an article or main element): it costs its log-odds of standing
outside against inside, next to nothing if it is as often inside.  A tag that is never seen inside costs one more than the most words of
any stretch outside that it opens, so no such stretch can pay for it; one outlier cannot
make a tag dear that articles use.  Weights are counted in Spark on at most
``sample`` labelled pages, chosen by a hash of the id; a tag with a class seen on one page only counts as the bare tag.

Elements that HTML itself, or a class, id or role as a whole, calls menu,
header, footer, sidebar, notice, advert, form or comments are no content: their
words score nothing and are left out of the text, wherever they stand.  Words outside the article of a page that names
it count against a region.  A name like ``notice-period`` or
``post-with-sidebar`` says nothing of that kind, headings are never such parts, nor is an element
that holds the page's heading and most of its words.  Scripts, styles, templates
and titles are single tags.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed, empty ones are left out, and the rest is joined by \\n
in page order; block-level tags and br separate blocks.  Defined results: a null
or empty page, or one without content, has the text ''; of regions with the same sum the
first counts, and of those the shortest; broken markup is
read as far as it goes; repeated rows are extracted one by one; a column of the output's name is replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import text_or_empty

SAMPLE = 2000           # labelled pages that weights are counted on
CHEAP, UNSEEN = 0.01, 1.0
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(script|style|template|noscript|iframe|svg|textarea|title|select|object)\b[^>]*>.*?(?:</\1\s*>|\Z)
      | <(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"<]*"|'[^'<]*'|[^'"<>])*|[^<>]*)>
      | <[!?/][^>]*(?:>|\Z)
      | ([^<]+|<)""", re.S | re.I | re.X)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Elements of HTML that separate blocks, have no end, or are no content.
BLOCK = frozenset("""address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot
th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
KEPT = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("nav header footer aside form menu button dialog head fieldset".split())
#: Words of a class, id or role that name parts that are no content, and words that say nothing beside one.
PARTS = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion
banner cookie cookies consent gdpr notice notices alert alerts popup modal sidebar sidebars menu menus nav navbar navigation
breadcrumb breadcrumbs header masthead footer form search searchbox login signup signin newsletter subscribe subscription comment
comments reply replies respond discussion share sharing social related recommended recommendations complementary contentinfo
""".split())
NEUTRAL = frozenset("""area article articles aside bar block blocks bottom box button buttons container content field fields global
group holder inner input item items left link links list main module outer page panel post posts primary region right row
secondary section site slot slots stories story text thread top unit widget widgets wrap wrapper""".split())


def names_part(value: str) -> bool:
    """Whether one of the names in a class, id or role is, as a whole, that of a part that is no content."""
    for name in value.lower().split():
        words = [w for w in re.split(r"[_-]+", name.strip("_-")) if w and not w.isdigit()]
        if any(w in PARTS for w in words) and all(w in PARTS or w in NEUTRAL for w in words):
            return True
    return False


@dataclass
class Weights:
    """Tag (with its class, if any) to its cost, as a negative number."""

    tags: dict[str, float] = field(default_factory=dict)

    def of(self, tag: str, name: str) -> float:
        if (w := self.tags.get(tag)) is None and (w := self.tags.get(name)) is None:
            return -UNSEEN if name in ASIDE else -CHEAP
        return w


@dataclass
class Token:
    tag: str            # "" for text
    name: str
    text: str
    words: int
    aside: bool
    inside: bool        # of an article or main element


def tokens(page: str) -> list[Token]:
    """The page's tags and texts; aside says that an open element is no content."""
    out: list[Token] = []
    open_: list[tuple[str, int | None]] = []            # element, and where it starts if it is no content
    parts: list[tuple[int, int]] = []
    inside = 0

    def close(at: int, with_tag: bool = False) -> None:
        """Ends the open elements from ``at`` on; its end tag belongs to the first of them."""
        nonlocal inside
        for i, (name, start) in enumerate(open_[at:]):
            if start is not None:
                parts.append((start, len(out) + (with_tag and i == 0)))
            inside -= name in ("article", "main")
        del open_[at:]

    for m in TOKEN.finditer(page):
        raw, end, name, attributes, text = m.groups()
        if text is not None:
            text = html.unescape(text)
            out.append(Token("", "", text, len(text.split()), False, inside > 0))
            continue
        name = (raw or name or "!").lower()
        tag = name
        if raw or name == "!":
            pass
        elif end:
            tag = f"/{name}"
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if at is not None:
                close(at, with_tag=True)
        else:
            named = {k.lower(): v.strip("\"'") for k, v in NAMED.findall(attributes or "")}
            if "class" in named:
                tag = ".".join([name, *sorted(named["class"].lower().split())[:2]])
            off = name in ASIDE or (name not in KEPT and any(names_part(v) for v in named.values()))
            if name in ("article", "main") and not off:         # an unclosed menu before it ends here
                parts += [(start, len(out)) for _, start in open_ if start is not None]
                open_ = [(x, None) for x, _ in open_]
            if name in BLOCK and name != "br":                  # a block ends an open paragraph
                at = len(open_) - 1
                while at >= 0 and open_[at][0] not in BLOCK:
                    at -= 1
                if at >= 0 and open_[at][0] == "p":
                    close(at)
            if name not in VOID and not (attributes or "").endswith("/"):
                open_.append((name, len(out) if off else None))
                inside += name in ("article", "main")
        out.append(Token(tag, name, "", 0, False, inside > 0))
    close(0)
    _mark(out, parts)
    return out


def _mark(page: list[Token], parts: list[tuple[int, int]]) -> None:
    """Marks the tokens of the parts that are no content, but for one that holds the page's heading and most words."""
    words, heads = [0], [0]
    for t in page:
        words.append(words[-1] + t.words)
        heads.append(heads[-1] + (t.name == "h1"))
    change = [0] * (len(page) + 1)
    for start, end in parts:
        if 2 * (words[end] - words[start]) > words[-1] and heads[end] > heads[start]:
            continue
        change[start] += 1
        change[end] -= 1
    depth = 0
    for t, c in zip(page, change, strict=False):
        depth += c
        t.aside = depth > 0


def region(page: list[Token], weights: Weights) -> tuple[int, int]:
    """First and last + 1 of the contiguous tokens with the largest sum (of equal ones the first and shortest).

    On a page that names its article, words outside it count against a region.
    """
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    named = any(t.inside and t.words and not t.aside for t in page)
    for i, t in enumerate(page):
        score = 0 if t.aside else weights.of(t.tag, t.name) if t.tag else -t.words if named and not t.inside else t.words
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, at = total, (start, i + 1)
    return at


def main_text(page: str, weights: Weights) -> str:
    found = tokens(page)
    first, last = region(found, weights)
    blocks, now = [], []
    for t in found[first:last]:
        if t.tag and t.name in BLOCK:
            blocks.append("".join(now))
            now = []
        elif not t.tag and not t.aside:
            now.append(t.text)
    blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def counted(page: str) -> list[tuple[str, str, int, bool, int]]:
    """(tag, name, 1, inside, words) of the page's tags outside asides; words: of the stretch outside that the tag opens.

    The tag that opens an article is outside, as a region begins after it.
    """
    found, out, stretch = tokens(page), [], 0
    for t, before in zip(reversed(found), [*reversed(found[:-1]), None], strict=False):
        inside = t.inside and not (t.name in ("article", "main") and (before is None or not before.inside))
        if inside:
            stretch = 0
        elif not t.tag and not t.aside:
            stretch += t.words
        if t.tag and not t.aside:
            out.append((t.tag, t.name if not t.tag.startswith("/") else t.tag, 1, inside, 0 if inside else stretch))
    return out


def learn(pages: DataFrame, sample: int = SAMPLE, id_col: str = "page_id", html_col: str = "html") -> Weights:
    """Tag weights of the labelled pages."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for page in p["html"]:
                rows = pd.DataFrame(counted(page), columns=["tag", "name", "n", "inside", "words"])
                yield rows.groupby(["tag", "name", "inside"], as_index=False).agg(n=("n", "sum"), words=("words", "max"))

    text = text_or_empty(html_col)
    labelled = pages.select(F.xxhash64(F.col(id_col), text).alias("h"), text.alias("html")).where(
        F.col("html").rlike(r"(?i)<(article|main)\b"))
    ids = labelled.select("h").distinct().orderBy("h").limit(sample)
    rows = labelled.join(F.broadcast(ids), "h", "left_semi").select("html").mapInPandas(
        run, "tag string, name string, inside boolean, n long, words long")
    n_in, n_out = F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0))
    figures = [n_in.alias("n_in"), n_out.alias("n_out"), F.max("words").alias("words"), F.count_distinct("inside").alias("sides"),
               F.count(F.lit(1)).alias("pages")]
    classes = rows.where("tag <> name").groupBy("tag").agg(*figures).where("pages > sides")      # on two pages at least
    names = rows.groupBy(F.col("name").alias("tag")).agg(*figures)
    return Weights({r["tag"]: -cost(r["n_in"], r["n_out"], r["words"]) for r in classes.unionByName(names).collect()})


def cost(n_in: int, n_out: int, words: int) -> float:
    """What a tag costs that is seen so often inside and outside articles, and opens stretches outside of so many words at most."""
    if not n_in:
        return 1.0 + words
    return CHEAP + max(0.0, math.log((n_out + 1) / (n_in + 1)))


def extract(pages: DataFrame, weights: Weights, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with a string column ``out`` (replacing one of that name)."""
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([main_text(t, weights) for t in texts], dtype=object)

    return pages.withColumn(out, run(text_or_empty(html_col)))
