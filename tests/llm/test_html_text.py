import html
import re

from basketry.llm import html_text as H
from tests.llm.helpers import SF, docs_of

PAGES = "page_id long, html string, main_text int"


def of_article(page):
    """The text of the generated pages' only article, read off their markup."""
    m = re.search(r"<article>(.*?)</article>", page, re.S)
    blocks = [html.unescape(re.sub("<[^>]*>", "", x)) for x in re.split(r"<(?:/?p|br|/?h1)>", m[1])]
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = H.extract(pages, H.learn(pages)).collect()
    assert len(rows) == pages.count()
    assert [r.page_id for r in rows if r.main_text != of_article(r.html)] == []


WORDS = " ".join(f"word{i}" for i in range(30))
PAGE = f"""<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li></ul><div class="cookie-notice">We use cookies {WORDS}</div>
<article><h1>Head &amp; line</h1><p>One <b>bo</b>ld&nbsp;text,\n  <a href="x">a link</a>.</p><!-- <p>no</p> --><p></p><p>{WORDS}
<aside>Side {WORDS}</aside><p>Two<br>lines &lt;tag&gt; &eacute; &#233; &bogus;<form><p>{WORDS}</p></form><p>End {WORDS}</article>
<section id="comments"><p>{WORDS} {WORDS}</p></section><footer>Foot {WORDS}</footer></body>"""


def test_parts_that_are_no_content():
    want = ["Head & line", "One bold text, a link.", WORDS, "Two", "lines <tag> é é &bogus;", f"End {WORDS}"]
    assert H.main_text(PAGE, H.Weights()) == "\n".join(want)


def test_region_is_the_best_of_all():
    w = H.Weights({"a": -3.0, "b": -0.5, "c": -40.0})
    page = H.tokens("<c>x x<a>y y y y<b>z<b><a>q q q<c>" + "r " * 9)
    score = [0 if t.aside else t.words if not t.tag else w.of(t.tag, t.name) for t in page]     # no article is named
    i, j = H.region(page, w)
    assert abs(sum(score[i:j]) - max(sum(score[a:b]) for a in range(len(score)) for b in range(a, len(score) + 1))) < 1e-9


def test_edges(spark):
    deep = "<div>" * 3000 + "deep words here" + "</div>" * 3000
    long = "<p>" + "x " * 100_000 + "</p>"
    rows = [(1, None, 1), (2, "", None), (None, "<p>plain", None), (3, "no tags at all", None), (3, "no tags at all", None),
            (4, "<<<>>><!-- never closed", None), (5, "<script>only()", None), (6, deep, None), (7, long, None),
            (8, "<p title='a>b\">x</p", None)]
    out = H.extract(docs_of(spark, rows, PAGES).withColumnRenamed("main_text", "words"), H.Weights())
    got = {r.page_id: r.main_text for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1] == got[2] == got[5] == "" and got[None] == "plain" and got[3] == "no tags at all"
    assert got[6] == "deep words here" and got[7] == "x " * 99_999 + "x"
    assert H.learn(docs_of(spark, [], PAGES)).tags == {}
    assert H.learn(docs_of(spark, rows, PAGES)).tags == {}


def odd(page, i):
    """A given page with parts that the given pages do not have."""
    words = " ".join(f"comment{j}" for j in range(500))
    if i % 10 == 0:                                         # a long plain paragraph outside the article
        page = page.replace("</article>", f"</article><div><p>{words}</p></div>")
    if i % 10 == 1:                                         # before it, too
        page = page.replace("<article>", f"<div><p>{words}</p></div><article>")
    if i % 10 == 2:                                         # a long advert and a share bar inside
        page = page.replace("</h1>", f"</h1><div class=\"ad-slot\">{words[:400]}</div>").replace(
            "</article>", "<ul class='share-links'><li>Share it</li></ul></article>")
    if i % 10 == 3:                                         # comments with a class nobody knows, in sections of their own
        page = page.replace("</article>", f"</article><section id=\"comments\"><h3>Replies</h3><p>{words}</p><p>{words}</p></section>")
    return page


def test_learned_weights_on_odd_pages(spark):
    given = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").collect()
    rows = [(r.page_id, odd(r.html, i)) for i, r in enumerate(given)]
    pages = docs_of(spark, rows, "page_id long, html string")
    weights = H.learn(pages)
    assert weights.of("p", "p") > -1
    got = {r.page_id: r.main_text for r in H.extract(pages, weights).collect()}
    assert [r.page_id for r in given if got[r.page_id] != of_article(r.html)] == []


def test_names_that_say_nothing(spark):
    """Slugs, wrappers and periods of notice are no parts of a page's frame."""
    weights = H.learn(spark.read.parquet(f"{SF}/pages.parquet"))
    body = f"<h1>Title here</h1><h2 id='search-basics'>Basics</h2><p class='notice-period'>{WORDS}</p><h2 id=related-work>Related</h2><p>{WORDS}</p>"
    want = "\n".join(["Title here", "Basics", WORDS, "Related", WORDS])
    for page in (f"<body><article>{body}</article></body>", f"<body><div class='post-with-sidebar'>{body}</div></body>",
                 f"<body><div class='sidebar'>{body}</div><footer>Foot</footer></body>",
                 f"<body><form id=form1><div id='search'>{body}</div></form></body>",
                 f"<body><div class='content'>{body}<div class='cookie-notice'>{WORDS}</div><div class='related_posts widget'>{WORDS}</div></div></body>"):
        assert H.main_text(page, weights) == want


def test_long_advert_after_the_first_paragraph(spark):
    weights = H.learn(spark.read.parquet(f"{SF}/pages.parquet"))
    page = f"<article><h1>Title</h1><p>First one.</p><div class=advert>{'buy ' * 400}</div><p>{WORDS}</p><aside>{WORDS * 9}</aside><p>End.</p></article>"
    assert H.main_text(page, weights) == f"Title\nFirst one.\n{WORDS}\nEnd."


def test_costs():
    assert H.cost(100, 10, 500) == H.CHEAP and H.cost(0, 3, 500) == 501.0
    assert H.cost(1, 1000, 500) < 10


def test_part_names():
    for name in ("ad", "ad-slot", "sidebar_left", "cookie-notice", "x comments", "Related-Posts", "comment-list-2", "nav"):
        assert H.names_part(name), name
    for name in ("notice-period", "post-with-sidebar", "search-basics", "related-work", "content", "admin", "headers-and-footers", ""):
        assert not H.names_part(name), name
