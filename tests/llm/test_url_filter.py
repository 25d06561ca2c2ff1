import random
from collections import Counter

from basketry.llm import url_filter as U
from tests.llm.helpers import docs_of

RULES = "host string, path string, verdict string"
PAGES = "page_id long, url string, host string, rule int"


def brute(rows, rules, default="allow"):
    out = []
    for page, url, *_ in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min((i for i, c in enumerate(rest) if c in "/?#"), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min((i for i, c in enumerate(path) if c in "?#"), default=len(path))]
        fits = [(len(h + p), len(h), h + p, v == "block", v) for h, p, v in rules
                if (host == h or host.endswith("." + h) or not h) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((page, host, path, best[2] if best else None, best[4] if best else default))
    return Counter(out)


def got(spark, rows, rules, **kw):
    return Counter(map(tuple, U.judge(docs_of(spark, rows, PAGES), docs_of(spark, rules, RULES), **kw).collect()))


def test_random_nested_rules(spark):
    rng = random.Random(4)
    labels, tails = ["a", "b", "ab", "a-b", "net"], ["", "/", "/x", "/x/", "/x/y", "/xy", "/x/y/z?q#f", "?q", "#f", "/é/"]
    def host():
        return ".".join(rng.choices(labels, k=rng.randrange(1, 5)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in
                  ((host(), rng.choice(tails[:6])) for _ in range(60))}.values())
    rows = [(i, f"http://{host()}{rng.choice(tails)}", None, None) for i in range(1500)]
    rows += [(i, "https://HOT.net/x/y", None, None) for i in range(1500, 3000)]     # one URL has half of the rows
    assert got(spark, rows, rules) == brute(rows, rules)


def test_edges(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("net", "", "block"), ("net", "", "allow")]
    rows = [(1, None, "x", 1), (None, "http://a.com", None, None), (2, "", None, None), (3, "no scheme.com/", None, None),
            (4, "://", None, None), (5, "x://Net", None, None), (5, "x://Net", None, None), (6, "a://b://c.net/", None, None),
            (7, "http://notexample.com/en/", None, None), (8, "http://EXAMPLE.com/en/?x=/de/", None, None),
            (9, "http://u@example.com:80/en/" + "p" * 50_000, None, None)]
    assert got(spark, rows, rules) == brute(rows, rules)
    assert got(spark, rows, [], default="block") == brute(rows, [], "block")
    assert got(spark, [], rules) == Counter()
    anywhere = [(None, None, "block"), ("com", "/", "allow")]
    assert got(spark, rows, anywhere) == brute(rows, [("", "", "block"), ("com", "/", "allow")])


def test_many_path_rules_of_one_host(spark):
    rules = [("h.com", f"/{'p' * i}", "block" if i % 2 else "allow") for i in range(300)]
    rows = [(i, f"http://h.com/{'p' * i}x", None, None) for i in range(0, 320, 7)]
    assert got(spark, rows, rules) == brute(rows, rules)
