from collections import Counter

from basketry.llm import line_dedup as L
from tests.llm.helpers import docs_of, documents, edge_docs


def brute(docs, min_docs, min_chars=1):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    rows = [(r.doc_id, (r.text or "").split("\n")) for r in docs.collect()]
    seen = Counter(k for _, lines in rows for k in {key(x) for x in lines})
    out = []
    for doc, lines in rows:
        kept = [x for x in lines if len(key(x)) < min_chars or seen[key(x)] < min_docs]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def got(docs, min_docs):
    return Counter(map(tuple, L.drop_frequent_lines(docs, min_docs).collect()))


def test_matches_brute_force(spark):
    docs = documents(spark)
    for n in (2, 10):
        want = brute(docs, n)
        assert got(docs, n) == want
    assert any(k[2] for k in want)


def test_edge_rows(spark):
    for n in (1, 2):
        assert got(edge_docs(spark), n) == brute(edge_docs(spark), n)


def test_a_line_twice_in_a_document_counts_once(spark):
    docs = docs_of(spark, [(1, "x\nx\nX \ny"), (2, "\x0bx\n\n"), (3, "z")])
    assert got(docs, 3) == brute(docs, 3)
    assert got(docs, 2) == Counter({(1, 4, 3, "y"): 1, (2, 3, 1, "\n"): 1, (3, 1, 0, "z"): 1})


def test_empty_table(spark):
    assert L.drop_frequent_lines(docs_of(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = L.drop_frequent_lines(documents(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
