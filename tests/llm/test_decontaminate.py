import random

from pyspark.sql import functions as F

from basketry.llm import decontaminate as D
from tests.llm.helpers import SF, docs_of, documents, edge_docs

ITEMS = "item_id long, text string"
Q = "Last week Alice buys 12 apples at 3 dollars each from Bob, then Alice sells 5 apples; how many apples does she keep now?"


def found(spark, docs, items):
    return {(r.doc_id, r.item_id): r for r in D.matches(docs_of(spark, docs), docs_of(spark, items, ITEMS)).collect()}


def test_planted_passages(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = documents(spark)
    got = {(r.doc_id, r.item_id) for r in D.matches(docs, bench).collect()}
    def plain(t):
        return " ".join(t.split())
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if plain(b.text) in plain(d.text or "")}
    assert want and got >= want
    assert len(got - want) <= 0.02 * len(want)
    left = {r.doc_id for r in D.clean(docs, bench).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_reparameterised_question(spark):
    other = Q.replace("Alice", "Carla").replace("Bob", "Dmitri").replace("12", "30").replace("3 ", "7 ").replace("5", "9")
    mixed = other.replace("then Carla", "then Bruno")       # one person became two: not the same question
    docs = [(1, Q), (2, f"Some words before. {other} And some after."), (3, mixed), (4, "Nothing of the kind is here at all, 12 apples.")]
    got = found(spark, docs, [(7, Q), (7, Q)])
    assert set(got) == {(1, 7), (2, 7)}
    assert got[1, 7].verbatim and not got[2, 7].verbatim
    assert got[1, 7].coverage == 1.0


def test_case_white_space_and_punctuation_do_not_matter(spark):
    got = found(spark, [(1, Q.replace(" ", "\n  ").replace(",", " ,").lower().replace("alice", "Alice").replace("bob", "Bob"))], [(1, Q)])
    assert (1, 1) not in got or got[1, 1].verbatim       # line breaks may start sentences: names there are literals
    assert set(found(spark, [(1, Q.upper().lower())], [(1, Q.lower())])) == {(1, 1)}


def test_short_items(spark):
    docs = [(1, "we know the quick brown fox is here"), (2, "The fox!"), (3, "the fox ran"), (4, ""), (5, "12")]
    items = [(1, "the quick brown fox is"), (2, "the fox"), (3, ""), (4, None), (5, "12"), (6, "...")]
    assert set(found(spark, docs, items)) == {(1, 1), (2, 2), (5, 5)}      # the shortest ones only as whole texts


def test_capitals_and_digits_do_not_match_each_other(spark):
    assert not found(spark, [(1, "x IT IS ALL ONE LOUD CRY OF THE CROWD " * 5), (2, "1 2 3 4 5 6 7 8 9 10 11 12")],
                     [(1, "so THE OTHER CROWD WAS LOUD AND FULL OF JOY"), (2, "9 8 7 6 5 4 3 2 1 0 12 13")])


def test_edges(spark):
    items = docs_of(spark, [(None, Q), (1, None)], ITEMS)
    assert D.matches(edge_docs(spark), items).collect() == []
    kept = D.clean(edge_docs(spark), items)
    assert kept.columns == edge_docs(spark).columns and kept.count() == edge_docs(spark).count()
    assert D.matches(docs_of(spark, []), items).collect() == []
    assert D.matches(edge_docs(spark), docs_of(spark, [], ITEMS)).collect() == []
    rows = D.matches(docs_of(spark, [(None, Q), (None, Q)]), items).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(None, None)]


def test_upper_and_lower_case_copies(spark):
    other = "the report of Anna Berg and Carl Dahl says that Emma Falk met Georg Holm in Oslo near the old town hall"
    docs = [(1, Q.upper()), (2, Q.lower()), (3, f"Before it. {other.upper()} And after."), (4, other.lower()), (5, Q.title())]
    got = found(spark, docs, [(1, Q), (2, other)])
    assert set(got) == {(1, 1), (2, 1), (5, 1), (3, 2), (4, 2)}
    assert all(r.coverage == 1.0 and r.verbatim for r in got.values())


def test_names_at_sentence_starts(spark):
    q = "Alice has 12 apples in her basket. Alice gives 5 apples to Bob. How many apples does Alice have now?"
    other = q.replace("Alice", "Carla").replace("Bob", "Dmitri").replace("12", "30")
    mixed = other.replace("Carla gives", "Bruno gives")
    short = "Anna went home with the 3 red balls today"
    docs = [(1, other), (2, f"Before it. {other} And after."), (3, mixed), (4, f"we know that {short}")]
    got = found(spark, docs, [(1, q), (2, short)])
    assert set(got) == {(1, 1), (2, 1), (4, 2)} and got[1, 1].coverage == 1.0


def test_long_excerpts(spark):
    words = [f"word{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100)]
    docs = [(1, "before " + " ".join(words[20:60]) + " after"), (2, " ".join(words[20:40]) + " and " + " ".join(words[41:61]))]
    got = found(spark, docs, [(1, " ".join(words))])
    assert set(got) == {(1, 1)} and got[1, 1].coverage < 0.5


def test_spelled_out_numbers_and_glued_units(spark):
    digits = "What is the total cost of 12 apples and 7 pears when each of the boxes weighs 5 km or 21 kg in all the shops"
    words = digits.replace("12", "twelve").replace("7", "Seven").replace("21", "twenty-one")
    docs = [(1, words), (2, digits.replace("5 km", "5km").replace("21 kg", "21kg")), (3, digits.replace("12", "one hundred twenty"))]
    got = found(spark, docs, [(1, digits)])
    assert set(got) == {(1, 1), (2, 1), (3, 1)} and all(r.coverage == 1.0 for r in got.values())
    assert got[2, 1].verbatim and not got[1, 1].verbatim
    t = D.templates(["one hundred twenty apples. Five", "six 5km 3.5kg 4th"], D.Codes())
    assert [t.value(i) for i in range(len(t.place))] == ["one hundred twenty", "apples", "five", "six", "5", "km", "3.5", "kg", "4th"]


def brute_templates(text):
    """Per form the canonical tokens, and the values, by a plain loop."""
    tokens, out, start, spelled = D.TOKEN.findall(text), [[], [], []], True, False
    values = []
    for t in tokens:
        if t in ".!?\n:":
            start, spelled = True, False
            continue
        low = t.lower()
        if spelled and low in D.NUMBERS:
            values[-1] += " " + low
            start = False
            continue
        spelled = low in D.NUMBERS
        kind = "<num>" if spelled or any(c.isdigit() for c in t) else "<unit>" if low in D.UNITS else None
        capital = kind is None and t[0].isupper()
        for form, name in enumerate((capital and not start, False, capital)):
            out[form].append(kind or ("<name>" if name else low))
        values.append(low)
        start = False
    return out, values


def brute_matches(docs, items):
    got = set()
    for item, q in items:
        forms, values = brute_templates(q)
        n = len(values)
        if 0 < n < D.LEAST:
            got |= {(d, item) for d, text in docs if brute_whole(text) == brute_whole(q)}
            continue
        for d, text in docs:
            theirs, others = brute_templates(text)
            for a, b in zip(forms, theirs, strict=True):
                w = min(D.WINDOW, n)
                mine = [i for i in range(n - w + 1) if sum(x[0] != "<" for x in a[i:i + w]) >= min(D.LITERALS, w)]
                by = {}
                for i in mine:
                    for j in range(len(b) - w + 1):
                        if a[i:i + w] == b[j:j + w]:
                            by.setdefault(j - i, []).append(i)
                covered, long = set(), False
                for diagonal, places in by.items():
                    pairs = {(values[i + k], others[i + k + diagonal]) for i in places for k in range(w) if a[i + k][0] == "<"}
                    if len({x for x, _ in pairs}) == len(pairs):
                        covered |= set(places)
                        long |= any(all(i + k in places for k in range(D.RUN)) for i in places)
                if mine and (len(covered) / len(mine) >= D.COVER or long):
                    got.add((d, item))
    return got


def brute_whole(text):
    return [t.lower() for t in D.TOKEN.findall(text) if t not in ".!?\n:"]


def test_templates_diagonals_and_slots_match_brute_force(spark):
    rng = random.Random(8)
    names, words = ["Anna", "Bob", "Carl", "Dora", "Emil"], "the a red of big sells buys then how many each gives box ball house tree".split()

    def token():
        return rng.choice([rng.choice(names), str(rng.randint(1, 30)), rng.choice(["two", "twenty one", "km", "5kg", "dollars"]),
                           *[rng.choice(words) for _ in range(6)]])

    def question():
        out = []
        for _ in range(rng.choice([2, 4, 7, 12, 20, 45])):
            out.append(token() + rng.choice(["", "", "", "", ".", "?"]))
        return " ".join(out)
    items = [(i, question()) for i in range(25)]
    docs = []
    for i in range(150):
        parts = [token() for _ in range(rng.randint(0, 10))]
        q = rng.choice(items)[1].split()
        if rng.random() < 0.5:                              # re-parameterised, mostly consistently
            change = {x: rng.choice(names) for x in names} | {str(k): str(rng.randint(1, 30)) for k in range(31)}
            q = [change.get(x, x) if rng.random() < 0.98 else token() for x in q]
        if rng.random() < 0.3:
            q = q[:rng.randint(1, len(q))]
        case = rng.choice([str, str, str, str.upper, str.lower])
        docs.append((i, case(" ".join([*parts, *q, *[token() for _ in range(rng.randint(0, 10))]]) if rng.random() < 0.8 else " ".join(q))))
    want = brute_matches(docs, items)
    assert len(want) > 30 and set(found(spark, docs, items)) == want


def test_bitmap_grows_with_the_benchmark(spark):
    one = D._bitmap(spark.range(10).select(F.xxhash64("id").alias("h")))
    many = D._bitmap(spark.range(50_000).select(F.xxhash64("id").alias("h")))
    assert len(one) == (1 << 16) // 8 and len(many) == (1 << 22) // 8
    assert sum(int(b).bit_count() for b in one) == 10
