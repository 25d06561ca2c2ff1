"""Property tests: the Spark column rules against a plain-Python statement of the same rules."""
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.functions import cleaning as C
from basketry.functions import vocab as V

WORDS = (["completed", "complete", "cancelled", "canceled", "pending", "processing", "shipped", "delivered",
          "refunded", "returned", "failed", "error", "unknwon", "on hold", "", "true", "false", "yes", "no", "y",
          "n", "1", "0", "active", "inactive", "vip", "gold", "premium", "standard", "basic", "silver", "regular",
          "new", "bronze", "n/a", "tbd", "unknown", "churned"])


@st.composite
def dirty_word(draw):
    w = draw(st.sampled_from(WORDS))
    w = "".join(ch.upper() if draw(st.booleans()) else ch for ch in w)
    return draw(st.sampled_from(["", " ", "  "])) + w + draw(st.sampled_from(["", " ", "\t"]))


def py_status(s):
    if s is None or s.strip(" ") == "":
        return "unknown"
    n = s.strip(" ").upper()
    for canon, spellings in V.STATUS_GROUPS:
        if n in spellings:
            return canon
    return s.strip(" ").lower()


def py_segment(s):
    if s is None or s.strip(" ") == "" or s.strip(" ").upper() in V.SEGMENT_SENTINELS:
        return "Unknown"
    n = s.strip(" ").upper()
    for canon, spellings in V.SEGMENT_GROUPS:
        if n in spellings:
            return canon
    return s.strip(" ")


def py_bool(s):
    if s is None:
        return None
    n = s.strip(" ").upper()
    return True if n in V.TRUE_TOKENS else False if n in V.FALSE_TOKENS else None


def py_phone(s):
    if s is None or s.strip(" ") == "" or s.strip(" ").upper() in V.PHONE_SENTINELS or s == "123-456-7890":
        return None
    d = re.sub(r"[^0-9]", "", s)
    if len(d) == 11 and d.startswith("1"):
        d = d[1:]
    return f"+1-{d[:3]}-{d[3:6]}-{d[6:]}" if len(d) == 10 else None


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), dirty_word()), min_size=1, max_size=40))
def test_status_segment_boolean_rules(spark, values):
    assert run(spark, values, C.clean_status) == [py_status(v) for v in values]
    assert run(spark, values, C.clean_segment) == [py_segment(v) for v in values]
    assert run(spark, values, C.parse_boolean) == [py_bool(v) for v in values]


digits = st.text(alphabet="0123456789", min_size=3, max_size=4)


@st.composite
def dirty_phone(draw):
    a, e, l4 = draw(st.text("0123456789", min_size=3, max_size=3)), draw(st.text("0123456789", min_size=3, max_size=3)), \
        draw(st.text("0123456789", min_size=4, max_size=4))
    layout = draw(st.sampled_from(["+1-{a}-{e}-{l}", "{a}.{e}.{l}", "({a}) {e}-{l}", "{a}{e}{l}", "1{a}{e}{l}",
                                   "{e}-{l}", "123-456-7890", "N/A", "unknown", "", " {a} {e} {l} "]))
    return layout.format(a=a, e=e, l=l4)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), dirty_phone()), min_size=1, max_size=40))
def test_phone_rule(spark, values):
    assert run(spark, values, C.clean_phone) == [py_phone(v) for v in values]
