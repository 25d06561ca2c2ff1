"""Driver contract: entry() runs, and every registered query matches its SQL oracle (sf0.001)."""
import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def _load(name, path):
    spec = importlib.util.spec_from_file_location(name, path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


E = _load("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
CHECK = _load("oracle_check", os.path.join(ROOT, "tools", "oracle_check.py"))


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["order_year", "order_month", "customer_segment", "value_segment", "revenue", "order_count",
                          "customer_count"]


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in CHECK.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    cur = duck.execute(E.oracle_sql()[name])
    d_cols = [c[0] for c in cur.description]
    assert sorted(sdf.columns) == sorted(d_cols)
    from collections import Counter
    s_rows = CHECK.rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    d_rows = CHECK.rows_of(d_cols, cur.fetchall())
    assert Counter(s_rows) == Counter(d_rows)


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF).count() >= 0
