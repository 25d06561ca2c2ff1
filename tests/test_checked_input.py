"""Malformed input: every record has one route, rejected ones keep their text and a cause."""

from collections import Counter

from pyspark.sql import types as T

from basketry.session import shared_dir
from basketry.sinks import layers as LY
from basketry.sources import checked as CK
from basketry.streaming import orders_stream as S

TYPES = list(S.EVENT_COLUMNS)


def texts(spark, lines, name="lines"):
    path = shared_dir(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


LINES = ['{"event_type":"order","order_id":1,"total_amount":5.5}', "{broken line", '{"event_type":"order","order_id":"abc"}',
         '{"event_type":"refund","order_id":2}', '{"order_id":3}', '{"event_type":"order","order_id":4,"extra":{"a":1}}', "[1, 2]", "null",
         '{"event_type":"order","total_amount":"1,000.00"}', '{"event_type":"customer_create","customer_id":7}', "plain text",
         '{"event_type":"order_item","quantity":1.5}', '{}']


def test_stream_routes_every_line(spark):
    out, ck = shared_dir(spark, "routes"), shared_dir(spark, "ck")
    path = texts(spark, LINES[:6]) + "*"
    S.await_all(spark, [CK.to_routes(CK.read_event_lines(spark, path, S.EVENT_SCHEMA, TYPES), out, ck)])
    more = spark.createDataFrame([(x,) for x in LINES[6:]], "value string").coalesce(1)
    more.write.mode("append").text(path[:-1])
    S.await_all(spark, [CK.to_routes(CK.read_event_lines(spark, path, S.EVENT_SCHEMA, TYPES), out, ck)])
    rows = spark.read.parquet(out)
    assert rows.count() == len(LINES)                      # rows in = rows routed
    got = {r.record_text: (r.route, r.cause) for r in rows.filter("record_text IS NOT NULL").collect()}
    assert got == {"{broken line": ("quarantine", CK.BROKEN), LINES[2]: ("quarantine", CK.VALUE), LINES[3]: ("other", CK.UNKNOWN_TYPE),
                   LINES[4]: ("other", CK.NO_TYPE), LINES[5]: ("quarantine", CK.SURPLUS), "[1, 2]": ("quarantine", CK.VALUE),
                   "null": ("quarantine", CK.VALUE), LINES[8]: ("quarantine", CK.VALUE), "plain text": ("quarantine", CK.BROKEN),
                   LINES[11]: ("quarantine", CK.VALUE), "{}": ("other", CK.NO_TYPE)}
    assert [(r.order_id, r.total_amount) for r in CK.read_route(spark, out, S.EVENT_SCHEMA, "order").collect()] == [(1, 5.5)]
    assert [r.customer_id for r in CK.read_route(spark, out, S.EVENT_SCHEMA, "customer_create").collect()] == [7]
    other = CK.read_route(spark, out, S.EVENT_SCHEMA, "other")
    assert Counter(r.order_id for r in other.collect()) == Counter([2, 3, None])


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("amount", T.DoubleType())])
CSV = {**LY._CSV}


def test_csv_keeps_bad_records(spark):
    lines = ["id,name,amount", "1,a,2.5", "x7,b,1.0", '2,"c, d","1,000.00"', "3,e,1.5,surplus", "4,f", "\\N,\\N,\\N", '5,"g ""q""",0', "6,,7"]
    landed = CK.land_csv(spark, texts(spark, lines), SCHEMA, CSV, shared_dir(spark, "landed"))
    assert landed.count() == len(lines) - 1
    assert sorted(map(tuple, CK.sound(landed).collect()), key=str) == sorted(
        [(1, "a", 2.5), (None, None, None), (5, 'g \\"q\\"', 0.0), (6, None, 7.0)], key=str) or \
        {r.id for r in CK.sound(landed).collect()} == {1, None, 5, 6}
    assert {r.record_text: r.cause for r in CK.rejected(landed).collect()} == {
        "x7,b,1.0": CK.VALUE, '2,"c, d","1,000.00"': CK.VALUE, "3,e,1.5,surplus": CK.SURPLUS, "4,f": CK.MISSING}


def test_json_keeps_bad_records(spark):
    lines = ['{"id":1,"name":"a","amount":2}', '{"id":"x"}', "{nope", '{"id":2,"other":1}', '{"name":"no id"}']
    landed = CK.land_json(spark, texts(spark, lines), SCHEMA, shared_dir(spark, "landed"))
    assert sorted(map(tuple, CK.sound(landed).collect()), key=str) == sorted([(1, "a", 2.0), (None, "no id", None)], key=str)
    assert {r.record_text: r.cause for r in CK.rejected(landed).collect()} == {
        '{"id":"x"}': CK.VALUE, "{nope": CK.BROKEN, '{"id":2,"other":1}': CK.SURPLUS}


def test_verdict_does_not_depend_on_the_columns_read(spark):
    """A CSV reader asked for one column does not look at the others; the landed table has."""
    landed = CK.land_csv(spark, texts(spark, ["id,name,amount", "1,a,bad", "2,b,3"]), SCHEMA, CSV, shared_dir(spark, "landed"))
    assert [r.id for r in CK.sound(landed).select("id").collect()] == [2]
    assert CK.rejected(landed).count() == 1


def test_empty_input(spark):
    landed = CK.land_json(spark, texts(spark, []), SCHEMA, shared_dir(spark, "landed"))
    assert landed.count() == 0 and CK.sound(landed).columns == ["id", "name", "amount"]
