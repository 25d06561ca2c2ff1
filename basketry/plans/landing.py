"""Order-event feed for the streaming queries, mapped from the ``events`` table.

A fixture of the test cluster, not part of the library: every event is an
order event, purchases also give an order item, signups a customer create or update.
The feed is dirty by rules on the event id, so that SQL can say the same: ids and
amounts are missing, order dates come in several layouts, some times are no
times.  It arrives in waves, as separate landings, with rows up to six minutes out of order
across them, so every stream runs over several micro-batches at any size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basketry.session import shared_dir
from basketry.sources.tables import read_table
from basketry.streaming import orders_stream as S

WAVES, JITTER_MINUTES = 3, 6


def landing_events(events: DataFrame) -> DataFrame:
    """Rows of ``EVENT_SCHEMA`` (one scan; nothing but explode makes rows)."""
    k, r, kind = F.col("event_id"), F.col("event_id") % 50, F.col("event_type")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    time = F.when(r == 17, "n/a").otherwise(iso)
    date = (F.when(r == 17, "n/a").when(r == 13, "soon").when(k % 5 == 1, F.date_format("ts", "yyyy-MM-dd"))
            .when(k % 5 == 2, F.date_format("ts", "MM/dd/yyyy")).when(k % 5 == 3, F.date_format("ts", "dd-MM-yyyy"))
            .when(k % 5 == 4, F.date_format("ts", "yyyy/MM/dd")).otherwise(iso))
    status = (F.when(kind == "purchase", "completed").when(kind == "error", "cancelled").when(kind == "click", "pending")
              .when(kind == "view", "shipped").when(kind == "signup", "refunded"))
    order_id, customer = F.when(r != 11, k), F.when(r != 7, F.col("user_id"))
    prop = F.get_json_object("props", "$.k").cast("long")
    quantity, discount = 1 + prop % 5, (k % 4 * 5).cast("double")

    def row(kind: str, **values) -> F.Column:
        values["event_type"] = F.lit(kind)
        values["event_timestamp"] = time
        return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.EVENT_SCHEMA])

    order = row("order", order_id=order_id, customer_id=customer, order_date=date, status=status,
                total_amount=F.when(r == 19, 0.0).when(r != 23, F.col("value")), source_system=F.lit("stream"))
    item = row("order_item", item_id=k * 10 + 1, order_id=order_id, product_id=prop, quantity=quantity, price=F.col("value"),
               discount_percent=discount, line_total=F.col("value") * quantity)
    more = 1 + (prop + 2) % 5
    second = row("order_item", item_id=k * 10 + 2, order_id=order_id, product_id=prop + 1, quantity=more, price=F.col("value"),
                 discount_percent=F.lit(0.0), line_total=F.col("value") * more)
    name = F.concat(F.lit("Customer "), F.col("user_id").cast("string"))
    update = row("customer_update", customer_id=customer, name=name,
                 email=F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit("@example.com")), join_date=date,
                 segment=F.when(k % 2 == 0, "VIP").otherwise("Regular"), phone=F.lit("5551230000"))
    update = update.withField("event_type", F.when(k % 3 == 0, "customer_create").otherwise("customer_update"))
    rows = F.array_compact(F.array(order, F.when(kind == "purchase", item), F.when((kind == "purchase") & (k % 4 == 1), second),
                                   F.when(kind == "signup", update)))
    return events.select(F.explode(rows).alias("e")).select("e.*")


def waves(events: DataFrame, n: int = WAVES) -> list[DataFrame]:
    """The events in order of arrival, cut into ``n`` parts of equal time spans."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    if span.lo is None:
        return [events]
    late = at + F.col("event_id") % (JITTER_MINUTES + 1) * 60_000_000
    number = F.least(F.lit(n - 1), F.floor((late - F.lit(span.lo)) * n / F.lit(span.hi - span.lo + 1)))
    return [events.filter(number == i) for i in range(n)]


def run_waves(spark: SparkSession, sf_dir: str, start: Callable[[str], list[StreamingQuery]], again: bool = False,
              closing: bool = False) -> str:
    """Lands each wave and runs the queries of ``start(landing)`` over it from their checkpoints; returns the landing.

    ``again``: every eleventh event of a wave comes once more with the same wave's end and with the next wave.
    ``closing``: a last wave of one order and one item a month later, whose watermark closes what is open.
    """
    root, events = shared_dir(spark, "landing"), read_table(spark, sf_dir, "events")
    before = None
    for i, wave in enumerate(waves(events)):
        rows = landing_events(wave)
        if again:
            rows = rows.unionByName(landing_events(repeated(wave)))
            rows = rows.unionByName(landing_events(repeated(before))) if before is not None else rows
        S.land_events(rows, f"{root}/wave={i}")
        S.await_all(spark, start(f"{root}/*"))
        before = wave
    if closing:
        S.land_events(closing_events(events), f"{root}/wave=closing")
        S.await_all(spark, start(f"{root}/*"))
    return f"{root}/*"


def repeated(events: DataFrame) -> DataFrame:
    """The events that are delivered again (only those with a time)."""
    return events.filter((F.col("event_id") % 11 == 4) & (F.col("event_id") % 50 != 17))


def closing_events(events: DataFrame) -> DataFrame:
    """An order and an item of nobody, 30 days after the newest event."""
    late = F.date_format(F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 30 DAYS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    def row(kind: str) -> F.Column:
        known = {"event_type": F.lit(kind), "event_timestamp": F.col("late"), "order_id": F.lit(-1), "customer_id": F.lit(-1),
                 "item_id": F.lit(-1)}
        return F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.EVENT_SCHEMA])
    last = events.agg(late.alias("late")).filter("late IS NOT NULL")
    return last.select(F.explode(F.array(row("order"), row("order_item"))).alias("e")).select("e.*")


def landing_lines(events: DataFrame) -> DataFrame:
    """The feed as text lines (column ``value``), some of which are no sound record of a known type."""
    text = F.col("order_id").cast("string")
    r = F.when(F.col("event_type") == "order", F.col("order_id") % 61)
    line = (F.when(r == 3, F.concat(F.lit("{broken "), text)).when(r == 7, F.concat(F.lit('{"event_type":"order","order_id":"x'), text, F.lit('"}')))
            .when(r == 11, F.concat(F.lit('{"event_type":"refund","order_id":'), text, F.lit("}")))
            .when(r == 13, F.concat(F.lit('{"event_type":"order","order_id":'), text, F.lit(',"colour":"red"}')))
            .when(r == 17, F.concat(F.lit('{"order_id":'), text, F.lit("}"))))
    return landing_events(events).select(F.coalesce(line, F.to_json(F.struct(*S.EVENT_SCHEMA.fieldNames()))).alias("value"))


def run_line_waves(spark: SparkSession, sf_dir: str, start: Callable[[str], list[StreamingQuery]]) -> None:
    root = shared_dir(spark, "lines")
    for i, wave in enumerate(waves(read_table(spark, sf_dir, "events"))):
        landing_lines(wave).write.text(f"{root}/wave={i}")
        S.await_all(spark, start(f"{root}/*"))


def landed(spark: SparkSession, sf_dir: str) -> str:
    """The whole feed in one landing directory."""
    path = shared_dir(spark, "landing")
    S.land_events(landing_events(read_table(spark, sf_dir, "events")), path)
    return path


# ------------------------------------------------------------------ the same in SQL
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
_TIME = f"CASE WHEN event_id % 50 = 17 THEN 'n/a' ELSE {_ISO} END"
_DATE = (f"CASE WHEN event_id % 50 = 17 THEN 'n/a' WHEN event_id % 50 = 13 THEN 'soon' ELSE CASE event_id % 5 "
         f"WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%m/%d/%Y') WHEN 3 THEN strftime(ts, '%d-%m-%Y') "
         f"WHEN 4 THEN strftime(ts, '%Y/%m/%d') ELSE {_ISO} END END")
_STATUS = ("CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'cancelled' WHEN 'click' THEN 'pending' "
           "WHEN 'view' THEN 'shipped' WHEN 'signup' THEN 'refunded' END")
_ORDER = "CASE WHEN event_id % 50 <> 11 THEN event_id END"
_CUSTOMER = "CASE WHEN event_id % 50 <> 7 THEN user_id END"
_AMOUNT = "CASE WHEN event_id % 50 = 19 THEN 0.0 WHEN event_id % 50 <> 23 THEN value END"
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

SQL_ORDERS = (f"SELECT 'order' AS event_type, {_TIME} AS event_timestamp, {_ORDER} AS order_id, {_CUSTOMER} AS customer_id, "
              f"{_DATE} AS order_date, {_STATUS} AS status, {_AMOUNT} AS total_amount, 'stream' AS source_system FROM events")
SQL_ITEMS = (f"SELECT 'order_item' AS event_type, {_TIME} AS event_timestamp, event_id * 10 + 1 AS item_id, {_ORDER} AS order_id, "
             f"{_K} AS product_id, 1 + {_K} % 5 AS quantity, value AS price, CAST(event_id % 4 * 5 AS DOUBLE) AS discount_percent, "
             f"value * (1 + {_K} % 5) AS line_total FROM events WHERE event_type = 'purchase' UNION ALL "
             f"SELECT 'order_item', {_TIME}, event_id * 10 + 2, {_ORDER}, {_K} + 1, 1 + ({_K} + 2) % 5, value, 0.0, "
             f"value * (1 + ({_K} + 2) % 5) FROM events WHERE event_type = 'purchase' AND event_id % 4 = 1")
SQL_CUSTOMERS = (f"SELECT CASE WHEN event_id % 3 = 0 THEN 'customer_create' ELSE 'customer_update' END AS event_type, {_TIME} AS event_timestamp, {_CUSTOMER} AS customer_id, "
                 f"'Customer ' || user_id AS name, 'c' || user_id || '@example.com' AS email, {_DATE} AS join_date, "
                 f"CASE WHEN event_id % 2 = 0 THEN 'VIP' ELSE 'Regular' END AS segment, '5551230000' AS phone "
                 f"FROM events WHERE event_type = 'signup'")
SQL_ALL = f"SELECT * FROM ({SQL_ORDERS}) UNION ALL BY NAME SELECT * FROM ({SQL_ITEMS}) UNION ALL BY NAME SELECT * FROM ({SQL_CUSTOMERS})"

#: Orders with parsed time t and date d, amount a in cents-exact decimals, and validity.
SQL_PARSED = f"""(SELECT *, CASE WHEN order_id IS NOT NULL AND customer_id IS NOT NULL AND d IS NOT NULL AND a > 0 THEN 1 ELSE 0 END AS valid
  FROM (SELECT event_id, {_ORDER} AS order_id, {_CUSTOMER} AS customer_id, {_STATUS} AS status, CAST({_AMOUNT} AS DECIMAL(18,2)) AS a,
    CASE WHEN event_id % 50 <> 17 THEN CAST(ts AS TIMESTAMP) END AS t,
    CASE WHEN event_id % 50 NOT IN (13, 17) THEN CAST(ts AS DATE) END AS d FROM events))"""
SQL_ENRICHED = f"""SELECT order_id, customer_id, status, CAST(a AS DOUBLE) AS total_amount, t AS event_time, d AS order_date_parsed,
  CAST(coalesce(year(d), year(t)) AS BIGINT) AS order_year, CAST(coalesce(month(d), month(t)) AS BIGINT) AS order_month,
  CASE WHEN status = 'completed' THEN 1 ELSE 0 END AS is_completed, valid AS is_valid_order FROM {SQL_PARSED}"""
