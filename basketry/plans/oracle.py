"""Independent SQL oracle (DuckDB dialect) for the registered queries.

The driver runs each registered Spark query and the SQL below on the same
parquet tables and compares row counts, schemas and value hashes.  The SQL is
written from the rule book, not generated from the Spark plans, so an error
in either shows up as a mismatch.

Every query string is ``WITH <shared CTEs> <final select>``; DuckDB inlines
CTEs, so unused ones cost nothing.
"""

from __future__ import annotations

from types import SimpleNamespace

# The rule values, written out here a second time and not taken from the
# package under test: a wrong value there must show as a mismatch.
V = SimpleNamespace(
    NAME_SENTINELS=["UNKNOWN", "N/A", "TBD", "TEST USER"],
    NAME_TITLE_PATTERN=r"^(Mr\.|Ms\.|Mrs\.|Dr\.)\s*",
    EMAIL_PATTERN=r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    EMAIL_SENTINELS=["N/A", "TBD", "UNKNOWN", "NOTANEMAIL"],
    STATUS_GROUPS=[("completed", ["COMPLETED", "COMPLETE"]), ("cancelled", ["CANCELLED", "CANCELED"]),
                   ("pending", ["PENDING", "PROCESSING"]), ("shipped", ["SHIPPED", "DELIVERED"]),
                   ("refunded", ["REFUNDED", "RETURNED"]), ("failed", ["FAILED", "ERROR"]), ("unknown", ["UNKNWON"])],
    SEGMENT_SENTINELS=["UNKNOWN", "N/A", "TBD"],
    SEGMENT_GROUPS=[("Premium", ["PREMIUM", "VIP", "GOLD"]), ("Regular", ["REGULAR", "STANDARD", "BASIC", "SILVER"]),
                    ("Bronze", ["BRONZE", "NEW"])],
    TRUE_TOKENS=["TRUE", "T", "YES", "Y", "1", "ACTIVE"], FALSE_TOKENS=["FALSE", "F", "NO", "N", "0", "INACTIVE"],
    PHONE_SENTINELS=["N/A", "UNKNOWN", "TBD"], PHONE_FAKE_PATTERN=r"^123-456-7890$",
    PRODUCT_SENTINELS=["UNKNOWN", "N/A", "TBD"], UNKNOWN_PRODUCT="Unknown Product", OTHER_CATEGORY="Other",
    CATEGORY_RULES=[("ELECTRONIC", "Electronics"), ("HOME", "Home & Kitchen"), ("KITCHEN", "Home & Kitchen"),
                    ("SPORT", "Sports & Outdoors"), ("BOOK", "Books")])
RULES = SimpleNamespace(
    cleaning=SimpleNamespace(order_amount=(0, 5000000), item_quantity=(1, 100), item_price=(0, 1000000), item_discount=(0, 100),
                             product_price=(0, 10000000), product_weight=(0, 1000), age=(18, 120)),
    rfm=SimpleNamespace(high_monetary=50000, high_recency_days=60, medium_monetary=25000, medium_recency_days=90),
    fraud=SimpleNamespace(amount=((500000, 4), (300000, 3), (200000, 2), (100000, 1)), velocity_days=((1, 4), (3, 2), (7, 1)),
                          total_quantity=((180, 3), (140, 2), (110, 1)), max_item_quantity=((48, 3), (45, 2), (40, 1)),
                          risk_levels=((8, "Critical"), (6, "High"), (4, "Medium")), low_label="Low", flag_at=3),
    stream_fraud=SimpleNamespace(amount=((200.0, 4), (120.0, 3), (80.0, 2)),
                                 alert_amount=((200.0, 4, "High transaction amount"), (80.0, 2, "Elevated transaction amount")),
                                 status_points=1, flag_at=3, high_risk_at=5, alt_high_at=4, alt_unit=40.0))


def _q(vals) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in vals)


def blank(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '')"


def norm(c: str) -> str:
    return f"upper(trim({c}))"


DUCK_DATE_FORMATS = ["%Y-%m-%d", "%m/%d/%Y", "%d-%m-%Y", "%Y%m%d", "%B %d, %Y"]


def parse_date(c: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime({c}, '{f}')::DATE" for f in DUCK_DATE_FORMATS) + ")"


def clean_name(c: str) -> str:
    return (f"CASE WHEN {blank(c)} OR {norm(c)} IN ({_q(V.NAME_SENTINELS)}) THEN NULL "
            f"ELSE regexp_replace(regexp_replace(trim({c}), '\\s+', ' ', 'g'), '{V.NAME_TITLE_PATTERN}', '') END")


def clean_email(c: str) -> str:
    return (f"CASE WHEN {blank(c)} OR {norm(c)} IN ({_q(V.EMAIL_SENTINELS)}) "
            f"OR NOT regexp_matches({c}, '{V.EMAIL_PATTERN}') THEN NULL ELSE lower(trim({c})) END")


def clean_status(c: str) -> str:
    parts = [f"WHEN {blank(c)} THEN 'unknown'"]
    parts += [f"WHEN {norm(c)} IN ({_q(sp)}) THEN '{canon}'" for canon, sp in V.STATUS_GROUPS]
    return "CASE " + " ".join(parts) + f" ELSE lower(trim({c})) END"


def clean_segment(c: str) -> str:
    parts = [f"WHEN {blank(c)} OR {norm(c)} IN ({_q(V.SEGMENT_SENTINELS)}) THEN 'Unknown'"]
    parts += [f"WHEN {norm(c)} IN ({_q(sp)}) THEN '{canon}'" for canon, sp in V.SEGMENT_GROUPS]
    return "CASE " + " ".join(parts) + f" ELSE trim({c}) END"


def parse_bool(c: str) -> str:
    n = f"upper(trim(CAST({c} AS VARCHAR)))"
    return f"CASE WHEN {n} IN ({_q(V.TRUE_TOKENS)}) THEN true WHEN {n} IN ({_q(V.FALSE_TOKENS)}) THEN false END"


def in_range(c: str, lo, hi) -> str:
    return f"CASE WHEN {c} >= {lo} AND {c} <= {hi} THEN {c} END"


def clean_phone(c: str) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    nat = f"(CASE WHEN length({d}) = 11 AND starts_with({d}, '1') THEN substring({d}, 2, 10) ELSE {d} END)"
    bad = f"{blank(c)} OR {norm(c)} IN ({_q(V.PHONE_SENTINELS)}) OR regexp_matches({c}, '{V.PHONE_FAKE_PATTERN}')"
    return (f"CASE WHEN {bad} OR length({nat}) <> 10 THEN NULL ELSE "
            f"concat_ws('-', '+1', substring({nat}, 1, 3), substring({nat}, 4, 3), substring({nat}, 7, 4)) END")


def category(c: str) -> str:
    inner = " ".join(f"WHEN contains({norm(c)}, '{needle}') THEN '{label}'" for needle, label in V.CATEGORY_RULES)
    return (f"CASE WHEN {blank(c)} OR {norm(c)} IN ({_q(V.PRODUCT_SENTINELS)}) THEN '{V.OTHER_CATEGORY}' "
            f"ELSE CASE {inner} ELSE trim({c}) END END")


def pick(sel: str, choices: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {sel} = {i} THEN {ch}" for i, ch in enumerate(choices)) + " END"


def render_date(d: str, sel: str) -> str:
    return pick(sel, [f"strftime({d}, '{f}')" for f in DUCK_DATE_FORMATS])


def dedup_first(table: str, key: str, cols: list[str]) -> str:
    order = ", ".join(f"{c} NULLS FIRST" for c in cols if c != key)
    return (f"SELECT {', '.join(cols)} FROM (SELECT {', '.join(cols)}, row_number() OVER "
            f"(PARTITION BY {key} ORDER BY {order}) AS _rn FROM {table}) WHERE _rn = 1")


def cents(x: str) -> str:
    return f"CAST(round({x} * 100) AS BIGINT)"


def cents_dec(x: str) -> str:
    """Exact DECIMAL(38,2) from an integer number of cents."""
    return f"(CAST({x} AS DECIMAL(38,0)) * CAST(0.01 AS DECIMAL(3,2)))"


def money_sum(x: str) -> str:
    """Exact total of a money column (doubles with <= 2 decimals) as DECIMAL(38,2)."""
    return cents_dec(f"sum({cents(x)})")


def div_half_up(num: str, den: int) -> str:
    return f"CAST(floor(({num} + {den // 2}) / {den}) AS BIGINT)"


def avg2(total: str, count: str) -> str:
    """Half-up cents of an average from an exact sum (matches Spark decimal rounding)."""
    return f"CAST(round(CAST({total} / {count} AS DECIMAL(38,6)), 2) AS DOUBLE)"


C = RULES.cleaning
MONEY = "DOUBLE"

# ----------------------------------------------------------------- raw model
_o = "o_orderkey"
RAW_ORDERS = f"""
raw_orders_base AS (
  SELECT {_o} AS order_id,
    CASE WHEN {_o} % 101 = 7 THEN NULL WHEN {_o} % 101 = 13 THEN -1 - o_custkey ELSE o_custkey END AS customer_id,
    CASE WHEN {_o} % 101 = 19 THEN NULL WHEN {_o} % 101 = 23 THEN '1996-17-40'
         WHEN {_o} % 101 = 29 THEN '1997-02-31' ELSE {render_date('CAST(o_orderdate AS DATE)', f'{_o} % 5')} END AS order_date,
    CASE WHEN {_o} % 101 = 31 THEN NULL WHEN {_o} % 101 = 37 THEN '' WHEN {_o} % 101 = 41 THEN 'on its way'
         WHEN {_o} % 101 = 43 THEN 'Refunded' WHEN {_o} % 101 = 47 THEN 'RETURNED' WHEN {_o} % 101 = 53 THEN 'canceled'
         WHEN {_o} % 101 = 59 THEN 'Failed' WHEN {_o} % 101 = 61 THEN 'on hold'
         WHEN o_orderstatus = 'F' THEN {pick(f'{_o} % 4', ["'completed'", "'Completed'", "'COMPLETE'", "' completed '"])}
         WHEN o_orderstatus = 'O' THEN {pick(f'{_o} % 4', ["'pending'", "'PENDING'", "'Pending '", "'pending'"])}
         ELSE {pick(f'{_o} % 4', ["'processing'", "'Processing'", "'shipped'", "'SHIPPED'"])} END AS status,
    CASE WHEN {_o} % 101 = 67 THEN NULL WHEN {_o} % 101 = 71 THEN -o_totalprice
         WHEN {_o} % 101 = 73 THEN 0.0 ELSE o_totalprice END AS total_amount,
    {pick(f'{_o} % 3', ["'web'", "'mobile'", "'store'"])} AS source_system,
    {pick(f'{_o} % 5', ['NULL', "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')", "strftime(o_orderdate, '%m/%d/%Y')", "CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR)"])} AS last_updated
  FROM orders),
raw_orders AS (
  SELECT order_id, customer_id, order_date, CASE WHEN _copy = 1 THEN 'completed' ELSE status END AS status, total_amount,
    CASE WHEN _copy = 1 THEN 'replay' ELSE source_system END AS source_system, last_updated
  FROM (SELECT *, unnest(CASE WHEN order_id % 211 = 5 THEN [0, 1] ELSE [0] END) AS _copy FROM raw_orders_base))"""

_k = "c_custkey"
_good = "lower(replace(c_name, '#', '.')) || '@example.com'"
_a = f"CAST(200 + {_k} % 800 AS VARCHAR)"
_e = f"CAST(100 + ({_k} * 7) % 900 AS VARCHAR)"
_l = f"CAST(1000 + ({_k} * 13) % 9000 AS VARCHAR)"
RAW_CUSTOMERS = f"""
raw_customers_base AS (
  SELECT {_k} AS customer_id,
    {pick(f'{_k} % 13', ['NULL', "''", "'N/A'", "'Mr. ' || c_name", "'Ms.  ' || c_name", "'  ' || upper(c_name) || '  '",
                         'lower(c_name)', "replace(c_name, '#', '  #')", "'Unknown'"] + ['c_name'] * 4)} AS name,
    {pick(f'{_k} % 17', ['NULL', "'no at sign'", "'nobody@'", "'@nowhere.org'", f"' ' || {_good}", f"upper({_good})", "'N/A'", "''",
                         "lower(replace(c_name, '#', '.')) || '@host'"] + [_good] * 8)} AS email,
    CASE WHEN {_k} % 6 = 5 THEN NULL ELSE {render_date(f"(DATE '1992-01-01' + CAST(({_k} * 37) % 2400 AS INTEGER))", f'{_k} % 6')} END AS join_date,
    CASE WHEN {_k} % 29 = 1 THEN 'vip ' WHEN {_k} % 29 = 2 THEN '' WHEN {_k} % 29 = 3 THEN NULL WHEN {_k} % 29 = 4 THEN 'N/A'
         WHEN {_k} % 29 = 5 THEN 'Churned' WHEN {_k} % 29 = 6 THEN 'new' WHEN {_k} % 29 = 7 THEN 'SILVER'
         ELSE CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Premium' WHEN 'BUILDING' THEN 'Regular' WHEN 'FURNITURE' THEN 'Standard'
              WHEN 'HOUSEHOLD' THEN 'Bronze' WHEN 'MACHINERY' THEN 'Gold' ELSE c_mktsegment END END AS segment,
    {pick(f'{_k} % 11', [f"'+1-' || {_a} || '-' || {_e} || '-' || {_l}", f"{_a} || '.' || {_e} || '.' || {_l}",
                         f"'(' || {_a} || ') ' || {_e} || '-' || {_l}", f"{_a} || {_e} || {_l}", "'123-456-7890'", 'NULL', "''",
                         "'N/A'", "'Unknown'", f"{_e} || '-' || {_l}", f"{_a} || '-' || {_e} || '-' || {_l}"])} AS phone,
    CAST(CASE WHEN {_k} % 53 = 0 THEN 150 + {_k} % 50 WHEN {_k} % 31 = 0 THEN NULL ELSE {_k} % 91 - 5 END AS BIGINT) AS age,
    {pick(f'{_k} % 12', ["'True'", "'False'", "'Yes'", "'No'", "'Y'", "'N'", "'1'", "'0'", "'Active'", "'Inactive'", "''", 'NULL'])} AS marketing_opt_in,
    CASE WHEN {_k} % 7 <> 0 THEN 'No. ' || CAST({_k} AS VARCHAR) || ' Main Street' END AS address,
    CASE WHEN {_k} % 9 <> 0 THEN strftime(DATE '1998-01-01' + CAST({_k} % 200 AS INTEGER), '%Y-%m-%d') END AS last_login
  FROM customer),
raw_customers AS (
  SELECT CASE WHEN _copy = 2 THEN NULL ELSE customer_id END AS customer_id,
    CASE WHEN _copy = 1 THEN upper(name) ELSE name END AS name, email, join_date,
    CASE WHEN _copy = 1 THEN 'Gold' ELSE segment END AS segment, phone, age, marketing_opt_in, address, last_login
  FROM (SELECT *, unnest(list_concat(list_concat([0], CASE WHEN customer_id % 97 = 1 THEN [1] ELSE []::INTEGER[] END),
                                     CASE WHEN customer_id % 197 = 3 THEN [2] ELSE []::INTEGER[] END)) AS _copy
        FROM raw_customers_base))"""

_r = "((l_orderkey + l_linenumber) % 89)"
_q_ = "CAST(l_quantity AS BIGINT)"
_ext_c = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_unit_c = f"CAST(floor({_ext_c} / {_q_}) AS BIGINT)"
_dp = "CAST(round(l_discount * 100) AS BIGINT)"
_tp = "CAST(round(l_tax * 100) AS BIGINT)"
_tax_c = div_half_up(f"{_ext_c} * (100 - {_dp}) * {_tp}", 10000)
_sub_c = f"({_q_} * {_unit_c})"
_correct_c = div_half_up(f"{_sub_c} * (100 - {_dp}) + {_tax_c} * 100", 100)
RAW_ITEMS = f"""
raw_items AS (
  SELECT l_orderkey * 8 + l_linenumber AS item_id, l_orderkey AS order_id, l_partkey AS product_id,
    CASE WHEN {_r} = 0 THEN NULL WHEN {_r} = 1 THEN 0 WHEN {_r} = 2 THEN -{_q_} ELSE {_q_} END AS quantity,
    CASE WHEN {_r} = 3 THEN NULL WHEN {_r} = 4 THEN -({_unit_c} / 100.0) ELSE {_unit_c} / 100.0 END AS price,
    CASE WHEN {_r} = 5 THEN NULL WHEN {_r} = 6 THEN -5.0 WHEN {_r} = 7 THEN 150.0 ELSE CAST({_dp} AS DOUBLE) END AS discount_percent,
    CASE WHEN {_r} = 8 THEN NULL ELSE {_tax_c} / 100.0 END AS tax_amount,
    CASE WHEN {_r} = 9 THEN NULL WHEN {_r} = 10 THEN ({_correct_c} + 100) / 100.0 ELSE {_correct_c} / 100.0 END AS line_total
  FROM lineitem)"""

_p = "p_partkey"
_rc = "CAST(round(p_retailprice * 100) AS BIGINT)"
_rp = f"({_rc} / 100.0)"


def _cost_at(pct) -> str:
    return f"({div_half_up(f'{_rc} * {pct}', 100)} / 100.0)"

_cd = f"(DATE '2015-01-01' + CAST({_p} % 3000 AS INTEGER))"
RAW_PRODUCTS = f"""
raw_products_base AS (
  SELECT {_p} AS product_id,
    {pick(f'{_p} % 19', ['NULL', "''", "'TBD'", "'  ' || p_name"] + ['p_name'] * 15)} AS product_name,
    {pick(f'{_p} % 23', ['NULL', "''", "'Unknown'", "'electronics'", "'kitchen things'", "'Home'", "'sports'", "'Books'", "'Gadget'", "'Music'"] + ['p_type'] * 13)} AS category,
    p_brand AS subcategory,
    CAST({pick(f'{_p} % 31', ['NULL', '0.0', f'-{_rp}', '250000.0'] + [_rp] * 27)} AS DOUBLE) AS unit_price,
    CAST({pick(f'{_p} % 37', ['NULL', _cost_at(125), '-1.0'] + [_cost_at(f'(40 + {_p} % 30)')] * 34)} AS DOUBLE) AS cost,
    {pick(f'{_p} % 10', ["'True'", "'False'", "'Yes'", "'No'", "'Active'", "'Inactive'", "'1'", "'0'", "''", 'NULL'])} AS is_active,
    {pick(f'{_p} % 4', [f"strftime({_cd}, '%Y-%m-%d')", f"strftime({_cd}, '%m/%d/%Y')", f"strftime({_cd}, '%d-%m-%Y')",
                        f"strftime({_cd}, '%Y-%m-%d %H:%M:%S')"])} AS created_date,
    CAST({pick(f'{_p} % 41', ['NULL', '-1.0', '5000.0'] + ['p_size * 0.5'] * 38)} AS DOUBLE) AS weight_kg,
    CASE WHEN {_p} % 43 <> 0 THEN {_p} % 100 + 1 END AS supplier_id
  FROM part),
raw_products AS (
  SELECT CASE WHEN _copy = 2 THEN NULL ELSE product_id END AS product_id,
    CASE WHEN _copy = 1 THEN upper(product_name) ELSE product_name END AS product_name,
    category, subcategory, unit_price, cost, is_active, created_date, weight_kg, supplier_id
  FROM (SELECT *, unnest(list_concat(list_concat([0], CASE WHEN product_id % 89 = 1 THEN [1] ELSE []::INTEGER[] END),
                                     CASE WHEN product_id % 211 = 2 THEN [2] ELSE []::INTEGER[] END)) AS _copy
        FROM raw_products_base))"""

# ----------------------------------------------------------------- cleaned model
ORDER_COLS = ["order_id", "customer_id", "order_date", "status", "total_amount", "source_system", "last_updated"]
CLEAN = f"""
orders_dedup AS ({dedup_first('raw_orders', 'order_id', ORDER_COLS)}),
orders_c1 AS (
  SELECT *, {parse_date('order_date')} AS order_date_cleaned, {clean_status('status')} AS status_cleaned,
    {in_range('total_amount', C.order_amount[0], C.order_amount[1])} AS total_amount_cleaned
  FROM orders_dedup),
orders_clean AS (
  SELECT *, CAST(year(order_date_cleaned) AS BIGINT) AS order_year, CAST(month(order_date_cleaned) AS BIGINT) AS order_month,
    CASE WHEN status_cleaned = 'completed' THEN 1 ELSE 0 END AS is_completed,
    CASE WHEN order_id IS NOT NULL AND customer_id IS NOT NULL AND order_date_cleaned IS NOT NULL
          AND total_amount_cleaned IS NOT NULL AND total_amount_cleaned > 0 THEN 1 ELSE 0 END AS is_valid_order
  FROM orders_c1),
as_of_t AS (
  SELECT max(d) AS as_of FROM (
    SELECT {parse_date('order_date')} AS d, {in_range('total_amount', C.order_amount[0], C.order_amount[1])} AS a,
      order_id, customer_id FROM raw_orders)
  WHERE order_id IS NOT NULL AND customer_id IS NOT NULL AND d IS NOT NULL AND a IS NOT NULL AND a > 0),
customers_c1 AS (
  SELECT *, {clean_name('name')} AS name_cleaned, {clean_email('email')} AS email_cleaned,
    {parse_date('join_date')} AS join_date_cleaned, {clean_segment('segment')} AS segment_cleaned,
    {parse_bool('marketing_opt_in')} AS marketing_opt_in_cleaned, {clean_phone('phone')} AS phone_cleaned
  FROM raw_customers),
customers_clean AS (
  SELECT *,
    CAST(round(CAST((CASE WHEN customer_id IS NULL THEN 0 ELSE 1 END + CASE WHEN {blank('name_cleaned')} THEN 0 ELSE 1 END
       + CASE WHEN {blank('email_cleaned')} THEN 0 ELSE 1 END + CASE WHEN join_date_cleaned IS NULL THEN 0 ELSE 1 END) * 100 AS DECIMAL(38,6)) / 4, 2) AS DOUBLE) AS data_quality_score,
    CAST(date_diff('day', join_date_cleaned, (SELECT as_of FROM as_of_t)) AS BIGINT) AS tenure_days,
    {in_range('age', C.age[0], C.age[1])} AS age_valid
  FROM customers_c1),
items_c1 AS (
  SELECT *, {in_range('quantity', *C.item_quantity)} AS quantity_cleaned, {in_range('price', *C.item_price)} AS price_cleaned,
    {in_range('discount_percent', *C.item_discount)} AS discount_percent_cleaned
  FROM raw_items),
items_c2 AS (
  SELECT *, CASE WHEN quantity_cleaned IS NOT NULL AND price_cleaned IS NOT NULL
      THEN quantity_cleaned * {cents('price_cleaned')} END AS _sub_c,
    CAST(round(discount_percent_cleaned * 100) AS BIGINT) AS _pct_h
  FROM items_c1),
items_c3 AS (
  SELECT *, CASE WHEN _sub_c IS NOT NULL AND _pct_h IS NOT NULL THEN _sub_c * _pct_h ELSE 0 END AS _disc_u FROM items_c2),
items_c4 AS (
  SELECT *, CASE WHEN _sub_c IS NOT NULL THEN _sub_c * 10000 - _disc_u + coalesce({cents('tax_amount')}, 0) * 10000 END AS _line_u
  FROM items_c3),
items_clean AS (
  SELECT * EXCLUDE (_sub_c, _pct_h, _disc_u, _line_u),
    CAST(_sub_c AS DOUBLE) / 100.0 AS subtotal_calculated,
    CAST(_disc_u AS DOUBLE) / 1000000.0 AS discount_amount_calculated,
    CAST(_line_u AS DOUBLE) / 1000000.0 AS line_total_calculated,
    CASE WHEN line_total IS NOT NULL AND _sub_c IS NOT NULL
      THEN abs({cents('line_total')} * 10000 - _line_u) < 10000 ELSE false END AS calculation_matches
  FROM items_c4),
products_c1 AS (
  SELECT *, {in_range('unit_price', *C.product_price)} AS unit_price_cleaned, {in_range('cost', *C.product_price)} AS cost_cleaned,
    {in_range('weight_kg', *C.product_weight)} AS weight_kg_cleaned, {parse_bool('is_active')} AS is_active_cleaned,
    {parse_date('created_date')} AS created_date_cleaned,
    CASE WHEN {blank('product_name')} OR {norm('product_name')} IN ({_q(V.PRODUCT_SENTINELS)}) THEN '{V.UNKNOWN_PRODUCT}' ELSE trim(product_name) END AS product_name_cleaned,
    {category('category')} AS category_cleaned
  FROM raw_products),
products_clean AS (
  SELECT *,
    CAST(CASE WHEN unit_price_cleaned IS NOT NULL AND cost_cleaned IS NOT NULL AND unit_price_cleaned > 0
      THEN round(CAST(CAST(({cents('unit_price_cleaned')} - {cents('cost_cleaned')}) * 100 AS DOUBLE) / {cents('unit_price_cleaned')} AS DECIMAL(38,6)), 2) END AS DOUBLE) AS margin_percent,
    CASE WHEN unit_price_cleaned IS NOT NULL AND cost_cleaned IS NOT NULL THEN cost_cleaned <= unit_price_cleaned END AS price_cost_valid
  FROM products_c1),
customer_dim AS ({dedup_first('customers_clean', 'customer_id', ['customer_id', 'name_cleaned', 'segment_cleaned', 'join_date_cleaned', 'data_quality_score'])}),
product_dim AS ({dedup_first('products_clean', 'product_id', ['product_id', 'product_name_cleaned', 'category_cleaned', 'is_active_cleaned'])}),
named_customers AS (SELECT * FROM customer_dim WHERE customer_id IS NOT NULL AND name_cleaned IS NOT NULL),
completed AS (
  SELECT order_id, customer_id, order_date_cleaned, order_year, order_month, total_amount_cleaned
  FROM orders_clean WHERE is_valid_order = 1 AND status_cleaned = 'completed'),
customer_months AS (
  SELECT customer_id, order_year, order_month, {money_sum('total_amount_cleaned')} AS revenue,
    count(*) AS orders, max(order_date_cleaned) AS last_order_date
  FROM completed GROUP BY ALL),
named_months AS (
  SELECT m.*, n.segment_cleaned AS customer_segment FROM customer_months m JOIN named_customers n USING (customer_id)),
rfm AS (
  SELECT customer_id, CAST(sum(revenue) AS DECIMAL(38,2)) AS monetary, sum(orders) AS frequency,
    max(last_order_date) AS last_order_date,
    CAST(date_diff('day', max(last_order_date), (SELECT as_of FROM as_of_t)) AS BIGINT) AS recency_days
  FROM named_months GROUP BY customer_id),
rfm_seg AS (
  SELECT *, CASE WHEN monetary >= {RULES.rfm.high_monetary} AND recency_days <= {RULES.rfm.high_recency_days} THEN 'high_value'
                 WHEN monetary >= {RULES.rfm.medium_monetary} AND recency_days <= {RULES.rfm.medium_recency_days} THEN 'medium_value'
                 ELSE 'low_value' END AS value_segment
  FROM rfm),
fact AS (
  SELECT o.order_id, o.customer_id, c.name_cleaned AS customer_name, c.segment_cleaned AS customer_segment,
    o.order_date_cleaned AS order_date, o.order_year, o.order_month, o.status_cleaned AS status,
    o.total_amount_cleaned AS total_amount, i.product_id, p.product_name_cleaned AS product_name,
    p.category_cleaned AS product_category, i.quantity_cleaned AS quantity, i.price_cleaned AS unit_price,
    i.line_total_calculated AS line_total, o.is_completed, c.data_quality_score AS customer_data_quality,
    i.calculation_matches AS line_calc_valid, p.is_active_cleaned AS product_active
  FROM (SELECT * FROM orders_clean WHERE is_valid_order = 1) o
  LEFT JOIN customer_dim c ON o.customer_id = c.customer_id
  LEFT JOIN (SELECT * FROM items_clean WHERE quantity_cleaned IS NOT NULL AND price_cleaned IS NOT NULL) i ON o.order_id = i.order_id
  LEFT JOIN product_dim p ON i.product_id = p.product_id
  WHERE c.name_cleaned IS NOT NULL)"""

ORDER_EVENTS = """
order_events AS (
  SELECT event_id, event_id AS order_id, user_id AS customer_id, CAST(ts AS TIMESTAMP) AS event_time,
    CAST(ts AS DATE) AS order_date,
    CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'cancelled' WHEN 'click' THEN 'pending'
      WHEN 'view' THEN 'shipped' WHEN 'signup' THEN 'refunded' END AS status,
    value AS total_amount, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
events_enriched AS (
  SELECT *, CASE WHEN status = 'completed' THEN 1 ELSE 0 END AS is_completed,
    CASE WHEN order_id IS NOT NULL AND customer_id IS NOT NULL AND order_date IS NOT NULL AND total_amount IS NOT NULL
      AND total_amount > 0 THEN 1 ELSE 0 END AS is_valid_order
  FROM order_events)"""

BASE_CTES = ",".join([RAW_ORDERS, RAW_CUSTOMERS, RAW_ITEMS, RAW_PRODUCTS, CLEAN, ORDER_EVENTS])


def with_base(final_sql: str, extra_ctes: str = "") -> str:
    extra = ("," + extra_ctes) if extra_ctes else ""
    return f"WITH {BASE_CTES}{extra}\n{final_sql}"
