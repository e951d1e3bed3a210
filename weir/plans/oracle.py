"""DuckDB SQL: the derived inputs as common table expressions, and the SQL of each query."""

from __future__ import annotations

_T = "'%Y-%m-%d %H:%M:%S'"


def _text(*columns: str) -> str:
    return ", ".join(f"strftime({c}, {_T}) AS {c}" for c in columns)


_TYPES = "('view', 'cart', 'order', 'pay')"
_BAD_TYPE = f"e.event_type NOT IN {_TYPES}"
_METRICS = """count(*) AS total_orders,
  CAST(count(*) FILTER (order_status IN ('PAID', 'REFUNDED')) AS BIGINT) AS paid_orders,
  CAST(count(*) FILTER (order_status = 'CANCELLED') AS BIGINT) AS cancelled_orders,
  CAST(count(*) FILTER (order_status = 'REFUNDED') AS BIGINT) AS refunded_orders,
  CAST(sum(order_amount) AS DECIMAL(22,2)) AS order_amount, CAST(sum(payment_amount) AS DECIMAL(22,2)) AS paid_amount,
  CAST(sum(refund_amount) AS DECIMAL(22,2)) AS refund_amount"""

#: name -> SELECT; later ones use earlier ones.
CTES = {
    "ods": f"""
SELECT CASE WHEN x.event_id % 211 <> 0 THEN 'E' || x.event_id END AS event_id,
  CASE WHEN x.event_id % 223 = 0 THEN ' ' ELSE 'S' || (x.event_id // 4) END AS session_id,
  CASE WHEN x.event_type IN ('signup', 'purchase') THEN 'O' || (x.event_id // 4) END AS order_id,
  CAST(x.event_id % 4 AS INTEGER) AS event_sequence, CAST(1 AS BIGINT) AS event_version,
  CASE WHEN x.event_id % 227 <> 0 THEN x.user_id END AS user_id,
  x.event_id % ((SELECT count(*) FROM part) + 50) AS product_id, x.event_id % ((SELECT count(*) FROM supplier) + 1) AS shop_id,
  CASE WHEN x.event_id % 97 <> 0 THEN CASE x.event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'cart' WHEN 'signup' THEN 'order'
    WHEN 'purchase' THEN 'pay' ELSE 'unknown' END END AS event_type,
  (['app', 'h5', 'wechat', 'search', 'ad'])[(x.event_id // 4) % 5 + 1] AS channel, CAST(x.value AS DECIMAL(10,2)) AS amount,
  CASE WHEN x.event_id % 229 = 0 THEN 'not-a-time' ELSE strftime(x.ts, {_T}) END AS event_time, x.event_id AS pos
FROM events AS x""",
    "ev": "SELECT *, TRY_CAST(event_time AS TIMESTAMP) AS event_ts FROM ods",
    "bad": f"""
SELECT e.*, concat_ws(';', CASE WHEN e.event_id IS NULL OR length(trim(e.event_id)) = 0 THEN 'EMPTY_EVENT_ID' END,
    CASE WHEN e.session_id IS NULL OR length(trim(e.session_id)) = 0 THEN 'EMPTY_SESSION_ID' END, CASE WHEN e.user_id IS NULL THEN 'EMPTY_USER_ID' END,
    CASE WHEN {_BAD_TYPE} THEN 'INVALID_EVENT_TYPE' END, CASE WHEN e.event_ts IS NULL THEN 'INVALID_EVENT_TIME' END) AS error_reason
FROM ev AS e WHERE e.event_id IS NULL OR length(trim(e.event_id)) = 0 OR e.session_id IS NULL OR length(trim(e.session_id)) = 0
  OR e.user_id IS NULL OR {_BAD_TYPE} OR e.event_ts IS NULL""",
    "dwd": f"""
SELECT e.*, p.p_name AS product_name, CAST(p.p_size AS BIGINT) AS category_id, p.p_type AS category_name, s.s_name AS shop_name, r.r_name AS province, n.n_name AS city
FROM ev AS e LEFT JOIN part AS p ON e.product_id = p.p_partkey LEFT JOIN supplier AS s ON e.shop_id = s.s_suppkey
LEFT JOIN nation AS n ON s.s_nationkey = n.n_nationkey LEFT JOIN region AS r ON n.n_regionkey = r.r_regionkey
WHERE length(trim(e.event_id)) > 0 AND length(trim(e.session_id)) > 0 AND e.user_id IS NOT NULL AND e.event_type IN {_TYPES} AND e.event_ts IS NOT NULL""",
    "overview": """
SELECT time_bucket(INTERVAL '1 minute', event_ts) AS window_start, time_bucket(INTERVAL '1 minute', event_ts) + INTERVAL '1 minute' AS window_end,
  count(*) FILTER (event_type = 'view') AS pv, count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS uv,
  count(DISTINCT CASE WHEN event_type = 'cart' THEN user_id END) AS cart_users, count(DISTINCT CASE WHEN event_type = 'order' THEN user_id END) AS order_users,
  count(DISTINCT CASE WHEN event_type = 'pay' THEN user_id END) AS pay_users,
  CAST(sum(CASE WHEN event_type = 'pay' THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS pay_amount
FROM dwd GROUP BY 1, 2""",
    "products": """
SELECT time_bucket(INTERVAL '5 minutes', event_ts) AS window_start, time_bucket(INTERVAL '5 minutes', event_ts) + INTERVAL '5 minutes' AS window_end,
  product_id, product_name, category_name, count(*) AS pay_count, CAST(sum(amount) AS DECIMAL(18,2)) AS pay_amount
FROM dwd WHERE event_type = 'pay' GROUP BY 1, 2, 3, 4, 5""",
    "categories": """
SELECT time_bucket(INTERVAL '5 minutes', event_ts) AS window_start, time_bucket(INTERVAL '5 minutes', event_ts) + INTERVAL '5 minutes' AS window_end,
  coalesce(category_name, 'UNKNOWN') AS category_name, count(*) AS pay_count, count(DISTINCT user_id) AS pay_users, CAST(sum(amount) AS DECIMAL(18,2)) AS pay_amount
FROM dwd WHERE event_type = 'pay' GROUP BY 1, 2, 3""",
    "stages": """
SELECT time_bucket(INTERVAL '30 minutes', event_ts) AS window_start, time_bucket(INTERVAL '30 minutes', event_ts) + INTERVAL '30 minutes' AS window_end, channel, session_id,
  min(event_ts) FILTER (event_type = 'view') AS view_ts, min(event_ts) FILTER (event_type = 'cart') AS cart_ts,
  min(event_ts) FILTER (event_type = 'order') AS order_ts, min(event_ts) FILTER (event_type = 'pay') AS pay_ts
FROM dwd GROUP BY 1, 2, 3, 4""",
    "funnel": """
SELECT window_start, window_end, channel, count(view_ts) AS view_users, count(*) FILTER (cart_ts >= view_ts) AS cart_users,
  count(*) FILTER (cart_ts >= view_ts AND order_ts >= cart_ts) AS order_users,
  count(*) FILTER (cart_ts >= view_ts AND order_ts >= cart_ts AND pay_ts >= order_ts) AS pay_users
FROM stages GROUP BY 1, 2, 3""",
    "o_final": """
SELECT 'O' || o_orderkey AS order_id, CAST(o_custkey AS BIGINT) AS user_id, CAST(o_orderkey % 100 AS BIGINT) AS shop_id,
  CASE o_orderstatus WHEN 'O' THEN 'CREATED' WHEN 'P' THEN 'CANCELLED' ELSE CASE WHEN o_orderkey % 8 = 0 THEN 'REFUNDED' ELSE 'PAID' END END AS order_status,
  o_orderpriority AS channel, CAST(o_totalprice AS DECIMAL(12,2)) AS order_amount,
  CASE o_orderkey % 4 WHEN 0 THEN 'NEW10' WHEN 1 THEN 'VIP20' WHEN 2 THEN 'SUMMER' END AS promotion_code,
  CAST(o_orderdate AS TIMESTAMP) AS create_time, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1 hour' AS update_time,
  CAST(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS BIGINT) AS version_no, o_orderkey AS order_key
FROM orders""",
    "o_log": """
SELECT order_id, op, order_key % 3 AS partition, order_key * 4 + n AS log_offset, n, CASE WHEN n = 0 THEN 'CREATED' ELSE order_status END AS status,
  CASE WHEN n = 0 THEN create_time ELSE update_time END AS updated, CASE WHEN n = 0 THEN 1 ELSE version_no END AS version
FROM o_final, (VALUES (0, 'c'), (1, 'u'), (2, 'd'), (3, 'c')) AS s(n, op)
WHERE n = 0 OR (n = 1 AND order_status <> 'CREATED') OR (n = 2 AND order_key % 50 = 0) OR (n = 3 AND order_key % 100 = 0)""",
    "o_last": "SELECT *, CAST(128 AS HUGEINT) * 72057594037927936 + CAST(log_offset AS HUGEINT) * 4096 + partition AS v FROM o_log QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY v DESC) = 1",
    "o_now": """
SELECT o.order_id, o.user_id, o.shop_id, l.status AS order_status, o.channel, o.order_amount, o.promotion_code, o.create_time, l.updated AS update_time, CAST(l.version AS BIGINT) AS version_no, o.order_key
FROM o_last AS l JOIN o_final AS o USING (order_id) WHERE l.op <> 'd'""",
    "d_now": """
SELECT l_orderkey || '-D' || l_linenumber AS detail_id, 'O' || l_orderkey AS order_id, CAST(l_partkey AS BIGINT) AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
  CAST(p.p_retailprice AS DECIMAL(10,2)) AS unit_price, CAST(l_extendedprice AS DECIMAL(12,2)) AS detail_amount, CAST(o.o_orderdate AS TIMESTAMP) AS create_time
FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC,
  l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC, l_shipdate DESC) = 1) AS l
JOIN orders AS o ON l.l_orderkey = o.o_orderkey LEFT JOIN part AS p ON l.l_partkey = p.p_partkey""",
    "pay": """
SELECT 'P' || order_key AS payment_id, order_id, CASE WHEN order_status IN ('PAID', 'REFUNDED') THEN 'SUCCESS' ELSE 'FAILED' END AS payment_status,
  CASE order_key % 3 WHEN 0 THEN 'alipay' WHEN 1 THEN 'wechat_pay' ELSE 'bank_card' END AS payment_method, order_amount AS payment_amount,
  CASE WHEN order_status IN ('PAID', 'REFUNDED') THEN create_time + INTERVAL '30 minutes' END AS payment_time
FROM o_final WHERE order_status IN ('PAID', 'REFUNDED') OR (order_status = 'CREATED' AND order_key % 5 = 0)""",
    "refund": """
SELECT 'R' || order_key AS refund_id, order_id, 'SUCCESS' AS refund_status,
  CAST(order_amount * CAST(CASE order_key % 3 WHEN 0 THEN '0.25' WHEN 1 THEN '0.50' ELSE '1.00' END AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS refund_amount,
  CASE WHEN order_key % 2 = 0 THEN 'damaged' END AS refund_reason, create_time + INTERVAL '2 hours' AS refund_time
FROM o_final WHERE order_status = 'REFUNDED'""",
    "scd2": """
SELECT CAST(p_partkey AS BIGINT) AS product_id, CAST(v AS INTEGER) AS version_no, p_name AS product_name, CAST(p_size AS BIGINT) AS category_id, p_type AS category_name,
  CASE WHEN v = 1 THEN CAST(p_retailprice AS DECIMAL(10,2)) ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 1.08 AS DECIMAL(10,2)) END AS price,
  CASE WHEN v = 1 THEN TIMESTAMP '1900-01-01 00:00:00' ELSE TIMESTAMP '1998-01-01 00:00:00' END AS effective_from,
  CASE WHEN v = 1 AND p_partkey % 3 = 0 THEN TIMESTAMP '1998-01-01 00:00:00' ELSE TIMESTAMP '9999-12-31 23:59:59.999' END AS effective_to,
  CAST(CASE WHEN v = 2 OR p_partkey % 3 <> 0 THEN 1 ELSE 0 END AS TINYINT) AS is_current
FROM part, (VALUES (1), (2)) AS t(v) WHERE v = 1 OR p_partkey % 3 = 0""",
    "wide": """
SELECT d.detail_id, d.order_id, o.user_id, o.shop_id, d.product_id, s.product_name, s.category_id, s.category_name, s.version_no AS product_version, s.price AS catalog_price,
  d.quantity, d.unit_price, d.detail_amount, o.order_status, o.order_amount, o.channel, o.promotion_code, p.payment_id, p.payment_status, p.payment_method, p.payment_amount,
  p.payment_time, r.refund_id, r.refund_status, r.refund_amount, r.refund_reason, r.refund_time, o.create_time AS order_create_time, o.update_time AS order_update_time,
  d.create_time AS detail_update_time, o.version_no AS order_version, CAST(1 AS BIGINT) AS detail_version,
  CASE WHEN p.payment_id IS NOT NULL THEN CAST(1 AS BIGINT) END AS payment_version, CASE WHEN r.refund_id IS NOT NULL THEN CAST(1 AS BIGINT) END AS refund_version
FROM d_now AS d JOIN o_now AS o USING (order_id)
JOIN scd2 AS s ON d.product_id = s.product_id AND d.create_time >= s.effective_from AND d.create_time < s.effective_to
LEFT JOIN pay AS p ON d.order_id = p.order_id LEFT JOIN refund AS r ON d.order_id = r.order_id""",
    "cur": """
SELECT order_id, max(channel) AS channel, max(order_status) AS order_status, max(order_amount) AS order_amount, max(coalesce(payment_amount, 0)) AS payment_amount,
  max(coalesce(refund_amount, 0)) AS refund_amount, max(strftime(order_create_time, '%Y-%m-%d')) AS order_date
FROM wide GROUP BY order_id""",
    "life": f"SELECT channel, {_METRICS} FROM cur GROUP BY channel",
    "day": f"SELECT order_date, channel, {_METRICS} FROM cur GROUP BY order_date, channel",
    "off_cur": """
SELECT CAST(o.create_time AS DATE) AS order_date, o.channel, o.order_status, o.order_amount,
  coalesce(CASE WHEN p.payment_status = 'SUCCESS' THEN p.payment_amount END, 0) AS payment_amount, coalesce(r.refund_amount, 0) AS refund_amount
FROM o_now AS o LEFT JOIN pay AS p USING (order_id) LEFT JOIN refund AS r USING (order_id)""",
    "off_day": f"SELECT order_date, channel, {_METRICS} FROM off_cur GROUP BY order_date, channel",
    "off_range": f"SELECT order_date, channel, {_METRICS} FROM off_cur WHERE order_date >= DATE '1997-01-01' AND order_date < DATE '1998-01-01' GROUP BY order_date, channel",
}
WITH = "WITH " + ",\n".join(f"{k} AS ({v.strip()})" for k, v in CTES.items()) + "\n"

_DWD = "event_id, session_id, order_id, event_sequence, event_version, user_id, product_id, product_name, category_id, category_name, shop_id, shop_name, event_type, channel, amount, province, city"
_WIDE_TIMES = ("payment_time", "refund_time", "order_create_time", "order_update_time", "detail_update_time")
_W = _text("window_start", "window_end")
_RECON = ", ".join(f"coalesce(a.{c}, 0) AS offline_{c}, coalesce(b.{c}, 0) AS realtime_{c}" for c in ("total_orders", "paid_orders", "cancelled_orders", "refunded_orders", "order_amount", "paid_amount", "refund_amount"))
_MATCH = " AND ".join(f"coalesce(a.{c}, 0) = coalesce(b.{c}, 0)" for c in ("total_orders", "paid_orders", "cancelled_orders", "refunded_orders", "order_amount", "paid_amount", "refund_amount"))
_HIT = "100.0 * count(*) FILTER (coalesce({c}, '') <> '') / count(*)"
_LIFE_BAD = "paid_orders > total_orders OR cancelled_orders > total_orders OR refunded_orders > paid_orders OR refund_amount > paid_amount OR refund_amount < 0"
_RULES = [
    ("behaviour facts exist", 1, None, "SELECT count(*) FROM dwd"), ("event_id is not empty", 0, 0, "SELECT count(*) FROM dwd WHERE event_id = ''"),
    ("event_type is known", 0, 0, f"SELECT count(*) FROM dwd WHERE event_type NOT IN {_TYPES}"),
    ("event_id is unique", 0, 0, "SELECT count(*) FROM (SELECT event_id FROM dwd GROUP BY event_id HAVING count(*) > 1)"),
    ("product hit rate", 95, 100, f"SELECT {_HIT.format(c='product_name')} FROM dwd"), ("shop hit rate", 95, 100, f"SELECT {_HIT.format(c='shop_name')} FROM dwd"),
    ("region hit rate", 95, 100, f"SELECT {_HIT.format(c='province')} FROM dwd"), ("overview exists", 1, None, "SELECT count(*) FROM overview"),
    ("product rank exists", 1, None, "SELECT count(*) FROM products"), ("category rank exists", 1, None, "SELECT count(*) FROM categories"),
    ("channel funnel exists", 1, None, "SELECT count(*) FROM funnel"), ("uv <= pv", 0, 0, "SELECT count(*) FROM overview WHERE uv > pv"),
    ("funnel is monotonic", 0, 0, "SELECT count(*) FROM funnel WHERE cart_users > view_users OR order_users > cart_users OR pay_users > order_users"),
    ("order details exist", 1, None, "SELECT count(*) FROM wide"), ("detail_id is unique", 0, 0, "SELECT count(*) FROM (SELECT detail_id FROM wide GROUP BY detail_id HAVING count(*) > 1)"),
    ("order_status is known", 0, 0, "SELECT count(*) FROM wide WHERE order_status NOT IN ('CREATED', 'PAID', 'CANCELLED', 'REFUNDED')"),
    ("paid orders have a successful payment", 0, 0, "SELECT count(*) FROM wide WHERE order_status IN ('PAID', 'REFUNDED') AND coalesce(payment_status, '') <> 'SUCCESS'"),
    ("refunded orders have a successful refund", 0, 0, "SELECT count(*) FROM wide WHERE order_status = 'REFUNDED' AND (coalesce(refund_status, '') <> 'SUCCESS' OR coalesce(refund_amount, 0) <= 0)"),
    ("unit price is the catalogue price of its time", 0, 0, "SELECT count(*) FROM wide WHERE unit_price <> catalog_price"),
    ("one current version a product", 0, 0, "SELECT count(*) FROM (SELECT product_id FROM scd2 GROUP BY product_id HAVING count(*) FILTER (is_current = 1) <> 1)"),
    ("versions do not overlap", 0, 0, "SELECT count(*) FROM scd2 AS a JOIN scd2 AS b ON a.product_id = b.product_id AND a.version_no < b.version_no AND a.effective_from < b.effective_to AND b.effective_from < a.effective_to"),
    ("lifecycle exists", 1, None, "SELECT count(*) FROM life"), ("daily metrics exist", 1, None, "SELECT count(*) FROM day"),
    ("lifecycle is consistent", 0, 0, f"SELECT count(*) FROM life WHERE {_LIFE_BAD}"),
]
_QUALITY = " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS rule, '{n}' AS name, CAST(({q}) AS DOUBLE) AS value, coalesce(({q}) >= {lo}{'' if hi is None else f' AND ({q}) <= {hi}'}, false) AS passed"
    for i, (n, lo, hi, q) in enumerate(_RULES, 1)
)
_LAST6 = "(SELECT *, row_number() OVER (ORDER BY window_start DESC) AS rn FROM overview QUALIFY rn <= 6)"
_ONE = f"(SELECT max(CASE WHEN rn = 1 THEN window_start END) AS window_start, max(CASE WHEN rn = 1 THEN window_end END) AS window_end, CAST(max(CASE WHEN rn = 1 THEN pay_amount END) AS DOUBLE) AS amount, max(CASE WHEN rn = 1 THEN pay_users END) AS users, max(CASE WHEN rn = 1 THEN uv END) AS uv, count(*) AS n, avg(CASE WHEN rn > 1 THEN CAST(pay_amount AS DOUBLE) END) AS mean FROM {_LAST6})"
_ALERT = lambda kind, level, metric, value, when: f"SELECT {_W}, '{kind}' AS alert_type, '{level}' AS alert_level, '{metric}' AS metric_name, CAST({value} AS DOUBLE) AS metric_value FROM {_ONE} WHERE {when}"

_RECON_SQL = f"SELECT strftime(coalesce(a.order_date, CAST(b.order_date AS DATE)), '%Y-%m-%d') AS order_date, coalesce(a.channel, b.channel) AS channel, {_RECON}, {_MATCH} AS is_match FROM {{a}} AS a FULL JOIN {{b}} AS b ON a.order_date = CAST(b.order_date AS DATE) AND a.channel = b.channel"
_FRAME = lambda x: f"CASE WHEN {x} IS NULL THEN unhex('FF') ELSE unhex(printf('%016x', strlen({x}))) || encode({x}) END"
_PAYLOAD = """'{' || concat_ws(',', '"event_id":"' || event_id || '"', '"session_id":"' || session_id || '"', '"user_id":' || user_id, '"event_type":"' || event_type || '"', '"event_time":"' || event_time || '"') || '}'"""
_ENVELOPES = (
    f"SELECT 1 AS schema_version, sha256({' || '.join(_FRAME(x) for x in ('topic', 'part', 'off', 'event_id', 'payload'))}) AS message_id, 'pending' AS status, topic AS source_topic, 0 AS source_partition, "
    "pos AS source_offset, 'DirtyEvent' AS error_type, error_reason AS error_message, '2024-02-01 00:00:00' AS failed_at, CAST(strlen(event_id) AS INTEGER) AS key_bytes, sha256(event_id) AS key_sha256, "
    "CAST(strlen(payload) AS INTEGER) AS value_bytes, sha256(payload) AS value_sha256 "
    f"FROM (SELECT *, 'ods_user_behavior' AS topic, '0' AS part, CAST(pos AS VARCHAR) AS off, {_PAYLOAD} AS payload FROM bad)"
)

_ALERTS = " UNION ALL ".join([
    _ALERT("pay_amount_zero", "WARNING", "pay_amount", "0", "amount = 0"), _ALERT("pay_users_zero", "WARNING", "pay_users", "0", "users = 0"),
    _ALERT("pay_amount_drop", "CRITICAL", "pay_amount", "amount", "n >= 5 AND mean > 0 AND amount < mean * 0.5"),
    _ALERT("low_conversion", "WARNING", "conversion_rate", "CAST(users AS DOUBLE) / uv", "uv > 100 AND CAST(users AS DOUBLE) / uv < 0.01"),
])

SQL = {
    "behavior_dirty": f"SELECT event_id, session_id, order_id, event_sequence, event_version, user_id, product_id, shop_id, event_type, channel, amount, event_time, error_reason FROM bad",
    "behavior_dirty_reasons": "SELECT error_reason, count(*) AS n FROM bad GROUP BY error_reason",
    "behavior_null_type": f"SELECT count(*) AS n FROM ev AS e WHERE length(trim(event_id)) > 0 AND length(trim(session_id)) > 0 AND user_id IS NOT NULL AND event_type IS NULL AND event_ts IS NOT NULL",
    "dwd_user_behavior": f"SELECT {_DWD}, {_text('event_ts')} FROM dwd",
    "ads_realtime_overview": f"SELECT * REPLACE ({_W}) FROM overview",
    "ads_product_rank": f"SELECT * REPLACE ({_W}) FROM products",
    "ads_category_rank": f"SELECT * REPLACE ({_W}) FROM categories",
    "dws_session_stage": f"SELECT * REPLACE ({_W}, {_text('view_ts', 'cart_ts', 'order_ts', 'pay_ts')}) FROM stages",
    "ads_channel_funnel": f"SELECT * REPLACE ({_W}) FROM funnel",
    "channel_event_mix": "SELECT channel, count(*) FILTER (event_type = 'view') AS view_cnt, count(*) FILTER (event_type = 'cart') AS cart_cnt, count(*) FILTER (event_type = 'order') AS order_cnt, count(*) FILTER (event_type = 'pay') AS pay_cnt, CAST(coalesce(sum(amount) FILTER (event_type = 'pay'), 0) AS DECIMAL(18,2)) AS pay_amount FROM dwd GROUP BY channel",
    "dimension_hit_rates": f"SELECT {_HIT.format(c='product_name')} AS product_hit, {_HIT.format(c='shop_name')} AS shop_hit, {_HIT.format(c='province')} AS region_hit FROM dwd",
    "duplicate_lineitem_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "order_log_versions": "SELECT order_id, op, CAST(CAST(128 AS HUGEINT) * 72057594037927936 + CAST(log_offset AS HUGEINT) * 4096 + partition AS DECIMAL(20,0)) AS ingest_version FROM o_log",
    "order_info_current": f"SELECT order_id, user_id, shop_id, order_status, channel, order_amount, promotion_code, {_text('create_time', 'update_time')}, version_no FROM o_now",
    "order_tombstones": "SELECT order_id, CAST(v AS DECIMAL(20,0)) AS ingest_version, CAST(1 AS TINYINT) AS is_deleted FROM o_last WHERE op = 'd'",
    "order_log_compacted": "SELECT order_id, op, log_offset AS \"offset\" FROM o_last",
    "dwd_order_detail": f"SELECT * REPLACE ({_text(*_WIDE_TIMES)}) FROM wide",
    "dws_order_current": "SELECT order_id, channel, order_status, order_amount, CAST(payment_amount AS DECIMAL(12,2)) AS payment_amount, CAST(refund_amount AS DECIMAL(12,2)) AS refund_amount, order_date FROM cur",
    "ads_order_lifecycle": "SELECT * FROM life",
    "ads_order_daily": "SELECT * FROM day",
    "backfill_order_daily": "SELECT * REPLACE (strftime(order_date, '%Y-%m-%d') AS order_date) FROM off_day",
    "backfill_order_range": "SELECT * REPLACE (strftime(order_date, '%Y-%m-%d') AS order_date) FROM off_range",
    "reconciliation": _RECON_SQL.format(a="off_day", b="day"),
    "scd2_versions": f"SELECT product_id, version_no, product_name, category_id, category_name, price, is_current, {_text('effective_from', 'effective_to')} FROM scd2",
    "scd2_overlaps": "SELECT a.product_id, a.version_no AS version_a, b.version_no AS version_b FROM scd2 AS a JOIN scd2 AS b ON a.product_id = b.product_id AND a.version_no < b.version_no AND a.effective_from < b.effective_to AND b.effective_from < a.effective_to",
    "scd2_not_one_current": "SELECT product_id, count(*) FILTER (is_current = 1) AS n_current FROM scd2 GROUP BY product_id HAVING count(*) FILTER (is_current = 1) <> 1",
    "versions_per_product": "SELECT product_id, count(*) AS versions FROM scd2 GROUP BY product_id HAVING count(*) > 1",
    "latest_overview": f"SELECT * REPLACE ({_W}) FROM overview ORDER BY window_start DESC LIMIT 20",
    "overview_trend": f"SELECT * REPLACE ({_W}) FROM overview ORDER BY window_start DESC LIMIT 30",
    "latest_products": f"SELECT * REPLACE ({_W}) FROM products ORDER BY products.window_start DESC, pay_amount DESC, product_id LIMIT 20",
    "top_products_latest_window": f"SELECT * REPLACE ({_W}) FROM products WHERE window_start = (SELECT max(window_start) FROM products) ORDER BY pay_amount DESC, product_id LIMIT 10",
    "latest_categories": f"SELECT * REPLACE ({_W}) FROM categories WHERE window_start = (SELECT max(window_start) FROM categories)",
    "latest_funnel": f"SELECT * REPLACE ({_W}) FROM funnel WHERE window_start = (SELECT max(window_start) FROM funnel)",
    "top_products_per_window": f"SELECT * REPLACE ({_W}) FROM (SELECT *, CAST(row_number() OVER (PARTITION BY window_start ORDER BY pay_amount DESC, product_id) AS INTEGER) AS rn FROM products) WHERE rn <= 10",
    "recent_facts": "SELECT event_id, " + _text("event_ts") + " FROM dwd ORDER BY dwd.event_ts DESC, event_id LIMIT 1000",
    "bi_order_daily": "SELECT *, CAST(paid_amount - refund_amount AS DECIMAL(23,2)) AS net_paid_amount FROM day",
    "bi_order_lifecycle": "SELECT *, CAST(paid_amount - refund_amount AS DECIMAL(23,2)) AS net_paid_amount FROM life",
    "bi_measures": "SELECT channel, CAST(sum(paid_orders) AS DOUBLE) / sum(total_orders) AS pay_rate, CASE WHEN sum(paid_orders) > 0 THEN CAST(sum(refunded_orders) AS DOUBLE) / sum(paid_orders) END AS refund_rate, CASE WHEN sum(paid_orders) > 0 THEN CAST(sum(paid_amount) AS DOUBLE) / sum(paid_orders) END AS paid_ticket FROM day GROUP BY channel",
    "bi_version_measures": "SELECT count(*) AS products, CAST(sum(n) AS BIGINT) AS versions, CAST(sum(c) AS BIGINT) AS current_versions, count(*) FILTER (n >= 2) AS repriced_products FROM (SELECT product_id, count(*) AS n, count(*) FILTER (is_current = 1) AS c FROM scd2 GROUP BY product_id)",
    "overview_moving_mean": f"SELECT {_text('window_start')}, pay_amount, avg(CAST(pay_amount AS DOUBLE)) OVER (ORDER BY window_start ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mean_before FROM overview",
    "alerts": _ALERTS,
    "alert_store": _ALERTS,
    "freshness": "SELECT *, true AS available, greatest(0.0, 2000000000 - last_epoch) AS age_seconds FROM (SELECT 'behavior_dwd' AS pipeline, CAST(epoch(max(event_ts)) AS DOUBLE) AS last_epoch FROM dwd UNION ALL SELECT 'order_dwd', CAST(epoch(max(greatest(order_create_time, order_update_time, detail_update_time, coalesce(payment_time, order_create_time), coalesce(refund_time, order_create_time)))) AS DOUBLE) FROM wide UNION ALL SELECT 'behavior_ads', CAST(epoch(max(window_end)) AS DOUBLE) FROM overview)",
    "quality_rules": _QUALITY,
    "table_counts": " UNION ALL ".join(f"SELECT '{k}' AS table_name, count(*) AS n FROM {v}" for k, v in (("dwd_user_behavior", "dwd"), ("dwd_dirty_behavior", "bad"), ("ads_realtime_overview", "overview"), ("ads_product_rank", "products"), ("ads_category_rank", "categories"), ("ads_channel_funnel", "funnel"), ("dwd_order_detail", "wide"), ("ads_order_lifecycle", "life"), ("ads_order_daily", "day"))),
    "schema_evolution_backfill": "SELECT order_id, user_id, CASE WHEN create_time < TIMESTAMP '1998-01-01' THEN CASE WHEN user_id % 2 = 0 THEN 'EXPRESS' ELSE 'STANDARD' END WHEN user_id % 3 = 0 THEN 'PICKUP' WHEN user_id % 3 = 1 THEN 'STANDARD' END AS delivery_type FROM o_now",
    "payments_in_range": "SELECT p.payment_id, p.order_id, p.payment_status, p.payment_amount FROM pay AS p JOIN o_now AS o USING (order_id) WHERE o.create_time >= TIMESTAMP '1997-01-01' AND o.create_time < TIMESTAMP '1998-01-01'",
    "loader_rejects": "SELECT error_message, count(*) AS n FROM (SELECT CASE WHEN event_id % 10 = 1 THEN 'unknown fields: extra' WHEN event_id % 10 = 2 THEN 'missing fields: amount' WHEN event_id % 10 = 3 THEN 'amount: not decimal(10,2)' WHEN event_id % 10 = 4 THEN 'event_sequence: not int32; user_id: not int64' WHEN event_id % 10 = 5 THEN 'value is no JSON object' END AS error_message FROM events) WHERE error_message IS NOT NULL GROUP BY 1",
    "stream_overview": f"SELECT * REPLACE ({_W}) FROM overview WHERE overview.window_end <= (SELECT max(event_ts) - INTERVAL '5 seconds' FROM ev)",
    "stream_funnel": f"SELECT * REPLACE ({_W}) FROM funnel WHERE funnel.window_end <= (SELECT max(event_ts) - INTERVAL '5 seconds' FROM ev)",
    "stream_order_daily": "SELECT * FROM day",
    "stream_order_state": "SELECT * FROM day",
    "backfill_job": _RECON_SQL.format(a="off_range", b="(SELECT * FROM day WHERE CAST(order_date AS DATE) >= DATE '1997-01-01' AND CAST(order_date AS DATE) < DATE '1998-01-01')"),
    "stream_keyed_sink": "SELECT order_id, order_status FROM o_now",
    "stream_loader": " UNION ALL ".join(
        f"SELECT '{t}' AS topic, '{kind}' AS kind, count(*) FILTER ({'' if kind == 'letters' else 'NOT '}{spoilt}) AS n FROM {v}"
        for t, v, spoilt in (("ads_order_daily", "day", "channel = '1-URGENT'"), ("ads_order_lifecycle", "life", "total_orders < 0"), ("dwd_order_detail", "wide", "quantity % 5 = 0"))
        for kind in ("rows", "letters")
    ),
    "stream_serving_table": "SELECT order_id, order_status FROM o_now",
    "stream_serving": "SELECT order_id, order_status FROM o_now",
    "dlq_envelopes": _ENVELOPES,
    "captured_tables": " UNION ALL ".join(
        f"SELECT '{k}' AS entity, count(*) + count(*) FILTER ({c} LIKE '%7') AS entries, count(*) FILTER ({c} LIKE '%7') AS deletes, count(*) FILTER (NOT {c} LIKE '%7') AS kept FROM {t}"
        for k, t, c in (("order_info", "o_final", "order_id"), ("order_detail", "d_now", "detail_id"), ("payment_info", "pay", "payment_id"), ("refund_info", "refund", "refund_id"), ("dim_product_scd2", "scd2", "CAST(product_id AS VARCHAR)"))
    ),
}
ORACLE_SQL = {k: WITH + v for k, v in SQL.items()}
