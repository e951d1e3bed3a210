"""The 24 quality rules. Each table is aggregated once for its rules, and once more by key where keys must be unique.

The tables should be stored ones: a lazy table is computed for each of its aggregations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.sources.contracts import EVENT_TYPES, ORDER_STATUSES

from .changelog import duplicate_keys
from .orders import order_current
from .scd2 import not_one_current, overlapping_products

#: (number, name, lowest and highest passing value); no highest: at least the lowest.
RULES = (
    (1, "behaviour facts exist", 1, None), (2, "event_id is not empty", 0, 0), (3, "event_type is known", 0, 0), (4, "event_id is unique", 0, 0),
    (5, "product hit rate", 95, 100), (6, "shop hit rate", 95, 100), (7, "region hit rate", 95, 100), (8, "overview exists", 1, None),
    (9, "product rank exists", 1, None), (10, "category rank exists", 1, None), (11, "channel funnel exists", 1, None), (12, "uv <= pv", 0, 0),
    (13, "funnel is monotonic", 0, 0), (14, "order details exist", 1, None), (15, "detail_id is unique", 0, 0), (16, "order_status is known", 0, 0),
    (17, "paid orders have a successful payment", 0, 0), (18, "refunded orders have a successful refund", 0, 0), (19, "unit price is the catalogue price of its time", 0, 0),
    (20, "one current version a product", 0, 0), (21, "versions do not overlap", 0, 0), (22, "lifecycle exists", 1, None), (23, "daily metrics exist", 1, None),
    (24, "lifecycle is consistent", 0, 0),
)


def _long(df: DataFrame, values: dict[int, Column]) -> DataFrame:
    """One aggregation of ``df``, a row (rule, value) for each."""
    row = df.agg(*[v.cast("double").alias(f"r{n}") for n, v in values.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{n}").alias("value")) for n in values])).alias("x")).select("x.*")


def measure(facts, overview, products, categories, funnel, wide, versions, lifecycle, daily) -> DataFrame:
    """rule, value: what each rule looks at."""
    n, bad = F.count(F.lit(1)), F.count_if
    rate = lambda c: F.when(n == 0, 0.0).otherwise(100.0 * bad(F.coalesce(F.col(c), F.lit("")) != "") / n)
    col = F.col
    parts = [
        _long(facts, {
            1: n, 2: bad(col("event_id") == ""), 3: bad(~col("event_type").isin(*EVENT_TYPES)),
            5: rate("product_name"), 6: rate("shop_name"), 7: rate("province"),
        }),
        _long(duplicate_keys(facts, ["event_id"]), {4: n}),
        _long(overview, {8: n, 12: bad(col("uv") > col("pv"))}),
        _long(products, {9: n}), _long(categories, {10: n}),
        _long(funnel, {11: n, 13: bad((col("cart_users") > col("view_users")) | (col("order_users") > col("cart_users")) | (col("pay_users") > col("order_users")))}),
        _long(wide, {
            14: n, 16: bad(~col("order_status").isin(*ORDER_STATUSES)),
            17: bad(col("order_status").isin("PAID", "REFUNDED") & (col("payment_id").isNull() | (F.coalesce(col("payment_status"), F.lit("")) != "SUCCESS"))),
            18: bad((col("order_status") == "REFUNDED") & ((F.coalesce(col("refund_status"), F.lit("")) != "SUCCESS") | (F.coalesce(col("refund_amount"), F.lit(0)) <= 0))),
            19: bad(col("unit_price") != col("catalog_price")),
        }),
        _long(duplicate_keys(wide, ["detail_id"]), {15: n}),
        _long(not_one_current(versions), {20: n}), _long(overlapping_products(versions), {21: n}),
        _long(lifecycle, {22: n, 24: bad(
            (col("paid_orders") > col("total_orders")) | (col("cancelled_orders") > col("total_orders")) | (col("refunded_orders") > col("paid_orders"))
            | (col("refund_amount") > col("paid_amount")) | (col("refund_amount") < 0)
        )}),
        _long(daily, {23: n}),
    ]
    return reduce(DataFrame.unionByName, parts)


def judge(measured: DataFrame) -> DataFrame:
    """rule, name, value, passed. A rule without a value (its query failed) does not pass."""
    rules = measured.sparkSession.createDataFrame([(n, name, float(lo), None if hi is None else float(hi)) for n, name, lo, hi in RULES], "rule int, name string, lo double, hi double")
    ok = (F.col("value") >= F.col("lo")) & F.coalesce(F.col("value") <= F.col("hi"), F.lit(True))
    return rules.join(measured, "rule", "left").select("rule", "name", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n of each table."""
    return reduce(DataFrame.unionAll, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("table_name"), "n") for k, t in tables.items()])


def order_counts(wide: DataFrame) -> DataFrame:
    """table_name, n of the order lines and of their metrics by channel and by day, from one pass over the lines: they are counted in the groups by day, which are few."""
    days = order_current(wide, F.count(F.lit(1)).alias("lines")).groupBy("order_date", "channel").agg(F.sum("lines").alias("lines"))
    channels = F.count_distinct(F.struct("channel"))  # a null channel is a group, too
    found = days.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("dwd_order_detail"), channels.alias("ads_order_lifecycle"), F.count(F.lit(1)).alias("ads_order_daily"))
    return found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("table_name"), F.col(k).alias("n")) for k in found.columns])).alias("x")).select("x.*")
