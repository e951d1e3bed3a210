"""Orders: wide order-detail facts, order-grain fold, lifecycle and daily aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scd2 import version_at

MONEY = "decimal(22,2)"


def order_detail_wide(details: DataFrame, orders: DataFrame, versions: DataFrame, payments: DataFrame, refunds: DataFrame, spread: bool = True, hot: DataFrame | None = None) -> DataFrame:
    """One row per order line: header and product version must exist, payment and refund may.

    The version is the one that held when the line was created. Payments and refunds are at most one
    per order, so the left joins don't multiply lines (``check_single`` tells).
    """
    o = orders.select(
        "order_id", "user_id", "shop_id", "order_status", "order_amount", "channel", "promotion_code",
        F.col("create_time").alias("order_create_time"), F.col("update_time").alias("order_update_time"), F.col("version_no").alias("order_version"),
    )
    p = payments.select("order_id", "payment_id", "payment_status", "payment_method", "payment_amount", "payment_time", F.col("version_no").alias("payment_version"))
    r = refunds.select("order_id", "refund_id", "refund_status", "refund_amount", "refund_reason", "refund_time", F.col("version_no").alias("refund_version"))
    d = version_at(details, versions, spread=spread, hot=hot).withColumnsRenamed({"update_time": "detail_update_time", "version_no": "detail_version"})
    wide = d.join(o, "order_id").join(p, "order_id", "left").join(r, "order_id", "left")
    return wide.select(
        "detail_id", "order_id", "user_id", "shop_id", "product_id", "product_name", "category_id", "category_name", "product_version", "catalog_price",
        "quantity", "unit_price", "detail_amount", "order_status", "order_amount", "channel", "promotion_code", "payment_id", "payment_status",
        "payment_method", "payment_amount", "payment_time", "refund_id", "refund_status", "refund_amount", "refund_reason", "refund_time",
        "order_create_time", "order_update_time", "detail_update_time", "order_version", "detail_version", "payment_version", "refund_version",
    )


def check_single(rows: DataFrame) -> DataFrame:
    """Orders with more than one row where one at most is allowed."""
    return rows.groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def order_current(wide: DataFrame, *more: Column) -> DataFrame:
    """Lines folded to orders before any sum, so that amounts count once an order; ``more`` aggregates of an order's lines may follow."""
    amount = lambda c: F.max(F.coalesce(c, F.lit(0).cast("decimal(12,2)"))).alias(c)
    return wide.groupBy("order_id").agg(
        F.max("channel").alias("channel"), F.max("order_status").alias("order_status"), F.max("order_amount").alias("order_amount"),
        amount("payment_amount"), amount("refund_amount"), F.max(F.date_format("order_create_time", "yyyy-MM-dd")).alias("order_date"), *more,
    )


def metrics(orders: DataFrame, *by: str) -> DataFrame:
    """Counts by status (refunded orders count as paid) and sums of amounts, per ``by``."""
    s = F.col("order_status")
    total = lambda c, name: F.sum(c).cast(MONEY).alias(name)
    return orders.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_orders"), F.count_if(s.isin("PAID", "REFUNDED")).alias("paid_orders"), F.count_if(s == "CANCELLED").alias("cancelled_orders"),
        F.count_if(s == "REFUNDED").alias("refunded_orders"), total("order_amount", "order_amount"), total("payment_amount", "paid_amount"), total("refund_amount", "refund_amount"),
    )


def lifecycle(current: DataFrame) -> DataFrame:
    return metrics(current, "channel")


def daily(current: DataFrame) -> DataFrame:
    return metrics(current, "order_date", "channel")


def changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """What turns ``before`` into ``after``: key, op ('u' or 'd') and after's other columns (null for 'd').

    Rows that stay the same are left out.
    """
    rest = [c for c in after.columns if c not in key]
    b = before.select(*key, F.struct(*rest).alias("__b"))
    a = after.select(*key, F.struct(*rest).alias("__a"))
    both = b.join(a, key, "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b")))
    return both.select(*key, F.when(F.col("__a").isNull(), "d").otherwise("u").alias("op"), "__a.*")
