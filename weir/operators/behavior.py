"""Behaviour events: dirty branch, clean branch, lookups, windowed aggregates, strict funnel.

Every function maps DataFrames to DataFrames and works on batch and streaming input alike, except
where it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.sources.contracts import DIRTY_CODES, EVENT_TYPES

MONEY = "decimal(18,2)"


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.length(F.trim(c)) == 0)


def _defects(strict: bool) -> list[Column]:
    """One condition a dirty code, in the order of the codes. A null type is no defect unless ``strict``."""
    kind = ~F.col("event_type").isin(*EVENT_TYPES)
    return [_blank("event_id"), _blank("session_id"), F.col("user_id").isNull(), (kind | F.col("event_type").isNull()) if strict else kind, F.col("event_ts").isNull()]


def dirty(events: DataFrame, strict: bool = False) -> DataFrame:
    """Events with any defect, with ``error_reason``: their codes joined by semicolons.

    SQL's three-valued logic leaves an event whose type is null, and that has no other defect, in
    neither branch; ``strict`` sends it here.
    """
    found = _defects(strict)
    any_ = found[0]
    for f in found[1:]:
        any_ = any_ | f
    codes = [F.when(f, code) for f, code in zip(found, DIRTY_CODES)]
    return events.where(any_).withColumn("error_reason", F.concat_ws(";", *codes))


def clean(events: DataFrame) -> DataFrame:
    """Events without defects."""
    ok = ~_blank("event_id") & ~_blank("session_id") & F.col("user_id").isNotNull() & F.col("event_type").isin(*EVENT_TYPES) & F.col("event_ts").isNotNull()
    return events.where(ok)


def enrich(events: DataFrame, products: DataFrame, shops: DataFrame, regions: DataFrame) -> DataFrame:
    """Clean events with product, shop and, through the shop, region; misses keep the event.

    The dimensions are joined as of now: a stream joins what the dimension holds in each batch. Spark
    broadcasts a dimension that its statistics show to be small and shuffles one that isn't.
    """
    p = products.select("product_id", "product_name", "category_id", "category_name")
    s, r = shops.select("shop_id", "shop_name", "region_id"), regions.select("region_id", "province", "city")
    # One after the other: of a join of dimensions Spark overestimates the size, and would shuffle the facts by shop.
    out = clean(events).join(p, "product_id", "left").join(s, "shop_id", "left").join(r, "region_id", "left")
    return out.select(
        "event_id", "session_id", "order_id", "event_sequence", "event_version", "user_id", "product_id", "product_name", "category_id", "category_name",
        "shop_id", "shop_name", "event_type", "channel", "amount", "event_ts", "province", "city",
    )


def _bounds(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


def overview(facts: DataFrame, size: str = "1 minute") -> DataFrame:
    """Per window: views, distinct viewers, distinct users by later step, amount paid.

    Distinct users come from two chained aggregations, (window, type, user) then window, which also
    streams need and which spreads a hot window over its users.
    """
    by_user = facts.groupBy(F.window("event_ts", size).alias("window"), "event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    users = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    return _bounds(
        by_user.groupBy("window").agg(
            F.coalesce(F.sum(F.when(F.col("event_type") == "view", F.col("n"))), F.lit(0)).alias("pv"),
            users("view").alias("uv"), users("cart").alias("cart_users"), users("order").alias("order_users"), users("pay").alias("pay_users"),
            F.coalesce(F.sum(F.when(F.col("event_type") == "pay", F.col("amount"))), F.lit(0)).cast(MONEY).alias("pay_amount"),
        )
    )


def product_rank(facts: DataFrame, size: str = "5 minutes") -> DataFrame:
    """Payments per window and product."""
    paid = facts.where("event_type = 'pay'").groupBy(F.window("event_ts", size).alias("window"), "product_id", "product_name", "category_name")
    return _bounds(paid.agg(F.count(F.lit(1)).alias("pay_count"), F.sum("amount").cast(MONEY).alias("pay_amount")))


def category_rank(facts: DataFrame, size: str = "5 minutes") -> DataFrame:
    """Payments and distinct payers per window and category."""
    paid = facts.where("event_type = 'pay'").withColumn("category_name", F.coalesce("category_name", F.lit("UNKNOWN")))
    by_user = paid.groupBy(F.window("event_ts", size).alias("window"), "category_name", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return _bounds(by_user.groupBy("window", "category_name").agg(F.sum("n").alias("pay_count"), F.count("user_id").alias("pay_users"), F.sum("amount").cast(MONEY).alias("pay_amount")))


def _stages(facts: DataFrame, size: str) -> DataFrame:
    at = [F.min(F.when(F.col("event_type") == t, F.col("event_ts"))).alias(f"{t}_ts") for t in EVENT_TYPES]
    return facts.groupBy(F.window("event_ts", size).alias("window"), "channel", "session_id").agg(*at)


def session_stages(facts: DataFrame, size: str = "30 minutes") -> DataFrame:
    """First time of each step per window, channel and session."""
    return _bounds(_stages(facts, size))


def funnel(facts: DataFrame, size: str = "30 minutes") -> DataFrame:
    """Strict funnel: sessions that took the steps in order, per window and channel (named *_users)."""
    reached, out = F.lit(True), []
    before = None
    for t in EVENT_TYPES:
        at = F.col(f"{t}_ts")
        reached = reached & at.isNotNull() & (F.lit(True) if before is None else at >= before)
        out.append(F.count(F.when(reached, 1)).alias(f"{t}_users"))
        before = at
    return _bounds(_stages(facts, size).groupBy("window", "channel").agg(*out))


def event_mix(facts: DataFrame) -> DataFrame:
    """Events by type and amount paid, per channel."""
    n = [F.count_if(F.col("event_type") == t).alias(f"{t}_cnt") for t in EVENT_TYPES]
    return facts.groupBy("channel").agg(*n, F.coalesce(F.sum(F.when(F.col("event_type") == "pay", F.col("amount"))), F.lit(0)).cast(MONEY).alias("pay_amount"))


def hit_rates(facts: DataFrame) -> DataFrame:
    """Share (in percent) of facts that each lookup answered; 0 without facts."""
    rate = lambda c: F.when(F.count(F.lit(1)) == 0, 0.0).otherwise(100.0 * F.count_if(F.col(c).isNotNull() & (F.col(c) != "")) / F.count(F.lit(1)))
    return facts.agg(rate("product_name").alias("product_hit"), rate("shop_name").alias("shop_hit"), rate("province").alias("region_hit"))
