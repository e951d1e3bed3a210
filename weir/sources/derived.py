"""Warehouse inputs derived from the TPC-H-like tables, so that every query has a SQL counterpart.

FIXTURES.md part C gives the rules. Times are truncated to seconds, as the event log's text has them.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.operators.intervals import hot_keys

from .contracts import CHANNELS, CONTRACTS
from .readers import captured, with_event_time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache
def _rows(application: str, sf_dir: str, name: str) -> int:
    """Rows of a table, counted once an application."""
    return table(SparkSession.getActiveSession(), sf_dir, name).count()


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    return _rows(spark.sparkContext.applicationId, sf_dir, name)


def _every(n: int, column: str = "event_id") -> Column:
    return F.col(column) % n == 0


def ods_behavior(spark: SparkSession, sf_dir: str, offsets: bool = False) -> DataFrame:
    """The behaviour log: nulls, blanks, unknown types, bad times and unknown dimension keys included; on demand with each record's offset."""
    parts, shops = (_rows(spark.sparkContext.applicationId, sf_dir, t) for t in ("part", "supplier"))
    e = table(spark, sf_dir, "events")
    session = F.floor(F.col("event_id") / 4)
    kinds = F.create_map(*[F.lit(x) for p in (("view", "view"), ("click", "cart"), ("signup", "order"), ("purchase", "pay")) for x in p])
    return e.select(
        F.when(~_every(211), F.concat(F.lit("E"), F.col("event_id").cast("string"))).alias("event_id"),
        F.when(_every(223), " ").otherwise(F.concat(F.lit("S"), session.cast("string"))).alias("session_id"),
        F.when(F.col("event_type").isin("signup", "purchase"), F.concat(F.lit("O"), session.cast("string"))).alias("order_id"),
        (F.col("event_id") % 4).cast("int").alias("event_sequence"),
        F.lit(1).cast("long").alias("event_version"),
        F.when(~_every(227), F.col("user_id")).alias("user_id"),
        (F.col("event_id") % (parts + 50)).alias("product_id"),
        (F.col("event_id") % (shops + 1)).alias("shop_id"),
        F.when(~_every(97), F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("unknown"))).alias("event_type"),
        F.element_at(F.array(*map(F.lit, CHANNELS)), (session % 5 + 1).cast("int")).alias("channel"),
        F.col("value").cast("decimal(10,2)").alias("amount"),
        F.when(_every(229), "not-a-time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("event_time"),
        *([F.col("event_id").cast("long").alias("offset")] if offsets else []),
    )


def behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_event_time(ods_behavior(spark, sf_dir))


def dim_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("long").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_size").cast("long").alias("category_id"),
        F.col("p_type").alias("category_name"), F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
    )


def dim_shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shop_id"), F.col("s_name").alias("shop_name"), F.col("s_nationkey").cast("long").alias("region_id"))


def dim_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("region_id"), F.col("r_name").alias("province"), F.col("n_name").alias("city"))


def _order_id(column: str) -> Column:
    return F.concat(F.lit("O"), F.col(column).cast("string"))


def order_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final state of every order."""
    o = table(spark, sf_dir, "orders")
    k, created = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    status = (
        F.when(F.col("o_orderstatus") == "O", "CREATED").when(F.col("o_orderstatus") == "P", "CANCELLED")
        .when(k % 8 == 0, "REFUNDED").otherwise("PAID")
    )
    return o.select(
        _order_id("o_orderkey").alias("order_id"), F.col("o_custkey").cast("long").alias("user_id"), (k % 100).cast("long").alias("shop_id"), status.alias("order_status"),
        F.col("o_orderpriority").alias("channel"), F.col("o_totalprice").cast("decimal(12,2)").alias("order_amount"),
        F.when(k % 4 == 0, "NEW10").when(k % 4 == 1, "VIP20").when(k % 4 == 2, "SUMMER").alias("promotion_code"),
        created.alias("create_time"), (created + F.expr("INTERVAL 1 HOUR")).alias("update_time"),
        F.when(F.col("o_orderstatus") == "O", 1).otherwise(2).cast("long").alias("version_no"), k.cast("long").alias("order_key"),
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log of orders: created, then the final status; every 50th deleted, every 100th restored.

    Columns: order_id, op, epoch, partition, offset, value (null for a delete).
    """
    o = order_info(spark, sf_dir)
    names = [c for c in o.columns if c != "order_key"]
    k = F.col("order_key")
    first = F.struct(*[(F.lit("CREATED") if c == "order_status" else F.lit(1).cast("long") if c == "version_no" else F.col("create_time") if c == "update_time" else F.col(c)).alias(c) for c in names])
    last = F.struct(*names)
    none = F.lit(None).cast(o.select(last.alias("v")).schema["v"].dataType)

    def step(n: int, op: str, value: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(op).alias("op"), (k * 4 + n).alias("offset"), value.alias("value")))

    steps = F.array(
        step(0, "c", first, F.lit(True)), step(1, "u", last, F.col("order_status") != "CREATED"),
        step(2, "d", none, k % 50 == 0), step(3, "c", last, k % 100 == 0),
    )
    rows = o.select("order_id", (k % 3).cast("int").alias("partition"), F.inline(F.array_compact(steps)))
    return rows.select("order_id", "op", F.lit(128).alias("epoch"), "partition", "offset", "value")


def order_detail(spark: SparkSession, sf_dir: str, amounts: bool = True) -> DataFrame:
    """Order lines, one a (order, line number): the largest of equal keys.

    Lines are dealt by order once, for their own grouping and for the join with orders. Columns behind the last one shown can't change what is shown.
    Without ``amounts``, quantity and detail_amount are null, and the product is the last one shown.
    """
    l, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    rest = ["l_partkey", *(["l_suppkey", "l_quantity", "l_extendedprice"] if amounts else [])]
    amount = lambda c, kind: (F.col(c) if amounts else F.lit(None)).cast(kind)
    best = l.select("l_orderkey", "l_linenumber", *rest).repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct(*rest)).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    best = best.join(o.select("o_orderkey", "o_orderdate"), best.l_orderkey == o.o_orderkey)
    best = best.join(p.select("p_partkey", "p_retailprice"), best.l_partkey == p.p_partkey, "left")
    created = F.col("o_orderdate").cast("timestamp")
    return best.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-D"), F.col("l_linenumber").cast("string")).alias("detail_id"), _order_id("l_orderkey").alias("order_id"),
        F.col("l_partkey").cast("long").alias("product_id"), amount("l_quantity", "int").alias("quantity"), F.col("p_retailprice").cast("decimal(10,2)").alias("unit_price"),
        amount("l_extendedprice", "decimal(12,2)").alias("detail_amount"), created.alias("create_time"), created.alias("update_time"), F.lit(1).cast("long").alias("version_no"),
    )


def hot_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products with very many lines, as ``intervals.at_time`` takes them: counted in the table of lines, before any join."""
    lines, dates = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("product_id")), table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("create_time"))
    return hot_keys(lines, "product_id", "create_time", bounds=dates)


def payment_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SUCCESS payment of each paid or refunded order; failed ones of every fifth created order."""
    o = order_info(spark, sf_dir)
    paid = F.col("order_status").isin("PAID", "REFUNDED")
    at = F.col("create_time") + F.expr("INTERVAL 30 MINUTES")
    return o.where(paid | ((F.col("order_status") == "CREATED") & _every(5, "order_key"))).select(
        F.concat(F.lit("P"), F.col("order_key").cast("string")).alias("payment_id"), "order_id", F.when(paid, "SUCCESS").otherwise("FAILED").alias("payment_status"),
        F.when(F.col("order_key") % 3 == 0, "alipay").when(F.col("order_key") % 3 == 1, "wechat_pay").otherwise("bank_card").alias("payment_method"),
        F.col("order_amount").alias("payment_amount"), F.when(paid, at).alias("payment_time"), at.alias("update_time"), F.lit(1).cast("long").alias("version_no"),
    )


def refund_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SUCCESS refund of each refunded order: a quarter, half or all of its amount."""
    o = order_info(spark, sf_dir).where("order_status = 'REFUNDED'")
    k = F.col("order_key")
    share = F.when(k % 3 == 0, F.lit("0.25")).when(k % 3 == 1, F.lit("0.50")).otherwise(F.lit("1.00")).cast("decimal(3,2)")
    at = F.col("create_time") + F.expr("INTERVAL 2 HOURS")
    return o.select(
        F.concat(F.lit("R"), k.cast("string")).alias("refund_id"), "order_id", F.concat(F.lit("P"), k.cast("string")).alias("payment_id"), F.lit("SUCCESS").alias("refund_status"),
        (F.col("order_amount") * share).cast("decimal(12,2)").alias("refund_amount"), F.when(k % 2 == 0, "damaged").alias("refund_reason"),
        at.alias("refund_time"), at.alias("update_time"), F.lit(1).cast("long").alias("version_no"),
    )


def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third product costs 8 % more from 1998 on."""
    p = dim_product(spark, sf_dir).where("product_id % 3 = 0")
    return p.select("product_id", (F.col("price") * F.lit("1.08").cast("decimal(3,2)")).cast("decimal(10,2)").alias("price"), F.lit("1998-01-01 00:00:00").cast("timestamp").alias("effective_from"))


def first_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 of every product, open since 1900."""
    start, end = F.lit("1900-01-01 00:00:00").cast("timestamp"), F.lit("9999-12-31 23:59:59.999").cast("timestamp")
    return dim_product(spark, sf_dir).select(
        "product_id", F.lit(1).alias("version_no"), "product_name", "category_id", "category_name", "price",
        start.alias("effective_from"), end.alias("effective_to"), F.lit(1).cast("byte").alias("is_current"), start.alias("updated_at"),
    )


def change_logs(spark: SparkSession, sf_dir: str, versions: DataFrame) -> dict[str, DataFrame]:
    """The five captured tables as change logs; keys that end in 7 are deleted in the end."""
    rows = {"order_info": order_info, "order_detail": order_detail, "payment_info": payment_info, "refund_info": refund_info}
    tables = {name: f(spark, sf_dir) for name, f in rows.items()} | {"dim_product_scd2": versions}
    out = {}
    for name, df in tables.items():
        key = F.col(CONTRACTS[name].key[0]).cast("string")
        out[name] = captured(df, CONTRACTS[name], F.endswith(key, F.lit("7")), F.length(key) % 3)
    return out
