"""The warehouse's registered queries. Times leave as text 'yyyy-MM-dd HH:mm:ss', as the serving tables hold them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weir.functions.versions import ingest_version
from weir.operators import backfill, behavior, changelog, dlq, orders, quality, scd2, serving
from weir.sources import derived as src
from weir.sources import readers, sinks
from weir.sources.contracts import CONTRACTS, evolve
from weir.sources.keyed_sink import KeyedSink, read_latest
from weir.sources.topics import TOPICS
from weir.streaming import behavior as live
from weir.streaming import keyed, loader
from weir.streaming import orders as live_orders
from weir.streaming.serving_table import ServingTable, start_upserts

RANGE = (date(1997, 1, 1), date(1998, 1, 1))
NOW = 2_000_000_000
#: As many files a batch as there are.
ALL_FILES = 2**31 - 1
#: Records a file of the loader's log, of about 600 bytes each; files a core in a batch of it.
FILE_RECORDS, TASK_FILES = 100_000, 2
#: Orders a bucket of a serving table, which a task sorts.
BUCKET_ORDERS = 250_000
#: Orders a group of keyed state, and a partition of it at most.
GROUP_ORDERS, PARTITION_ORDERS = 64, 250_000


def _text(df: DataFrame) -> DataFrame:
    """Timestamps and dates as text."""
    kinds = {T.TimestampType: "yyyy-MM-dd HH:mm:ss", T.DateType: "yyyy-MM-dd"}
    times = {f.name: F.date_format(f.name, kinds[type(f.dataType)]) for f in df.schema.fields if type(f.dataType) in kinds}
    return df.withColumns(times) if times else df


class Warehouse:
    """The tables of one input folder, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.at = (spark, sf_dir)

    def events(self):
        return src.behavior(*self.at)

    def dirty(self):
        return behavior.dirty(self.events())

    def facts(self):
        return behavior.enrich(self.events(), src.dim_product(*self.at), src.dim_shop(*self.at), src.dim_region(*self.at))

    def overview(self):
        return behavior.overview(behavior.clean(self.events()))

    def products(self):
        return behavior.product_rank(self.facts())

    def categories(self):
        return behavior.category_rank(self.facts())

    def funnel(self):
        return behavior.funnel(behavior.clean(self.events()))

    def log(self):
        return src.order_log(*self.at)

    def orders(self):
        return changelog.fold(self.log(), ["order_id"])

    def versions(self):
        return scd2.apply_price_changes(src.first_versions(*self.at), src.price_changes(*self.at))[0]

    def payments(self):
        return src.payment_info(*self.at)

    def refunds(self):
        return src.refund_info(*self.at)

    def wide(self):
        return orders.order_detail_wide(src.order_detail(*self.at), self.orders(), self.versions(), self.payments(), self.refunds(), hot=src.hot_products(*self.at))

    def current(self):
        return orders.order_current(self.wide())

    def daily(self):
        return orders.daily(self.current())

    def lifecycle(self):
        return orders.lifecycle(self.current())

    def offline(self, *span):
        return backfill.order_daily(self.orders(), self.payments(), self.refunds(), *span)


def _null_type(w: Warehouse) -> DataFrame:
    """Events in neither branch: those that only a strict dirty branch takes."""
    e = w.events()
    return behavior.dirty(e, strict=True).where("error_reason = 'INVALID_EVENT_TYPE' and event_type is null").agg(F.count(F.lit(1)).alias("n"))


def _counts(w: Warehouse) -> DataFrame:
    """Rows of each table; order lines are computed once for the three tables of orders, and carry only what decides how many rows there are."""
    names = {"dwd_user_behavior": w.facts, "dwd_dirty_behavior": w.dirty, "ads_realtime_overview": w.overview, "ads_product_rank": w.products, "ads_category_rank": w.categories, "ads_channel_funnel": w.funnel}
    headers = changelog.fold(changelog.showing(w.log(), "channel", "create_time"), ["order_id"])
    lines = orders.order_detail_wide(src.order_detail(*w.at, amounts=False), headers, w.versions(), w.payments(), w.refunds(), hot=src.hot_products(*w.at))
    return quality.table_counts({k: f() for k, f in names.items()}).unionAll(quality.order_counts(lines))


def _quality(w: Warehouse) -> DataFrame:
    """Facts, versions and order lines are computed once and stored; all rules and aggregates read these."""
    root = _work(w.at[0], "weir-quality-")
    stored = lambda name, df: _stored(df, f"{root}/{name}")
    facts = stored("facts", w.facts().select("event_id", "session_id", "user_id", "event_type", "channel", "amount", "event_ts", "product_id", "product_name", "category_name", "shop_name", "province"))
    versions = stored("versions", w.versions())
    shown = ("detail_id", "order_id", "order_status", "order_amount", "channel", "payment_id", "payment_status", "payment_amount", "refund_status", "refund_amount", "unit_price", "catalog_price", "order_create_time")
    wide = stored("wide", orders.order_detail_wide(src.order_detail(*w.at), w.orders(), versions, w.payments(), w.refunds(), hot=src.hot_products(*w.at)).select(*shown))
    current = stored("current", orders.order_current(wide))
    measured = quality.measure(
        facts, behavior.overview(facts), behavior.product_rank(facts), behavior.category_rank(facts), behavior.funnel(facts), wide, versions, orders.lifecycle(current), orders.daily(current)
    )
    return quality.judge(measured)


def _loader(w: Warehouse) -> DataFrame:
    """Records spoilt in known ways, by the reason for which the loader rejects them."""
    spark, sf_dir = w.at
    e = src.table(spark, sf_dir, "events")
    k = F.col("event_id") % 10
    value = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("event_id"), F.lit("S").alias("session_id"), F.when(k == 4, "seven").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(k == 4, F.lit(5_000_000_000)).otherwise(F.lit(1)).alias("event_sequence"), F.lit(1).alias("event_version"), F.lit(1).alias("product_id"), F.lit("2").alias("shop_id"), F.lit("pay").alias("event_type"),
        F.lit("app").alias("channel"), F.when(k == 2, None).when(k == 3, "1.234").otherwise("7.2500").alias("amount"), F.lit("2024-03-05T06:07:08.5").alias("event_ts"),
        F.when(k == 1, "x").alias("extra"),
    ))
    records = e.select(F.lit("dwd_user_behavior").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.lit(None).cast("string").alias("key"), F.when(k == 5, "{oops").otherwise(value).alias("value"))
    return dlq.validate(records, TOPICS["dwd_user_behavior"])[1].groupBy("error_message").agg(F.count(F.lit(1)).alias("n"))


def _envelopes(w: Warehouse) -> DataFrame:
    """Dead letters of the dirty events, redacted."""
    d = behavior.dirty(readers.with_event_time(src.ods_behavior(*w.at, offsets=True)))
    bad = d.select(F.lit("ods_user_behavior").alias("topic"), F.lit(0).alias("partition"), "offset", F.col("event_id").alias("key"), F.to_json(F.struct("event_id", "session_id", "user_id", "event_type", "event_time")).alias("value"), F.lit("DirtyEvent").alias("error_type"), F.col("error_reason").alias("error_message"))
    return dlq.redacted(dlq.envelopes(bad, F.lit("2024-02-01 00:00:00")))


def _alert_store(w: Warehouse) -> DataFrame:
    """Alerts of the newest windows, stored twice (the second time adds nothing) and read again."""
    path = _work(w.at[0], "weir-alerts-")
    found = serving.alerts(w.overview())
    for _ in range(2):
        serving.store_alerts(found, path)
    return serving.recent_alerts(sinks.stored(found, path))


def _evolution(w: Warehouse) -> DataFrame:
    """Orders written before and after a field was added, read together: older ones take the contract's fill, what was written later is as written."""
    spark, _ = w.at
    root = _work(spark, "weir-versions-")
    first = CONTRACTS["order_info"]
    second = evolve(first, T.StructField("delivery_type", T.StringType()), fill={"delivery_type": "CASE WHEN user_id % 2 = 0 THEN 'EXPRESS' ELSE 'STANDARD' END"})
    orders, early = w.orders(), F.col("create_time") < "1998-01-01"
    orders.where(early).select(*first.schema.names).write.parquet(f"{root}/version={first.version}")
    later = orders.where(~early).withColumn("delivery_type", F.when(F.col("user_id") % 3 == 0, "PICKUP").when(F.col("user_id") % 3 == 1, "STANDARD"))
    later.select(*second.schema.names).write.parquet(f"{root}/version={second.version}")
    return readers.read_versions(spark, root, second).select("order_id", "user_id", "delivery_type")


def _captured(w: Warehouse) -> DataFrame:
    """Of each captured table: entries of its change log, deletes among them, and the rows that are left; of values only whether there is one."""
    out = []
    for name, log in src.change_logs(*w.at, w.versions()).items():
        log = log.withColumn("value", F.when(F.col("value").isNotNull(), F.struct(F.lit(True).alias("known"))))
        counts = log.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("op") == "d").alias("deletes"))
        now = changelog.fold(log, CONTRACTS[name].key).agg(F.count(F.lit(1)).alias("kept"))
        out.append(counts.select(F.lit(name).alias("entity"), "entries", "deletes", F.lit(None).cast("long").alias("kept")).unionByName(now.select(F.lit(name).alias("entity"), F.lit(None).cast("long").alias("entries"), F.lit(None).cast("long").alias("deletes"), "kept")))
    return reduce(DataFrame.unionByName, out).groupBy("entity").agg(*[F.max(c).alias(c) for c in ("entries", "deletes", "kept")])


def _backfill_job(w: Warehouse) -> DataFrame:
    """The whole job over a year: recompute, overwrite partitions, compare with the served metrics, store the comparison; which is read."""
    root = _work(w.at[0], "weir-backfill-")
    done = backfill.run(w.orders(), w.payments(), w.refunds(), w.daily(), f"{root}/daily", f"{root}/reconciliation", *map(str, RANGE))
    return done.compared


def _serving_stream(w: Warehouse) -> DataFrame:
    """Orders' current rows after the order log went through the upsert sink, read as the newest version of each key."""
    spark, sf_dir = w.at
    root = _work(spark, "weir-serving-")
    log = w.log().select("order_id", F.col("value.order_status").alias("order_status"), F.col("value").isNull().cast("byte").alias("is_deleted"), "offset", "partition")
    stream = spark.readStream.schema(log.schema).parquet
    _deliver(_thirds(log), f"{root}/log", lambda path: live.start_serving(stream(path), ["order_id"], f"{root}/rows", f"{root}/checkpoint", availableNow=True))
    return readers.read_serving(spark, f"{root}/rows", ["order_id"]).select("order_id", "order_status")


def _serving_table(w: Warehouse) -> DataFrame:
    """The same through a serving table whose runs are merged level by level."""
    spark, _ = w.at
    root = _work(spark, "weir-table-")
    version = ingest_version(F.col("epoch"), F.col("offset"), F.col("partition")).alias("ingest_version")
    steps = w.log().select("order_id", F.col("value.order_status").alias("order_status"), version, F.col("value").isNull().cast("byte").alias("is_deleted"), (F.col("offset") % 4).alias("step"))
    log = steps.drop("step")
    buckets = max(4, src.row_count(*w.at, "orders") // BUCKET_ORDERS)
    table = ServingTable(spark, f"serving_{uuid.uuid4().hex}", f"{root}/rows", log.schema, ("order_id",), buckets=buckets, fan=2)
    stream = spark.readStream.schema(log.schema).parquet
    batches = [steps.where(F.col("step") == step).drop("step") for step in range(4)]  # a key's versions come in their order
    _deliver(batches, f"{root}/log", lambda path: start_upserts(stream(path), table, f"{root}/checkpoint", availableNow=True))
    return table.read().select("order_id", "order_status")


def _thirds(log: DataFrame) -> list[DataFrame]:
    """A log in three parts, each with the shape of its tasks; a key's entries lie in several."""
    return [log.where(F.pmod(F.xxhash64("order_id", "offset"), F.lit(3)) == i) for i in range(3)]


def _keyed_sink(w: Warehouse) -> DataFrame:
    """The same through the keyed sink, whose commits say what counts."""
    spark, _ = w.at
    root = _work(spark, "weir-sink-")
    log = w.log().select("order_id", F.col("value.order_status").alias("order_status"), "op", "offset")
    spark.dataSource.register(KeyedSink)
    options = {"path": f"{root}/sink", "key": "order_id", "version": "offset", "checkpointLocation": f"{root}/checkpoint"}
    stream = spark.readStream.schema(log.schema).parquet
    _deliver(_thirds(log), f"{root}/log", lambda path: stream(path).writeStream.format("weir_keyed").options(**options).trigger(availableNow=True).start())
    return read_latest(spark, f"{root}/sink", log.select("order_id", "order_status").schema)


def _all_topics(w: Warehouse) -> DataFrame:
    """Rows and dead letters by topic after one query has loaded records of several topics, some spoilt by an unknown field.

    Order lines and orders are computed once and stored. The loader keeps a batch while it works on it, some files a task: files have ``FILE_RECORDS``
    records at most, and a batch has ``TASK_FILES`` files a core, so neither a task nor a batch grows with the log.
    """
    spark, _ = w.at
    root = _work(spark, "weir-loader-")
    wide = _stored(w.wide(), f"{root}/wide")
    current = _stored(orders.order_current(wide), f"{root}/current")
    spoilt = {"ads_order_daily": F.col("channel") == "1-URGENT", "ads_order_lifecycle": F.col("total_orders") < 0, "dwd_order_detail": F.col("quantity") % 5 == 0}
    tables = {"ads_order_daily": orders.daily(current), "ads_order_lifecycle": orders.lifecycle(current), "dwd_order_detail": wide}
    for topic, rows in tables.items():
        rows = _text(rows.withColumn("extra", F.when(spoilt[topic], "x")))
        records = rows.select(F.lit(topic).alias("topic"), F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), F.lit(None).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
        records.write.mode("append").options(maxRecordsPerFile=FILE_RECORDS, compression="zstd").parquet(f"{root}/log")
    files = TASK_FILES * spark.sparkContext.defaultParallelism
    stream = spark.readStream.schema("topic string, partition int, offset long, key string, value string").option("maxFilesPerTrigger", files).parquet(f"{root}/log")
    loader.start_all_topics(stream, f"{root}/out", loader.LoaderMetrics(), availableNow=True).awaitTermination()
    count = lambda topic, kind: spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/out/{topic}/{kind}").agg(F.lit(topic).alias("topic"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return reduce(DataFrame.unionByName, [count(t, kind) for t in tables for kind in ("rows", "letters")])


def _work(spark: SparkSession, prefix: str) -> str:
    """A new folder that executors can write to, under spark.checkpoint.dir; it goes with the driver's JVM.

    Where that is unset, a local master gets a folder of its own, and any other an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="weir-")
    path = f"{shared.rstrip('/')}/{prefix}{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def _stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` computed once and read from ``path``."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _deliver(batches: Iterable[DataFrame], log: str, start: Callable[[str], StreamingQuery]) -> None:
    """Each batch is added to a log, in as many files as it has tasks, and then streamed; the query goes on from its checkpoint."""
    for rows in batches:
        rows.write.mode("append").parquet(log)
        start(log).awaitTermination()


def _streamed(w: Warehouse, name: str) -> DataFrame:
    """An aggregate computed by a stream over the event log written as JSON; windows that closed."""
    spark, sf_dir = w.at
    loader.configure(spark)
    root = _work(spark, "weir-stream-")
    src.ods_behavior(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).write.text(f"{root}/log")
    events = live.timed(readers.stream_events(spark, f"{root}/log"))
    q = live.start_aggregate(behavior.clean(events), name, f"{root}/out", f"{root}/checkpoint", availableNow=True)
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def _order_changes(w: Warehouse) -> dict[str, DataFrame]:
    """The change logs of orders, their lines, payments, refunds and product versions."""
    at, key = w.at, ("product_id", "version_no")

    def created(rows: DataFrame, offset: Column, *key: str) -> DataFrame:
        value = F.struct(*[c for c in rows.columns if c != "order_key"])
        return rows.select(*key, F.lit("c").alias("op"), F.lit(128).alias("epoch"), F.lit(0).alias("partition"), offset.cast("long").alias("offset"), value.alias("value"))

    when = F.unix_seconds("update_time")  # positions in order of time
    return {
        "order_info": w.log(), "order_detail": created(src.order_detail(*at), when, "detail_id"), "payment_info": created(w.payments(), when, "payment_id"),
        "refund_info": created(w.refunds(), when, "refund_id"), "dim_product_scd2": created(w.versions(), F.lit(1), *key),
    }


def _order_stream(w: Warehouse) -> DataFrame:
    """Daily metrics of a stream of order changes in five batches.

    Orders before 1997 come first, then the rest, whose changes are split over batches, deletes and restores late. Product version 1 comes at
    first as if it had ended before the latter. Before the last batches the state is compacted and forgets the old orders; their headers
    and payments come once more, and version 1 is dated anew.
    """
    spark, _ = w.at
    root = _work(spark, "weir-orders-")
    whole = _order_changes(w)
    state = live_orders.OrderState(spark, f"{root}/state", {k: v.schema for k, v in whole.items()}, buckets=2)
    versions, key = whole["dim_product_scd2"], ["product_id", "version_no"]
    redated = F.when(F.col("version_no") == 1, F.col("value").withField("effective_to", F.lit("1997-01-01").cast("timestamp"))).otherwise(F.col("value"))
    log, others = w.log(), [e for e in whole if e not in ("order_info", "dim_product_scd2")]
    past = src.order_info(*w.at).where("create_time < '1997-01-01'").select("order_id")
    old = {e: (log if e == "order_info" else whole[e].withColumn("order_id", F.col("value.order_id"))).join(past, "order_id", "left_semi").select(*whole[e].columns) for e in ("order_info", *others)}
    new = {e: (log if e == "order_info" else whole[e].withColumn("order_id", F.col("value.order_id"))).join(past, "order_id", "left_anti").select(*whole[e].columns) for e in ("order_info", *others)}
    early = F.col("offset") % 4 < 2
    batches = [
        {**old, "dim_product_scd2": versions.withColumn("value", F.when(F.col("value.product_id") % 2 == 0, redated).otherwise(F.col("value")))},
        {"order_info": new["order_info"].where(early), "order_detail": new["order_detail"], "dim_product_scd2": versions.withColumn("offset", F.lit(2).cast("long"))},
        {"dim_product_scd2": versions.where("product_id % 2 = 1").withColumns({"offset": F.lit(3).cast("long"), "value": redated}), "payment_info": new["payment_info"]},
        {"order_info": new["order_info"].where(~early), "refund_info": new["refund_info"]},
        {"dim_product_scd2": versions.where("version_no = 1").withColumn("offset", F.lit(4).cast("long")), "order_info": old["order_info"], "payment_info": old["payment_info"]},
    ]
    rows = [reduce(DataFrame.unionByName, [d.select(F.lit(e).alias("entity"), F.to_json(F.struct("*")).alias("row")) for e, d in batch.items()]) for batch in batches]
    stream = spark.readStream.schema("entity string, row string").parquet
    _deliver(rows, f"{root}/log", lambda log: live_orders.start(stream(log), state, f"{root}/checkpoint", compact_every=3, ttl_days=366, clock=lambda: datetime(1998, 1, 2), availableNow=True))
    return state.daily()


def _order_state(w: Warehouse) -> DataFrame:
    """Daily metrics of orders kept as keyed state, from a stream of changes year by year; at last those before 1997 once more, when their orders are forgotten."""
    spark, sf_dir = w.at
    root = _work(spark, "weir-state-")
    logs = _order_changes(w)
    ended = src.order_info(spark, sf_dir).select("order_id", (F.col("update_time") + F.expr("INTERVAL 1 HOUR")).alias("deleted_at"))
    known = scd2.version_at(src.order_detail(spark, sf_dir), w.versions(), hot=src.hot_products(*w.at)).select("detail_id")
    parts = [
        keyed.of_log("order_info", logs["order_info"].join(ended, "order_id"), at=F.col("deleted_at")), keyed.of_log("order_detail", logs["order_detail"].join(known, "detail_id", "left_semi")),
        keyed.of_log("payment_info", logs["payment_info"]), keyed.of_log("refund_info", logs["refund_info"]),
    ]
    reduce(DataFrame.unionByName, parts).write.parquet(f"{root}/changes")
    changes = spark.read.parquet(f"{root}/changes")
    year, n = F.year("at"), src.row_count(spark, sf_dir, "orders")
    size = {"groups": n // GROUP_ORDERS + 1, "partitions": max(spark.sparkContext.defaultParallelism, n // PARTITION_ORDERS)}
    rows = [changes.where(some) for some in (year <= 1996, year == 1997, year == 1998, year == 1999, (year > 1999) | (year <= 1996))]
    _deliver(rows, f"{root}/log", lambda log: keyed.start(keyed.read_changes(spark, log, ALL_FILES), f"{root}/signed", f"{root}/checkpoint", 366, **size, availableNow=True))
    return keyed.metrics(spark.read.schema(keyed.SIGNED).parquet(f"{root}/signed"), "order_date", "channel")


_desc = F.desc
PLANS = {
    "behavior_dirty": lambda w: w.dirty().drop("event_ts", "proc_time"),
    "behavior_dirty_reasons": lambda w: w.dirty().groupBy("error_reason").agg(F.count(F.lit(1)).alias("n")),
    "behavior_null_type": _null_type,
    "dwd_user_behavior": lambda w: w.facts(),
    "ads_realtime_overview": lambda w: w.overview(),
    "ads_product_rank": lambda w: w.products(),
    "ads_category_rank": lambda w: w.categories(),
    "dws_session_stage": lambda w: behavior.session_stages(behavior.clean(w.events())),
    "ads_channel_funnel": lambda w: w.funnel(),
    "channel_event_mix": lambda w: behavior.event_mix(behavior.clean(w.events())),
    "dimension_hit_rates": lambda w: behavior.hit_rates(w.facts()),
    "duplicate_lineitem_keys": lambda w: changelog.duplicate_keys(src.table(*w.at, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "order_log_versions": lambda w: w.log().select("order_id", "op", ingest_version(F.col("epoch"), F.col("offset"), F.col("partition")).alias("ingest_version")),
    "order_info_current": lambda w: w.orders().drop("ingest_version", "is_deleted"),
    "order_tombstones": lambda w: changelog.fold(w.log(), ["order_id"], keep_deleted=True).where("is_deleted = 1").select("order_id", "ingest_version", "is_deleted"),
    "order_log_compacted": lambda w: changelog.compact(w.log(), ["order_id"]).select("order_id", "op", "offset"),
    "dwd_order_detail": lambda w: w.wide(),
    "dws_order_current": lambda w: w.current(),
    "ads_order_lifecycle": lambda w: w.lifecycle(),
    "ads_order_daily": lambda w: w.daily(),
    "backfill_order_daily": lambda w: w.offline(),
    "backfill_order_range": lambda w: w.offline(*RANGE),
    "reconciliation": lambda w: backfill.reconcile(w.offline(), w.daily()),
    "scd2_versions": lambda w: w.versions().drop("updated_at"),
    "scd2_overlaps": lambda w: scd2.overlaps(w.versions()),
    "scd2_not_one_current": lambda w: scd2.not_one_current(w.versions()),
    "versions_per_product": lambda w: scd2.version_counts(w.versions()),
    "latest_overview": lambda w: serving.newest(w.overview(), 20),
    "overview_trend": lambda w: serving.trend(w.overview()),
    "latest_products": lambda w: serving.newest(w.products(), 20, _desc("pay_amount"), F.col("product_id")),
    "top_products_latest_window": lambda w: serving.latest_window(w.products(), _desc("pay_amount"), F.col("product_id"), n=10),
    "latest_categories": lambda w: serving.latest_window(w.categories(), _desc("pay_amount")),
    "latest_funnel": lambda w: serving.latest_window(w.funnel(), _desc("view_users")),
    "top_products_per_window": lambda w: serving.top_n_per_window(w.products(), 10, _desc("pay_amount"), F.col("product_id")),
    "recent_facts": lambda w: serving.newest(w.facts(), 1000, F.col("event_id"), by="event_ts").select("event_id", "event_ts"),
    "bi_order_daily": lambda w: serving.net_paid(w.daily()).orderBy("order_date", "channel"),
    "bi_order_lifecycle": lambda w: serving.net_paid(w.lifecycle()).orderBy(_desc("paid_amount")),
    "bi_measures": lambda w: serving.bi_measures(w.daily()),
    "bi_version_measures": lambda w: serving.version_measures(w.versions()),
    "overview_moving_mean": lambda w: serving.moving_mean(w.overview()),
    "alerts": lambda w: serving.alerts(w.overview()),
    "freshness": lambda w: serving.freshness(w.facts(), w.wide(), w.overview(), F.lit(NOW)),
    "quality_rules": _quality,
    "table_counts": _counts,
    "schema_evolution_backfill": _evolution,
    "payments_in_range": lambda w: readers.of_orders(w.payments(), readers.orders_in_range(w.orders(), *RANGE)).select("payment_id", "order_id", "payment_status", "payment_amount"),
    "loader_rejects": _loader,
    "dlq_envelopes": _envelopes,
    "captured_tables": _captured,
    "alert_store": _alert_store,
    "backfill_job": _backfill_job,
    "stream_serving": _serving_stream,
    "stream_serving_table": _serving_table,
    "stream_keyed_sink": _keyed_sink,
    "stream_loader": _all_topics,
    "stream_overview": lambda w: _streamed(w, "ads_realtime_overview"),
    "stream_funnel": lambda w: _streamed(w, "ads_channel_funnel"),
    "stream_order_daily": _order_stream,
    "stream_order_state": _order_state,
}


def _query(name: str, plan):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _text(plan(Warehouse(spark, sf_dir)))

    run.__name__ = name
    return run


QUERIES = {k: _query(k, f) for k, f in PLANS.items()}
