"""Live order pipeline: change logs in, order facts and metrics out, with retractions.

Spark's stream-stream joins never take a result back, so each batch recomputes what its changes
touch: the touched orders' current rows from their log entries, and the metrics of the groups that
those orders leave or enter, by subtracting their old and adding their new contributions. Product
versions are an entity like the others: one that arrives late, or is dated anew, touches the orders
with lines of that product in the time whose version changes.

State is kept as Parquet tables in folders by bucket of the key and by batch. A batch reads the
buckets of its keys only (lines, payments and refunds are found by order, and lines by product,
through index tables); a batch that is run again overwrites its own folders and reads only earlier
ones, which makes the pipeline idempotent. ``OrderState.compact`` reduces each table to the newest row of
each key and forgets keys without a change for longer than a time to live.

Forgetting frees state and changes no result. What isn't known any more keeps its served value: an order whose header or
lines are forgotten stays as it was served, and so do the amounts of forgotten payments and refunds; a delete is told
from that by its tombstone. A change to a forgotten key that the log delivers again is recognised by its position,
at or before the newest forgotten one of its log partition, and ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weir.operators import changelog
from weir.operators import orders as op
from weir.operators.changelog import fold
from weir.sources.contracts import schema

VERSIONS = "dim_product_scd2"
#: Entity -> key. The first key column also names the bucket.
ENTITIES = {"order_info": ["order_id"], "order_detail": ["detail_id"], "payment_info": ["payment_id"], "refund_info": ["refund_id"], VERSIONS: ["product_id", "version_no"]}
OF_ORDERS = ("order_detail", "payment_info", "refund_info")
LINES = "lines_by_product"
MARKS = schema("epoch int, partition int, upto bigint")

GROUP = ["order_date", "channel"]
COUNTS = ("total_orders", "paid_orders", "cancelled_orders", "refunded_orders")
SUMS = ("order_amount", "paid_amount", "refund_amount")
DAILY = schema(
    "order_date string, channel string, op string, total_orders bigint, paid_orders bigint, cancelled_orders bigint, refunded_orders bigint, "
    "order_amount decimal(22,2), paid_amount decimal(22,2), refund_amount decimal(22,2), batch_id bigint"
)
CURRENT = schema(
    "order_id string, op string, channel string, order_status string, order_amount decimal(12,2), payment_amount decimal(12,2), refund_amount decimal(12,2), "
    "order_date string, batch_id bigint"
)
SERVED = {"dws_order_current": (CURRENT, ["order_id"]), "ads_order_daily": (DAILY, GROUP)}


@dataclass
class OrderState:
    """Tables under ``root``: logs by entity, indexes, served orders and daily metrics with op and batch."""

    spark: SparkSession
    root: str
    schemas: dict[str, T.StructType]
    buckets: int = 16
    clock: Callable[[], datetime] = datetime.now
    #: Of frames of keys that a batch reads by more than once: the frame and its buckets.
    hit: dict[tuple, tuple[DataFrame, list[int]]] = field(default_factory=dict)

    def together(self, *jobs: Callable[[], object]) -> list:
        """The results of jobs that need nothing of each other, run side by side: most of a small batch's time is not spent in tasks."""
        target = inheritable_thread_target(self.spark)
        with ThreadPoolExecutor(max(1, len(jobs))) as pool:
            return [f.result() for f in [pool.submit(target(job)) for job in jobs]]

    def _path(self, name: str) -> str:
        path = f"{self.root}/{name}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(p)
        return path

    def _folders(self, name: str) -> list[tuple[int, object]]:
        """(batch, path) of a table's folders."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/bucket=*/batch=*")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        return [(int(f.getPath().getName().partition("=")[2]), f.getPath()) for f in found]

    def _bucket(self, key: list[str]):
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _hit(self, keys: DataFrame, key: list[str]) -> list[int]:
        """The buckets of a frame of keys, found once a batch."""
        own = (id(keys), *key)
        if own not in self.hit:
            self.hit[own] = keys, [r[0] for r in keys.select(self._bucket(key).alias("bucket")).distinct().collect()]
        return self.hit[own][1]

    def _index(self, name: str) -> T.StructType:
        if name == LINES:
            return schema("product_id bigint, order_id string, create_time timestamp")
        return T.StructType([T.StructField("order_id", T.StringType()), *[self.schemas[name][k] for k in ENTITIES[name]]])

    def _read(self, name: str, table: T.StructType, key: list[str], keys: DataFrame | None, before: int | None = None) -> DataFrame:
        """Rows with ``batch``, of the given keys (all, if None) and batches before ``before``: other buckets aren't read."""
        own = T.StructType([*table.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])
        rows = self.spark.read.schema(own).option("ignoreMissingFiles", "true").parquet(self._path(name))
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        if keys is not None:
            if self.buckets > 1:
                rows = rows.where(F.col("bucket").isin(self._hit(keys, key)))
            rows = rows.join(keys.select(*key), key, "left_semi")
        return rows.drop("bucket")

    def _write(self, name: str, rows: DataFrame, key: list[str], batch_id: int) -> None:
        """A bucket with many rows is written by several tasks."""
        out = rows.withColumns({"bucket": self._bucket(key), "batch": F.lit(batch_id).cast("long")}).hint("rebalance", "bucket")
        out.write.partitionBy("bucket", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self._path(name))

    def _log(self, entity: str) -> T.StructType:
        """What is stored of an entity: its change rows and when they came, by which tombstones age."""
        return T.StructType([*self.schemas[entity].fields, T.StructField("seen", T.TimestampType())])

    def log(self, entity: str, keys: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """What was received of an entity."""
        return self._read(entity, self._log(entity), ENTITIES[entity][:1], keys, before).drop("batch", "seen")

    def keys_of(self, entity: str, orders: DataFrame, *also: str) -> DataFrame:
        """The keys that an entity's rows of these orders have or had, with order_id if ``also`` names it."""
        return self._read(f"{entity}_by_order", self._index(entity), ["order_id"], orders).select(*ENTITIES[entity], *also).distinct()

    def lines(self, products: DataFrame) -> DataFrame:
        """product_id, order_id, create_time of the lines that these products have or had."""
        return self._read(LINES, self._index(LINES), ["product_id"], products).drop("batch").distinct()

    def _forgotten(self, entity: str) -> DataFrame:
        """epoch, partition, upto: the newest forgotten position of each log partition."""
        marks = self._read(f"{entity}_forgotten", MARKS, ["epoch"], None)
        return marks.groupBy("epoch", "partition").agg(F.max("upto").alias("upto"))

    def _news(self, entity: str, rows: DataFrame, batch_id: int) -> DataFrame:
        """``rows`` without changes of forgotten keys that the log delivers again."""
        key = ENTITIES[entity]
        if not self._folders(f"{entity}_forgotten"):
            return rows
        old = rows.join(self._forgotten(entity), ["epoch", "partition"]).where("offset <= upto")
        known = self.log(entity, old, batch_id).select(*key).distinct()
        again = old.join(known, key, "left_anti").select(*key, "epoch", "partition", "offset").distinct()
        return rows.join(again, [*key, "epoch", "partition", "offset"], "left_anti")

    def receive(self, entity: str, rows: DataFrame, batch_id: int) -> DataFrame:
        """Store what a batch brings of an entity, which is returned."""
        key = ENTITIES[entity]
        rows = self._news(entity, rows, batch_id).select(*self.schemas[entity].names)
        self._write(entity, rows.withColumn("seen", F.lit(self.clock()).cast("timestamp")), key[:1], batch_id)
        rows = self._read(entity, self._log(entity), key[:1], None).where(F.col("batch") == batch_id).select(*self.schemas[entity].names)
        known, indexes = rows.where("value is not null"), []
        if entity in OF_ORDERS:
            indexes.append(lambda: self._write(f"{entity}_by_order", known.select("value.order_id", *key).distinct(), ["order_id"], batch_id))
        if entity == "order_detail":
            indexes.append(lambda: self._write(LINES, known.select("value.product_id", "value.order_id", "value.create_time").distinct(), ["product_id"], batch_id))
        self.together(*indexes)
        return rows

    def staged(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` stored until the next batch, so that plans don't hold those of all that they come from."""
        path = self._path(f"work/{name}")
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def current(self, entity: str) -> DataFrame:
        return fold(self.log(entity), ENTITIES[entity])

    def _served(self, name: str, keys: DataFrame | None, before: int | None) -> DataFrame:
        """The newest row of each key, of batches before ``before`` (or all), without deleted ones."""
        table, key = SERVED[name]
        rest = [c for c in table.names if c not in (*key, "batch_id")]
        best = self._read(name, table, key, keys, before).groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("m")).select(*key, "m.*")
        return best.where("op = 'u'").drop("op")

    def orders(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Current orders."""
        return self._served("dws_order_current", keys, before)

    def daily(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The served metrics."""
        return self._served("ads_order_daily", keys, before)

    def serve(self, name: str, changed: DataFrame, batch_id: int) -> DataFrame:
        table, key = SERVED[name]
        self._write(name, changed.withColumn("batch_id", F.lit(batch_id).cast("long")).select(*table.names), key, batch_id)
        return self._read(name, table, key, None).where(F.col("batch") == batch_id).drop("batch")

    def compact(self, upto: int, ttl_days: int | None = None, now: datetime | None = None) -> None:
        """Rewrite what batches up to ``upto`` left: the newest row of each key, in one folder a bucket.

        With ``ttl_days``, keys of orders and their lines, payments and refunds whose newest change is older than that at
        ``now`` are forgotten; served rows and product versions stay. A tombstone is as old as its arrival. A crash on the way leaves rows
        twice, which no reader minds, and the positions of what is to be forgotten are noted first.
        """
        self.together(*[partial(self._compact_log, entity, upto, ttl_days, now) for entity in ENTITIES])
        self.together(partial(self._compact_lines, upto), *[partial(self._compact_served, name, upto) for name in SERVED])

    def _compact_log(self, entity: str, upto: int, ttl_days: int | None, now: datetime | None) -> None:
        key = ENTITIES[entity]
        rows = self._read(entity, self._log(entity), key[:1], None, upto + 1).drop("batch")
        kept = changelog.compact(rows, key)
        if ttl_days is not None and entity != VERSIONS:
            aged = rows.withColumn("__at", F.coalesce("value.update_time", "seen"))
            live = changelog.expire(aged, key, "__at", ttl_days, F.lit(now).cast("timestamp")).select(*key).distinct()
            gone = kept.join(live, key, "left_anti").groupBy("epoch", "partition").agg(F.max("offset").alias("upto"))
            self._replace(f"{entity}_forgotten", self._forgotten(entity).unionByName(gone).groupBy("epoch", "partition").agg(F.max("upto").alias("upto")).select(*MARKS.names), ["epoch"], upto)
            kept = kept.join(live, key, "left_semi")
        self._replace(entity, kept.select(*self._log(entity).names), key[:1], upto)
        if entity in OF_ORDERS:
            index = f"{entity}_by_order"
            live = self._read(entity, self._log(entity), key[:1], None).select(*key).distinct()
            self._replace(index, self._read(index, self._index(entity), ["order_id"], None, upto + 1).drop("batch").distinct().join(live, key, "left_semi").select(*self._index(entity).names), ["order_id"], upto)

    def _compact_lines(self, upto: int) -> None:
        with_lines = self._read("order_detail_by_order", self._index("order_detail"), ["order_id"], None).select("order_id").distinct()
        lines = self._read(LINES, self._index(LINES), ["product_id"], None, upto + 1).drop("batch").distinct()
        self._replace(LINES, lines.join(with_lines, "order_id", "left_semi").select(*self._index(LINES).names), ["product_id"], upto)

    def _compact_served(self, name: str, upto: int) -> None:
        table, key = SERVED[name]
        rows = self._read(name, table, key, None, upto + 1)
        rest = [c for c in table.names if c not in key]
        best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("m")).select(*key, "m.*").where("op = 'u'")
        self._replace(name, best.select(*table.names), key, upto)

    def _replace(self, name: str, rows: DataFrame, key: list[str], upto: int) -> None:
        """``rows`` instead of a table's folders up to batch ``upto``; compacted folders have negative numbers."""
        self._write(name, rows, key, -upto - 1)
        found = self._folders(name)
        age = lambda n: -n - 1 if n < 0 else n
        for n, folder in sorted(found, key=lambda x: age(x[0])):  # oldest first, so that no older row outlives what replaced it
            if n <= upto and n != -upto - 1:
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def _redated(state: OrderState, rows: DataFrame, batch_id: int) -> DataFrame:
    """product_id, since, until: the times in which another version holds than before the batch."""
    key, keys = ENTITIES[VERSIONS], rows.select("product_id").distinct()
    shown = ("product_name", "category_id", "category_name", "price")
    side = lambda before, name: fold(state.log(VERSIONS, keys, before), key).join(rows.select(*key).distinct(), key, "left_semi").select(*key, F.struct("effective_from", "effective_to", F.struct(*shown).alias("shown")).alias(name))
    both = side(batch_id, "a").join(side(None, "b"), key, "full_outer")
    same_start = (F.col("a.effective_from") == F.col("b.effective_from")) & F.col("a.shown").eqNullSafe(F.col("b.shown"))
    span = lambda x, y: F.struct(x.alias("since"), y.alias("until"))
    ends = span(F.least("a.effective_to", "b.effective_to"), F.greatest("a.effective_to", "b.effective_to"))
    whole = F.array(span(F.col("a.effective_from"), F.col("a.effective_to")), span(F.col("b.effective_from"), F.col("b.effective_to")))
    return both.select("product_id", F.inline(F.when(F.coalesce(same_start, F.lit(False)), F.array(ends)).otherwise(whole))).where("since < until")


def _touched(state: OrderState, arrived: dict[str, DataFrame], batch_id: int) -> DataFrame:
    """Orders that the batch's rows belong to now or belonged to before."""
    def part(entity: str, rows: DataFrame) -> DataFrame:
        if entity == "order_info":
            return rows.select("order_id")
        if entity == VERSIONS:
            when = state.staged("redated", _redated(state, rows, batch_id))
            hit = (F.col("create_time") >= F.col("since")) & (F.col("create_time") < F.col("until"))
            return state.lines(when).join(when, "product_id").where(hit).select("order_id")
        return state.log(entity, rows).select("value.order_id")  # a delete has no value, so its order is looked up in the log

    parts = state.together(*[partial(part, entity, rows) for entity, rows in arrived.items()])
    return reduce(DataFrame.unionByName, parts).where("order_id is not null").distinct()


def _current(state: OrderState, entity: str, touched: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Current rows of the touched orders; ``keys`` are those of an entity that orders own."""
    key = ENTITIES[entity]
    if keys is None:
        return fold(state.log(entity, touched), key)
    return fold(state.log(entity, keys), key).join(touched, "order_id", "left_semi")


def _remembered(now: DataFrame, old: DataFrame, owned: dict[str, DataFrame]) -> DataFrame:
    """Orders' rows, with the amounts served before where the state has neither payment (or refund) nor a tombstone of one."""
    out = now.join(old.select("order_id", *[F.col(f"{c}_amount").alias(f"__{c}") for c in ("payment", "refund")]), "order_id", "left")
    for c in ("payment", "refund"):
        out = out.join(owned[f"{c}_info"].select("order_id", F.lit(True).alias(f"__has_{c}")), "order_id", "left")
        out = out.withColumn(f"{c}_amount", F.when(F.col(f"__has_{c}"), F.col(f"{c}_amount")).otherwise(F.coalesce(f"__{c}", f"{c}_amount")))
    return out.select(*now.columns)


def apply_batch(state: OrderState, arrived: dict[str, DataFrame], batch_id: int) -> DataFrame:
    """Take in a batch of change rows by entity; the changes of the daily metrics (op 'u' or 'd')."""
    arrived = dict(zip(arrived, state.together(*[partial(state.receive, entity, rows, batch_id) for entity, rows in arrived.items()])))
    touched = state.staged("touched", _touched(state, arrived, batch_id))
    state._hit(touched, ["order_id"])  # once, before several ask for it
    known = lambda e: state.staged(f"{e}_keys", state.keys_of(e, touched, "order_id"))
    old, *found = state.together(lambda: state.staged("old", state.orders(batch_id, touched)), *[partial(known, e) for e in OF_ORDERS])
    keys = dict(zip(OF_ORDERS, found))
    owned = {e: keys[e].select("order_id").distinct() for e in OF_ORDERS}
    # Orders that were served, but whose header or lines are forgotten, stay as they are.
    whole = state.log("order_info", touched).select("order_id").distinct().join(owned["order_detail"], "order_id", "left_semi")
    stay = old.join(whole, "order_id", "left_anti").select("order_id")

    def lines_and_versions() -> tuple[DataFrame, DataFrame]:
        lines = state.staged("lines", _current(state, "order_detail", touched, keys["order_detail"]))
        products = state.staged("products", lines.select("product_id").distinct())
        return lines, fold(state.log(VERSIONS, products), ENTITIES[VERSIONS])

    others = [e for e in ENTITIES if e not in ("order_detail", VERSIONS)]
    (lines, versions), *rest = state.together(lines_and_versions, *[partial(_current, state, e, touched, keys.get(e)) for e in others])
    parts = {"order_detail": lines} | dict(zip(others, rest))
    wide = op.order_detail_wide(parts["order_detail"], parts["order_info"], versions, parts["payment_info"], parts["refund_info"], spread=False)
    changed = op.changes(old, _remembered(op.order_current(wide), old, owned), ["order_id"]).join(stay, "order_id", "left_anti")
    changed = state.serve("dws_order_current", changed, batch_id)

    names = [*GROUP, *COUNTS, *SUMS]
    came = op.daily(changed.where("op = 'u'")).select(*names)
    left = op.daily(old.join(changed.select("order_id"), "order_id", "left_semi")).select(*GROUP, *[(-F.col(c)).alias(c) for c in (*COUNTS, *SUMS)])
    delta = state.staged("delta", came.unionByName(left))
    before = state.daily(batch_id, delta.select(*GROUP).distinct()).select(*names)
    sums = [F.sum(c).cast(DAILY[c].dataType).alias(c) for c in (*COUNTS, *SUMS)]
    after = before.unionByName(delta).groupBy(*GROUP).agg(*sums).where("total_orders > 0")
    out = state.serve("ads_order_daily", op.changes(before, after, GROUP), batch_id)
    state.hit.clear()
    return out


def start(log: DataFrame, state: OrderState, checkpoint: str, compact_every: int = 100, ttl_days: int | None = 30, clock: Callable[[], datetime] = datetime.now, **trigger) -> StreamingQuery:
    """Run ``apply_batch`` on a stream of (entity, row) where ``row`` is the JSON of a change-log row. ``clock`` tells the state's time, too.

    Every ``compact_every`` batches the state is compacted, and what had no change for ``ttl_days`` is forgotten.
    """

    state.clock = clock

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        present = {r[0] for r in rows.select("entity").distinct().collect()}
        arrived = {e: rows.where(F.col("entity") == e).select(F.from_json("row", s).alias("r")).select("r.*") for e, s in state.schemas.items() if e in present}
        if arrived:
            apply_batch(state, arrived, batch_id)
        if batch_id % compact_every == compact_every - 1:
            state.compact(batch_id, ttl_days, clock())
        rows.unpersist()

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
