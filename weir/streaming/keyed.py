"""Orders as keyed state: each order's header, lines, payments and refunds in a state store, retractions out.

One stream of changes (``of_log``) is dealt by group of orders. The processor keeps the newest change of each key, tombstones
included, and what it last gave out for each order. When that changes it gives out the old row with sign -1 and the new one with
sign 1, so that sums over its output are the metrics at any time, however often an order changes. A micro-batch
touches the state of its own orders' groups only, and of these it parses its own orders only. A key costs several round trips between
Python and the state store whatever it holds, so groups of some dozens of orders are much cheaper than orders of their own.

State ages in event time. An order without a change for ``ttl_days`` is forgotten: its group's timer frees its changes and gives out nothing. The
row that was given out stays, without which a later change could not be told from a new order's: until header and lines
are known again nothing is given out, and amounts of payments or refunds that aren't known stay as they were. Changes older than
the newest by more than ``ttl_days`` are late; Spark drops them, so what the log delivers again brings nothing back.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

CHANGES = "order_id string, entity string, id string, epoch int, position long, part int, at timestamp, deleted boolean, channel string, order_status string, order_date string, amount decimal(12,2)"
SIGNED = "order_id string, sign int, order_date string, channel string, order_status string, order_amount decimal(12,2), payment_amount decimal(12,2), refund_amount decimal(12,2)"
#: Entity -> the column of its key, the one of its amount.
ENTITIES = {"order_info": ("order_id", "order_amount"), "order_detail": ("detail_id", None), "payment_info": ("payment_id", "payment_amount"), "refund_info": ("refund_id", "refund_amount")}
_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Groups of orders, unless told: so many that each of some million orders is a group of its own.
GROUPS = 1 << 20
_NAMES = [f.split()[0] for f in SIGNED.split(", ")]
#: What is told of a change beside its order and time; the first two name its key, the others are ``Known``.
_CHANGE = ("entity", "id", "epoch", "position", "part", "deleted", "channel", "order_status", "order_date", "amount")
Known = namedtuple("Known", ("epoch", "position", "part", "deleted", "channel", "order_status", "order_date", "amount"))


def of_log(entity: str, log: DataFrame, order_id: Column | None = None, at: Column | None = None) -> DataFrame:
    """A change log (key, op, epoch, partition, offset, value) as changes of orders.

    A tombstone has no value: ``order_id`` tells its order (of an order itself the key does), ``at`` its time. Without
    them it is left out.
    """
    key, amount = ENTITIES[entity]
    header = entity == "order_info"
    value = lambda name: F.col(f"value.{name}") if header else F.lit(None).cast("string")
    out = log.select(
        F.coalesce(F.col("order_id") if header else F.col("value.order_id"), order_id if order_id is not None else F.lit(None)).alias("order_id"), F.lit(entity).alias("entity"), F.col(key).alias("id"),
        "epoch", F.col("offset").alias("position"), F.col("partition").alias("part"), F.coalesce("value.update_time", at if at is not None else F.lit(None)).cast("timestamp").alias("at"), F.col("value").isNull().alias("deleted"),
        value("channel").alias("channel"), value("order_status").alias("order_status"), (F.date_format("value.create_time", "yyyy-MM-dd") if header else F.lit(None).cast("string")).alias("order_date"),
        (F.col(f"value.{amount}") if amount else F.lit(None)).cast("decimal(12,2)").alias("amount"),
    )
    return out.where("order_id is not null and at is not null")


class OrderProcessor(StatefulProcessor):
    """The changes of a group's orders, and the row last given out for each: one value, since each access of state is a round trip."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("orders", "due long, orders string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.state.get()
        due, orders = (None, {}) if stored is None else (stored[0], _read_orders(stored[1]))
        touched = {}
        for r in rows:
            if r[1] not in touched:
                at, known, old = _read_order(orders.get(json.dumps(r[1])))
                touched[r[1]] = [at or 0, known, old]
            order = touched[r[1]]
            order[0] = max(order[0], int(r[2].timestamp() * 1000))
            values = list(json.loads(r[3]).values())
            own, value = tuple(values[:2]), _known(values[2:])
            if own not in order[1] or value[:3] > order[1][own][:3]:
                order[1][own] = value
        out = []
        for order_id, (at, known, old) in touched.items():
            new = self._current(known, old)
            orders[json.dumps(order_id)] = _write_order(at, known, new)
            if new != old:
                out.extend(Row(**dict(zip(_NAMES, (order_id, sign, *values)))) for sign, values in ((-1, old), (1, new)) if values is not None)
        self._store(orders, due)
        yield from out

    def _store(self, orders: dict[str, str], due: int | None) -> None:
        """Keep ``orders``, with a timer, in place of the one at ``due``, for the first that is to be forgotten."""
        first = min((int(at) for at in (text.partition("\t")[0] for text in orders.values()) if at), default=None)
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if first is not None:
                self.handle.registerTimer(first)
        if orders:
            self.state.update((first, _write_orders(orders)))
        else:
            self.state.clear()

    @staticmethod
    def _current(known: dict[tuple, Known], old: tuple | None) -> tuple | None:
        """The order's row by what is known, None if there is none; ``old`` where too much is forgotten to tell."""
        header, lines, amounts = None, [], {"payment_info": [], "refund_info": []}
        for (entity, _), value in known.items():
            if entity == "order_info":
                header = value
            elif entity == "order_detail":
                lines.append(value)
            else:
                amounts[entity].append(value)
        if header is None or not lines:
            return old
        if header.deleted or all(x.deleted for x in lines):
            return None
        sums = []
        for i, own in enumerate(amounts.values()):
            if own or old is None:
                sums.append(max([Decimal(0), *(x.amount or Decimal(0) for x in own if not x.deleted)]).quantize(Decimal("0.01")))
            else:
                sums.append(old[4 + i])
        return (header.order_date, header.channel, header.order_status, header.amount, *sums)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Free the state of orders that had no change for their time; nothing is given out."""
        orders, expired = _read_orders(self.state.get()[1]), expiredTimerInfo.getExpiryTimeInMs()
        upto = max(expired, timerValues.getCurrentWatermarkInMs() - 1)
        left = {}
        for order_id, text in orders.items():
            at, _, given = text.split("\t")
            if not at or int(at) > upto:
                left[order_id] = text
            elif given:
                left[order_id] = f"\t[]\t{given}"
        self._store(left, expired)
        return iter(())

    def close(self) -> None:
        pass


def _write_known(known: dict[tuple, Known]) -> str:
    return json.dumps([[*own, *value] for own, value in known.items()], default=str)


def _known(values: list) -> Known:
    """Of a change's values; amounts are text."""
    return Known(*values[:7], None if values[7] is None else Decimal(values[7]))


def _read_known(text: str) -> dict[tuple, Known]:
    """The changes of an order by entity and key; amounts are text in the state."""
    return {(x[0], x[1]): _known(x[2:]) for x in json.loads(text)}


def _read_given(text: str | None) -> tuple | None:
    if text is None:
        return None
    values = json.loads(text)
    return (*values[:3], *[None if v is None else Decimal(v) for v in values[3:]])


def _write_order(at: int, known: dict[tuple, Known], given: tuple | None) -> str:
    """When the order changed last, its changes, and the row given out, none of which has a tab or an end of line in it."""
    return f"{at}\t{_write_known(known)}\t{'' if given is None else json.dumps(given, default=str)}"


def _read_order(text: str | None) -> tuple[int | None, dict[tuple, Known], tuple | None]:
    if text is None:
        return None, {}, None
    at, known, given = text.split("\t")
    return int(at) if at else None, _read_known(known), _read_given(given or None)


def _write_orders(orders: dict[str, str]) -> str:
    """A group: a line an order, its key as JSON first, so that orders which aren't touched are never parsed."""
    return "\n".join(f"{order_id}\t{text}" for order_id, text in orders.items())


def _read_orders(text: str) -> dict[str, str]:
    return dict(line.split("\t", 1) for line in text.split("\n"))


def signed_orders(changes: DataFrame, ttl_days: int = 30, groups: int = GROUPS) -> DataFrame:
    """A stream of orders' rows with signs from a stream of ``CHANGES``; orders are dealt to ``groups`` by their hash."""
    group = F.pmod(F.xxhash64("order_id"), F.lit(groups)).alias("group")
    # Python takes rows value by value, so a change is one.
    change = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if c == "amount" else F.col(c) for c in _CHANGE]), {"ignoreNullFields": "false"}).alias("change")
    dealt = changes.withWatermark("at", f"{ttl_days} days").select(group, "order_id", "at", change)
    return dealt.groupBy("group").transformWithState(OrderProcessor(), T.StructType.fromDDL(SIGNED), "Append", "EventTime")


def start(changes: DataFrame, out: str, checkpoint: str, ttl_days: int = 30, groups: int = GROUPS, partitions: int | None = None, **trigger) -> StreamingQuery:
    """Append ``signed_orders`` to Parquet files under ``out``, each once; state lies in RocksDB.

    ``groups`` and ``partitions`` of the state (as many as the session shuffles to, unless told) stay those of the checkpoint. Each partition costs some
    time in each batch, however little it holds.
    """
    spark = changes.sparkSession
    own = _ROCKS | ({} if partitions is None else {"spark.sql.shuffle.partitions": str(partitions)})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        stream = signed_orders(changes, ttl_days, groups).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
        return stream.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def metrics(signed: DataFrame, *by: str) -> DataFrame:
    """Counts by status (refunded orders count as paid) and sums of amounts, per ``by``, of rows with signs."""
    s, sign = F.col("order_status"), F.col("sign")
    count = lambda when, name: F.sum(F.when(when, sign).otherwise(0)).alias(name)
    total = lambda c, name: F.sum(F.col(c) * sign).cast("decimal(22,2)").alias(name)
    out = signed.groupBy(*by).agg(
        F.sum("sign").alias("total_orders"), count(s.isin("PAID", "REFUNDED"), "paid_orders"), count(s == "CANCELLED", "cancelled_orders"), count(s == "REFUNDED", "refunded_orders"),
        total("order_amount", "order_amount"), total("payment_amount", "paid_amount"), total("refund_amount", "refund_amount"),
    )
    return out.where("total_orders > 0")


def read_changes(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of ``CHANGES`` from Parquet files, ``files`` a batch."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files).parquet(path)
