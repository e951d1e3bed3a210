"""Sources: JSON event logs, keyed change logs, JDBC range scans, Parquet partitions, bounded snapshots."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions.times import event_time

from .contracts import BEHAVIOR, Contract


def decode_json(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """JSON text to columns: mistyped or missing fields become null, unparseable records are skipped."""
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in corrupt.fields])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.select("*", F.from_json(column, nullable, options).alias("_r"))
    # A mistyped field marks the whole record corrupt too; only text that is no JSON object at all goes.
    readable = F.col(column).isNotNull() & F.try_parse_json(column).isNotNull() & F.trim(column).startswith("{")
    keep = [c for c in lines.columns if c != column]
    return parsed.where(readable).select(*keep, *[F.col(f"_r.{f.name}") for f in schema.fields])


def with_event_time(events: DataFrame) -> DataFrame:
    """Adds event_ts and proc_time, which the lookups use."""
    return events.withColumn("event_ts", event_time()).withColumn("proc_time", F.current_timestamp())


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines event log."""
    return decode_json(spark.read.text(path), BEHAVIOR.schema)


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same log as a stream of files."""
    return decode_json(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), BEHAVIOR.schema)


def stream_kafka(spark: SparkSession, servers: str, topics: Sequence[str], starting: str = "earliest", most_per_batch: int = 1_000_000) -> DataFrame:
    """Kafka topics as (key, value, topic, partition, offset), what the loaders read; needs the connector on the class path.

    Offsets lie in the query's checkpoint; ``starting`` counts only where there is none. Records that
    the broker has dropped since are an error, not a gap.
    """
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": starting, "failOnDataLoss": "true", "maxOffsetsPerTrigger": str(most_per_batch)}
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.selectExpr("CAST(key AS STRING) key", "CAST(value AS STRING) value", "topic", "partition", "offset")


def snapshot(log: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bounded scan of a log: rows with low <= offset < high per (topic, partition).

    Second result, per partition: read, wanted, complete. An empty partition is complete.
    """
    rows = log.join(F.broadcast(marks), ["topic", "partition"]).where("offset >= low and offset < high")
    read = rows.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("read"), F.max("offset").alias("last"))
    state = marks.join(read, ["topic", "partition"], "left").select(
        "topic", "partition", F.coalesce("read", F.lit(0)).alias("read"), (F.col("high") - F.col("low")).alias("wanted"),
        ((F.col("high") <= F.col("low")) | F.coalesce(F.col("last") >= F.col("high") - 1, F.lit(False))).alias("complete"),
    )
    return rows.drop("low", "high"), state


def watermarks(log: DataFrame) -> DataFrame:
    """topic, partition, low, high of a log as it is now, fixed: a row a partition, which later entries don't change."""
    found = log.groupBy("topic", "partition").agg(F.min("offset").alias("low"), (F.max("offset") + 1).alias("high"))
    return log.sparkSession.createDataFrame(found.collect(), found.schema)


@dataclass(frozen=True)
class Scan:
    """What a bounded scan read: rows; whether every partition was read to its mark; whether a limit cut it short."""

    rows: DataFrame
    scanned: int
    complete: bool
    truncated: bool


def scan(log: DataFrame, marks: DataFrame | None = None, limit: int | None = None) -> Scan:
    """A log's entries up to ``marks``, those of the moment by default; ``limit`` keeps the entries of the smallest offsets only."""
    marks = watermarks(log) if marks is None else marks
    rows, state = snapshot(log, marks)
    if limit is not None:
        rows, state = snapshot(rows.orderBy("offset", "topic", "partition").limit(limit), marks)
    read = state.agg(F.sum("read").alias("read"), F.count_if(~F.col("complete")).alias("open")).first()
    scanned, complete = read["read"] or 0, not read["open"]
    return Scan(rows, scanned, complete, not complete and limit is not None and scanned >= limit)


def read_versions(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """Files of a contract's versions, in folders ``version=N``, read as its newest: fields that a version didn't have yet take the contract's fill.

    A null in a file that has the field stays null; files of a version beyond the contract's are an error.
    """
    fields = [T.StructField(f.name, f.dataType) for f in contract.schema.fields]
    rows = spark.read.schema(T.StructType([*fields, T.StructField("version", T.IntegerType())])).option("basePath", path).parquet(path)
    known = F.assert_true(F.col("version") <= contract.version, F.lit(f"a newer version than {contract.version} of {contract.name}"))
    fill = lambda f: F.when(F.col("version") < contract.since[f.name][0], F.expr(contract.since[f.name][1])).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in contract.since else F.col(f.name)
    return rows.where(known.isNull()).select(*[fill(f) for f in contract.schema.fields])


def jdbc_range_query(entity: str, columns: list[str], start: date, end: date, scan_time: bool = False) -> str:
    """A ``dbtable`` subquery with pruned columns and a half-open date range on the order's creation.

    With ``scan_time`` the creation time is a column of that name.
    """
    at = "t" if entity == "order_info" else "o"
    picked = ", ".join([*(f"t.{c}" for c in columns), *([f"{at}.create_time AS scan_time"] if scan_time else [])])
    join = "" if entity == "order_info" else " JOIN order_info o ON o.order_id = t.order_id"
    return f"(SELECT {picked} FROM {entity} t{join} WHERE {at}.create_time >= '{start} 00:00:00' AND {at}.create_time < '{end} 00:00:00') scan"


def read_jdbc_range(spark: SparkSession, url: str, entity: str, columns: list[str], start: date, end: date, slices: int = 8, **options: str) -> DataFrame:
    """The rows of a date range, in ``slices`` half-open slices of the creation time: each is read by a task over a connection of its own."""
    days = (end - start).days
    edges = sorted({start + timedelta(days * i // slices) for i in range(slices + 1)})
    parts = [f"scan_time >= '{a} 00:00:00' AND scan_time < '{b} 00:00:00'" for a, b in zip(edges, edges[1:])]
    rows = spark.read.jdbc(url, jdbc_range_query(entity, columns, start, end, True), predicates=parts, properties=options)
    return rows.select(*[F.col(c).alias(c) for c in columns])


class Lookup:
    """A dimension whose copy is read again once it is older than ``ttl_s``; call it for the current copy."""

    def __init__(self, read: Callable[[], DataFrame], ttl_s: float = 60, clock: Callable[[], float] = time.monotonic):
        self.read, self.ttl_s, self.clock = read, ttl_s, clock
        self.copy: DataFrame | None = None
        self.at = 0.0

    def __call__(self) -> DataFrame:
        if self.copy is None or self.clock() - self.at >= self.ttl_s:
            old, self.copy, self.at = self.copy, self.read().persist(), self.clock()
            self.copy.count()  # now, so that the copy is of one time
            if old is not None:
                old.unpersist()
        return self.copy


def jdbc_lookup(spark: SparkSession, url: str, table: str, columns: Sequence[str], ttl_s: float = 60, clock: Callable[[], float] = time.monotonic, **options: str) -> Lookup:
    """A dimension table behind JDBC: only ``columns`` are read, again after ``ttl_s``."""

    def read() -> DataFrame:
        rows = spark.read.jdbc(url, f"(SELECT {', '.join(columns)} FROM {table}) lookup", properties=options)
        return rows.select(*[F.col(c).alias(c) for c in columns])

    return Lookup(read, ttl_s, clock)


def orders_in_range(orders: DataFrame, start: date, end: date) -> DataFrame:
    return orders.where((F.col("create_time") >= F.lit(str(start)).cast("timestamp")) & (F.col("create_time") < F.lit(str(end)).cast("timestamp")))


def of_orders(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Payments or refunds of the given orders: at most one row an order, so a semi-join equals the join."""
    return rows.join(orders.select("order_id"), "order_id", "left_semi")


def captured(rows: DataFrame, contract: Contract, deleted: Column, partition: Column) -> DataFrame:
    """The change log of a captured table: its snapshot ('r'), then the deletes of the ``deleted`` rows ('d')."""
    read = change_log(rows, contract, F.lit("r"), partition, F.lit(0))
    return read.unionByName(change_log(rows.where(deleted), contract, F.lit("d"), partition, F.lit(1)))


def change_log(rows: DataFrame, contract: Contract, op: Column, partition: Column, offset: Column, epoch: int = 128) -> DataFrame:
    """Rows of a source table as a keyed change log: key columns, op, position, value struct (null for a delete)."""
    value = F.struct(*[F.col(f.name) for f in contract.schema.fields if f.name in rows.columns])
    return rows.select(
        *contract.key, op.alias("op"), F.lit(epoch).alias("epoch"), partition.cast("int").alias("partition"), offset.cast("long").alias("offset"),
        F.when(op != "d", value).alias("value"),
    )


def read_serving(spark: SparkSession, path: str, key: list[str], where: Column | None = None) -> DataFrame:
    """Logical rows of a versioned serving table: the newest version of each key, without deleted ones, then ``where``.

    Rows are dealt by key before they are grouped, so that no task sorts its whole split.
    """
    from weir.operators.changelog import active

    out = active(spark.read.option("recursiveFileLookup", "true").parquet(path).repartition(*key), key)
    return out if where is None else out.where(where)


def read_http_rows(spark: SparkSession, urls: Sequence[str], schema: T.StructType, timeout_s: float = 30) -> DataFrame:
    """A typed frame of what HTTP sources answer, one JSON object a line. Each URL, say one for each day, is fetched by a task."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url in b.column("url").to_pylist():
                lines: list[str] = []
                with urllib.request.urlopen(url, timeout=timeout_s) as answer:
                    for line in answer:
                        if line.strip():
                            lines.append(line.decode())
                        if len(lines) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(lines)], ["value"])
                            lines = []
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    asked = spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, len(urls)))
    return typed_rows(asked.mapInArrow(fetch, "value string"), schema)


def typed_rows(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON objects with typed fields, whether numbers are quoted (as 64-bit ones often are) or not; null where a value doesn't fit."""
    texts = decode_json(lines, T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]))
    return texts.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def rows_frame(spark: SparkSession, lines: list[str], schema: T.StructType) -> DataFrame:
    """A typed frame of JSON rows that an HTTP source returned (one object a line)."""
    return typed_rows(spark.createDataFrame([(x,) for x in lines if x.strip()], "value string"), schema)
