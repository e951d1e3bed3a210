"""Keyed change logs: versions, latest state per key, tombstones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.versions import ingest_version


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of largest ``order`` of each key: one aggregation, whose partial maxima are all that is shuffled.

    Two rows of a key with equal order are settled by the other columns, so that results repeat.
    """
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("__m"))
    return best.select(*[c if c in key else F.col(f"__m.{c}").alias(c) for c in rows.columns])


def fold(log: DataFrame, key: Sequence[str], keep_deleted: bool = False) -> DataFrame:
    """Current state of a change log (key, op, epoch, partition, offset, value).

    The newest entry of each key counts; only then are deleted keys left out, so a delete never
    brings an older value back. With ``keep_deleted`` they stay, with ``is_deleted`` 1 and null values.

    Entries are dealt by key before they are grouped: rows of structs are grouped by sorting, so partial groups would sort a task's whole input.
    """
    versioned = log.repartition(*key).withColumn("ingest_version", ingest_version(F.col("epoch"), F.col("offset"), F.col("partition")))
    now = versioned.groupBy(*key).agg(F.max_by(F.struct("ingest_version", "value"), "ingest_version").alias("__m"))
    out = now.select(*key, F.col("__m.ingest_version").alias("ingest_version"), F.when(F.col("__m.value").isNull(), 1).otherwise(0).cast("byte").alias("is_deleted"), F.col("__m.value").alias("value"))
    fields = [f.name for f in log.schema["value"].dataType.fields if f.name not in key]
    if not keep_deleted:
        out = out.where("is_deleted = 0")
    return out.select(*key, *[F.col(f"value.{f}").alias(f) for f in fields], "ingest_version", "is_deleted")


def showing(log: DataFrame, *fields: str) -> DataFrame:
    """A change log whose values are null but for ``fields``; deletes stay deletes.

    The optimizer can't see which fields of a value are used behind ``fold``, and would deal all of them.
    """
    kind = log.schema["value"].dataType
    kept = [(F.col("value")[f.name] if f.name in fields else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields]
    return log.withColumn("value", F.when(F.col("value").isNotNull(), F.struct(*kept)))


def tombstone(record_value: Column, soft_delete: bool) -> Column:
    """What a null value means: 'delete' for soft-delete topics, 'ignore' for others, 'row' if there is a value."""
    return F.when(record_value.isNotNull(), "row").otherwise("delete" if soft_delete else "ignore")


def active(serving: DataFrame, key: Sequence[str]) -> DataFrame:
    """Logical read of a versioned serving table: newest version of each key, then without deleted ones."""
    return latest(serving, key, ["ingest_version"]).where("is_deleted = 0")


def duplicate_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def compact(log: DataFrame, key: Sequence[str], drop_tombstones: bool = False) -> DataFrame:
    """A log with the newest entry of each key only; tombstones stay until ``drop_tombstones``. Dealt by key first, as in ``fold``."""
    versioned = log.repartition(*key).withColumn("__v", ingest_version(F.col("epoch"), F.col("offset"), F.col("partition")))
    out = versioned.groupBy(*key).agg(F.max_by(F.struct(*[c for c in log.columns if c not in key]), "__v").alias("__m")).select(*key, "__m.*")
    return out.where("value is not null") if drop_tombstones else out


def expire(log: DataFrame, key: Sequence[str], time: str, days: int, now: Column) -> DataFrame:
    """A log without the keys whose newest ``time`` is more than ``days`` old: state with a time to live.

    A change that comes later finds no state, as in any store that forgets.
    """
    newest = log.groupBy(*key).agg(F.max(time).alias("__t")).where(F.col("__t") >= now - F.make_dt_interval(F.lit(days)))
    return log.join(newest.select(*key), list(key), "left_semi")
