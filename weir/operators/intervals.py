"""Join of rows to the intervals of their key that hold at their time, with hot keys spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are spread at most, the most frequent ones; each other key has less than this part of all rows.
HOT_KEYS = 1024
#: Rows that a key needs to be spread.
HOT_ROWS = 100_000
#: Cells of time and salts within a cell of a hot key.
CELLS, SALTS = 64, 16


def hot_keys(rows: DataFrame, key: str, time: str, at_least: int = HOT_ROWS, bounds: DataFrame | None = None) -> DataFrame:
    """key, lo, step: the most frequent keys, where their time begins and how long a cell of it is, in microseconds; ``HOT_KEYS`` rows at most.

    With ``bounds``, a row with the first and last ``time`` of all, rows need no time of their own.
    """
    t = F.unix_micros(time)
    span = (F.min(t).alias("lo"), F.max(t).alias("hi"))
    if bounds is None:
        counts = rows.where(F.col(key).isNotNull() & t.isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *span)
    else:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least).crossJoin(F.broadcast(bounds.agg(*span)))
    top = counts.where(F.col("n") >= at_least).orderBy(F.desc("n"), key).limit(HOT_KEYS)
    return top.select(key, "lo", F.expr(f"(hi - lo) div {CELLS} + 1").alias("step"))


def at_time(rows: DataFrame, spans: DataFrame, key: str, time: str, since: str, until: str, at_least: int = HOT_ROWS, hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined on ``key`` to the ``spans`` with since <= time < until; the columns of both, ``key`` once.

    The join hashes on the key. A key that many rows have is joined by cell of its time and by salt, too: its intervals are given
    to the cells that they meet, and to each salt, which multiplies the intervals of at most ``HOT_KEYS`` keys and never the rows. Null keys,
    times and bounds match nothing, and repeated rows stay repeated. ``hot``, as of ``hot_keys``, saves the count of ``rows``, which are computed twice
    otherwise; it decides cost, never results, so it may come from other rows and bounds: times outside lie in the first or last cell.
    """
    hot = hot_keys(rows, key, time, at_least) if hot is None else hot
    hot = F.broadcast(hot.select(F.col(key).alias("__hot"), F.col("lo").alias("__lo"), F.col("step").alias("__step")))
    is_hot = F.col("__hot").isNotNull()

    def cell(t: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit(CELLS - 1).cast("long"), F.call_function("div", t - F.col("__lo"), F.col("__step"))))

    placed = rows.join(hot, F.col(key) == F.col("__hot"), "left").select(
        *rows.columns, F.when(is_hot, cell(F.unix_micros(time))).otherwise(0).cast("int").alias("__cell"), F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int").alias("__salt")
    )
    first, last = cell(F.unix_micros(since)), cell(F.unix_micros(until) - 1)
    cells = F.when(~is_hot, F.array(F.lit(0))).when(first <= last, F.sequence(first.cast("int"), last.cast("int")))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = spans.join(hot, F.col(key) == F.col("__hot"), "left").select(*spans.columns, F.explode(cells).alias("__cell"), salts.alias("__salts"))
    dealt = dealt.select(*spans.columns, "__cell", F.explode("__salts").alias("__salt"))
    holds = (F.col(time) >= F.col(since)) & (F.col(time) < F.col(until))
    return placed.join(dealt, [key, "__cell", "__salt"]).where(holds).drop("__cell", "__salt")
