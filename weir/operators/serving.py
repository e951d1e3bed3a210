"""Reads of the serving tables: newest windows, rankings, BI rows, alerts, freshness."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.sources.sinks import append, stored


def newest(df: DataFrame, n: int, *order: Column, by: str = "window_start") -> DataFrame:
    """The n rows of largest ``by``, ties by ``order``."""
    return df.orderBy(F.desc(by), *order).limit(n)


def latest_window(df: DataFrame, *order: Column, n: int | None = None) -> DataFrame:
    """Rows of the newest window."""
    top = df.agg(F.max("window_start").alias("__top"))
    out = df.join(F.broadcast(top), F.col("window_start") == F.col("__top")).drop("__top").orderBy(*order)
    return out.limit(n) if n else out


def top_n_per_window(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each window, with their rank."""
    rank = F.row_number().over(Window.partitionBy("window_start").orderBy(*order))
    return df.withColumn("rn", rank).where(F.col("rn") <= n)


def trend(overview: DataFrame, n: int = 30) -> DataFrame:
    """The newest n windows, oldest first."""
    return newest(overview, n).orderBy("window_start")


def net_paid(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("net_paid_amount", F.col("paid_amount") - F.col("refund_amount"))


def bi_measures(daily: DataFrame) -> DataFrame:
    """Pay rate, refund rate and paid ticket size per channel; null where there is nothing to divide by."""
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b.cast("double"))
    s = daily.groupBy("channel").agg(*[F.sum(c).alias(c) for c in ("total_orders", "paid_orders", "refunded_orders", "paid_amount")])
    return s.select(
        "channel", ratio(F.col("paid_orders"), F.col("total_orders")).alias("pay_rate"), ratio(F.col("refunded_orders"), F.col("paid_orders")).alias("refund_rate"),
        ratio(F.col("paid_amount"), F.col("paid_orders")).alias("paid_ticket"),
    )


def version_measures(versions: DataFrame) -> DataFrame:
    """Products, versions, current versions and products that changed price."""
    per = versions.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_current") == 1).alias("c"))
    return per.agg(
        F.count(F.lit(1)).alias("products"), F.coalesce(F.sum("n"), F.lit(0)).alias("versions"), F.coalesce(F.sum("c"), F.lit(0)).alias("current_versions"),
        F.count_if(F.col("n") >= 2).alias("repriced_products"),
    )


#: Windows of which the moving mean is taken in one task.
RANGE = 4096


def moving_mean(overview: DataFrame, before: int = 5, length: int = RANGE) -> DataFrame:
    """Each window with the mean amount of the ``before`` windows that precede it.

    Windows are numbered by their times: by day, days by year, and years by their counts, of which the driver has one a calendar year. Runs
    of ``length`` windows are averaged side by side, each with the last ``before`` of the run before it.
    """
    rows = overview.select("window_start", F.col("pay_amount"), F.to_date("window_start").alias("day"))
    days = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n")).withColumn("year", F.year("day"))
    by_year = sorted((r["year"], r["n"]) for r in days.groupBy("year").agg(F.sum("n").alias("n")).collect())
    upto, starts = 0, []
    for year, n in by_year:
        starts.append((year, upto))
        upto += n
    starts = rows.sparkSession.createDataFrame(starts, "year int, year_start long")
    in_year = F.coalesce(F.sum("n").over(Window.partitionBy("year").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("in_year", in_year).join(F.broadcast(starts), "year").select("day", (F.col("year_start") + F.col("in_year")).alias("day_start"))
    number = F.col("day_start") + F.row_number().over(Window.partitionBy("day").orderBy("window_start")) - 1
    numbered = rows.join(days, "day").select("window_start", "pay_amount", number.alias("number"))
    own = F.floor(F.col("number") / length)
    last = F.col("number") % length >= length - before
    runs = F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))).alias("run")
    mean = F.avg(F.col("pay_amount").cast("double")).over(Window.partitionBy("run").orderBy("number").rowsBetween(-before, -1))
    out = numbered.select("*", runs).withColumn("mean_before", mean)
    return out.where(F.col("run") == own).select("window_start", "pay_amount", "mean_before")


def alerts(overview: DataFrame) -> DataFrame:
    """What is wrong with the newest window: alert_type, alert_level, metric_name, metric_value."""
    last = newest(overview, 6)
    n = F.row_number().over(Window.orderBy(F.desc("window_start")))
    rows = last.withColumn("rn", n)
    first = lambda c: F.max(F.when(F.col("rn") == 1, F.col(c))).alias(c)
    one = rows.agg(
        *[first(c) for c in ("window_start", "window_end", "pay_amount", "pay_users", "uv")], F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("rn") > 1, F.col("pay_amount").cast("double"))).alias("mean"),
    ).where("n > 0")
    amount, users, uv = F.col("pay_amount").cast("double"), F.col("pay_users"), F.col("uv")

    def alert(kind: str, level: str, metric: str, value: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("alert_type"), F.lit(level).alias("alert_level"), F.lit(metric).alias("metric_name"), value.cast("double").alias("metric_value")))

    rate = users / F.nullif(uv, F.lit(0))
    found = F.array(
        alert("pay_amount_zero", "WARNING", "pay_amount", F.lit(0.0), amount == 0), alert("pay_users_zero", "WARNING", "pay_users", F.lit(0.0), users == 0),
        alert("pay_amount_drop", "CRITICAL", "pay_amount", amount, (F.col("n") >= 5) & (F.col("mean") > 0) & (amount < F.col("mean") * 0.5)),
        alert("low_conversion", "WARNING", "conversion_rate", rate, (uv > 100) & (rate < 0.01)),
    )
    return one.select("window_start", "window_end", F.inline(F.array_compact(found)))


def fresh_alerts(found: DataFrame, sent: DataFrame) -> DataFrame:
    """Alerts that were not sent before for their window."""
    return found.join(sent, ["window_start", "alert_type"], "left_anti")


def store_alerts(found: DataFrame, path: str) -> int:
    """Append the alerts that the store doesn't have for their window yet; how many these are."""
    new = fresh_alerts(found, stored(found, path).select("window_start", "alert_type")).persist()
    n = new.count()
    if n:
        append(new, path)
    new.unpersist()
    return n


def recent_alerts(sent: DataFrame, n: int = 50) -> DataFrame:
    """The newest n stored alerts."""
    return newest(sent, n, F.col("alert_type"))


class FreshnessState:
    """What a freshness exporter knows: of each pipeline the newest answer, and how the rounds of questions went.

    A pipeline whose question fails keeps its older answer. With ``stale_after_s`` the text has more series: whether a pipeline has
    data, its newest business time, the age from which it counts as stale, and the time of the latest round.
    """

    def __init__(self, clock: Callable[[], float] = time.time, stale_after_s: float | None = None):
        self.clock, self.stale_after_s = clock, stale_after_s
        self.answers: dict[str, float] = {}
        self.asked: set[str] = set()
        #: (time, questions that failed) of the latest round and of the latest without failures; failures of all rounds.
        self.latest, self.clean, self.failures = (0.0, 1), (0.0, 0), 0

    last_epoch = property(lambda self: self.answers)
    success = property(lambda self: int(self.latest[1] == 0))
    last_success = property(lambda self: self.clean[0])

    def collect(self, queries: dict[str, Callable[[], float]]) -> None:
        """A round: each pipeline's newest business time, in epoch seconds, from its query."""
        new = {pipeline: answer for pipeline, query in queries.items() if (answer := _answer(query)) is not None}
        self.answers, self.asked = self.answers | new, self.asked | set(queries)
        self.latest = (self.clock(), len(queries) - len(new))
        self.failures += self.latest[1]
        self.clean = self.clean if self.latest[1] else self.latest

    def stale(self) -> list[str]:
        """Pipelines whose data is older than ``stale_after_s``, or missing."""
        now = self.clock()
        return sorted(p for p in self.asked if self.stale_after_s is not None and now - max(0.0, self.answers.get(p, 0.0)) > self.stale_after_s)

    def text(self) -> str:
        """The state as Prometheus text; pipelines without an answer have no age."""
        now, series = self.clock(), []
        known = {p: t for p, t in sorted(self.answers.items()) if t > 0}
        for p, t in known.items():
            series.append((f'age_seconds{{pipeline="{p}"}}', max(0.0, now - t)))
        series += [("collection_success", self.success), ("collection_failures_total", self.failures), ("last_success_unixtime_seconds", self.last_success)]
        if self.stale_after_s is not None:
            series += [("stale_threshold_seconds", self.stale_after_s), ("last_collection_unixtime_seconds", self.latest[0])]
            series += [(f'available{{pipeline="{p}"}}', int(p in known)) for p in sorted(self.asked)]
            series += [(f'max_business_unixtime_seconds{{pipeline="{p}"}}', t) for p, t in known.items()]
        return "".join(f"freshness_{name} {value:.12g}\n" for name, value in series)


def _answer(query: Callable[[], float]) -> float | None:
    """What a query gives; None if it fails, whatever of, so that the others go on."""
    try:
        return query()
    except Exception:  # noqa: BLE001
        return None


def freshness_queries(facts: DataFrame, wide: DataFrame, overview: DataFrame, zone: str = "UTC") -> dict[str, Callable[[], float]]:
    """A query of the newest business time of each pipeline, for ``FreshnessState``."""
    rows = freshness(facts, wide, overview, F.lit(0), zone)
    return {p: lambda p=p: rows.where(F.col("pipeline") == p).first()["last_epoch"] for p in ("behavior_dwd", "order_dwd", "behavior_ads")}


def _epoch(c: str, zone: str) -> Column:
    """Epoch seconds of business wall-clock time in ``zone``; 0 for null."""
    return F.coalesce(F.unix_micros(F.to_utc_timestamp(F.col(c), zone)) / 1_000_000, F.lit(0.0))


def freshness(facts: DataFrame, wide: DataFrame, overview: DataFrame, now: Column, zone: str = "UTC") -> DataFrame:
    """pipeline, last_epoch, available, age_seconds of the three pipelines.

    Wall-clock columns are business time in ``zone`` (checked by name). Age is never negative.
    """
    if not all(part.replace("_", "").replace("-", "").replace("+", "").isalnum() for part in zone.split("/")):
        raise ValueError(f"{zone!r} is no time zone name")
    at = ("order_create_time", "order_update_time", "detail_update_time", "payment_time", "refund_time")
    parts = (
        facts.agg(F.max(_epoch("event_ts", zone)).alias("t")).withColumn("pipeline", F.lit("behavior_dwd")),
        wide.agg(F.max(F.greatest(*[_epoch(c, zone) for c in at])).alias("t")).withColumn("pipeline", F.lit("order_dwd")),
        overview.agg(F.max(_epoch("window_end", zone)).alias("t")).withColumn("pipeline", F.lit("behavior_ads")),
    )
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("t", F.coalesce("t", F.lit(0.0)))
    age = F.greatest(F.lit(0.0), now.cast("double") - F.col("t"))
    return rows.select("pipeline", F.col("t").alias("last_epoch"), (F.col("t") > 0).alias("available"), F.when(F.col("t") > 0, age).alias("age_seconds"))
