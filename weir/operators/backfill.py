"""Offline recompute of order metrics and reconciliation with the incremental result."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.sources import sinks
from weir.sources.readers import of_orders, orders_in_range

from .orders import MONEY, metrics

COUNTS = ("total_orders", "paid_orders", "cancelled_orders", "refunded_orders")
SUMS = ("order_amount", "paid_amount", "refund_amount")


def parse_range(start: str, end: str) -> tuple[date, date]:
    """A half-open date range from strict, zero-padded ISO dates; ValueError otherwise."""
    for s in (start, end):
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", s):
            raise ValueError(f"{s!r} is not a date yyyy-mm-dd")
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    if a >= b:
        raise ValueError("the range is empty: start must come before end")
    return a, b


def _succeeded(rows: DataFrame, kind: str) -> DataFrame:
    amount = F.max(F.when(F.col(f"{kind}_status") == "SUCCESS", F.col(f"{kind}_amount")).otherwise(F.lit(0).cast("decimal(12,2)")))
    return rows.groupBy("order_id").agg(amount.alias(f"{kind}_amount"))


def order_daily(orders: DataFrame, payments: DataFrame, refunds: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Daily metrics from the source tables; only successful payments and refunds count.

    With a range, only its orders, and only their payments and refunds, are read.
    """
    if start:
        orders = orders_in_range(orders, start, end)
        payments, refunds = of_orders(payments, orders), of_orders(refunds, orders)
    zero = F.lit(0).cast("decimal(12,2)")
    current = (
        orders.select(F.to_date("create_time").alias("order_date"), "order_id", "channel", "order_status", "order_amount")
        .join(_succeeded(payments, "payment"), "order_id", "left").join(_succeeded(refunds, "refund"), "order_id", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("payment_amount", "refund_amount")})
    )
    return metrics(current, "order_date", "channel")


def reconcile(offline: DataFrame, realtime: DataFrame) -> DataFrame:
    """Both results side by side on (order_date, channel), with ``is_match``; a missing side counts as zeros."""
    o = offline.select("order_date", "channel", *[F.col(c).alias(f"offline_{c}") for c in (*COUNTS, *SUMS)])
    r = realtime.select(F.col("order_date").cast("date").alias("order_date"), "channel", *[F.col(c).alias(f"realtime_{c}") for c in (*COUNTS, *SUMS)])
    both = o.join(r, ["order_date", "channel"], "full_outer")
    filled, match = [], F.lit(True)
    for c in (*COUNTS, *SUMS):
        zero = F.lit(0).cast("long" if c in COUNTS else MONEY)
        a, b = F.coalesce(f"offline_{c}", zero), F.coalesce(f"realtime_{c}", zero)
        filled += [a.alias(f"offline_{c}"), b.alias(f"realtime_{c}")]
        match = match & (a == b)
    return both.select("order_date", "channel", *filled, match.alias("is_match"))


def exit_code(rows: int, matches: bool, allow_mismatch: bool = False) -> int:
    """0 if the run counts as a success; an empty source is an error."""
    if not rows:
        raise ValueError("the source range is empty")
    return 0 if matches or allow_mismatch else 1


@dataclass(frozen=True)
class Done:
    """What a backfill run left: counts of its range before, written and read back; the stored comparison; the report; the exit code."""

    rows: tuple[int, int, int]
    compared: DataFrame
    report: str
    code: int


def run(orders: DataFrame, payments: DataFrame, refunds: DataFrame, realtime: DataFrame, target: str, reconciliation: str, start: str, end: str, allow_mismatch: bool = False) -> Done:
    """The backfill job of a half-open date range, from parsing to exit code.

    Recomputes the daily metrics of the range, overwrites its partitions of ``target``, compares what it reads back
    with the ``realtime`` rows of the range, and stores the comparison under folders of start and end. Run again, it
    replaces its own output. An empty range is an error.
    """
    a, b = parse_range(start, end)
    rows = sinks.overwrite_partitions(order_daily(orders, payments, refunds, a, b), target)
    inside = lambda c: (c >= F.lit(a)) & (c < F.lit(b))
    offline = orders.sparkSession.read.parquet(target).where(inside(F.col("order_date")))
    compared = reconcile(offline, realtime.where(inside(F.col("order_date").cast("date"))))
    compared = sinks.write_reconciliation(compared, reconciliation, a, b)
    same, report = sinks.reconciliation_report(compared, a, b)
    return Done(rows, compared, report, exit_code(rows[1], same, allow_mismatch))
