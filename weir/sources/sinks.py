"""Sinks: append, versioned upsert, dynamic partition overwrite with verification, reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class VerificationError(RuntimeError):
    """What was read back differs from what was written."""


def append(df: DataFrame, path: str) -> None:
    """Add rows to a table."""
    df.write.mode("append").parquet(path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows of a table with the columns of ``df``; none if nothing was written yet."""
    try:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    except Exception as e:  # noqa: BLE001 - only a missing folder is expected
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return df.limit(0)


def overwrite_partitions(df: DataFrame, path: str, by: str = "order_date") -> tuple[int, int, int]:
    """Replace the partitions that ``df`` holds; (rows before, rows written, rows read back) of its range.

    Only partitions in ``df`` change. The counts are of the range of its partition values.
    """
    spark = df.sparkSession
    low, high, rows = df.agg(F.min(by), F.max(by), F.count(F.lit(1))).first()
    if not rows:
        raise ValueError("nothing to write: the source range is empty")
    inside = F.col(by).between(F.lit(low), F.lit(high))
    try:
        before = spark.read.parquet(path).where(inside).count()
    except Exception as e:  # noqa: BLE001 - only a missing folder is expected
        if "PATH_NOT_FOUND" not in str(e):
            raise
        before = 0
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    after = spark.read.parquet(path).where(inside).count()
    if after != rows:
        raise VerificationError(f"wrote {rows} rows of {low} to {high}, read {after}")
    return before, rows, after


def reconciliation_report(compared: DataFrame, start: date, end: date, sample: int = 20) -> tuple[bool, str]:
    """(all rows match, Markdown report with at most ``sample`` mismatches)."""
    n, bad = compared.agg(F.count(F.lit(1)), F.count_if(~F.col("is_match"))).first()
    lines = [f"# Reconciliation [{start}, {end})", "", f"- rows compared: {n}", f"- mismatches: {bad}", f"- result: {'PASS' if n and not bad else 'FAIL'}"]
    if bad:
        rows = compared.where("not is_match").orderBy("order_date", "channel").limit(sample).collect()
        names = [c for c in compared.columns if c != "is_match"]
        lines += ["", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
        lines += ["| " + " | ".join(str(r[c]) for c in names) + " |" for r in rows]
    return bool(n and not bad), "\n".join(lines) + "\n"


def quality_report(rules: DataFrame) -> tuple[bool, str]:
    """(all rules pass, Markdown checklist)."""
    rows = rules.orderBy("rule").collect()
    ok = bool(rows) and all(r["passed"] for r in rows)
    lines = ["# Data quality", "", f"{sum(bool(r['passed']) for r in rows)}/{len(rows)} {'PASS' if ok else 'FAIL'}", ""]
    lines += [f"- [{'x' if r['passed'] else ' '}] {r['rule']}. {r['name']}: {r['value']}" for r in rows]
    return ok, "\n".join(lines) + "\n"


def write_reconciliation(compared: DataFrame, root: str, start: date, end: date) -> DataFrame:
    """``compared`` as Parquet under folders of the range's start and end, replacing an earlier run of the range; read back."""
    path = f"{root}/start_date={start}/end_date={end}"
    compared.write.mode("overwrite").parquet(path)
    return compared.sparkSession.read.parquet(path)
