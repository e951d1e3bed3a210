"""Slowly changing product dimension: half-open versions, price changes, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.sources.contracts import OPEN_END

from .intervals import at_time


def apply_price_changes(versions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new versions table, rejected changes).

    A change (product_id, price, effective_from) closes the open version at its time and opens the
    next one. Several changes of a product apply in order of time. A change that doesn't come after
    the open version's start, repeats a time, or names an unknown product is rejected.
    """
    open_ = versions.where("is_current = 1")
    known = open_.select("product_id", F.col("effective_from").alias("__start"), F.col("version_no").alias("__last"), "product_name", "category_id", "category_name")
    c = changes.join(known, "product_id", "left")
    nth = F.row_number().over(Window.partitionBy("product_id", "effective_from").orderBy("price"))
    c = c.withColumn("__nth", nth).withColumn("__ok", F.coalesce((F.col("effective_from") > F.col("__start")) & (F.col("__nth") == 1), F.lit(False)))
    rejected = c.where("not __ok").select(*changes.columns)
    order = Window.partitionBy("product_id").orderBy("effective_from")
    end = F.lit(OPEN_END).cast("timestamp")
    new = c.where("__ok").select(
        "product_id", (F.col("__last") + F.row_number().over(order)).cast("int").alias("version_no"), "product_name", "category_id", "category_name", "price", "effective_from",
        F.coalesce(F.lead("effective_from").over(order), end).alias("effective_to"),
        F.when(F.lead("effective_from").over(order).isNull(), 1).otherwise(0).cast("byte").alias("is_current"), F.col("effective_from").alias("updated_at"),
    )
    first = new.groupBy("product_id").agg(F.min("effective_from").alias("__close"))
    kept = versions.join(first, "product_id", "left")
    closes = (F.col("is_current") == 1) & F.col("__close").isNotNull()
    kept = kept.withColumns({
        "effective_to": F.when(closes, F.col("__close")).otherwise(F.col("effective_to")),
        "updated_at": F.when(closes, F.col("__close")).otherwise(F.col("updated_at")),
        "is_current": F.when(closes, 0).otherwise(F.col("is_current")).cast("byte"),
    })
    return kept.select(*versions.columns).unionByName(new.select(*versions.columns)), rejected


def current_dimension(versions: DataFrame) -> DataFrame:
    """The product dimension as lookups see it: the open versions."""
    return versions.where("is_current = 1").select("product_id", "product_name", "category_id", "category_name", "price")


def version_at(rows: DataFrame, versions: DataFrame, time: str = "create_time", spread: bool = True, hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to the product version that holds at their ``time``: from <= time < to.

    Hashes on the product; with ``spread`` a product with very many rows is spread (``intervals.at_time``), at the cost of counting rows by product unless ``hot`` names these products.
    """
    shown = ("product_version", "product_name", "category_id", "category_name", "catalog_price")
    v = versions.withColumns({"product_version": F.col("version_no"), "catalog_price": F.col("price")}).select("product_id", *shown, "effective_from", "effective_to")
    if not spread:
        p = v.withColumnRenamed("product_id", "__p")
        hit = (F.col("product_id") == F.col("__p")) & (F.col(time) >= F.col("effective_from")) & (F.col(time) < F.col("effective_to"))
        return rows.join(p, hit).select(*rows.columns, *shown)
    return at_time(rows, v, "product_id", time, "effective_from", "effective_to", hot=hot).select(*rows.columns, *shown)


def not_one_current(versions: DataFrame) -> DataFrame:
    """Products without exactly one open version."""
    return versions.groupBy("product_id").agg(F.count_if(F.col("is_current") == 1).alias("n_current")).where("n_current <> 1")


def overlaps(versions: DataFrame) -> DataFrame:
    """Pairs of versions of a product whose intervals overlap: product_id, version_a < version_b."""
    a = versions.select("product_id", F.col("version_no").alias("version_a"), F.col("effective_from").alias("fa"), F.col("effective_to").alias("ta"))
    b = versions.select("product_id", F.col("version_no").alias("version_b"), F.col("effective_from").alias("fb"), F.col("effective_to").alias("tb"))
    return a.join(b, "product_id").where("version_a < version_b and fa < tb and fb < ta").select("product_id", "version_a", "version_b")


def overlapping_products(versions: DataFrame) -> DataFrame:
    """Products with any overlap, by a running maximum of ends: one sort a product, no pairs."""
    w = Window.partitionBy("product_id").orderBy("effective_from", "version_no").rowsBetween(Window.unboundedPreceding, -1)
    return versions.withColumn("__until", F.max("effective_to").over(w)).where("effective_from < __until and effective_from < effective_to").select("product_id").distinct()


def version_counts(versions: DataFrame) -> DataFrame:
    """Products with several versions, most first."""
    return versions.groupBy("product_id").agg(F.count(F.lit(1)).alias("versions")).where("versions > 1").orderBy(F.desc("versions"), "product_id")
