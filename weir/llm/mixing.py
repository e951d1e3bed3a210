"""Mixing sources to target weights.

Documents get hash-random keys; within each source they stand in key order, equal-width key
ranges give distributed prefix sums of word counts, and each source is cut at its exact budget
after as many whole epochs as fit.

Edge cases: null text has size 0; null source is a source of its own, last in order; repeated
rows share one place in the order and split the cut evenly; an empty table gives an empty
result; a source without words has target 0, takes 0 words and, in ``mix``, is kept once.
Extra columns are ignored by ``mix_words`` and kept by ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle, stage, staged, unstage


#: Sources that one task ranks, about.
RANGE = 200_000


def _keyed(docs: DataFrame, seed: int, keep: list[Column] = []) -> DataFrame:
    """source, doc_id, size and the total order (key, id, size, text hash) of each row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-(2**63)))), 1)
    return docs.select(
        F.col("source").alias("__source"),
        F.col("doc_id").cast("long").alias("__doc"),
        size.alias("__size"),
        F.struct(
            key.alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"),
            size.alias("size"), F.xxhash64("text").alias("text"),
        ).alias("__at"),
        *keep,
    )


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sources`` with its weight and target: weights by code-point rank, capped, the excess reshared.

    Sources are ranked in ranges of some RANGE, each in a task of its own; the resharing loop moves three scalars a round.
    """
    order = F.col("__source").asc_nulls_last()
    sources = stage(sources, "mix-sizes")
    ranges = max(1, -(-sources.count() // RANGE))
    dealt = stage(sources.repartitionByRange(ranges, order).withColumn("__range", F.spark_partition_id()), "mix-ranges", narrow=False)
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__in"))
    first = counts.select("__range", (F.sum("__in").over(Window.orderBy("__range")) - F.col("__in")).alias("__before"))  # a row a range
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1 + F.col("__before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    ranked = stage(dealt.join(first, "__range").withColumn("__w", weight).drop("__range", "__before"), "mix-sources")
    most = F.col("__source_size") * F.lit(float(cap))
    total = ranked.agg(F.sum("__source_size")).first()[0] or 0
    budget, lam, held = share * total, 0.0, -1
    while True:
        over = F.lit(lam) * F.col("__w") > most
        row = ranked.agg(
            F.count(F.when(over, 1)).alias("n"),
            F.coalesce(F.sum(F.when(over, most)), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~over, F.col("__w"))), F.lit(0.0)).alias("w"),
        ).first()
        if row["n"] == held or not row["w"]:
            break
        held, lam = row["n"], (budget - row["full"]) / row["w"]
    target = F.least(most, F.lit(lam) * F.col("__w")) if lam else most * 0
    return ranked.withColumn("__target", target)


def plan_mix(docs: DataFrame, weights=(5, 2, 1), share=1.5, cap=2.0, seed=0) -> tuple[DataFrame, DataFrame]:
    """(keyed rows, one row per source with target, whole epochs and the cut of the last epoch)."""
    rows = stage(_keyed(docs, seed), "mix-rows", narrow=False)
    before_plan = staged()
    sources = rows.groupBy("__source").agg(F.sum("__size").alias("__source_size"), F.count(F.lit(1)).alias("__n"))
    plan = _targets(sources, weights, share, cap)
    budget = F.floor(F.col("__target") + 0.5)
    plan = plan.withColumn("__epochs", F.when(F.col("__source_size") > 0, F.floor(budget / F.col("__source_size"))).otherwise(1)).withColumn(
        "__rest", F.when(F.col("__source_size") > 0, budget - F.col("__epochs") * F.col("__source_size")).otherwise(0)
    )
    plan = stage(plan, "mix-plan")
    # Equal rows are one place in the order, so a row repeated a million times is one record here.
    places = rows.groupBy("__source", "__at").agg(F.count(F.lit(1)).alias("__c"), F.first("__size").alias("__size"))
    wanted = plan.where("__rest > 0").select(F.col("__source").alias("__s"), "__rest", "__n")
    places = places.join(wanted, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    ranges = F.ceil(F.sqrt("__n"))  # as many ranges as rows in a range: neither level grows with the whole source
    places = places.withColumn("__range", F.floor(F.col("__at.key") / F.lit(float(2**63)) * ranges)).withColumn("__sum", F.col("__size") * F.col("__c"))
    sums = places.groupBy("__source", "__range", "__rest").agg(F.sum("__sum").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("__source").orderBy("__range")) - F.col("__sum")
    edge = sums.withColumn("__before", before).where("__before < __rest and __rest <= __before + __sum")
    edge = edge.select(F.col("__source").alias("__s"), F.col("__range").alias("__r"), "__before")
    inside = places.join(edge, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    run = F.sum("__sum").over(Window.partitionBy("__source").orderBy("__at")) - F.col("__sum") + F.col("__before")
    cuts = inside.withColumn("__run", run).where("__run < __rest and __rest <= __run + __sum")
    cuts = cuts.select(
        F.col("__source").alias("__s"), F.col("__at").alias("__cut"),
        F.floor((F.col("__rest") - F.col("__run")) / F.col("__c")).alias("__part"),
    )
    plan = plan.join(cuts, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s")
    plan = stage(plan.select("__source", "__source_size", "__target", "__epochs", "__cut", "__part"), "mix-cuts")
    settle(docs.sparkSession, before_plan, plan)
    return rows, plan


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.withColumnRenamed("__source", "__s")
    out = rows.join(p, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s")
    last = F.when(F.col("__cut").isNull() | (F.col("__at") > F.col("__cut")), 0).when(F.col("__at") < F.col("__cut"), F.col("__size")).otherwise(F.col("__part"))
    return out.withColumn("__last", last)


def mix_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words that the mix takes)."""
    rows, plan = plan_mix(docs, **options)
    out = _with_plan(rows, plan)
    return out.select(
        F.col("__doc").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"), F.col("__target").cast("double").alias("target"),
        (F.col("__epochs") * F.col("__size") + F.col("__last")).cast("long").alias("taken"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table itself: each document as often as the mix takes it, columns unchanged.

    The document that a budget cuts is taken whole if at least half of it lies inside.
    """
    made, plan = plan_mix(docs, **options)
    unstage(made)
    rows = _keyed(docs, options.get("seed", 0), [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")])
    out = _with_plan(rows, plan)
    part = (F.col("__at") < F.col("__cut")) | ((F.col("__at") == F.col("__cut")) & (F.col("__last") * 2 >= F.col("__size")))
    copies = F.col("__epochs") + F.when(F.coalesce(part, F.lit(False)), 1).otherwise(0)
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("__row.*")
