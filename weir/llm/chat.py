"""Chat formatting: cumulative-snapshot collapse, then rendering. DataFrame functions only.

A log that stores a conversation after every turn holds each conversation many times, each a
prefix of the next. Every turn gets a rolling hash of the turns up to it; a conversation whose
last hash is a proper-prefix hash of another one is dropped by an anti-join, equal conversations
keep the smallest conv_id, and what is left is rendered.

The rolling hash XORs two independent 64-bit hashes of (position, role, text), so it needs one
running window and no fold over arrays.

Edge cases: turns sort by (turn, role, text), nulls first, so repeated turn numbers have one
order; null role or text differs from an empty one when compared and renders as empty; rows with
null conv_id form one conversation; repeated rows are turns of their own; an empty table gives an
empty result; extra columns are ignored. A conversation is one row of the result, so its turns
meet in one task whatever their number; copies and prefixes are reduced to one row per distinct
hash before they are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, stage, staged


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, i (from 1), n, h (two rolling hashes) for every turn."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    row = [F.col("i"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    hashed = turns.select("conv_id", "turn", "role", "text").withColumn("i", F.row_number().over(order))
    hashed = hashed.withColumn("a", F.xxhash64(F.lit(1), *row)).withColumn("b", F.xxhash64(F.lit(2), *row))
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.select(
        "conv_id", "i", F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"),
        F.struct(F.bit_xor("a").over(run).alias("a"), F.bit_xor("b").over(run).alias("b")).alias("h"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no longer one continues."""
    hashes = stage(prefix_hashes(turns), "chat-hashes")
    whole = hashes.where("i = n").groupBy("n", "h").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = hashes.where("i < n").select(F.col("i").alias("n"), "h").distinct()
    kept = whole.join(prefixes, ["n", "h"], "left_anti")
    return kept.select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame, start="<|im_start|>", end="<|im_end|>") -> DataFrame:
    """``kept`` with ``rendered``: each turn as start, role, newline, text, end; turns on lines of their own."""
    k = kept.withColumnRenamed("conv_id", "__conv")
    rows = turns.select("conv_id", F.struct("turn", "role", "text").alias("t"))
    rows = rows.join(k.select("__conv"), F.col("conv_id").eqNullSafe(F.col("__conv")), "left_semi")
    said = F.transform(
        F.sort_array(F.collect_list("t")),
        lambda t: F.concat(F.lit(start), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(end)),
    )
    text = rows.groupBy("conv_id").agg(F.array_join(said, "\n").alias("rendered"))
    return text.join(k, F.col("conv_id").eqNullSafe(F.col("__conv"))).select("conv_id", "n_turns", "n_copies", "rendered")


def format_chats(turns: DataFrame, **markers) -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, n_copies, rendered."""
    before = staged()
    kept = stage(maximal_conversations(turns), "chat-kept")
    settle(turns.sparkSession, before, kept)
    return render(turns, kept, **markers)
