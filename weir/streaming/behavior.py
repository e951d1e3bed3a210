"""Live behaviour pipeline: watermark, dirty and clean branches, windowed aggregates.

The functions of ``weir.operators.behavior`` run unchanged on streams. Events without a time are
dirty and leave before the watermark, which they could not advance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weir.functions.versions import ingest_version
from weir.operators import behavior
from weir.sources.readers import with_event_time

DELAY = "5 seconds"
#: Aggregates by name; each is (facts) -> windows.
AGGREGATES = {
    "ads_realtime_overview": behavior.overview,
    "ads_product_rank": behavior.product_rank,
    "ads_category_rank": behavior.category_rank,
    "ads_channel_funnel": behavior.funnel,
}


def timed(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Events with a time, watermarked: later than ``delay`` behind the newest one, they are dropped."""
    return with_event_time(events).where("event_ts is not null").withWatermark("event_ts", delay)


def start_aggregate(facts: DataFrame, name: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the closed windows of an aggregate to Parquet, exactly once a window."""
    out = AGGREGATES[name](facts)
    return out.writeStream.queryName(name).outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def start_append(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream's rows, each exactly once: the file sink's own log says which files count."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def start_branches(events: DataFrame, dimensions, good: str, bad: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write enriched and dirty events of each batch. ``dimensions`` is called per batch, so lookups see new rows.

    A batch that is run again after a failure replaces what it wrote, since its folder bears its id.
    """

    def both(batch: DataFrame, batch_id: int) -> None:
        batch = with_event_time(batch).persist()
        products, shops, regions = dimensions()
        behavior.enrich(batch, products, shops, regions).write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        behavior.dirty(batch).drop("proc_time").write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        batch.unpersist()

    return events.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def start_serving(rows: DataFrame, key: list[str], path: str, checkpoint: str, epoch: int = 128, **trigger) -> StreamingQuery:
    """Append versioned rows (with partition and offset columns) to a serving table; readers take the newest of each key."""
    versioned = rows.withColumn("ingest_version", ingest_version(F.lit(epoch), F.col("offset"), F.col("partition")))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return versioned.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
