"""The serving loader: records of a topic to versioned rows and dead letters, with metrics and retries."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from weir.operators import changelog, dlq
from weir.sources.topics import TOPICS, Topic, serving_key

#: Session settings of long-running queries: state on disk, checkpoints a few generations deep.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.minBatchesToRetain": "10",
}


def with_retries(f: Callable[[], object], attempts: int = 5, most_s: float = 15, sleep: Callable[[float], None] = time.sleep, failed: Callable[[], None] = lambda: None):
    """``f()``, tried again after 1, 2, 4, ... seconds, ``most_s`` at most; the last error is raised."""
    for n in range(1, attempts + 1):
        try:
            return f()
        except Exception:
            failed()
            if n == attempts:
                raise
            sleep(min(2.0 ** (n - 1), most_s))


def supervise(start: Callable[[], StreamingQuery], attempts: int = 100, delay_s: float = 5, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run a query to its end, started again after failures; how often it was started."""
    for n in range(1, attempts + 1):
        try:
            start().awaitTermination()
            return n
        except Exception:
            if n == attempts:
                raise
            sleep(delay_s)
    return attempts


@dataclass
class LoaderMetrics:
    """Counters of a loader, as Prometheus text."""

    values: dict[str, float] = field(default_factory=lambda: {"start_unixtime_seconds": time.time()})
    #: Name -> kind; the order of the text.
    KINDS = {
        "messages_consumed_total": "counter", "rows_inserted_total": "counter", "insert_failures_total": "counter", "decode_failures_total": "counter",
        "dlq_publish_success_total": "counter", "dlq_publish_failures_total": "counter", "successful_batches_total": "counter",
        "last_success_unixtime_seconds": "gauge", "last_batch_duration_seconds": "gauge", "start_unixtime_seconds": "gauge",
    }

    #: Of a listener; in the text once there is one.
    PROGRESS = {"source_rows_total": "counter", "query_failures_total": "counter", "last_batch_id": "gauge", "input_rows_per_second": "gauge", "processed_rows_per_second": "gauge"}

    def __post_init__(self) -> None:
        self.lock = threading.Lock()  # queries of a session run in threads of their own

    def add(self, name: str, n: float = 1) -> None:
        with self.lock:
            self.values[name] = self.values.get(name, 0) + n

    def set(self, **values: float) -> None:
        with self.lock:
            self.values |= values

    def text(self, prefix: str = "loader") -> str:
        shown = self.KINDS | {k: v for k, v in self.PROGRESS.items() if k in self.values}
        return "".join(f"# TYPE {prefix}_{k} {kind}\n{prefix}_{k} {self.values.get(k, 0):g}\n" for k, kind in shown.items())


class LoaderListener(StreamingQueryListener):
    """Takes what Spark reports of the loaders' batches into their metrics; ``names`` are the queries to listen to."""

    def __init__(self, metrics: LoaderMetrics, *names: str):
        self.metrics, self.names = metrics, names

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name in self.names and p.numInputRows:
            self.metrics.add("source_rows_total", p.numInputRows)
            self.metrics.set(last_batch_id=p.batchId, input_rows_per_second=p.inputRowsPerSecond, processed_rows_per_second=p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:  # the event has no name; a loader's session runs loaders
            self.metrics.add("query_failures_total")


def _counted(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """``write(df)``, and how many rows that were, observed on the way."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get.get("n", 0)


def load_batch(records: DataFrame, topic: Topic, rows_path: str, dlq_path: str, batch_id: int, metrics: LoaderMetrics, epoch: int = 128, **retry) -> None:
    """Write a batch's rows and dead letters. The stream commits its offsets only after both are written.

    Each batch has folders of its own, so one that is run again replaces what it left. Records are judged once, and counted as they are written.
    """
    with _batch(records, metrics) as (records, found):
        _load(records, topic, rows_path, dlq_path, batch_id, metrics, epoch, **retry)
        metrics.add("messages_consumed_total", sum(found.values()))


def load_topics(records: DataFrame, topics: Mapping[str, Topic], batch_id: int, metrics: LoaderMetrics, paths: Callable[[str], tuple[str, str]], epoch: int = 128, **retry) -> None:
    """``load_batch`` for the records of several topics in one pass: ``paths`` gives a topic's folders of rows and letters.

    The source is read once; a topic's part is judged once. Topics without records in the batch are left alone.
    """
    with _batch(records, metrics) as (records, found):
        for name in (t for t in topics if t in found):
            _load(records.where(F.col("topic") == name), topics[name], *paths(name), batch_id, metrics, epoch, **retry)
            metrics.add("messages_consumed_total", found[name])


@contextmanager
def _batch(records: DataFrame, metrics: LoaderMetrics) -> Iterator[tuple[DataFrame, dict[str, int]]]:
    """The batch kept while it is worked on, and its number of records by topic; a batch that ends well is counted."""
    began, records = time.time(), records.persist()
    try:
        yield records, {r["topic"]: r["n"] for r in records.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as topics
        metrics.add("successful_batches_total")
        metrics.set(last_success_unixtime_seconds=time.time(), last_batch_duration_seconds=time.time() - began)
    finally:
        records.unpersist()


def _load(records: DataFrame, topic: Topic, rows_path: str, dlq_path: str, batch_id: int, metrics: LoaderMetrics, epoch: int, **retry) -> None:
    judged = dlq.judged(records, topic).persist()
    good, bad = dlq.split(judged, topic, records.columns, epoch)
    letters = dlq.envelopes(bad, F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    write = lambda df, path: _counted(df, lambda d: d.write.mode("overwrite").parquet(f"{path}/batch={batch_id}"))
    try:
        inserted = with_retries(lambda: write(good, rows_path), failed=lambda: metrics.add("insert_failures_total"), **retry)
        rejected = with_retries(lambda: write(letters, dlq_path), failed=lambda: metrics.add("dlq_publish_failures_total"), **retry)
        for name, n in (("rows_inserted_total", inserted), ("decode_failures_total", rejected), ("dlq_publish_success_total", rejected)):
            metrics.add(name, n)
    finally:
        judged.unpersist()


def configure(spark: SparkSession) -> None:
    """Give a session the settings of long-running queries."""
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)


def start_all_topics(records: DataFrame, root: str, metrics: LoaderMetrics, topics: Mapping[str, Topic] = TOPICS, epoch: int = 128, name: str = "loader", **trigger) -> StreamingQuery:
    """One query for all topics: each batch is read once, split by topic, and its offsets are committed once all topics are written.

    Rows and dead letters of a topic are under ``root``/its name, the query's offsets under ``root``/checkpoint.
    """
    configure(records.sparkSession)
    paths = lambda t: (f"{root}/{t}/rows", f"{root}/{t}/letters")
    run = lambda batch, i: load_topics(batch, topics, i, metrics, paths, epoch)
    return records.writeStream.queryName(name).foreachBatch(run).option("checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def start_loaders(records: DataFrame, root: str, metrics: LoaderMetrics, topics: Mapping[str, Topic] = TOPICS, epoch: int = 128, **trigger) -> dict[str, StreamingQuery]:
    """A query for each topic, so that one that fails holds up no other; each reads the whole source, which ``start_all_topics`` reads once.

    Rows, dead letters and offsets of a topic are under ``root``/its name.
    """
    configure(records.sparkSession)
    return {
        name: start_loader(records.where(F.col("topic") == name), topic, f"{root}/{name}/rows", f"{root}/{name}/letters", f"{root}/{name}/checkpoint", metrics, epoch, **trigger)
        for name, topic in topics.items()
    }


def compact_rows(spark: SparkSession, path: str, topic: str, upto: int) -> None:
    """Rewrite a loader's batches up to ``upto`` as one: the newest version of each key, deleted ones included."""
    found = _batches(spark, path)
    old = [(n, p) for n, p in found if n <= upto]
    if not old:
        return
    rows = spark.read.parquet(*[p for _, p in old])
    target = f"{path}/batch={-upto - 1}"
    changelog.latest(rows, list(serving_key(topic)), ["ingest_version"]).write.mode("overwrite").parquet(target)
    fs = spark._jvm.org.apache.hadoop.fs
    for n, p in old:
        if n != -upto - 1:
            at = fs.Path(p)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _batches(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return [(int(f.getPath().getName().partition("=")[2]), f.getPath().toString()) for f in found]


def start_loader(records: DataFrame, topic: Topic, rows_path: str, dlq_path: str, checkpoint: str, metrics: LoaderMetrics, epoch: int = 128, **trigger) -> StreamingQuery:
    """A stream of records (topic, partition, offset, key, value) into ``load_batch``."""
    run = lambda batch, i: load_batch(batch, topic, rows_path, dlq_path, i, metrics, epoch)
    return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start()
