import json
import time

import pytest
from duck import against_duckdb
from pyspark.sql import functions as F

from weir.operators import changelog, dlq
from weir.plans import queries
from weir.plans.oracle import ORACLE_SQL
from weir.sources import readers
from weir.sources.contracts import schema
from weir.sources.topics import TOPICS, serving_key
from weir.streaming import loader

TOPIC = TOPICS["ads_order_daily"]


def batch(spark, rows):
    return spark.createDataFrame([("ads_order_daily", 0, o, json.dumps(k) if k else None, v if v is None or isinstance(v, str) else json.dumps(v)) for o, k, v in rows], "topic string, partition int, offset long, key string, value string")


def test_loads_deletes_restores_and_replays(spark, tmp_path):
    rows, letters, metrics = str(tmp_path / "rows"), str(tmp_path / "dlq"), loader.LoaderMetrics()
    key = {"order_date": "2024-01-01", "channel": "app"}
    first = batch(spark, [(1, key, {**key, "total_orders": 1}), (2, key, {**key, "total_orders": "x"}), (3, None, "{oops")])
    read = lambda: [r["total_orders"] for r in readers.read_serving(spark, rows, list(serving_key("ads_order_daily"))).collect()]
    for _ in range(2):  # the second time is a batch run again
        loader.load_batch(first, TOPIC, rows, letters, 0, metrics)
        assert read() == [1] and spark.read.parquet(letters).count() == 2
    loader.load_batch(batch(spark, [(4, key, None)]), TOPIC, rows, letters, 1, metrics)
    assert read() == []
    loader.load_batch(batch(spark, [(5, key, {**key, "total_orders": 7})]), TOPIC, rows, letters, 2, metrics)
    assert read() == [7]
    text = metrics.text()
    assert "loader_messages_consumed_total 8\n" in text and "loader_decode_failures_total 4\n" in text and text.count("# TYPE") == 10


def test_stream_loader(spark, tmp_path):
    log = tmp_path / "log"
    batch(spark, [(i, None, {"order_date": "2024-01-01", "channel": f"c{i}"}) for i in range(5)]).write.parquet(str(log))
    stream = spark.readStream.schema("topic string, partition int, offset long, key string, value string").parquet(str(log))
    metrics = loader.LoaderMetrics()
    start = lambda: loader.start_loader(stream, TOPIC, str(tmp_path / "r"), str(tmp_path / "d"), str(tmp_path / "c"), metrics, availableNow=True)
    assert loader.supervise(start) == 1
    start().awaitTermination()  # nothing new
    assert spark.read.parquet(str(tmp_path / "r")).count() == 5


def test_all_topics_load_side_by_side(spark, tmp_path):
    values = {
        "ads_order_daily": {"order_date": "2024-01-01", "channel": "app", "total_orders": 1}, "ads_order_lifecycle": {"channel": "app", "total_orders": 2},
        "dwd_dirty_behavior": {"error_reason": "EMPTY_EVENT_ID"}, "dwd_order_detail": {"detail_id": "D1"},
    }
    rows = [(t, 0, i, None, json.dumps(values[t]) if t in values else "{oops") for i, t in enumerate([*TOPICS, *TOPICS])]
    log = str(tmp_path / "log")
    spark.createDataFrame(rows, "topic string, partition int, offset long, key string, value string").write.parquet(log)
    stream = spark.readStream.schema("topic string, partition int, offset long, key string, value string").parquet(log)
    metrics = loader.LoaderMetrics()
    for _ in range(2):  # the second time finds nothing new
        queries = loader.start_loaders(stream, str(tmp_path / "out"), metrics, availableNow=True)
        assert set(queries) == set(TOPICS)
        for q in queries.values():
            q.awaitTermination()
    n = lambda t, kind: spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out" / t / kind)).count()
    assert {t: n(t, "rows") for t in TOPICS} == {t: 2 * (t in values) for t in TOPICS}
    assert {t: n(t, "letters") for t in TOPICS} == {t: 2 * (t not in values) for t in TOPICS}
    assert metrics.values["messages_consumed_total"] == 20
    # Dirty rows have no id: their log positions keep both apart. The lifecycle's two rows are one channel's.
    read = lambda t: readers.read_serving(spark, str(tmp_path / "out" / t / "rows"), list(serving_key(t))).count()
    assert read("dwd_dirty_behavior") == 2 and read("ads_order_lifecycle") == 1
    for k, v in loader.STREAM_CONF.items():
        assert spark.conf.get(k) == v


def test_one_query_loads_all_topics(spark, tmp_path):
    """The source is read once, all topics are committed together, and counts come from the writes and from Spark's reports."""
    values = {"ads_order_daily": {"order_date": "2024-01-01", "channel": "app"}, "dwd_dirty_behavior": {"error_reason": "EMPTY_EVENT_ID"}, "dwd_order_detail": {"detail_id": "D1"}}
    schema_ = "topic string, partition int, offset long, key string, value string"
    produced = 0
    for part in range(2):
        rows = [(t, 0, 100 * part + i, None, json.dumps(values[t]) if t in values else "{oops") for i, t in enumerate([*TOPICS, *values, "another_topic"])]
        spark.createDataFrame(rows, schema_).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        produced += len(rows)
    stream = spark.readStream.schema(schema_).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    metrics = loader.LoaderMetrics()
    spark.streams.addListener(listener := loader.LoaderListener(metrics, "all"))
    run = lambda: loader.start_all_topics(stream, str(tmp_path / "out"), metrics, name="all", availableNow=True).awaitTermination()
    try:
        run()
        newest = max((tmp_path / "out" / "checkpoint" / "commits").glob("[0-9]*"))
        newest.unlink()
        (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
        n = lambda t, kind: spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out" / t / kind)).count()
        want = {t: (4, 0) if t in values else (0, 2) for t in TOPICS}
        assert {t: (n(t, "rows"), n(t, "letters")) for t in TOPICS} == want
        assert metrics.values["rows_inserted_total"] == 12 and metrics.values["dlq_publish_success_total"] == 14
        for _ in range(100):  # reports come a little later
            if metrics.values.get("source_rows_total") == produced:
                break
            time.sleep(0.1)
        assert metrics.values["source_rows_total"] == produced == metrics.values["messages_consumed_total"] + 2
        text = metrics.text()
        assert "loader_source_rows_total 28\n" in text and "loader_last_batch_id 1\n" in text
        run()  # the batch whose commit was lost is run again and replaces what it left
        assert {t: (n(t, "rows"), n(t, "letters")) for t in TOPICS} == want
    finally:
        spark.streams.removeListener(listener)


def test_judged_records_keep_what_their_side_needs(spark):
    key = {"order_date": "2024-01-01", "channel": "app"}
    records = batch(spark, [(1, key, {**key, "total_orders": 1}), (2, key, "{oops"), (3, key, None), (4, None, None)])
    judged = dlq.judged(records, TOPIC)
    assert "names" not in judged.columns
    got = {r["offset"]: (r["value"], r["fields"] is not None, r["key_fields"] is not None) for r in judged.collect()}
    assert got == {1: (None, True, True), 2: ("{oops", False, False), 3: (None, False, True), 4: (None, False, False)}
    good, bad = dlq.validate(records, TOPIC)
    assert sorted((r["source_offset"], r["channel"], r["total_orders"], r["is_deleted"]) for r in good.collect()) == [(1, "app", 1, 0), (3, "app", None, 1)]
    assert sorted((r["offset"], r["value"], r["error_message"]) for r in bad.collect()) == [(2, "{oops", "value is no JSON object"), (4, None, "delete without key")]


def test_batches_do_not_grow_with_the_log(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "_work", lambda spark, prefix: str(tmp_path))
    monkeypatch.setattr(queries, "FILE_RECORDS", 200)
    monkeypatch.setattr(queries, "TASK_FILES", 1)
    against_duckdb(queries.QUERIES["stream_loader"](spark, sf), ORACLE_SQL["stream_loader"], sf)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 200
    rows = spark.read.parquet(str(tmp_path / "out" / "dwd_order_detail" / "rows")).groupBy("batch").count()
    assert rows.count() > 2 and rows.agg(F.max("count")).first()[0] <= 200 * spark.sparkContext.defaultParallelism


def test_writes_are_tried_again_and_counted_once(spark, tmp_path, monkeypatch):
    key, metrics, calls = {"order_date": "2024-01-01", "channel": "app"}, loader.LoaderMetrics(), []
    counted = loader._counted

    def fails(df, write):
        calls.append(1)
        if len(calls) in (1, 3):
            raise OSError("no")
        return counted(df, write)

    monkeypatch.setattr(loader, "_counted", fails)
    loader.load_batch(batch(spark, [(1, key, key), (2, key, "{oops")]), TOPIC, str(tmp_path / "r"), str(tmp_path / "d"), 0, metrics, sleep=lambda s: None)
    v = metrics.values
    assert (v["insert_failures_total"], v["dlq_publish_failures_total"], v["rows_inserted_total"], v["decode_failures_total"], v["messages_consumed_total"]) == (1, 1, 1, 1, 2)


def test_loaded_rows_are_compacted(spark, tmp_path):
    rows, letters, metrics = str(tmp_path / "rows"), str(tmp_path / "dlq"), loader.LoaderMetrics()
    key = {"order_date": "2024-01-01", "channel": "app"}
    for i in range(3):
        loader.load_batch(batch(spark, [(10 * i + 1, key, {**key, "total_orders": i}), (10 * i + 2, None, {**key, "channel": f"c{i}"})]), TOPIC, rows, letters, i, metrics)
    loader.load_batch(batch(spark, [(40, {**key, "channel": "c1"}, None)]), TOPIC, rows, letters, 3, metrics)
    read = lambda: sorted((r["channel"], r["total_orders"]) for r in readers.read_serving(spark, rows, list(serving_key("ads_order_daily"))).collect())
    before = read()
    assert before == [("app", 2), ("c0", None), ("c2", None)]
    for upto in (1, 3):
        loader.compact_rows(spark, rows, "ads_order_daily", upto)
        assert read() == before
    assert len(list((tmp_path / "rows").iterdir())) == 1
    loader.compact_rows(spark, rows, "ads_order_daily", -9)
    assert read() == before


def test_retries():
    waits, calls = [], []

    def fails(n):
        calls.append(1)
        if len(calls) <= n:
            raise OSError("no")
        return "done"

    assert loader.with_retries(lambda: fails(3), sleep=waits.append) == "done" and waits == [1, 2, 4]
    calls.clear()
    with pytest.raises(OSError):
        loader.with_retries(lambda: fails(99), attempts=6, sleep=waits.append)
    assert waits[-1] == 15 and len(calls) == 6


def test_expire_and_rows_frame(spark):
    log = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-03-01"), ("b", "2024-01-01")], "k string, d string").withColumn("t", F.col("d").cast("timestamp"))
    kept = changelog.expire(log, ["k"], "t", 30, F.lit("2024-03-15").cast("timestamp"))
    assert sorted(r["k"] for r in kept.collect()) == ["a", "a"]
    got = readers.rows_frame(spark, ['{"order_date": "2024-01-01", "total_orders": "3"}', ""], schema("order_date date, total_orders bigint")).collect()
    assert len(got) == 1 and str(got[0]["order_date"]) == "2024-01-01" and got[0]["total_orders"] == 3


def test_fields_that_fit_are_checked_once_and_others_named(spark):
    topic = TOPICS["ads_order_lifecycle"]
    values = ['{"channel":"a","order_amount":12345678.90}', '{"channel":"a","total_orders":"x","paid_amount":1.234}', '{"channel":"a","refund_amount":"1e3"}', json.dumps({"channel": "e"})]
    records = spark.createDataFrame([(topic.table, 0, i, None, v) for i, v in enumerate(values)], "topic string, partition int, offset long, key string, value string")
    judged = dlq.judged(records, topic)
    found = {r["offset"]: (r["error_message"], r["fields"] and r["fields"]["order_amount"]) for r in judged.collect()}
    assert found[0] == (None, "12345678.9") and found[3] == (None, None)
    assert found[1][0] == "total_orders: not int64; paid_amount: not decimal(22,2)" and found[2][0] == "refund_amount: not decimal(22,2)"
    assert "[eE]" not in judged._jdf.queryExecution().optimizedPlan().toString()
