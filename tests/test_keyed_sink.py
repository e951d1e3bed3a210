import pytest
from weir.sources import keyed_sink
from weir.sources.contracts import schema

SUMS = schema("channel string, total bigint, n bigint")


def feed(spark, path, rows):
    spark.createDataFrame(rows, "channel string, total long, n long, op string").coalesce(1).write.mode("append").parquet(path)


def run(spark, root):
    spark.dataSource.register(keyed_sink.KeyedSink)
    stream = spark.readStream.schema("channel string, total long, n long, op string").parquet(f"{root}/in")
    out = stream.writeStream.format("weir_keyed").option("path", f"{root}/out").option("key", "channel").option("version", "n").option("checkpointLocation", f"{root}/check")
    out.trigger(availableNow=True).start().awaitTermination()
    return {r["channel"]: r["total"] for r in keyed_sink.read_latest(spark, f"{root}/out", SUMS).collect()}


def test_a_stream_upserts_and_deletes(spark, tmp_path):
    root = str(tmp_path)
    feed(spark, f"{root}/in", [("app", 1, 1, "u"), ("web", 2, 1, "u"), ("app", 5, 2, "u"), ('a "quoted"\n', 1, 1, "u")])
    assert run(spark, root) == {"app": 5, "web": 2, 'a "quoted"\n': 1}
    feed(spark, f"{root}/in", [("app", 6, 3, "u"), ("web", None, 2, "d"), ("app", 0, 0, "d")])
    assert run(spark, root) == {"app": 6, 'a "quoted"\n': 1}
    log = keyed_sink.read_log(spark, f"{root}/out")
    assert log.count() == 7 and log.where("value is null").count() == 2
    # The query's own record of the last batch is lost, but not the sink's: the batch is run again and changes nothing.
    newest = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    assert run(spark, root) == {"app": 6, 'a "quoted"\n': 1}
    assert keyed_sink.read_log(spark, f"{root}/out").count() == 7 and keyed_sink.clean(f"{root}/out") == 0


def test_a_crash_between_write_and_commit_leaves_no_row_twice(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/sink"
    w = keyed_sink.KeyedSink({"path": path, "key": "channel", "version": "n"}).streamWriter(SUMS, False)
    rows = [(f"c{i}", i, 1) for i in range(7)]
    monkeypatch.setattr(keyed_sink, "ROWS", 3)
    w.write(iter(rows))  # lost before its commit
    assert keyed_sink.read_log(spark, path).count() == 0
    first = [w.write(iter(rows[:5])), w.write(iter([])), w.write(iter(rows[5:]))]
    w.commit(first, 0)
    w.commit([w.write(iter(rows))], 0)  # run again after its commit
    w.abort([w.write(iter(rows)), None], 1)
    assert [m.rows for m in first] == [5, 0, 2]
    assert sorted(r["key"] for r in keyed_sink.read_log(spark, path).collect()) == [f'{{"channel":"c{i}"}}' for i in range(7)]
    assert keyed_sink.clean(path) == 1 and keyed_sink.clean(path) == 0
    assert {r["total"] for r in keyed_sink.read_latest(spark, path, SUMS).collect()} == set(range(7))


def test_key_columns_must_exist():
    with pytest.raises(ValueError, match="no columns"):
        keyed_sink.KeyedSink({"path": "/x", "key": "nope", "version": "n"}).streamWriter(SUMS, False)


def test_the_newest_rows_are_dealt_before_they_are_grouped(spark, tmp_path):
    schema = "k string, n long"
    spark.dataSource.register(keyed_sink.KeyedSink)
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.format("weir_keyed").option("path", str(tmp_path / "out")).option("key", "k").option("version", "n")
    stream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    out = keyed_sink.read_latest(spark, str(tmp_path / "out"), spark.createDataFrame([], schema).schema)
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    grouped = [i for i, x in enumerate(lines) if "Aggregate" in x]
    assert max(grouped) < next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(key" in x)
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 2)]
