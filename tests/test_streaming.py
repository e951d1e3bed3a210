import json
import os
import random

import pytest
from pyspark.sql import functions as F

from weir.operators import behavior, serving
from weir.sources import generators, readers
from weir.streaming import behavior as live


def write(path, rows, name):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}.json", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_closed_windows_equal_batch_across_a_restart(spark, tmp_path):
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    e = sorted(generators.journeys(400, seed=5, disorder_s=0), key=lambda r: r["event_time"])
    for part, name in ((e[:500], "a"), (e[500:], "b")):
        write(log, part, name)
        q = live.start_aggregate(behavior.clean(live.timed(readers.stream_events(spark, log))), "ads_realtime_overview", out, check, availableNow=True)
        q.awaitTermination()
    got = spark.read.parquet(out)
    events = readers.with_event_time(readers.read_events(spark, log))
    end = events.agg((F.max("event_ts") - F.expr("INTERVAL 5 SECONDS")).alias("t")).first()["t"]
    assert rows(got) == rows(behavior.overview(behavior.clean(events)).where(F.col("window_end") <= F.lit(end)))
    assert got.count() == got.select("window_start").distinct().count()


def test_late_events_are_dropped(spark, tmp_path):
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    one = {"session_id": "s", "user_id": 1, "event_type": "view", "channel": "app", "amount": "1.00"}
    for name, at in (("a", "2024-01-01 00:00:10"), ("b", "2024-01-01 00:10:00"), ("c", "2024-01-01 00:00:20"), ("d", "2024-01-01 00:20:00")):
        write(log, [{**one, "event_id": name, "event_time": at}], name)
        live.start_aggregate(behavior.clean(live.timed(readers.stream_events(spark, log))), "ads_realtime_overview", out, check, availableNow=True).awaitTermination()
    got = {str(r["window_start"]): r["pv"] for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-01 00:00:00": 1, "2024-01-01 00:10:00": 1}


def test_branches(spark, tmp_path):
    log = str(tmp_path / "log")
    write(log, generators.journeys(100, seed=1, dirty=0.3), "a")
    dims = lambda: tuple(spark.createDataFrame([], s) for s in ("product_id long, product_name string, category_id long, category_name string", "shop_id long, shop_name string, region_id long", "region_id long, province string, city string"))
    q = live.start_branches(readers.stream_events(spark, log), dims, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "check"), availableNow=True)
    q.awaitTermination()
    n = readers.read_events(spark, log).count()
    assert spark.read.parquet(str(tmp_path / "good")).count() + spark.read.parquet(str(tmp_path / "bad")).count() == n


def test_append_sink_writes_each_row_once(spark, tmp_path):
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    e = generators.independent_events(300, seed=3, dirty=0.2)
    for part, name in ((e[:200], "a"), (e[200:], "b"), ([], "c")):
        write(log, part, name)
        live.start_append(behavior.dirty(readers.with_event_time(readers.stream_events(spark, log))).drop("proc_time"), out, check, availableNow=True).awaitTermination()
    want = behavior.dirty(readers.with_event_time(readers.read_events(spark, log))).drop("proc_time")
    got = spark.read.parquet(out)
    assert rows(got) == rows(want) and got.count() > 20


def test_alert_store(spark, tmp_path):
    path = str(tmp_path / "alerts")
    one, two = serving.alerts(overview(spark, [10] * 5 + [4])), serving.alerts(overview(spark, [10] * 5 + [0], [9] * 5 + [0]))
    assert [serving.store_alerts(x, path) for x in (one, one, two, two)] == [1, 0, 3, 0]  # the drop was sent for that window before
    sent = spark.read.parquet(path)
    assert serving.recent_alerts(sent).count() == 4 and serving.recent_alerts(sent, 2).count() == 2
    assert serving.store_alerts(one.limit(0), str(tmp_path / "none")) == 0


def test_freshness_survives_failed_queries():
    now = [100.0]
    state = serving.FreshnessState(lambda: now[0])

    def fails():
        raise OSError("gone")

    state.collect({"a": lambda: 90.0, "b": fails})
    assert state.last_epoch == {"a": 90.0} and (state.success, state.failures, state.last_success) == (0, 1, 0.0)
    now[0] = 200
    state.collect({"a": fails, "b": lambda: 250.0})
    assert state.last_epoch == {"a": 90.0, "b": 250.0} and (state.success, state.failures) == (0, 2)
    now[0] = 300
    state.collect({"a": lambda: 280.0, "b": lambda: 250.0})
    assert (state.success, state.failures, state.last_success) == (1, 2, 300.0)
    assert state.text().splitlines() == ['freshness_age_seconds{pipeline="a"} 20', 'freshness_age_seconds{pipeline="b"} 50', "freshness_collection_success 1", "freshness_collection_failures_total 2", "freshness_last_success_unixtime_seconds 300"]


def test_freshness_queries_read_the_pipelines(spark, sf):
    from weir.plans.queries import Warehouse

    w = Warehouse(spark, sf)
    state = serving.FreshnessState(lambda: 2e9)
    state.collect(serving.freshness_queries(w.facts(), w.wide(), w.overview()))
    want = {r["pipeline"]: r["last_epoch"] for r in serving.freshness(w.facts(), w.wide(), w.overview(), F.lit(2e9)).collect()}
    assert state.last_epoch == want and state.success == 1


def overview(spark, amounts, users=None, uv=200):
    data = [(f"2024-01-01 00:{i:02d}:00", f"2024-01-01 00:{i + 1:02d}:00", 300, uv, 5, 5, (users or [9] * len(amounts))[i], float(a)) for i, a in enumerate(amounts)]
    df = spark.createDataFrame(data, "a string, b string, pv long, uv long, cart_users long, order_users long, pay_users long, x double")
    return df.select(F.col("a").cast("timestamp").alias("window_start"), F.col("b").cast("timestamp").alias("window_end"), "pv", "uv", "cart_users", "order_users", "pay_users", F.col("x").cast("decimal(18,2)").alias("pay_amount"))


def test_alerts(spark):
    kinds = lambda *a, **k: {r["alert_type"] for r in serving.alerts(overview(spark, *a, **k)).collect()}
    assert kinds([10] * 6) == set()
    assert kinds([10] * 5 + [4]) == {"pay_amount_drop"}
    assert kinds([10] * 3 + [4]) == set()
    assert kinds([10] * 5 + [0], [9] * 5 + [0]) == {"pay_amount_zero", "pay_users_zero", "pay_amount_drop", "low_conversion"}
    assert kinds([10] * 6, [1] * 6) == {"low_conversion"}
    assert kinds([10] * 6, [1] * 6, uv=100) == set()
    assert kinds([]) == set()
    found = serving.alerts(overview(spark, [10] * 5 + [4]))
    assert serving.fresh_alerts(found, found.select("window_start", "alert_type")).count() == 0


def test_freshness_of_nothing(spark):
    o = overview(spark, [])
    facts = spark.createDataFrame([], "event_ts timestamp")
    wide = spark.createDataFrame([], ", ".join(f"{c} timestamp" for c in ("order_create_time", "order_update_time", "detail_update_time", "payment_time", "refund_time")))
    assert [(r["available"], r["age_seconds"]) for r in serving.freshness(facts, wide, o, F.lit(1)).collect()] == [(False, None)] * 3
    future = facts.unionByName(spark.sql("select timestamp '2024-01-01 08:00:00' as event_ts"))
    r = serving.freshness(future, wide, o, F.lit(0), "Asia/Shanghai").where("pipeline = 'behavior_dwd'").first()
    assert r["age_seconds"] == 0.0 and r["last_epoch"] == 1704067200.0


def test_moving_mean_over_runs(spark):
    from datetime import datetime, timedelta

    r, at, rows = random.Random(3), datetime(2023, 12, 30), []
    for _ in range(120):
        at += timedelta(minutes=r.choice([1, 1, 1, 60, 3000, 200_000]))
        rows.append((at, float(r.randint(0, 99))))
    df = spark.createDataFrame(rows, "window_start timestamp, pay_amount double").repartition(3)
    for length in (7, 5, 4096):
        got = {x["window_start"]: x["mean_before"] for x in serving.moving_mean(df, length=length).collect()}
        assert len(got) == 120
        for i, (t, _) in enumerate(rows):
            before = [v for _, v in rows[max(0, i - 5) : i]]
            assert got[t] == (pytest.approx(sum(before) / len(before)) if before else None)
    plan = serving.moving_mean(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert serving.moving_mean(df.limit(0)).count() == 0


def test_freshness_series_with_a_threshold():
    now = [100.0]
    state = serving.FreshnessState(lambda: now[0], stale_after_s=30)
    state.collect({"a": lambda: 90.0, "b": lambda: 0.0, "c": lambda: 1 / 0})
    assert state.stale() == ["b", "c"] and state.success == 0
    now[0] = 121.0
    assert state.stale() == ["a", "b", "c"]
    text = state.text()
    for line in ('freshness_available{pipeline="a"} 1', 'freshness_available{pipeline="c"} 0', "freshness_stale_threshold_seconds 30", "freshness_last_collection_unixtime_seconds 100", 'freshness_max_business_unixtime_seconds{pipeline="a"} 90', 'freshness_age_seconds{pipeline="a"} 31'):
        assert line in text.splitlines()
