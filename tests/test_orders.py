from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weir.functions import versions as ver
from weir.operators import backfill, changelog, orders, quality, scd2
from weir.sources import contracts, derived, generators, readers, sinks
from weir.streaming import orders as live

LOG = "k string, op string, epoch int, partition int, offset long, value struct<v:int>"


def test_fold_replay_epoch_and_tombstones(spark):
    rows = [("a", "c", 128, 0, 1, (1,)), ("a", "u", 128, 0, 2, (2,)), ("b", "c", 128, 1, 1, (5,)), ("b", "d", 128, 1, 2, None), ("c", "d", 128, 0, 3, None), ("c", "c", 128, 0, 4, (9,))]
    log = spark.createDataFrame(rows, LOG)
    state = lambda d: {r["k"]: r["v"] for r in changelog.fold(d, ["k"]).collect()}
    assert state(log) == {"a": 2, "c": 9} == state(log.unionAll(log))
    later = spark.createDataFrame([("a", "c", 129, 0, 0, (7,))], LOG)
    assert state(log.unionAll(later))["a"] == 7
    hidden = {r["k"] for r in changelog.fold(log, ["k"], keep_deleted=True).where("is_deleted = 1").collect()}
    assert hidden == {"b"}
    assert {r["k"] for r in changelog.compact(log, ["k"]).collect()} == {"a", "b", "c"}
    assert {r["k"] for r in changelog.compact(log, ["k"], drop_tombstones=True).collect()} == {"a", "c"}


def test_version_bounds(spark):
    assert ver.version(255, (1 << 44) - 1, 4095) == 2**64 - 1
    for bad in ((256, 0, 0), (0, 1 << 44, 0), (0, 0, 4096), (-1, 0, 0)):
        with pytest.raises(ValueError):
            ver.version(*bad)
    df = spark.createDataFrame([(128, 5, 3), (255, (1 << 44) - 1, 4095), (256, 0, 0)], "e int, o long, p int")
    got = [r[0] for r in df.select(ver.ingest_version(F.col("e"), F.col("o"), F.col("p"))).collect()]
    assert got[0] == Decimal(ver.version(128, 5, 3)) and got[1] == Decimal(2**64 - 1) and got[2] is None


def test_money_counts_once_an_order(spark, sf):
    from weir.plans.queries import Warehouse

    w = Warehouse(spark, sf)
    wide = w.wide()
    assert orders.check_single(w.payments()).count() == 0
    assert wide.select("detail_id").distinct().count() == wide.count()
    total = w.current().agg(F.sum("order_amount")).first()[0]
    in_wide = wide.select("order_id", "order_amount").distinct().agg(F.sum("order_amount")).first()[0]
    assert total == in_wide


def test_order_counts_are_those_of_the_tables(spark, sf):
    from weir.plans.queries import Warehouse

    wide = Warehouse(spark, sf).wide()
    odd = wide.where("channel = '1-URGENT'").withColumns({"channel": F.lit(None).cast("string"), "order_id": F.concat(F.lit("N"), "order_id")})
    for lines in (wide, wide.unionByName(odd).unionByName(odd.withColumn("order_create_time", F.lit(None).cast("timestamp"))), wide.where("false")):
        current = orders.order_current(lines)
        tables = {"dwd_order_detail": lines, "ads_order_lifecycle": orders.lifecycle(current), "ads_order_daily": orders.daily(current)}
        assert {r["table_name"]: r["n"] for r in quality.order_counts(lines).collect()} == {k: t.count() for k, t in tables.items()}


def test_showing_keeps_deletes(spark):
    log = spark.createDataFrame([("a", "c", 128, 0, 1, (1, 2)), ("a", "d", 128, 0, 2, None), ("b", "c", 128, 0, 1, (3, None))], LOG.replace("v:int", "v:int,u:int"))
    assert [(r["k"], r["value"] and tuple(r["value"])) for r in changelog.showing(log, "v").collect()] == [("a", (1, None)), ("a", None), ("b", (3, None))]


def test_price_changes(spark):
    v = spark.createDataFrame([(1, 1, "a", 1, "c", Decimal("10.00"), "1900-01-01", "9999-12-31 23:59:59.999", 1)], "product_id long, version_no int, product_name string, category_id long, category_name string, price decimal(10,2), f string, t string, c int")
    v = v.select("product_id", "version_no", "product_name", "category_id", "category_name", "price", F.col("f").cast("timestamp").alias("effective_from"), F.col("t").cast("timestamp").alias("effective_to"), F.col("c").cast("byte").alias("is_current"), F.col("f").cast("timestamp").alias("updated_at"))
    ch = spark.createDataFrame([(1, Decimal("11.00"), "2000-01-01"), (1, Decimal("12.00"), "2001-01-01"), (1, Decimal("9.00"), "2001-01-01"), (1, Decimal("8.00"), "1899-01-01"), (2, Decimal("1.00"), "2000-01-01")], "product_id long, price decimal(10,2), t string").select("product_id", "price", F.col("t").cast("timestamp").alias("effective_from"))
    out, rejected = scd2.apply_price_changes(v, ch)
    rows = out.orderBy("version_no").collect()
    assert [(r["version_no"], str(r["price"]), r["is_current"]) for r in rows] == [(1, "10.00", 0), (2, "11.00", 0), (3, "9.00", 1)]
    assert all(a["effective_to"] == b["effective_from"] for a, b in zip(rows, rows[1:]))
    assert rejected.count() == 3
    assert scd2.overlaps(out).count() == scd2.overlapping_products(out).count() == scd2.not_one_current(out).count() == 0
    broken = out.withColumn("effective_to", F.lit("9999-01-01").cast("timestamp"))
    assert scd2.overlaps(broken).count() == 3 and scd2.overlapping_products(broken).count() == 1


def test_backfill_is_idempotent_and_reconciles(spark, sf, tmp_path):
    from weir.plans.queries import Warehouse

    w = Warehouse(spark, sf)
    span = backfill.parse_range("1996-01-01", "1997-01-01")
    out = w.offline(*span).cache()
    first = sinks.overwrite_partitions(out, str(tmp_path / "d"))
    second = sinks.overwrite_partitions(out, str(tmp_path / "d"))
    assert first[0] == 0 and second[0] == first[1] == second[2] > 0
    same = backfill.reconcile(out, out)
    assert sinks.reconciliation_report(same, *span)[0] and same.where("not is_match").count() == 0
    ok, text = sinks.reconciliation_report(backfill.reconcile(out, out.limit(0)), *span)
    assert not ok and "FAIL" in text and text.count("\n|") <= 22
    with pytest.raises(ValueError):
        sinks.overwrite_partitions(out.limit(0), str(tmp_path / "d"))
    with pytest.raises(ValueError):
        backfill.exit_code(0, True)
    assert backfill.exit_code(5, False) == 1 and backfill.exit_code(5, False, True) == 0


@pytest.mark.parametrize("bad", [("2024-1-01", "2024-02-01"), ("2024-02-01", "2024-01-01"), ("2024-01-01", "2024-01-01"), ("2024-13-01", "2025-01-01"), ("x", "y")])
def test_range_validation(bad):
    with pytest.raises(ValueError):
        backfill.parse_range(*bad)


def test_backfill_job(spark, sf, tmp_path):
    from weir.plans.queries import Warehouse

    w = Warehouse(spark, sf)
    args = (w.orders(), w.payments(), w.refunds())
    run = lambda realtime, **k: backfill.run(*args, realtime, str(tmp_path / "daily"), str(tmp_path / "recon"), "1996-01-01", "1997-01-01", **k)
    daily = w.offline().cache()  # the served metrics count failed payments too, so they differ
    first, second = run(daily), run(daily)
    assert first.code == second.code == 0 and "PASS" in first.report and second.rows[0] == second.rows[1] == first.rows[2] > 0
    stored = spark.read.parquet(str(tmp_path / "recon" / "start_date=1996-01-01" / "end_date=1997-01-01"))
    assert stored.count() == second.compared.count() and stored.where("not is_match").count() == 0
    wrong = daily.withColumn("total_orders", F.col("total_orders") + 1)
    assert run(wrong).code == run(w.daily()).code == 1 and run(wrong, allow_mismatch=True).code == 0
    with pytest.raises(ValueError):
        backfill.run(*args, daily, str(tmp_path / "daily"), str(tmp_path / "recon"), "2030-01-01", "2031-01-01")


def test_jdbc_subqueries_push_range_and_columns():
    q = readers.jdbc_range_query("payment_info", ["order_id", "payment_amount"], date(2024, 1, 1), date(2024, 2, 1))
    assert "JOIN order_info" in q and "t.order_id, t.payment_amount" in q and "< '2024-02-01" in q
    assert "JOIN" not in readers.jdbc_range_query("order_info", ["order_id"], date(2024, 1, 1), date(2024, 2, 1))


def test_snapshot_is_bounded(spark):
    log = spark.createDataFrame([("t", p, o, "v") for p in (0, 1) for o in range(5)], "topic string, partition int, offset long, value string")
    marks = spark.createDataFrame([("t", 0, 1, 3), ("t", 1, 2, 9), ("t", 2, 4, 4)], "topic string, partition int, low long, high long")
    rows, state = readers.snapshot(log, marks)
    assert rows.count() == 2 + 3
    assert {r["partition"]: r["complete"] for r in state.collect()} == {0: True, 1: False, 2: True}


def test_schema_evolution():
    T = contracts.T
    add = T.StructField("delivery_type", T.StringType())
    new = contracts.evolve(contracts.ORDER_INFO, add)
    assert new.version == 2 and contracts.evolve(new, add).version == 2
    assert contracts.compare_schema(contracts.ORDER_INFO.schema, new.schema) == []
    assert contracts.compare_schema(new.schema, contracts.ORDER_INFO.schema) == ["field delivery_type is gone"]
    narrow = contracts.schema("a int")
    assert contracts.compare_schema(contracts.schema("a bigint"), narrow) and not contracts.compare_schema(narrow, contracts.schema("a bigint"))
    with pytest.raises(ValueError):
        contracts.evolve(contracts.ORDER_INFO, T.StructField("must", T.StringType(), False))


def test_a_rule_without_value_fails(spark):
    rows = spark.createDataFrame([(n, 1.0 if n in (1, 8, 9, 10, 11, 14, 22, 23) else 100.0 if n in (5, 6, 7) else 0.0) for n in range(1, 25) if n != 21], "rule int, value double")
    out = {r["rule"]: r["passed"] for r in quality.judge(rows).collect()}
    assert [n for n, ok in out.items() if not ok] == [21]
    ok, text = sinks.quality_report(quality.judge(rows))
    assert not ok and "23/24" in text


@pytest.mark.parametrize("rule", [2, 3, 5, 13, 16, 17, 18, 19])
def test_an_injected_violation_fails_its_rule(spark, sf, rule):
    from weir.plans.queries import Warehouse

    w = Warehouse(spark, sf)
    facts, wide, funnel = w.facts().limit(50), w.wide().limit(50), w.funnel().limit(20)
    wide = wide.withColumn("unit_price", F.col("catalog_price"))
    if rule == 2:
        facts = facts.withColumn("event_id", F.lit(""))
    if rule == 3:
        facts = facts.withColumn("event_type", F.lit("other"))
    if rule == 5:
        facts = facts.withColumn("product_name", F.lit(None).cast("string"))
    if rule == 13:
        funnel = funnel.withColumn("cart_users", F.col("view_users") + 1)
    if rule == 16:
        wide = wide.withColumn("order_status", F.lit("LOST"))
    if rule in (17, 18):
        wide = wide.withColumns({"order_status": F.lit("REFUNDED"), "payment_status": F.lit("FAILED"), "refund_status": F.lit(None).cast("string")})
    if rule == 19:
        wide = wide.withColumn("unit_price", F.col("catalog_price") + 1)
    small = w.lifecycle().limit(0)
    got = quality.judge(quality.measure(facts, w.overview().limit(5), w.products().limit(0), w.categories().limit(0), funnel, wide, w.versions().limit(5), small, w.daily().limit(0)))
    assert not got.where(F.col("rule") == rule).first()["passed"]


def order_state(spark, path, **options):
    schemas = {}
    for e, key in live.ENTITIES.items():
        c = contracts.CONTRACTS[e].schema
        T = contracts.T
        value = T.StructType([T.StructField(f.name, f.dataType) for f in c.fields])
        keys = [T.StructField(k, c[k].dataType) for k in key]
        schemas[e] = T.StructType([*keys, T.StructField("op", T.StringType()), T.StructField("epoch", T.IntegerType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("value", value)])
    return live.OrderState(spark, str(path), schemas, **options)


class Feed:
    """Change rows by entity, batch by batch, and everything so far."""

    def __init__(self, spark, state):
        self.spark, self.state, self.offset, self.all = spark, state, 0, {e: [] for e in live.ENTITIES}

    def rows(self, entries):
        out = {}
        for entity, op, row in entries:
            self.offset += 1
            value = None if op == "d" else tuple(row[f] for f in contracts.CONTRACTS[entity].schema.names)
            out.setdefault(entity, []).append((*[row[k] for k in live.ENTITIES[entity]], op, 128, 0, self.offset, value))
        for e, r in out.items():
            self.all[e] += r
        return {e: self.spark.createDataFrame(r, self.state.schemas[e]) for e, r in out.items()}

    def whole(self):
        now = {e: changelog.fold(self.spark.createDataFrame(r, self.state.schemas[e]), live.ENTITIES[e]) for e, r in self.all.items()}
        return orders.daily(orders.order_current(orders.order_detail_wide(now["order_detail"], now["order_info"], now["dim_product_scd2"], now["payment_info"], now["refund_info"])))


def daily_rows(d):
    return sorted(map(tuple, d.select(*sorted(d.columns)).collect()))


def test_incremental_orders_equal_batch_and_retract(spark, tmp_path):
    state = order_state(spark, tmp_path, buckets=2)
    feed = Feed(spark, state)
    for batch, phase in enumerate(generators.order_phases(40, seed=2)):
        live.apply_batch(state, feed.rows(phase), batch)
    assert daily_rows(state.daily()) == daily_rows(feed.whole())
    assert state.daily().agg(F.sum("refunded_orders")).first()[0] > 0
    before, offset = daily_rows(state.daily()), feed.offset
    # Compaction changes no result and leaves one folder a bucket.
    state.compact(2)
    assert daily_rows(state.daily()) == before and state.current("order_info").count() == 40
    assert all(len(list(p.iterdir())) == 1 for p in tmp_path.glob("*/bucket=*"))
    # Deleting every header retracts every group; restoring brings them back; a repeated batch changes nothing.
    newest = {r[0]: r for r in feed.all["order_info"]}
    schema = state.schemas["order_info"]
    deletes = [(k, "d", 128, 0, offset + i, None) for i, k in enumerate(sorted(newest), 1)]
    gone = live.apply_batch(state, {"order_info": spark.createDataFrame(deletes, schema)}, 3)
    assert state.daily().count() == 0 and gone.where("op = 'd'").count() == len(before)
    back = [(k, "c", 128, 0, offset + 1000 + i, newest[k][5]) for i, k in enumerate(sorted(newest))]
    live.apply_batch(state, {"order_info": spark.createDataFrame(back, schema)}, 4)
    live.apply_batch(state, {"order_info": spark.createDataFrame(back, schema)}, 4)
    assert daily_rows(state.daily()) == before


def test_late_and_redated_product_versions_reach_the_facts(spark, tmp_path):
    state = order_state(spark, tmp_path, buckets=2)
    feed = Feed(spark, state)
    first = next(generators.order_phases(12, seed=4))
    live.apply_batch(state, feed.rows([x for x in first if x[0] != "dim_product_scd2"]), 0)
    assert state.daily().count() == 0
    versions = [x for x in first if x[0] == "dim_product_scd2"]
    live.apply_batch(state, feed.rows(versions[::2]), 1)
    live.apply_batch(state, feed.rows(versions[1::2]), 2)
    assert daily_rows(state.daily()) == daily_rows(feed.whole()) != []
    used = {r["product_id"] for e, _, r in first if e == "order_detail"}
    late = [("dim_product_scd2", "u", {**r, "effective_from": generators.LAST}) for _, _, r in versions if r["product_id"] in used and r["is_current"]][:4]
    live.apply_batch(state, feed.rows(late), 3)
    assert daily_rows(state.daily()) == daily_rows(feed.whole())
    live.apply_batch(state, feed.rows([("dim_product_scd2", "d", r) for _, _, r in versions]), 4)
    assert daily_rows(state.daily()) == daily_rows(feed.whole()) == []


def test_state_forgets_after_its_time(spark, tmp_path):
    from datetime import datetime, timedelta

    state = order_state(spark, tmp_path, buckets=2)
    feed = Feed(spark, state)
    first = next(generators.order_phases(10, seed=1))
    later = {f"O{i:06d}" for i in range(5, 10)}
    live.apply_batch(state, feed.rows(first), 0)
    before = daily_rows(state.daily())
    touched = [("order_info", "u", {**r, "update_time": r["update_time"] + timedelta(days=40)}) for e, _, r in first if e == "order_info" and r["order_id"] in later]
    live.apply_batch(state, feed.rows(touched), 1)
    state.compact(1, ttl_days=30, now=datetime(2024, 2, 20))
    assert {r[0] for r in state.log("order_info").select("order_id").collect()} == later
    assert state.log("order_detail").count() == 0 and state.log("dim_product_scd2").count() > 100
    assert daily_rows(state.daily()) == before


def test_order_stream_compacts(spark, tmp_path):
    import json
    from datetime import datetime

    state = order_state(spark, tmp_path / "state", buckets=2)
    feed = Feed(spark, state)
    first = next(generators.order_phases(6, seed=3))
    frames = feed.rows(first)
    log = tmp_path / "log"
    for i, part in enumerate((("dim_product_scd2", "order_info"), ("order_detail",))):
        rows = [(e, r["row"]) for e in part for r in frames[e].select(F.to_json(F.struct("*")).alias("row")).collect()]
        spark.createDataFrame(rows, "entity string, row string").coalesce(1).write.mode("append").parquet(str(log))
        stream = spark.readStream.schema("entity string, row string").parquet(str(log))
        live.start(stream, state, str(tmp_path / "check"), compact_every=1, ttl_days=None, clock=lambda: datetime(2024, 1, 2), availableNow=True).awaitTermination()
    assert json.dumps(daily_rows(state.daily()), default=str) == json.dumps(daily_rows(feed.whole()), default=str) != "[]"


def forgetful(spark, path, n=6):
    """A state whose orders are all served and, but for product versions, forgotten; with a feed and what is served."""
    from datetime import datetime

    state = order_state(spark, path, buckets=2, clock=lambda: datetime(2024, 1, 2))
    feed = Feed(spark, state)
    phases = list(generators.order_phases(n, seed=1))
    live.apply_batch(state, feed.rows(phases[0]), 0)
    state.compact(0, ttl_days=30, now=datetime(2024, 6, 1))
    assert state.log("order_info").count() == state.log("order_detail").count() == state.lines(state.log("dim_product_scd2").select("product_id")).count() == 0
    return state, feed, phases, daily_rows(state.daily())


def test_a_late_payment_of_a_forgotten_order_changes_nothing(spark, tmp_path):
    state, feed, phases, before = forgetful(spark, tmp_path)
    late = [x for x in phases[1] if x[0] == "payment_info"]
    live.apply_batch(state, feed.rows(late), 1)
    assert late and before and daily_rows(state.daily()) == before
    live.apply_batch(state, feed.rows([x for x in phases[1] if x[0] == "order_info"]), 2)
    assert daily_rows(state.daily()) == before


def test_a_price_correction_after_forgetting_changes_nothing(spark, tmp_path):
    from datetime import timedelta

    state, feed, phases, before = forgetful(spark, tmp_path)
    moved = [("dim_product_scd2", "u", {**r, "effective_from": r["effective_from"] + timedelta(days=1)}) for e, _, r in phases[0] if e == "dim_product_scd2"]
    live.apply_batch(state, feed.rows(moved), 1)
    assert daily_rows(state.daily()) == before != []


def test_a_change_delivered_again_after_forgetting_brings_nothing_back(spark, tmp_path):
    from datetime import datetime

    state = order_state(spark, tmp_path, buckets=2, clock=lambda: datetime(2024, 3, 1))
    feed = Feed(spark, state)
    first = next(generators.order_phases(4, seed=1))
    rows = feed.rows(first)
    live.apply_batch(state, rows, 0)
    header = next(r for e, _, r in first if e == "order_info")
    live.apply_batch(state, feed.rows([("order_info", "d", header)]), 1)
    assert state.daily().agg(F.sum("total_orders")).first()[0] == 3
    # Two days later the delete is younger than the time to live, and still known; weeks later nothing is.
    for upto, now in ((1, datetime(2024, 3, 3)), (2, datetime(2024, 3, 4)), (3, datetime(2024, 6, 1))):
        state.compact(upto, ttl_days=30, now=now)
        assert (state.log("order_info").where("value is null").count() == 1) == (upto < 3)
        live.apply_batch(state, {e: r for e, r in rows.items() if e != "dim_product_scd2"}, upto + 1)
        assert state.daily().agg(F.sum("total_orders")).first()[0] == 3


def test_amounts_of_forgotten_payments_stay(spark, tmp_path):
    from datetime import datetime, timedelta

    state = order_state(spark, tmp_path, buckets=2)
    feed = Feed(spark, state)
    phases = list(generators.order_phases(20, seed=2))
    live.apply_batch(state, feed.rows(phases[0]), 0)
    live.apply_batch(state, feed.rows(phases[1]), 1)
    before = state.daily().agg(F.sum("paid_amount")).first()[0]
    later = lambda e, op, r: (e, op, {**r, "update_time": r["update_time"] + timedelta(days=60)})
    newest = {(e, r.get("order_id"), r.get("detail_id")): later(e, "u", r) for p in phases[:2] for e, _, r in p if e in ("order_info", "order_detail")}
    live.apply_batch(state, feed.rows(newest.values()), 2)
    state.compact(2, ttl_days=30, now=datetime(2024, 3, 1))
    assert state.log("payment_info").count() == 0 < state.log("order_info").count()
    live.apply_batch(state, feed.rows(newest.values()), 3)
    assert state.daily().agg(F.sum("paid_amount")).first()[0] == before > 0


def test_versions_are_read_together(spark, tmp_path):
    T = contracts.T
    first = contracts.Contract("t", contracts.schema("k string not null, n int not null"), ("k",), "t")
    second = contracts.evolve(first, T.StructField("kind", T.StringType()), fill={"kind": "IF(n > 1, 'many', 'one')"})
    third = contracts.evolve(second, T.StructField("extra", T.IntegerType()))
    for version, rows, ddl in ((1, [("a", 1), ("b", 2)], "k string, n int"), (2, [("c", 3, "x"), ("d", 4, None)], "k string, n int, kind string"), (3, [("e", 5, "y", 6)], "k string, n int, kind string, extra int")):
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / f"version={version}"))
    got = sorted(map(tuple, readers.read_versions(spark, str(tmp_path), third).collect()))
    assert got == [("a", 1, "one", None), ("b", 2, "many", None), ("c", 3, "x", None), ("d", 4, None, None), ("e", 5, "y", 6)]
    with pytest.raises(Exception, match="a newer version than 2"):
        readers.read_versions(spark, str(tmp_path), second).collect()


def test_a_batch_finds_buckets_once_and_keeps_plans_short(spark, tmp_path):
    state = order_state(spark, tmp_path, buckets=2)
    keys = spark.createDataFrame([("a",), ("b",)], "order_id string")
    for _ in range(2):
        state.orders(None, keys)
    assert len(state.hit) == 1
    staged = state.staged("some", keys.groupBy("order_id").count())
    assert "Exchange" not in staged._jdf.queryExecution().executedPlan().toString() and staged.count() == 2


def test_a_batch_does_side_by_side_what_needs_nothing_of_each_other(spark, tmp_path, monkeypatch):
    import threading

    state, met, write = order_state(spark, tmp_path, buckets=2), threading.Barrier(2, timeout=60), live.OrderState._write

    def meeting(self, name, *args):
        if name in ("order_info", "order_detail"):
            met.wait()  # fails unless the other is written at the same time
        write(self, name, *args)

    monkeypatch.setattr(live.OrderState, "_write", meeting)
    feed = Feed(spark, state)
    live.apply_batch(state, feed.rows(next(generators.order_phases(12, seed=4))), 0)
    assert daily_rows(state.daily()) == daily_rows(feed.whole()) != []
    state.compact(0)
    assert daily_rows(state.daily()) == daily_rows(feed.whole())
