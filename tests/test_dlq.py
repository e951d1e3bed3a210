import hashlib
import json

import pytest
from pyspark.sql import functions as F

from weir.operators import dlq
from weir.sources import readers
from weir.sources.topics import TOPICS, differences, serving_key

FACTS = TOPICS["dwd_user_behavior"]

GOOD = {"event_id": "e1", "session_id": "s1", "event_sequence": 1, "event_version": 1, "user_id": 7, "product_id": 1, "shop_id": 2, "event_type": "pay", "channel": "app", "amount": "7.2500", "event_ts": "2024-03-05T06:07:08.25"}


def records(spark, rows, topic="t"):
    return spark.createDataFrame([(topic, 0, i, k, v) for i, (k, v) in enumerate(rows)], "topic string, partition int, offset long, key string, value string")


def run(spark, changes, topic=FACTS):
    good, bad = dlq.validate(records(spark, [(None, c if isinstance(c, str) else json.dumps({**GOOD, **c}))for c in changes]), topic)
    return good.collect(), {r["offset"]: r["error_message"] for r in bad.collect()}


def test_accepts_scale_zeros_and_drops_fraction(spark):
    good, bad = run(spark, [{}])
    assert not bad and str(good[0]["amount"]) == "7.25" and str(good[0]["event_ts"]) == "2024-03-05 06:07:08"
    assert good[0]["ingest_version"] == 128 << 56


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"user_id": "seven"}, "user_id: not int64"), ({"amount": "2,50"}, "amount: not decimal(10,2)"), ({"amount": "0.125"}, "amount: not decimal(10,2)"),
        ({"amount": "987654321"}, "amount: not decimal(10,2)"), ({"event_ts": "yesterday"}, "event_ts: not datetime"), ({"event_sequence": 5_000_000_000}, "event_sequence: not int32"),
        ({"user_id": True}, "user_id: not int64"), ({"event_version": -1}, "event_version: not uint64"), ({"amount": None}, "missing fields: amount"), ({"more": 1}, "unknown fields: more"),
        ("[1]", "value is no JSON object"), ("{oops", "value is no JSON object"), ({"event_ts": "2024-02-30 00:00:00"}, "event_ts: not datetime"),
    ],
)
def test_rejects(spark, change, reason):
    good, bad = run(spark, [change])
    assert not good and bad == {0: reason}


def test_integer_text_and_extremes_pass(spark):
    good, bad = run(spark, [{"user_id": "42", "event_version": 2**64 - 1, "event_sequence": -(2**31)}])
    assert not bad and good[0]["user_id"] == 42 and int(good[0]["event_version"]) == 2**64 - 1


def test_deletes(spark):
    r = records(spark, [('{"order_date": "2024-01-01", "channel": "app"}', None), (None, None), ('{"channel": "app"}', None)])
    good, bad = dlq.validate(r, TOPICS["ads_order_daily"])
    rows = good.collect()
    assert len(rows) == 1 and rows[0]["is_deleted"] == 1 and rows[0]["total_orders"] is None and str(rows[0]["order_date"]) == "2024-01-01"
    assert {x["error_message"] for x in bad.collect()} == {"delete without key"} and bad.count() == 2
    good, bad = dlq.validate(records(spark, [("k", None)]), FACTS)
    assert good.count() == bad.count() == 0


def test_envelope_identity_and_redaction(spark):
    _, bad = dlq.validate(records(spark, [("k", "{oops"), (None, "{oops"), ("", "{oops")]), FACTS)
    env = dlq.envelopes(bad, F.lit("now"))
    ids = [r["message_id"] for r in env.collect()]
    assert len(set(ids)) == 3 and ids == [r["message_id"] for r in env.collect()]
    out = dlq.redacted(env).orderBy("source_offset").collect()
    assert [r["key_bytes"] for r in out] == [1, None, 0] and all(r["value_bytes"] == 5 for r in out)


def test_repairs():
    value = json.dumps({"a": 1, "b": {"x": 1}})
    assert json.loads(dlq.repair(value, "t", dlq.Repair(patch={"b": 2}))[1]) == {"a": 1, "b": 2}
    assert dlq.repair(value, "t", dlq.Repair(original=True)) == ("t", value)
    assert dlq.repair(None, "t", dlq.Repair(original=True)) == ("t", None)
    assert json.loads(dlq.repair(None, "t", dlq.Repair(replacement={"c": 3}))[1]) == {"c": 3}
    for bad in (dlq.Repair(), dlq.Repair(patch={}, original=True), dlq.Repair(original=True, topic="u")):
        with pytest.raises(ValueError):
            dlq.repair(value, "t", bad)
    assert dlq.repair(value, "t", dlq.Repair(original=True, topic="u", allow_topic_change=True))[0] == "u"
    with pytest.raises(ValueError):
        dlq.repair(None, "t", dlq.Repair(patch={"a": 1}))


def test_replay_plan(spark):
    _, bad = dlq.validate(records(spark, [("k", "{oops"), ("l", "{oops")]), FACTS)
    env = dlq.envelopes(bad, F.lit("now")).withColumns({"replay_topic": F.lit(None).cast("string"), "replay_sha256": F.lit(None).cast("string")})
    one = env.limit(1)
    done = dlq.replayed(one, "t", F.lit("v"))
    log = env.withColumn("offset", F.lit(1)).unionByName(done.withColumn("offset", F.lit(2)))
    ids = [r["message_id"] for r in env.collect()]
    assert dlq.plan_replay(log, ids, True).count() == 1
    for args in ((ids, True, True), (ids[:1], False, True)):
        with pytest.raises(ValueError):
            dlq.plan_replay(log, *args)


def letters(spark, values, key="k", topic="dwd_user_behavior"):
    """A dead-letter log of the given values, in order, and its marks."""
    _, bad = dlq.validate(records(spark, [(key, v) for v in values], topic), TOPICS[topic])
    env = dlq.envelopes(bad, F.lit("2024-01-01 00:00:00")).withColumns({"topic": F.lit("dlq"), "partition": F.lit(0), "offset": F.col("source_offset")})
    return env, spark.createDataFrame([("dlq", 0, 0, len(values))], "topic string, partition int, low long, high long")


def test_replay_runs_once_and_leaves_an_audit(spark):
    log, marks = letters(spark, [json.dumps({**GOOD, "user_id": "seven"}), "{oops"])
    ids = [r["message_id"] for r in log.orderBy("offset").collect()]
    sent, audits = [], []
    fix = dlq.Repair(patch={"user_id": 7})
    run = lambda **k: dlq.replay(log, marks, ids[0], fix, lambda r: sent.extend(r.collect()), lambda a: audits.extend(a.collect()), F.lit("2024-01-02 00:00:00"), **k)
    plan = run()
    assert not plan.executed and not sent and not audits and json.loads(plan.record.first()["value"])["user_id"] == 7
    done = run(execute=True)
    assert done.executed and done.complete and [r["topic"] for r in sent] == ["dwd_user_behavior"] and sent[0]["key"] == "k"
    one = audits[0]
    assert (one["status"], one["message_id"], one["replay_topic"], one["replayed_at"]) == ("replayed", ids[0], "dwd_user_behavior", "2024-01-02 00:00:00")
    assert one["replay_sha256"] == hashlib.sha256(sent[0]["value"].encode()).hexdigest()
    with_audit = log.unionByName(done.audit.withColumns({"topic": F.lit("dlq"), "partition": F.lit(0), "offset": F.lit(2).cast("long")}), allowMissingColumns=True)
    later = spark.createDataFrame([("dlq", 0, 0, 3)], marks.schema)
    with pytest.raises(LookupError):
        dlq.replay(with_audit, later, ids[0], fix, sent.append, audits.append, F.lit("x"), execute=True)


def test_replay_refuses(spark):
    log, marks = letters(spark, [json.dumps({**GOOD, "user_id": "seven"}), "{oops"])
    ids = [r["message_id"] for r in log.orderBy("offset").collect()]

    def refused(error, message, *, name=ids[0], how=dlq.Repair(patch={"user_id": 7}), of=log, upto=marks):
        with pytest.raises(error, match=message):
            dlq.replay(of, upto, name, how, pytest.fail, pytest.fail, F.lit("x"), execute=True)

    refused(ValueError, "rejected again: user_id: not int64", how=dlq.Repair(patch={"user_id": "eight"}))
    refused(ValueError, "rejected again", how=dlq.Repair(original=True))
    refused(ValueError, "rejected again: unknown fields", how=dlq.Repair(patch={"user_id": 7, "more": 1}))
    refused(ValueError, "no JSON", name=ids[1])
    refused(ValueError, "is no loader topic", how=dlq.Repair(replacement=GOOD, topic="elsewhere", allow_topic_change=True))
    refused(ValueError, "allow_topic_change", how=dlq.Repair(replacement=GOOD, topic="ads_order_daily"))
    refused(LookupError, "no pending letter", name="0" * 64)
    refused(RuntimeError, "end of every partition", upto=spark.createDataFrame([("dlq", 0, 0, 9)], marks.schema))
    empty = marks.unionByName(spark.createDataFrame([("dlq", 1, 5, 5)], marks.schema))
    assert dlq.replay(log, empty, ids[0], dlq.Repair(patch={"user_id": 7}), lambda r: None, lambda a: None, F.lit("x"), execute=True).executed


def test_malformed_letters_are_set_aside(spark):
    log, marks = letters(spark, [json.dumps({**GOOD, "user_id": "seven"})] * 2)
    spoilt = {
        "message_id is no SHA-256": {"message_id": F.lit("12")}, "unknown schema version 2": {"schema_version": F.lit(2)}, "unknown topic other": {"source_topic": F.lit("other")},
        "no base64: value_base64": {"value_base64": F.lit("***")}, "missing fields: error_type,failed_at": {"error_type": F.lit(None).cast("string"), "failed_at": F.lit(None).cast("string")},
    }
    for reason, change in spoilt.items():
        good, bad = dlq.well_formed(log.withColumns(change))
        assert good.count() == 0 and {r["reason"] for r in bad.collect()} == {reason}
    assert dlq.well_formed(log)[1].count() == 0
    assert {r["reason"] for r in dlq.well_formed(log.drop("failed_at"))[1].collect()} == {"missing fields: failed_at"}
    with pytest.raises(LookupError):
        dlq.replay(log.withColumn("schema_version", F.lit(2)), marks, log.first()["message_id"], dlq.Repair(original=True), print, print, F.lit("x"))


def test_topics_agree_with_contracts_and_outputs(spark, sf):
    from weir.plans.queries import Warehouse

    w = Warehouse(spark, sf)
    made = {
        "dwd_user_behavior": w.facts(), "ads_realtime_overview": w.overview(), "ads_product_rank": w.products(), "ads_category_rank": w.categories(), "ads_channel_funnel": w.funnel(),
        "dwd_order_detail": w.wide(), "ads_order_lifecycle": w.lifecycle(), "ads_order_daily": w.daily(), "dwd_dirty_behavior": w.dirty().drop("event_ts", "proc_time"),
        "ods_dim_product_scd2": w.versions(),
    }
    assert set(made) == set(TOPICS)
    for name, df in made.items():
        assert differences(TOPICS[name], df.schema) == [], name
    assert serving_key("dwd_dirty_behavior") == ("source_topic", "source_partition", "source_offset")
    assert len(TOPICS) == 10 and all(set(t.required) | set(t.key) <= set(t.types) for t in TOPICS.values())
    wrong = w.daily().withColumn("total_orders", F.lit(1)).drop("channel").withColumn("x", F.lit(1))
    assert differences(TOPICS["ads_order_daily"], wrong.schema) == ["channel is missing", "x is unknown", "total_orders is int32, not int64"]


def test_contracts_agree_with_what_is_captured(spark, sf):
    """Names, types, keys and log topics of every entity, against the tables and change logs that the warehouse makes."""
    from weir.plans.queries import Warehouse
    from weir.sources import derived
    from weir.sources.contracts import CONTRACTS

    w = Warehouse(spark, sf)
    logs = derived.change_logs(spark, sf, w.versions())
    for name, log in logs.items():
        c = CONTRACTS[name]
        assert log.columns == [*c.key, "op", "epoch", "partition", "offset", "value"]
        assert {f.name: f.dataType for f in log.schema["value"].dataType.fields} == {f.name: f.dataType for f in c.schema.fields}, name
        assert all(not c.schema[k].nullable for k in c.key) and c.soft_delete and c.topic.startswith("ods_")
    behavior = CONTRACTS["user_behavior"]
    assert {f.name: f.dataType for f in w.events().drop("event_ts", "proc_time").schema.fields} == {f.name: f.dataType for f in behavior.schema.fields}
    assert len({c.topic for c in CONTRACTS.values()}) == len(CONTRACTS) == 6 and not behavior.soft_delete


def test_replay_keeps_bytes(spark):
    """What isn't changed is sent as it was, whatever its bytes; the letter's key too."""
    value = json.dumps({**GOOD, "channel": "caf"}).encode().replace(b"caf", b"caf\xe9")
    raw = spark.createDataFrame([("dwd_user_behavior", 0, 0, b"k\xe9", value)], "topic string, partition int, offset long, key binary, value binary")
    bad = raw.select("*", F.lit("ValidationError").alias("error_type"), F.lit("x").alias("error_message"))
    log = dlq.envelopes(bad, F.lit("2024-01-01 00:00:00")).withColumns({"topic": F.lit("dlq"), "partition": F.lit(0), "offset": F.lit(0).cast("long")})
    letter, sent = log.first(), []
    done = dlq.replay(log, None, letter["message_id"], dlq.Repair(original=True), lambda r: sent.extend(r.collect()), lambda a: None, F.lit("x"), execute=True)
    assert bytes(sent[0]["key_bytes"]) == b"k\xe9" and bytes(sent[0]["value_bytes"]) == value
    assert done.audit.first()["replay_sha256"] == hashlib.sha256(value).hexdigest()
    patched = dlq.candidate(letter, dlq.Repair(patch={"channel": "é"}), spark).first()
    assert bytes(patched["key_bytes"]) == b"k\xe9" and json.loads(bytes(patched["value_bytes"]))["channel"] == "é"
    assert {r["reason"] for r in dlq.well_formed(log.drop("key_base64", "value_base64"))[1].collect()} == {"missing fields: key_base64,value_base64"}


def test_scan_fixes_marks_and_tells_when_it_was_cut(spark, tmp_path):
    log, _ = letters(spark, [json.dumps({**GOOD, "user_id": "seven"})] * 3)
    path = str(tmp_path / "log")
    log.write.parquet(path)
    stored = spark.read.parquet(path)
    marks = readers.watermarks(stored)
    log.withColumn("offset", F.col("offset") + 3).write.mode("append").parquet(path)
    assert [tuple(r) for r in marks.collect()] == [("dlq", 0, 0, 3)]
    grown = spark.read.parquet(path)
    whole, old, cut = readers.scan(grown), readers.scan(grown, marks), readers.scan(grown, limit=2)
    assert [(s.scanned, s.complete, s.truncated) for s in (whole, old, cut)] == [(6, True, False), (3, True, False), (2, False, True)]
    assert readers.scan(grown, limit=6).complete and not readers.scan(grown, limit=6).truncated
    assert readers.scan(grown.limit(0)).complete
    fix, name = dlq.Repair(patch={"user_id": 7}), log.first()["message_id"]
    run = lambda **k: dlq.replay(grown, None, name, fix, lambda r: None, lambda a: None, F.lit("x"), **k)
    with pytest.raises(RuntimeError, match="cut short"):
        run(execute=True, scan_limit=2)
    plan = run(scan_limit=2)
    assert plan.truncated and plan.scanned == 2 and not plan.executed and run(execute=True).executed


def test_large_numbers_are_exact(spark):
    topic = TOPICS["ads_order_daily"]
    values = ["73178117.31", "12345678901234567890.12", "9999999.99", "10000000.5", '"73178117.31"', "73178117.314", "1E5"]
    rows = [("k", f'{{"order_date":"2024-01-01","channel":"c{i}","order_amount":{v}}}') for i, v in enumerate(values)]
    good, bad = dlq.validate(records(spark, rows, "ads_order_daily"), topic)
    got = {r["channel"]: str(r["order_amount"]) for r in good.collect()}
    assert {k: got[k] for k in ("c0", "c1", "c2", "c3", "c4")} == {"c0": "73178117.31", "c1": "12345678901234567890.12", "c2": "9999999.99", "c3": "10000000.50", "c4": "73178117.31"}
    assert [r["error_message"] for r in bad.where("value like '%c5%'").collect()] == ["order_amount: not decimal(22,2)"]
