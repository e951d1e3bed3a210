from datetime import datetime

from pyspark.sql import functions as F

from weir.operators import behavior
from weir.sources import derived, generators, readers
from weir.sources.contracts import BEHAVIOR


def events(spark, rows):
    full = [{"event_id": "e", "session_id": "s", "user_id": 1, "event_type": "view", "channel": "app", "amount": "1.00", "event_time": "2024-01-01 00:00:00", **r} for r in rows]
    import json

    lines = spark.createDataFrame([(json.dumps(r),) for r in full], "value string")
    return readers.with_event_time(readers.decode_json(lines, BEHAVIOR.schema))


def test_partition_property(spark, sf):
    e = derived.behavior(spark, sf)
    key = "concat_ws('|', product_id, shop_id, event_time, session_id)"
    seen = behavior.dirty(e).selectExpr(f"{key} as k")
    lost = e.where("event_type is null").selectExpr(f"{key} as k").join(seen, "k", "left_anti").count()
    assert behavior.clean(e).count() + behavior.dirty(e).count() + lost == e.count()
    assert behavior.clean(e).count() + behavior.dirty(e, strict=True).count() == e.count()


def test_reasons_come_in_order(spark):
    e = events(spark, [{"event_id": None, "session_id": " ", "user_id": None, "event_type": "x", "event_time": "bad"}, {"event_id": "", "event_type": None}])
    got = [r[0] for r in behavior.dirty(e).select("error_reason").collect()]
    assert sorted(got) == ["EMPTY_EVENT_ID", "EMPTY_EVENT_ID;EMPTY_SESSION_ID;EMPTY_USER_ID;INVALID_EVENT_TYPE;INVALID_EVENT_TIME"]


def test_decode_skips_noise_and_nulls_mistyped_fields(spark):
    lines = spark.createDataFrame([("not json",), (None,), ('{"event_id": "a", "user_id": "x"}',), ('{"event_id": "b", "user_id": 7, "more": 1}',), ("[1]",)], "value string")
    got = {r["event_id"]: r["user_id"] for r in readers.decode_json(lines, BEHAVIOR.schema).collect()}
    assert got == {"a": None, "b": 7}


def test_funnel_is_strict(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    rows = [{"session_id": "ok", "event_type": t, "event_time": at(i)} for i, t in enumerate(("view", "cart", "order", "pay"))]
    rows += [{"session_id": "back", "event_type": t, "event_time": at(i)} for i, t in enumerate(("cart", "view", "order", "pay"))]
    rows += [{"session_id": "same", "event_type": t, "event_time": at(9)} for t in ("view", "cart")]
    r = behavior.funnel(behavior.clean(events(spark, rows))).first()
    assert (r["view_users"], r["cart_users"], r["order_users"], r["pay_users"]) == (3, 2, 1, 1)
    assert r["window_start"] == datetime(2024, 1, 1)


def test_lookup_misses_keep_the_fact(spark):
    e = events(spark, [{"product_id": 9999, "shop_id": 1}])
    dims = [spark.createDataFrame(r, s) for r, s in (([], "product_id long, product_name string, category_id long, category_name string"), ([(1, "shop", 5)], "shop_id long, shop_name string, region_id long"), ([(5, "p", "c")], "region_id long, province string, city string"))]
    r = behavior.enrich(e, *dims).first()
    assert (r["product_name"], r["shop_name"], r["province"], r["city"]) == (None, "shop", "p", "c")


def test_generated_journeys(spark):
    rows = generators.journeys(300, seed=3)
    assert rows == generators.journeys(300, seed=3)
    e = events(spark, rows)
    good = behavior.clean(e)
    assert 0 < behavior.dirty(e).count() < 30
    assert behavior.overview(good).where("uv > pv").count() == 0
    f = behavior.funnel(good).where("cart_users > view_users or order_users > cart_users or pay_users > order_users")
    assert f.count() == 0
    assert len(generators.independent_events(200, seed=1)) == 200
