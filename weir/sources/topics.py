"""The loader's topics: target table, field types, required fields, keys, delete rule."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import types as T

from .contracts import BEHAVIOR, PRODUCT_SCD2, schema


@dataclass(frozen=True)
class Topic:
    """Types: string, int8, int32, int64, uint64, decimal(p,s), datetime, date."""

    table: str
    types: Mapping[str, str]
    required: tuple[str, ...]
    key: tuple[str, ...]
    soft_delete: bool = False


_KINDS = {"tinyint": "int8", "int": "int32", "bigint": "int64", "timestamp": "datetime"}


def kind_of(column: T.DataType) -> str:
    """The loader's name of a column type."""
    name = column.simpleString()
    return _KINDS.get(name, name)


def _topic(table: str, columns: T.StructType, key: tuple[str, ...], soft_delete: bool = False) -> Topic:
    """Fields from a table's columns: those that aren't null are required; event versions are unsigned."""
    types = {f.name: "uint64" if f.name == "event_version" else kind_of(f.dataType) for f in columns.fields}
    return Topic(table, types, tuple(f.name for f in columns.fields if not f.nullable), key, soft_delete)


#: The columns of the served tables, as their topics carry them.
_DIRTY = T.StructType([*BEHAVIOR.schema.fields, T.StructField("error_reason", T.StringType(), False)])
_FACTS = schema(
    "event_id string not null, session_id string not null, order_id string, event_sequence int not null, event_version bigint not null, user_id bigint not null, "
    "product_id bigint not null, product_name string, category_id bigint, category_name string, shop_id bigint not null, shop_name string, event_type string not null, "
    "channel string not null, amount decimal(10,2) not null, province string, city string, event_ts timestamp not null"
)
_OVERVIEW = schema(
    "window_start timestamp not null, window_end timestamp not null, pv bigint not null, uv bigint not null, cart_users bigint not null, order_users bigint not null, "
    "pay_users bigint not null, pay_amount decimal(18,2) not null"
)
_PRODUCTS = schema(
    "window_start timestamp not null, window_end timestamp not null, product_id bigint not null, product_name string, category_name string, pay_count bigint not null, "
    "pay_amount decimal(18,2) not null"
)
_CATEGORIES = schema(
    "window_start timestamp not null, window_end timestamp not null, category_name string not null, pay_count bigint not null, pay_users bigint not null, "
    "pay_amount decimal(18,2) not null"
)
_FUNNEL = schema(
    "window_start timestamp not null, window_end timestamp not null, channel string not null, view_users bigint not null, cart_users bigint not null, "
    "order_users bigint not null, pay_users bigint not null"
)
_ORDER_LINES = schema(
    "detail_id string not null, order_id string, user_id bigint, shop_id bigint, product_id bigint, product_name string, category_id bigint, category_name string, "
    "product_version int, catalog_price decimal(10,2), quantity int, unit_price decimal(10,2), detail_amount decimal(12,2), order_status string, "
    "order_amount decimal(12,2), channel string, promotion_code string, payment_id string, payment_status string, payment_method string, "
    "payment_amount decimal(12,2), payment_time timestamp, refund_id string, refund_status string, refund_amount decimal(12,2), refund_reason string, "
    "refund_time timestamp, order_create_time timestamp, order_update_time timestamp, detail_update_time timestamp, order_version bigint, detail_version bigint, "
    "payment_version bigint, refund_version bigint"
)
_LIFECYCLE = schema(
    "channel string not null, total_orders bigint, paid_orders bigint, cancelled_orders bigint, refunded_orders bigint, "
    "order_amount decimal(22,2), paid_amount decimal(22,2), refund_amount decimal(22,2)"
)
_DAILY = T.StructType([T.StructField("order_date", T.DateType(), False), *_LIFECYCLE.fields])
TOPICS = {
    "dwd_dirty_behavior": _topic("dwd_dirty_behavior", _DIRTY, ()),
    "dwd_user_behavior": _topic("dwd_user_behavior", _FACTS, ("event_id",)),
    "ads_realtime_overview": _topic("ads_realtime_overview", _OVERVIEW, ("window_start", "window_end")),
    "ads_product_rank": _topic("ads_product_rank", _PRODUCTS, ("window_start", "window_end", "product_id")),
    "ads_category_rank": _topic("ads_category_rank", _CATEGORIES, ("window_start", "window_end", "category_name")),
    "ads_channel_funnel": _topic("ads_channel_funnel", _FUNNEL, ("window_start", "window_end", "channel")),
    "ods_dim_product_scd2": _topic("dim_product_scd2", PRODUCT_SCD2.schema, PRODUCT_SCD2.key, True),
    "dwd_order_detail": _topic("dwd_order_detail", _ORDER_LINES, ("detail_id",), True),
    "ads_order_lifecycle": _topic("ads_order_lifecycle", _LIFECYCLE, ("channel",), True),
    "ads_order_daily": _topic("ads_order_daily", _DAILY, ("order_date", "channel"), True),
}
#: The dirty table's key is the log position, since its event_id may be null.
POSITION_KEY = ("source_topic", "source_partition", "source_offset")


def serving_key(topic: str) -> tuple[str, ...]:
    """The columns that identify a row of the topic's table."""
    return TOPICS[topic].key or POSITION_KEY


def differences(topic: Topic, columns: T.StructType) -> list[str]:
    """Where a table's columns don't fit a topic: missing or unknown names, other types. Signed versions fit unsigned ones, text fits dates."""
    have = {f.name: kind_of(f.dataType) for f in columns.fields}
    out = [f"{n} is missing" for n in topic.types if n not in have] + [f"{n} is unknown" for n in have if n not in topic.types]
    fits = lambda want, got: want == got or (want, got) in (("uint64", "int64"), ("date", "string"))
    return out + [f"{n} is {have[n]}, not {k}" for n, k in topic.types.items() if n in have and not fits(k, have[n])]
