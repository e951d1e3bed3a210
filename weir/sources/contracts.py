"""Schemas, keys and delete semantics of every entity, and schema-evolution checks."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

#: The domains of the warehouse.
EVENT_TYPES = ("view", "cart", "order", "pay")
CHANNELS = ("app", "h5", "wechat", "search", "ad")
ORDER_STATUSES = ("CREATED", "PAID", "CANCELLED", "REFUNDED")
DIRTY_CODES = ("EMPTY_EVENT_ID", "EMPTY_SESSION_ID", "EMPTY_USER_ID", "INVALID_EVENT_TYPE", "INVALID_EVENT_TIME")
OPEN_END = "9999-12-31 23:59:59.999"


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "tinyint": T.ByteType(), "timestamp": T.TimestampType(), "date": T.DateType()}


def schema(text: str) -> T.StructType:
    """A flat schema from DDL, without a session: "name type [not null], ..."."""
    fields = []
    for name, kind, null in re.findall(r"(\w+) (\w+(?:\(\d+,\d+\))?)( not null)?", text):
        size = re.fullmatch(r"decimal\((\d+),(\d+)\)", kind)
        fields.append(T.StructField(name, T.DecimalType(int(size[1]), int(size[2])) if size else _TYPES[kind], not null))
    return T.StructType(fields)


@dataclass(frozen=True)
class Contract:
    """An entity: schema, primary key, log topic, and what a null value of a key means."""

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    topic: str
    soft_delete: bool = True
    version: int = 1
    required: tuple[str, ...] = field(default=())
    #: Added field -> (version that has it first, SQL of its value in rows of older versions).
    since: Mapping[str, tuple[int, str]] = field(default_factory=dict)


BEHAVIOR = Contract(
    "user_behavior",
    schema(
        "event_id string, session_id string, order_id string, event_sequence int, event_version bigint, user_id bigint, "
        "product_id bigint, shop_id bigint, event_type string, channel string, amount decimal(10,2), event_time string"
    ),
    ("event_id",), "ods_user_behavior", soft_delete=False,
)
ORDER_INFO = Contract(
    "order_info",
    schema(
        "order_id string not null, user_id bigint not null, shop_id bigint not null, order_status string not null, channel string not null, "
        "order_amount decimal(12,2) not null, promotion_code string, create_time timestamp not null, update_time timestamp not null, version_no bigint not null"
    ),
    ("order_id",), "ods_order_info",
)
ORDER_DETAIL = Contract(
    "order_detail",
    schema(
        "detail_id string not null, order_id string not null, product_id bigint not null, quantity int not null, unit_price decimal(10,2) not null, "
        "detail_amount decimal(12,2) not null, create_time timestamp not null, update_time timestamp not null, version_no bigint not null"
    ),
    ("detail_id",), "ods_order_detail",
)
PAYMENT_INFO = Contract(
    "payment_info",
    schema(
        "payment_id string not null, order_id string not null, payment_status string not null, payment_method string not null, "
        "payment_amount decimal(12,2) not null, payment_time timestamp, update_time timestamp not null, version_no bigint not null"
    ),
    ("payment_id",), "ods_payment_info",
)
REFUND_INFO = Contract(
    "refund_info",
    schema(
        "refund_id string not null, order_id string not null, payment_id string not null, refund_status string not null, refund_amount decimal(12,2) not null, "
        "refund_reason string, refund_time timestamp, update_time timestamp not null, version_no bigint not null"
    ),
    ("refund_id",), "ods_refund_info",
)
PRODUCT_SCD2 = Contract(
    "dim_product_scd2",
    schema(
        "product_id bigint not null, version_no int not null, product_name string not null, category_id bigint not null, category_name string not null, "
        "price decimal(10,2) not null, effective_from timestamp not null, effective_to timestamp not null, is_current tinyint not null, updated_at timestamp not null"
    ),
    ("product_id", "version_no"), "ods_dim_product_scd2",
)
CONTRACTS = {c.name: c for c in (BEHAVIOR, ORDER_INFO, ORDER_DETAIL, PAYMENT_INFO, REFUND_INFO, PRODUCT_SCD2)}


def compare_schema(old: T.StructType, new: T.StructType) -> list[str]:
    """Why ``new`` is not a backward-additive evolution of ``old``; empty if it is.

    Adding nullable fields is additive; dropping (or renaming) fields, narrowing types, and adding
    or turning fields required are not.
    """
    wider = {("int", "bigint"), ("tinyint", "int"), ("tinyint", "bigint"), ("float", "double")}
    have, found = {f.name: f for f in new.fields}, []
    for f in old.fields:
        n = have.pop(f.name, None)
        if n is None:
            found.append(f"field {f.name} is gone")
            continue
        a, b = f.dataType, n.dataType
        decimal = isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType) and b.scale >= a.scale and b.precision - b.scale >= a.precision - a.scale
        if a != b and not decimal and (a.simpleString(), b.simpleString()) not in wider:
            found.append(f"field {f.name} changes from {a.simpleString()} to {b.simpleString()}")
        if f.nullable and not n.nullable:
            found.append(f"field {f.name} becomes required")
    return found + [f"new field {n} is required" for n, f in have.items() if not f.nullable]


def evolve(contract: Contract, *fields: T.StructField, fill: Mapping[str, str] | None = None) -> Contract:
    """The next version of a contract with ``fields`` added; adding what is there changes nothing.

    ``fill``: SQL over the older fields for what rows of older versions get, null by default.
    """
    have = {f.name for f in contract.schema.fields}
    new = [f for f in fields if f.name not in have]
    schema = T.StructType([*contract.schema.fields, *new])
    if problems := compare_schema(contract.schema, schema):
        raise ValueError("; ".join(problems))
    version = contract.version + bool(new)
    since = {**contract.since, **{f.name: (version, (fill or {}).get(f.name, "NULL")) for f in new}}
    return replace(contract, schema=schema, version=version, since=since)
