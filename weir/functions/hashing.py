"""Identities of log records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _framed(c: Column) -> Column:
    """Length-prefixed bytes; a single byte FF for null."""
    raw = c.cast("binary")
    return F.when(c.isNull(), F.unhex(F.lit("FF"))).otherwise(F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw))


def message_id(topic: Column, partition: Column, offset: Column, key: Column, value: Column) -> Column:
    """SHA-256 over the length-prefixed position, key and value of a record: the same for each delivery."""
    parts = [topic.cast("string"), partition.cast("string"), offset.cast("string"), key, value]
    return F.sha2(F.concat(*map(_framed, parts)), 256)
