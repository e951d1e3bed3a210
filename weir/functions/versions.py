"""Versions of log positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of (epoch, offset, partition) in a version.
EPOCH_BITS, OFFSET_BITS, PARTITION_BITS = 8, 44, 12


def ingest_version(epoch: Column, offset: Column, partition: Column) -> Column:
    """Unsigned 64-bit version of a log position as decimal(20,0): equal on replay, larger in a later epoch.

    Null where a part is out of its range.
    """
    fits = [(c >= 0) & (c < 1 << bits) for c, bits in ((epoch, EPOCH_BITS), (offset, OFFSET_BITS), (partition, PARTITION_BITS))]
    d = lambda c: c.cast("decimal(20,0)")
    power = lambda n: F.lit(str(1 << n)).cast("decimal(20,0)")
    value = d(epoch) * power(OFFSET_BITS + PARTITION_BITS) + d(offset) * power(PARTITION_BITS) + d(partition)
    return F.when(fits[0] & fits[1] & fits[2], value.cast("decimal(20,0)"))


def version(epoch: int, offset: int, partition: int) -> int:
    """The same in Python; ValueError out of range."""
    for name, v, bits in (("epoch", epoch, EPOCH_BITS), ("offset", offset, OFFSET_BITS), ("partition", partition, PARTITION_BITS)):
        if not 0 <= v < 1 << bits:
            raise ValueError(f"{name} {v} is not in [0, 2^{bits})")
    return epoch << OFFSET_BITS + PARTITION_BITS | offset << PARTITION_BITS | partition
