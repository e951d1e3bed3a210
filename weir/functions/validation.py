"""Type checks of text values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import normal_datetime

_INT_RANGE = {"int8": (-(2**7), 2**7 - 1), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1), "uint64": (0, 2**64 - 1)}


def fits(value: Column, kind: str) -> Column:
    """Whether the text of a JSON scalar is a value of ``kind``; null passes (requiredness is another rule).

    Integers may be written as text but not as true, 1.0 or 1e3. A decimal's value must need no more
    digits than the type has, so 19.900 fits two decimals and 19.905 doesn't.
    """
    text = F.trim(value)
    if kind == "string":
        ok = F.lit(True)
    elif kind in _INT_RANGE:
        lo, hi = _INT_RANGE[kind]
        n = F.when(text.rlike(r"^[+-]?[0-9]{1,30}$"), text.try_cast("decimal(38,0)"))
        ok = n.between(F.lit(str(lo)).cast("decimal(38,0)"), F.lit(str(hi)).cast("decimal(38,0)"))
    elif kind.startswith("decimal"):
        p, s = map(int, kind[8:-1].split(","))
        whole = F.regexp_extract(text, r"^[+-]?0*([0-9]*)(?:\.([0-9]*?)0*)?$", 1)
        part = F.regexp_extract(text, r"^[+-]?0*([0-9]*)(?:\.([0-9]*?)0*)?$", 2)
        ok = text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$") & (F.length(whole) <= p - s) & (F.length(part) <= s)
    elif kind == "datetime":
        ok = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?$") & normal_datetime(text).try_cast("timestamp").isNotNull()
    elif kind == "date":
        ok = text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull()
    else:
        raise ValueError(f"type {kind} is not known")
    return value.isNull() | F.coalesce(ok, F.lit(False))
