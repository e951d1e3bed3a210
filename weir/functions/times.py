"""Event and loader times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_time(column: str = "event_time") -> Column:
    """Event timestamp of a text column; null where the text is no time."""
    return F.try_to_timestamp(F.col(column), F.lit("yyyy-MM-dd HH:mm:ss"))


def normal_datetime(c: Column) -> Column:
    """ISO date and time as 'date time' in whole seconds: the T becomes a blank, the fraction goes."""
    return F.split_part(F.replace(c, F.lit("T"), F.lit(" ")), F.lit("."), F.lit(1))
