"""Instants as whole microseconds, so that every frame bound is exact.

A time column may be a timestamp (with or without zone), a date, a whole number
of microseconds, or a double of epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    column = F.col(name)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.round(column * SECOND).cast("long")
    return column.cast("long")


def span(seconds: float) -> int:
    return int(round(seconds * SECOND))


def slot_start(t: Column | str, width: int) -> Column:
    """Start of the slot of `width` microseconds that holds `t`."""
    t = F.col(t) if isinstance(t, str) else t
    return t - F.pmod(t, F.lit(width))
