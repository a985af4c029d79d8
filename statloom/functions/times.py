"""Time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions.numeric import whole_div


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed from ``start`` to ``end`` (0.9 s to 1.1 s is 1, not 0)."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def clock_text(seconds: Column) -> Column:
    """Seconds as ``HH:MM:SS``; hours grow past two digits when needed."""
    return F.format_string("%02d:%02d:%02d", whole_div(seconds, 3600), whole_div(seconds % 3600, 60), seconds % 60)


def as_timestamp(moment) -> Column:
    """A Python datetime, ISO text or Column as a timestamp column."""
    return moment if isinstance(moment, Column) else F.lit(moment).cast("timestamp")
