"""Time arithmetic that does not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAINS = {"minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}


def epoch_seconds(value: Column, data_type: T.DataType) -> Column:
    """Whole seconds since 1970; for times without zone by their own calendar, so that later is never smaller."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_seconds(value)
    days = F.datediff(value.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
    if isinstance(data_type, T.DateType):
        return days
    return days + F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)


def grain_number(value: Column, data_type: T.DataType, grain: str | int) -> Column:
    """Number of the ``grain`` (a name of ``GRAINS`` or a width in seconds) that holds the time."""
    width = GRAINS[grain] if isinstance(grain, str) else int(grain)
    return F.floor(epoch_seconds(value, data_type) / F.lit(width))


def seconds_between(first: Column, last: Column) -> Column:
    """Exact seconds from ``first`` to ``last`` (two timestamps of one type) as a double."""
    gap = last - first
    units = [("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1)]
    parts = [F.extract(F.lit(unit), gap) * F.lit(size) for unit, size in units]
    total = parts[0].cast("decimal(20,6)")
    for part in parts[1:]:
        total = total + part.cast("decimal(20,6)")
    return total.cast("double")
