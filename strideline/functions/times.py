"""Exact time arithmetic on zone-free timestamps (session zone pinned to UTC)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per bucket unit.
UNIT_SECONDS = {"day": 86_400, "hour": 3_600}
MICROS = 1_000_000
DAY_MICROS = 86_400 * MICROS


def micros(column: Column) -> Column:
    """Microseconds since the epoch, as a long."""
    return F.unix_micros(column.cast("timestamp"))


def from_micros(column: Column) -> Column:
    return F.timestamp_micros(column.cast("long")).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with microsecond precision, as a double."""
    return (micros(end) - micros(start)) / F.lit(float(MICROS))


def bucket_index(join_time: Column, event_time: Column, unit: str = "day") -> Column:
    """Whole 24-hour (or one-hour) windows since joining.

    Counts crossed second boundaries, so both instants are cut to seconds first.
    """
    elapsed = F.unix_timestamp(event_time) - F.unix_timestamp(join_time)
    return F.greatest(F.lit(0), F.floor(elapsed / F.lit(UNIT_SECONDS[unit]))).cast("int")


def elapsed_units(join_time: Column, observed_until: Column, unit: str = "day") -> Column:
    """The last bucket that was fully observable; negative if joined later.

    ``join_time + k units <= observed_until`` holds exactly for ``k`` up to this.
    """
    width = UNIT_SECONDS[unit] * MICROS
    return F.floor((micros(observed_until) - micros(join_time)) / F.lit(width)).cast("int")


def shift_days(column: Column, days: int) -> Column:
    return column + F.make_dt_interval(F.lit(days))


def as_instant(value: datetime | Column) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
