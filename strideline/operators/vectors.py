"""Per-user bucket values and the shared frame of the metric tables.

Tables are computed from sparse rows: a user contributes a row only for buckets in
which something happened. The dense user-by-bucket grid exists for callers that
need a vector (one row per user and bucket), never inside a table.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.times import as_instant, bucket_index, elapsed_units, from_micros, micros
from strideline.operators.cohorts import activity
from strideline.operators.ordering import exact_quantiles, quantile_instant
from strideline.operators.skew import HotKeys

OBSERVED_FRACTION = 0.999  # fixed value


def _utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def observed_until(events: DataFrame, now: datetime | None = None) -> datetime | None:
    """End of observation: the 0.999 quantile of event time, not after ``now`` (the current UTC time), in whole seconds."""
    end = quantile_instant(events, "event_time", OBSERVED_FRACTION)
    return None if end is None else min(end, now or _utc_now()).replace(microsecond=0)


def observation_end(events: DataFrame, now: datetime | None = None) -> DataFrame:
    """The same as a lazy one-row DataFrame."""
    rows = events.select(micros(F.col("event_time")).alias("_us"))
    found = exact_quantiles(rows, [], "_us", [OBSERVED_FRACTION], "micros", collapse=False)
    # A null quantile (no events) stays null: the smaller of null and a time would be the time.
    end = F.when(F.col("quantile").isNotNull(), F.least(from_micros(F.col("quantile")), as_instant(now or _utc_now())))
    return found.select(F.date_trunc("second", end).cast("timestamp_ntz").alias("observation_end"))


def last_bucket(max_day: int, unit: str) -> int:
    return max_day if unit == "day" else max_day * 24


def user_buckets(
    events: DataFrame,
    members: DataFrame,
    until: datetime | Column,
    max_day: int,
    unit: str,
    values: Sequence[Column],
    hot: HotKeys | None = None,
) -> DataFrame:
    """``(cohort_id, user_id, bucket, *values)`` for eligible buckets with activity."""
    joined = activity(events, members, hot)
    bucketed = joined.withColumn("bucket", bucket_index(F.col("join_time"), F.col("event_time"), unit))
    limit = F.least(F.lit(last_bucket(max_day, unit)), elapsed_units(F.col("join_time"), as_instant(until), unit))
    grouped = bucketed.where(F.col("bucket") <= limit).groupBy("cohort_id", "user_id", "bucket")
    return grouped.agg(*values) if values else grouped.agg(F.lit(1).alias("active"))


def eligibility(members: DataFrame, until: datetime | Column, max_day: int, unit: str = "day") -> DataFrame:
    """``(cohort_id, bucket, size, eligible)`` for every cohort and bucket.

    Users are counted once by their last observable bucket. What is left is one row
    per cohort and bucket, small enough to repeat for every bucket it counts in.
    """
    top = last_bucket(max_day, unit)
    last = F.least(F.lit(top), elapsed_units(F.col("join_time"), as_instant(until), unit))
    ends = members.groupBy("cohort_id", F.greatest(F.lit(-1), last).alias("_last")).agg(F.count(F.lit(1)).alias("_n"))
    grid = ends.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(top))))
    within = F.when(F.col("bucket") <= F.col("_last"), F.col("_n")).otherwise(0)
    return grid.groupBy("cohort_id", "bucket").agg(F.sum("_n").alias("size"), F.sum(within).alias("eligible"))


def dense(
    sparse: DataFrame, members: DataFrame, until: datetime | Column, max_day: int, unit: str, columns: Sequence[str]
) -> DataFrame:
    """One row per member and bucket, zero-filled, with ``is_eligible``."""
    top = last_bucket(max_day, unit)
    grid = members.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(top))))
    last = elapsed_units(F.col("join_time"), as_instant(until), unit)
    joined = grid.join(sparse, ["cohort_id", "user_id", "bucket"], "left")
    return joined.select(
        "cohort_id",
        "user_id",
        "bucket",
        *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in columns],
        (F.col("bucket") <= last).cast("int").alias("is_eligible"),
    )


def retention_buckets(
    events: DataFrame,
    members: DataFrame,
    until: datetime | Column,
    max_day: int,
    unit: str = "day",
    event: str | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    rows = events if event in (None, "any") else events.where(F.col("event_name") == event)
    return user_buckets(rows, members, until, max_day, unit, [], hot)


def retention_vector(
    events: DataFrame,
    members: DataFrame,
    until: datetime | Column,
    max_day: int,
    unit: str = "day",
    event: str | None = None,
    kind: str = "classic",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Active (classic) or still active later (ever_after) per user and bucket."""
    sparse = retention_buckets(events, members, until, max_day, unit, event, hot)
    grid = dense(sparse.withColumnRenamed("active", "value"), members, until, max_day, unit, ["value"])
    if kind == "classic":
        return grid
    onward = Window.partitionBy("cohort_id", "user_id").orderBy("bucket").rowsBetween(
        Window.currentRow, Window.unboundedFollowing
    )
    return grid.withColumn("value", F.max("value").over(onward))


def usage_vector(
    events: DataFrame,
    members: DataFrame,
    until: datetime | Column,
    max_day: int,
    event: str,
    metric: str = "volume",
    unit: str = "day",
    where: Column | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Event count (volume) or a 0/1 flag (unique) per user and bucket."""
    rows = events.where(F.col("event_name") == event)
    if where is not None:
        rows = rows.where(where)
    value = F.sum("event_count") if metric == "volume" else F.lit(1.0)
    sparse = user_buckets(rows, members, until, max_day, unit, [value.alias("value")], hot)
    return dense(sparse, members, until, max_day, unit, ["value"])


def revenue_vector(
    events: DataFrame,
    members: DataFrame,
    until: datetime | Column,
    max_day: int,
    unit: str = "day",
    where: Column | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Revenue and event count per user and bucket; every row counts."""
    rows = events if where is None else events.where(where)
    values = [F.sum("modified_revenue").alias("value"), F.sum("event_count").alias("event_count")]
    sparse = user_buckets(rows, members, until, max_day, unit, values, hot)
    return dense(sparse, members, until, max_day, unit, ["value", "event_count"])
