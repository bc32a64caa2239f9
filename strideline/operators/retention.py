"""Retention tables from sparse activity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.functions.stats import wilson_bounds
from strideline.functions.times import UNIT_SECONDS, as_instant, bucket_index
from strideline.operators.cohorts import activity
from strideline.operators.skew import HotKeys
from strideline.operators.vectors import eligibility, last_bucket, retention_buckets

HORIZON_PERCENT = 1.0  # fixed value


def active_users(sparse: DataFrame, kind: str = "classic") -> DataFrame:
    """``(cohort_id, bucket, active)``.

    Ever-after counts a user in every bucket up to their last one.
    """
    if kind == "classic":
        return sparse.groupBy("cohort_id", "bucket").agg(F.count(F.lit(1)).alias("active"))
    return _up_to_last(sparse.groupBy("cohort_id", "user_id").agg(F.max("bucket").alias("bucket")))


def _up_to_last(lasts: DataFrame) -> DataFrame:
    """Users per bucket when each counts from bucket 0 to ``bucket``.

    Users are counted by that bucket first, so only one row per cohort and bucket is
    repeated.
    """
    ends = lasts.groupBy("cohort_id", F.col("bucket").alias("_last")).agg(F.count(F.lit(1)).alias("_n"))
    spread = ends.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    return spread.groupBy("cohort_id", "bucket").agg(F.sum("_n").alias("active"))


def retention_table(
    events: DataFrame,
    members: DataFrame,
    until: datetime | Column,
    max_day: int,
    unit: str = "day",
    kind: str = "classic",
    event: str | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """``(cohort_id, bucket, size, eligible, active, retention)``, percent of eligible.

    ``retention`` is NULL where nobody was observable long enough.
    """
    sparse = retention_buckets(events, members, until, max_day, unit, event, hot)
    frame = eligibility(members, until, max_day, unit).join(active_users(sparse, kind), ["cohort_id", "bucket"], "left")
    frame = frame.withColumn("active", F.coalesce("active", F.lit(0).cast("long")))
    percent = F.when(F.col("eligible") > 0, F.col("active") * 100.0 / F.col("eligible"))
    return frame.withColumn("retention", percent.cast("double"))


def with_interval(table: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Add the Wilson bounds of the retention share, in percent."""
    low, high = wilson_bounds(F.col("active"), F.col("eligible"), confidence)
    return table.withColumn("ci_lower", low * 100).withColumn("ci_upper", high * 100)


def useful_horizon(table: DataFrame) -> DataFrame:
    """The last day before every cohort is under one percent, at least 1."""
    best = table.groupBy("bucket").agg(F.max(F.coalesce("retention", F.lit(0.0))).alias("best"))
    return best.agg(
        F.min(F.when(F.col("best") < HORIZON_PERCENT, F.col("bucket"))).alias("_end"), F.max("bucket").alias("_last")
    ).select(F.greatest(F.lit(1), F.coalesce(F.col("_end") - 1, F.col("_last"))).alias("horizon"))


def ever_after_counts(
    events: DataFrame, members: DataFrame, max_day: int, unit: str = "day", event: str | None = None, hot: HotKeys | None = None
) -> DataFrame:
    """Users active at or after each bucket, without a boundary or eligibility.

    Activity beyond the last bucket counts towards all of them.
    """
    rows = events if event in (None, "any") else events.where(F.col("event_name") == event)
    joined = activity(rows, members, hot).withColumn("bucket", bucket_index(F.col("join_time"), F.col("event_time"), unit))
    lasts = joined.groupBy("cohort_id", "user_id").agg(F.max("bucket").alias("bucket"))
    capped = lasts.withColumn("bucket", F.least(F.col("bucket"), F.lit(last_bucket(max_day, unit))))
    return _up_to_last(capped).withColumnRenamed("active", "active_users")


def eligibility_counts(members: DataFrame, until: datetime | Column, max_day: int, unit: str = "day") -> DataFrame:
    """Users whose elapsed seconds cover each bucket."""
    seconds = F.unix_timestamp(as_instant(until)) - F.unix_timestamp(F.col("join_time"))
    elapsed = F.floor(seconds / F.lit(UNIT_SECONDS[unit])).cast("int")
    capped = members.where(seconds >= 0).select("cohort_id", F.least(F.lit(last_bucket(max_day, unit)), elapsed).alias("bucket"))
    return _up_to_last(capped).withColumnRenamed("active", "eligible_users")
