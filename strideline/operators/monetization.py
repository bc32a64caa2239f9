"""Revenue per bucket and what is derived from it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.operators.retention import active_users
from strideline.operators.skew import HotKeys, hot_keys, join_per_key
from strideline.operators.vectors import eligibility, retention_buckets, user_buckets
from strideline.specs import RevenueRule


def revenue_table(
    events: DataFrame,
    members: DataFrame,
    until: datetime | Column,
    max_day: int,
    where: Column | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """``(cohort_id, bucket, size, eligible, revenue, event_count)``."""
    rows = events if where is None else events.where(where)
    values = [F.sum("modified_revenue").alias("revenue"), F.sum("event_count").alias("event_count")]
    sparse = user_buckets(rows, members, until, max_day, "day", values, hot)
    by_day = sparse.groupBy("cohort_id", "bucket").agg(
        F.sum("revenue").alias("revenue"), F.sum("event_count").alias("event_count")
    )
    frame = eligibility(members, until, max_day).join(by_day, ["cohort_id", "bucket"], "left")
    return frame.na.fill(0, ["revenue", "event_count"])


def monetization_table(
    events: DataFrame, members: DataFrame, until: datetime | Column, max_day: int, hot: HotKeys | None = None
) -> DataFrame:
    """Revenue, events and retained users per bucket from one activity join.

    Revenue and activity share their rows, so a user's bucket is aggregated once.
    """
    values = [F.sum("modified_revenue").alias("revenue"), F.sum("event_count").alias("event_count")]
    sparse = user_buckets(events, members, until, max_day, "day", values, hot)
    by_day = sparse.groupBy("cohort_id", "bucket").agg(
        F.sum("revenue").alias("revenue"),
        F.sum("event_count").alias("event_count"),
        F.count(F.lit(1)).alias("retained"),
    )
    frame = eligibility(members, until, max_day).join(by_day, ["cohort_id", "bucket"], "left")
    return frame.na.fill(0, ["revenue", "event_count", "retained"])


def retained_users(
    events: DataFrame, members: DataFrame, until: datetime | Column, max_day: int, hot: HotKeys | None = None
) -> DataFrame:
    return active_users(retention_buckets(events, members, until, max_day, hot=hot))


def derived_revenue(table: DataFrame) -> DataFrame:
    """Total, cumulative, per acquired user and per retained user; 0 without users."""
    window = Window.partitionBy("cohort_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def per(amount: Column, users: str) -> Column:
        return F.when(F.col(users) > 0, amount / F.col(users)).otherwise(0.0).cast("double")

    revenue, running = F.col("revenue"), F.col("cumulative_revenue")
    return table.withColumn("cumulative_revenue", F.sum("revenue").over(window)).select(
        "cohort_id",
        "bucket",
        F.col("revenue").alias("total_revenue"),
        "cumulative_revenue",
        per(revenue, "size").alias("revenue_per_acquired_user"),
        per(running, "size").alias("cumulative_revenue_per_acquired_user"),
        per(revenue, "retained").alias("revenue_per_retained_user"),
    )


def calendar_day_revenue(
    events: DataFrame, members: DataFrame, rules: Sequence[RevenueRule], max_day: int, hot: HotKeys | None = None
) -> DataFrame:
    """Revenue by calendar days between joining and event, included events only."""
    included = [rule.event_name for rule in rules if rule.included]
    joined = join_per_key(events.where(F.col("event_name").isin(included)), members, hot_keys(events) if hot is None else hot)
    day = F.datediff(F.to_date("event_time"), F.to_date("join_time"))
    return (
        joined.withColumn("day_number", day)
        .where(F.col("day_number").between(0, max_day))
        .groupBy("cohort_id", "day_number")
        .agg(F.sum("modified_revenue").alias("revenue"), F.sum("event_count").alias("event_volume"))
    )
