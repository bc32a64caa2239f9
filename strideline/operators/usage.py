"""Usage of one event by members, per bucket and in total."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.operators.cohorts import activity, cohort_sizes
from strideline.operators.retention import active_users
from strideline.operators.skew import HotKeys
from strideline.operators.vectors import eligibility, retention_buckets, user_buckets

# Upper ends and names of the frequency classes.
FREQUENCY_CLASSES = ((0, "0"), (1, "1"), (5, "2-5"), (10, "6-10"), (20, "11-20"))
FREQUENCY_REST = "20+"


def _so_far(column: str) -> Column:
    window = Window.partitionBy("cohort_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(column).over(window)


def usage_table(
    events: DataFrame,
    members: DataFrame,
    until: datetime | Column,
    max_day: int,
    event: str,
    retention_event: str | None = None,
    where: Column | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """``(cohort_id, bucket, size, eligible, volume, users, adopted, retained)``.

    ``users`` are distinct that day, ``adopted`` is the running count of users by
    first active day, ``retained`` counts any (or the chosen) event. All four come
    from one activity join: usage and retention are conditional aggregates of the
    same user buckets.
    """
    used = F.col("event_name") == event
    if where is not None:
        used = used & where
    kept = F.lit(True) if retention_event in (None, "any") else F.col("event_name") == retention_event
    values = [
        F.sum(F.when(used, F.col("event_count")).otherwise(0.0)).alias("volume"),
        F.max(F.when(used, 1).otherwise(0)).alias("used"),
        F.max(F.when(kept, 1).otherwise(0)).alias("kept"),
    ]
    rows = events.where(used | kept)
    sparse = user_buckets(rows, members, until, max_day, "day", values, hot)
    # A user has at most max_day + 1 buckets, so this window is short.
    first = F.min(F.when(F.col("used") == 1, F.col("bucket"))).over(Window.partitionBy("cohort_id", "user_id"))
    keys = ["cohort_id", "bucket"]
    by_day = sparse.withColumn("_first", first).groupBy(*keys).agg(
        F.sum("volume").alias("volume"),
        F.sum("used").alias("users"),
        F.count_if(F.col("bucket") == F.col("_first")).alias("_new"),
        F.sum("kept").alias("retained"),
    )
    frame = eligibility(members, until, max_day).join(by_day, keys, "left").na.fill(0, ["volume", "users", "_new", "retained"])
    return frame.select(*keys, "size", "eligible", "volume", "users", _so_far("_new").alias("adopted"), "retained")


def usage_by_day(
    events: DataFrame,
    members: DataFrame,
    until: datetime | Column,
    max_day: int,
    event: str,
    where: Column | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Only volume and distinct users: one activity join."""
    rows = events.where(F.col("event_name") == event)
    if where is not None:
        rows = rows.where(where)
    sparse = user_buckets(rows, members, until, max_day, "day", [F.sum("event_count").alias("volume")], hot)
    by_day = sparse.groupBy("cohort_id", "bucket").agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("users"))
    frame = eligibility(members, until, max_day).join(by_day, ["cohort_id", "bucket"], "left")
    return frame.na.fill(0, ["volume", "users"])


def adoption_by_day(
    events: DataFrame, members: DataFrame, until: datetime | Column, max_day: int, event: str, hot: HotKeys | None = None
) -> DataFrame:
    """Running number of users by their first active day."""
    rows = events.where(F.col("event_name") == event)
    sparse = user_buckets(rows, members, until, max_day, "day", [], hot)
    firsts = sparse.groupBy("cohort_id", "user_id").agg(F.min("bucket").alias("bucket"))
    new = firsts.groupBy("cohort_id", "bucket").agg(F.count(F.lit(1)).alias("_new"))
    frame = eligibility(members, until, max_day).join(new, ["cohort_id", "bucket"], "left").na.fill(0, ["_new"])
    return frame.select("cohort_id", "bucket", "size", _so_far("_new").alias("adopted"))


def retained_by_day(
    events: DataFrame,
    members: DataFrame,
    until: datetime | Column,
    max_day: int,
    event: str | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    sparse = retention_buckets(events, members, until, max_day, "day", event, hot)
    frame = eligibility(members, until, max_day).join(active_users(sparse), ["cohort_id", "bucket"], "left")
    return frame.select("cohort_id", "bucket", "size", "eligible", F.coalesce("active", F.lit(0).cast("long")).alias("retained"))


def derived_volume(table: DataFrame) -> DataFrame:
    """The volume display modes, 0 where a denominator is 0."""

    def per(amount: Column, users: str) -> Column:
        return F.when(F.col(users) > 0, amount / F.col(users)).otherwise(0.0).cast("double")

    volume, running = F.col("volume"), F.col("cumulative_count")
    return table.withColumn("cumulative_count", _so_far("volume")).select(
        "cohort_id",
        "bucket",
        F.col("volume").alias("count"),
        "cumulative_count",
        per(volume, "size").alias("per_installed_user"),
        per(running, "size").alias("cumulative_per_installed_user"),
        per(volume, "users").alias("per_event_firer"),
        per(volume, "retained").alias("per_active_user"),
    )


def derived_users(table: DataFrame) -> DataFrame:
    """The user display modes: counts and percent of the cohort."""

    def percent(users: str) -> Column:
        return F.when(F.col("size") > 0, F.col(users) * 100.0 / F.col("size")).otherwise(0.0).cast("double")

    return table.select(
        "cohort_id",
        "bucket",
        F.col("users").alias("count"),
        percent("users").alias("percent"),
        F.col("adopted").alias("adoption_count"),
        percent("adopted").alias("adoption_percent"),
    )


def frequency_class(total: Column) -> Column:
    label = F.lit(FREQUENCY_REST)
    for upper, name in reversed(FREQUENCY_CLASSES):
        label = F.when(total <= upper, name).otherwise(label)
    return label


def usage_frequency(
    events: DataFrame, members: DataFrame, event: str, where: Column | None = None, hot: HotKeys | None = None
) -> DataFrame:
    """``(cohort_id, frequency, users, share)``: members by their number of events after joining.

    Every class is present for every cohort; members without the event are class 0.
    """
    rows = events.where(F.col("event_name") == event)
    if where is not None:
        rows = rows.where(where)
    totals = activity(rows, members, hot).groupBy("cohort_id", "user_id").agg(F.sum("event_count").alias("total"))
    filled = members.join(totals, ["cohort_id", "user_id"], "left")
    counted = filled.groupBy("cohort_id", frequency_class(F.coalesce("total", F.lit(0.0))).alias("frequency")).agg(
        F.count(F.lit(1)).alias("users")
    )
    names = [name for _, name in FREQUENCY_CLASSES] + [FREQUENCY_REST]
    grid = cohort_sizes(members).withColumn("frequency", F.explode(F.array(*[F.lit(name) for name in names])))
    frame = grid.join(counted, ["cohort_id", "frequency"], "left").na.fill(0, ["users"])
    return frame.select(
        "cohort_id", "frequency", "users", F.least(F.col("users") / F.col("size"), F.lit(1.0)).alias("share")
    )
