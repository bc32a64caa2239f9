"""Individual users: search, summary, paged timeline, jumps and cohort tags."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.functions.times import as_instant
from strideline.operators.events import properties_of
from strideline.operators.ordering import GROUP_LIMIT, first_per_key
from strideline.operators.prefix import slice_of
from strideline.operators.skew import HotKeys, hot_keys, join_per_key
from strideline.specs import Cohort, SpecError

# Fixed values.
MAX_SEARCH = 100
MAX_PAGE = 200
ALL_USERS_NAME = "All Users"


def search_users(events: DataFrame, text: str, limit: int = 20, members: DataFrame | None = None, cohort_id: int | None = None) -> DataFrame:
    """User ids containing the text, in order; optionally only of one cohort."""
    if not 1 <= limit <= MAX_SEARCH:
        raise SpecError(f"the limit is 1 to {MAX_SEARCH}")
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    found = events.where(F.col("user_id").ilike(f"%{escaped}%")).select("user_id").distinct()
    if members is not None and cohort_id is not None:
        found = found.join(members.where(F.col("cohort_id") == cohort_id), "user_id", "left_semi")
    return found.orderBy("user_id").limit(limit)


def _of(events: DataFrame, user_id: str | None) -> DataFrame:
    return events if user_id is None else events.where(F.col("user_id") == user_id)


def user_summary(events: DataFrame, user_id: str | None = None) -> DataFrame:
    """First and last event, total events and latest properties, for one or all users."""
    names = properties_of(events)
    picks = [
        F.min("event_time").alias("first_event_time"),
        F.max("event_time").alias("last_event_time"),
        F.sum("event_count").cast("long").alias("total_events"),
    ]
    if names:
        newest = F.struct("event_time", "event_name", "row_id")
        picks.append(F.max_by(F.struct(*names), newest).alias("_latest"))
    summary = _of(events, user_id).groupBy("user_id").agg(*picks)
    return summary.select("user_id", "first_event_time", "last_event_time", "total_events", *[F.col(f"_latest.{n}").alias(n) for n in names])


def timeline_page(events: DataFrame, page: int, size: int, user_id: str | None = None) -> DataFrame:
    """One page of each user's events by (time, name), with the position."""
    if page < 1 or not 1 <= size <= MAX_PAGE:
        raise SpecError(f"pages start at 1 and hold 1 to {MAX_PAGE} events")
    then = ["event_name", "row_id"]
    if page * size > GROUP_LIMIT:
        deep = slice_of(_of(events, user_id), ["user_id"], ["event_time", *then], (page - 1) * size + 1, page * size)
        return deep.withColumnRenamed("_pos", "position")
    first = first_per_key(_of(events, user_id), ["user_id"], "event_time", then, page * size)
    return first.where(F.col("_pos") > (page - 1) * size).withColumnRenamed("_pos", "position")


_SPOT = ("event_time", "event_name", "row_id")


def _nearest(rows: DataFrame, earliest: bool) -> DataFrame:
    pick = (F.min if earliest else F.max)(F.struct(*_SPOT)).alias("_spot")
    return rows.groupBy("user_id").agg(pick).select("user_id", *[F.col(f"_spot.{name}").alias(name) for name in _SPOT])


def jump_to(events: DataFrame, instant: datetime, user_id: str | None = None) -> DataFrame:
    """Each user's first event at or after an instant."""
    return _nearest(_of(events, user_id).where(F.col("event_time") >= as_instant(instant)), True)


def next_event(events: DataFrame, name: str, instant: datetime, user_id: str | None = None) -> DataFrame:
    """The first event of that name strictly after an instant."""
    rows = _of(events, user_id).where((F.col("event_name") == name) & (F.col("event_time") > as_instant(instant)))
    return _nearest(rows, True)


def previous_event(events: DataFrame, name: str, instant: datetime, user_id: str | None = None) -> DataFrame:
    """The last event of that name strictly before an instant."""
    rows = _of(events, user_id).where((F.col("event_name") == name) & (F.col("event_time") < as_instant(instant)))
    return _nearest(rows, False)


def page_of(events: DataFrame, spots: DataFrame, size: int, hot: HotKeys | None = None) -> DataFrame:
    """The page each spot ``(user_id, event_time, event_name)`` is on: a count, not a sort."""
    targets = spots.select("user_id", F.col("event_time").alias("_time"), F.col("event_name").alias("_name"))
    heavy = hot_keys(events) if hot is None else hot
    joined = join_per_key(events.select("user_id", "event_time", "event_name", "row_id"), targets, heavy)
    before = (F.col("event_time") < F.col("_time")) | (
        (F.col("event_time") == F.col("_time")) & (F.col("event_name") < F.col("_name"))
    )
    counted = joined.groupBy("user_id", "_time", "_name").agg(F.count_if(before).alias("_n"))
    page = (F.floor(F.col("_n") / F.lit(size)) + 1).cast("int")
    return counted.select("user_id", F.col("_time").alias("event_time"), F.col("_name").alias("event_name"), page.alias("page"))


def cohort_join_tags(events: DataFrame, members: DataFrame, cohorts: Sequence[Cohort], hot: HotKeys | None = None) -> DataFrame:
    """``(user_id, event_time, event_name, row_id, cohort_joins)``.

    Every visible cohort a user joined is shown on their first event at or after
    the join time, in join order. Cohorts of everybody are left out.
    """
    shown = [c for c in cohorts if not c.hidden and c.name and c.name != ALL_USERS_NAME]
    label: Column = F.lit(None).cast("string")
    for cohort in shown:
        label = F.when(F.col("cohort_id") == cohort.cohort_id, cohort.name).otherwise(label)
    joins = members.where(F.col("cohort_id").isin([c.cohort_id for c in shown])).withColumn("_cohort", label)
    heavy = hot_keys(events) if hot is None else hot
    joined = join_per_key(events.select("user_id", *_SPOT), joins, heavy).where(F.col("event_time") >= F.col("join_time"))
    spots = joined.groupBy("user_id", "cohort_id", "_cohort", "join_time").agg(F.min(F.struct(*_SPOT)).alias("_spot"))
    # One entry per cohort spec at most, so the list is short.
    tags = spots.groupBy("user_id", "_spot").agg(F.array_sort(F.collect_list(F.struct("join_time", "_cohort"))).alias("_tags"))
    return tags.select("user_id", *[F.col(f"_spot.{n}").alias(n) for n in _SPOT], F.col("_tags._cohort").alias("cohort_joins"))
