"""Restricting the dataset and finding out what is in it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.functions.predicates import kind_of, scope_predicate, search_predicate
from strideline.specs import Filter, SpecError

# Identifier columns that are listed rather than ranked.
HIGH_CARDINALITY = ("user_id", "device_id", "anonymous_id", "session_id")
#: Values a report lists if nothing else is said; ``limit=None`` lists all.
MAX_VALUES = 100


def apply_scope(events: DataFrame, filters: Sequence[Filter] = (), date_from: Any = None, date_to: Any = None) -> DataFrame:
    return events.where(scope_predicate(events.schema, filters, date_from, date_to))


def scope_summary(events: DataFrame, filters: Sequence[Filter] = (), date_from: Any = None, date_to: Any = None) -> DataFrame:
    """Row counts before and after, events and users in scope, from one scan."""
    inside = F.coalesce(scope_predicate(events.schema, filters, date_from, date_to), F.lit(False))
    counts = events.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(inside).alias("filtered_rows"),
        F.coalesce(F.sum(F.when(inside, F.col("event_count"))), F.lit(0.0)).alias("total_events"),
        F.count_distinct(F.when(inside, F.col("user_id"))).alias("total_users"),
    )
    share = F.when(F.col("total_rows") > 0, F.col("filtered_rows") * 100.0 / F.col("total_rows")).otherwise(0.0)
    return counts.withColumn("percentage", share.cast("double"))


def _candidates(events: DataFrame, column: str, event_name: str | None, search: str | None) -> DataFrame:
    if column not in events.columns:
        raise SpecError(f"unknown column {column!r}")
    rows = events.where(F.col(column).isNotNull())
    if kind_of(events.schema[column].dataType) == "TEXT":
        rows = rows.where(F.col(column) != "")
    if event_name is not None and column != "event_name":
        rows = rows.where(F.col("event_name") == event_name)
    if search:
        rows = rows.where(search_predicate(F.col(column), search))
    return rows


def _limited(values: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of a report, or all of them for no limit."""
    if limit is None:
        return values
    if limit < 1:
        raise SpecError("the limit is at least 1")
    return values.limit(limit)


def column_values(
    events: DataFrame, column: str, event_name: str | None = None, search: str | None = None, limit: int | None = MAX_VALUES
) -> DataFrame:
    """The most frequent values by event count, ties by value, as a top-k report.

    Identifier columns are listed in order instead.
    """
    if column.lower() in HIGH_CARDINALITY:
        return distinct_values(events, column, event_name, search, limit)
    values = (
        _candidates(events, column, event_name, search)
        .groupBy(F.col(column).alias("value"))
        .agg(F.sum("event_count").alias("frequency"))
        .orderBy(F.col("frequency").desc(), F.col("value").asc())
    )
    return _limited(values, limit)


def distinct_values(
    events: DataFrame, column: str, event_name: str | None = None, search: str | None = None, limit: int | None = MAX_VALUES
) -> DataFrame:
    """The first distinct values, without ranking them."""
    values = (
        _candidates(events, column, event_name, search)
        .select(F.col(column).alias("value"))
        .distinct()
        .orderBy("value")
    )
    return _limited(values, limit)


def count_values(events: DataFrame, column: str, event_name: str | None = None, search: str | None = None) -> DataFrame:
    rows = _candidates(events, column, event_name, search)
    return rows.agg(F.count_distinct(column).alias("total_distinct"))


def date_range(events: DataFrame) -> DataFrame:
    times = F.col("event_time")
    return events.agg(F.to_date(F.min(times)).alias("min_date"), F.to_date(F.max(times)).alias("max_date"))


def list_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_name").isNotNull()).select("event_name").distinct().orderBy("event_name")


def event_property_values(events: DataFrame, event_name: str, column: str, limit: int | None = 25) -> DataFrame:
    """Values of a property on one event by number of rows, ties by value."""
    values = (
        events.where((F.col("event_name") == event_name) & F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.col("rows").desc(), F.col("value").asc())
    )
    return _limited(values, limit)
