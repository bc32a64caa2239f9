"""The step both flows and paths are made of: each user's nearest next row.

A state is one row per cohort and user (and flow node) with the trail of rows used
so far. One step joins the candidate events to the states on the user and keeps the
nearest one with a decomposable ``min`` / ``max``, so no user's history is ever
sorted or collected in one place; hot users are spread over salts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.operators.skew import HotKeys, fan_out, mark

_TRAIL = "array<struct<time:timestamp_ntz,id:bigint,branch:int,name:string>>"


def start_states(members: DataFrame, hot: HotKeys) -> DataFrame:
    """Members with an empty trail."""
    return mark(members, hot).withColumn("trail", F.array().cast(_TRAIL))


def next_rows(
    rows: DataFrame,
    states: DataFrame,
    hot: HotKeys,
    done: int,
    match: Column | None = None,
    branch: Column | None = None,
    forward: bool = True,
    gap_minutes: int | None = None,
    keep_unmatched: bool = True,
    keys: Sequence[str] = ("cohort_id", "user_id"),
    expected: bool = False,
) -> DataFrame:
    """Extend trails of length ``done`` by the nearest matching row.

    ``rows`` carry ``_salt``. A row at the same instant as the last one qualifies in
    either direction if it is not in the trail yet. With ``expected`` the row's name
    must equal the state's ``expected`` column. States that find nothing keep their
    trail, or are dropped without ``keep_unmatched``.
    """
    candidates = (rows if match is None else rows.where(match)).select(
        F.col("user_id").alias("_user"),
        F.col("_salt").alias("_cell"),
        F.struct(
            F.col("event_time").alias("time"),
            F.col("row_id").alias("id"),
            (F.lit(0) if branch is None else branch).cast("int").alias("branch"),
            F.col("event_name").alias("name"),
        ).alias("_next"),
    )
    time = F.col("_next.time")
    on = (F.col("user_id") == F.col("_user")) & (F.col("_salt") == F.col("_cell"))
    on &= (F.size("trail") == done) & (time >= F.col("join_time"))
    if done:
        last = F.element_at("trail", -1)["time"]
        beyond = time > last if forward else time < last
        on &= beyond | ((time == last) & ~F.array_contains(F.col("trail.id"), F.col("_next.id")))
        if gap_minutes is not None:
            on &= time <= last + F.make_dt_interval(mins=F.lit(gap_minutes))
    if expected:
        on &= F.col("_next.name") == F.col("expected")
    joined = fan_out(states, hot).join(candidates, on, "left" if keep_unmatched else "inner")
    carried = [name for name in states.columns if name not in keys]
    nearest = (F.min if forward else F.max)("_next")
    grouped = joined.groupBy(*keys).agg(F.first(F.struct(*carried)).alias("_state"), nearest.alias("_next"))
    longer = F.when(F.col("_next").isNull(), F.col("_state.trail")).otherwise(
        F.array_append(F.col("_state.trail"), F.col("_next"))
    )
    kept = [F.col(f"_state.{name}").alias(name) for name in carried if name != "trail"]
    return grouped.select(*keys, *kept, longer.alias("trail"))
