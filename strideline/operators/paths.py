"""Ordered paths: greedy matching of steps after joining a cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.predicates import any_of, event_predicate
from strideline.functions.times import seconds_between
from strideline.operators.cohorts import cohort_sizes
from strideline.operators.ordering import quantile_seconds
from strideline.operators.sequences import next_rows, start_states
from strideline.operators.skew import HotKeys, hot_keys, spread
from strideline.operators.staging import stage
from strideline.specs import PathStep, check_path

# Thresholds of the insights.
PERCENTILE_FLOOR = 50
DROP_OFF_PERCENT = 20
SLOW_SECONDS = 120
VARIABLE_RATIO = 5
NOT_STARTED_SHARE = 0.2
GAP_POINTS = 10
COMPARED_COHORTS = 3


def path_trails(
    events: DataFrame,
    members: DataFrame,
    steps: Sequence[PathStep],
    gap_minutes: int | None = None,
    upto: int | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """``(cohort_id, user_id, join_time, trail)``: the steps each member completed.

    Every step takes the earliest later unused row that satisfies one of its
    alternatives, never reconsidering earlier choices. On the same row the first
    alternative wins. Only the events of a step take part in its join.
    """
    check_path(steps)
    heavy = hot_keys(events) if hot is None else hot
    columns = {key for step in steps for group in step.groups for key in group.filters}
    needed = ["user_id", "event_time", "row_id", "event_name", *sorted(columns - {"user_id", "event_time", "row_id", "event_name"})]
    rows = spread(events.select(*needed), heavy)
    states = start_states(members, heavy)
    for done, step in enumerate(steps[: upto or len(steps)]):
        matches = [event_predicate(events.schema, group) for group in step.groups]
        branch = F.lit(len(matches) - 1)
        for number in reversed(range(len(matches) - 1)):
            branch = F.when(matches[number], number).otherwise(branch)
        states = next_rows(rows, states, heavy, done, any_of(matches), branch, gap_minutes=gap_minutes)
    return states.select("cohort_id", "user_id", "join_time", "trail")


def reached_steps(trails: DataFrame) -> DataFrame:
    """``(cohort_id, user_id, step, branch, seconds)``, one row per completed step."""
    long_form = trails.select("cohort_id", "user_id", "trail", F.posexplode("trail").alias("_pos", "_at"))
    before = F.when(F.col("_pos") > 0, F.get("trail", F.col("_pos") - 1)["time"])
    return long_form.select(
        "cohort_id",
        "user_id",
        (F.col("_pos") + 1).alias("step"),
        F.col("_at.branch").alias("branch"),
        seconds_between(before, F.col("_at.time")).alias("seconds"),
    )


def _one_decimal(column: Column) -> Column:
    return F.bround(column.cast("double"), 1)


def path_conversion(trails: DataFrame, members: DataFrame, steps: Sequence[PathStep], percentile_floor: int = PERCENTILE_FLOOR) -> DataFrame:
    """Users, conversion, drop-off and step times for every cohort and step.

    Percentiles are NULL below ``percentile_floor`` users at the step; 1 shows all.
    """
    reached = stage(reached_steps(trails))
    counts = reached.groupBy("cohort_id", "step").agg(F.count(F.lit(1)).alias("users"), F.avg("seconds").alias("mean_seconds"))
    spans = quantile_seconds(reached, ["cohort_id", "step"], "seconds", {"p20_seconds": 0.2, "p80_seconds": 0.8})
    grid = cohort_sizes(members).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(steps)))))
    frame = (
        grid.join(counts, ["cohort_id", "step"], "left")
        .join(spans, ["cohort_id", "step"], "left")
        .withColumn("users", F.coalesce("users", F.lit(0).cast("long")))
    )
    before = F.lag("users").over(Window.partitionBy("cohort_id").orderBy("step"))
    drop = F.when(before > 0, (before - F.col("users")) * 100.0 / before).when(before.isNotNull(), 0.0)
    label = F.element_at(F.array(*[F.lit(step.label) for step in steps]), F.col("step"))
    many = F.col("users") >= percentile_floor
    return frame.withColumn("_drop", drop).select(
        "cohort_id",
        "step",
        label.alias("event"),
        "size",
        "users",
        _one_decimal(F.col("users") * 100.0 / F.col("size")).alias("conversion_pct"),
        _one_decimal(F.col("_drop")).alias("drop_off_pct"),
        _one_decimal(F.col("mean_seconds")).alias("mean_seconds"),
        _one_decimal(F.when(many, F.col("p20_seconds"))).alias("p20_seconds"),
        _one_decimal(F.when(many, F.col("p80_seconds"))).alias("p80_seconds"),
    )


def group_breakdown(trails: DataFrame, steps: Sequence[PathStep]) -> DataFrame:
    """Share of a step's users by the alternative that matched, absent ones as 0."""
    options = [
        F.struct(F.lit(number).alias("step"), F.lit(branch).alias("branch"), F.lit(group.event_name).alias("event"))
        for number, step in enumerate(steps, start=1)
        if len(step.groups) > 1
        for branch, group in enumerate(step.groups)
    ]
    counts = reached_steps(trails).groupBy("cohort_id", "step", "branch").agg(F.count(F.lit(1)).alias("users"))
    totals = counts.groupBy("cohort_id", "step").agg(F.sum("users").alias("step_users"))
    named = totals.withColumn("_o", F.explode(F.array(*options))).where(F.col("_o.step") == F.col("step"))
    grid = named.select("cohort_id", "step", "_o.branch", "_o.event", "step_users")
    frame = grid.join(counts, ["cohort_id", "step", "branch"], "left").na.fill(0, ["users"])
    return frame.withColumn("share_pct", _one_decimal(F.col("users") * 100.0 / F.col("step_users")))


def path_insights(conversion: DataFrame) -> DataFrame:
    """``(cohort_id, step, insight, amount)``, every insight that applies."""
    ratio = F.when(F.col("p20_seconds") > 0, F.col("p80_seconds") / F.col("p20_seconds"))
    idle = (F.col("size") - F.col("users")) / F.col("size")

    def when(condition: Column, name: str, amount: Column) -> Column:
        return F.when(condition, F.struct(F.lit(name).alias("insight"), amount.cast("double").alias("amount")))

    found = F.array_compact(
        F.array(
            when(F.col("drop_off_pct") > DROP_OFF_PERCENT, "drop_off", F.col("drop_off_pct")),
            when(F.col("p80_seconds") > SLOW_SECONDS, "slow_progression", F.col("p80_seconds")),
            when(ratio > VARIABLE_RATIO, "high_variability", ratio),
            when((F.col("step") == 1) & (idle > NOT_STARTED_SHARE), "not_started", _one_decimal(idle * 100)),
        )
    )
    return conversion.select("cohort_id", "step", F.explode(found).alias("_i")).select("cohort_id", "step", "_i.insight", "_i.amount")


def cohort_gaps(conversion: DataFrame, compared: int | None = COMPARED_COHORTS) -> DataFrame:
    """Steps where two of the ``compared`` largest cohorts (all of them for None) differ by over ten points."""
    rows = conversion
    if compared is not None:
        largest = conversion.where(F.col("step") == 1).orderBy(F.col("size").desc(), "cohort_id").limit(compared).select("cohort_id")
        rows = conversion.join(largest, "cohort_id", "left_semi")
    rows = rows.select("cohort_id", "step", "conversion_pct")
    left = rows.select("step", F.col("cohort_id").alias("_a"), F.col("conversion_pct").alias("_pa"))
    right = rows.select("step", F.col("cohort_id").alias("_b"), F.col("conversion_pct").alias("_pb"))
    pairs = left.join(right, "step").where(F.col("_a") < F.col("_b"))
    gap = F.abs(F.col("_pa") - F.col("_pb"))
    ahead = F.col("_pa") > F.col("_pb")
    return pairs.where(gap > GAP_POINTS).select(
        "step",
        F.when(ahead, F.col("_a")).otherwise(F.col("_b")).alias("higher_cohort"),
        F.when(ahead, F.col("_b")).otherwise(F.col("_a")).alias("lower_cohort"),
        _one_decimal(gap).alias("points"),
    )


def dropoff_cohort(
    events: DataFrame,
    members: DataFrame,
    steps: Sequence[PathStep],
    step: int,
    gap_minutes: int | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Members who completed exactly the steps before ``step``, with their join times."""
    trails = path_trails(events, members, steps, gap_minutes, step, hot)
    return trails.where(F.size("trail") == step - 1).select("cohort_id", "user_id", "join_time")


def reached_cohort(
    events: DataFrame,
    members: DataFrame,
    steps: Sequence[PathStep],
    step: int,
    gap_minutes: int | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Members who completed ``step``, with their join times."""
    trails = path_trails(events, members, steps, gap_minutes, step, hot)
    return trails.where(F.size("trail") >= step).select("cohort_id", "user_id", "join_time")


def path_references(events: DataFrame, steps: Sequence[PathStep]) -> DataFrame:
    """Whether each event and property value a path refers to occurs, in one scan."""
    check_path(steps)
    wanted: dict[tuple[str, str], Column] = {}
    for step in steps:
        for group in step.groups:
            wanted.setdefault(("event_name", group.event_name), F.col("event_name") == group.event_name)
            event_predicate(events.schema, group)  # unknown columns and wrong types raise
            for key, value in group.filters.items():
                typed = F.lit(value).cast(events.schema[key].dataType)
                wanted.setdefault((key, str(value)), F.col(key) == typed)
    names = list(wanted)
    counted = events.agg(*[F.count_if(wanted[name]).alias(f"_{i}") for i, name in enumerate(names)])
    rows = F.array(
        *[
            F.struct(F.lit(column).alias("column_name"), F.lit(value).alias("value"), F.col(f"_{i}").alias("rows"))
            for i, (column, value) in enumerate(names)
        ]
    )
    return counted.select(F.explode(rows).alias("r")).select("r.*").withColumn("present", F.col("rows") > 0)
