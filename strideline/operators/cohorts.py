"""Cohort definitions to membership, and membership to activity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideline.functions.predicates import all_of, any_of, predicate
from strideline.operators.ordering import GROUP_LIMIT, TOP_SALTS, crossing_time
from strideline.operators.skew import HotKeys, hot_keys, join_per_key, row_salt
from strideline.specs import Cohort, Condition


def _condition_predicate(events: DataFrame, condition: Condition) -> Column:
    match = F.col("event_name") == condition.event_name
    if condition.where is not None:
        match = match & predicate(events.schema, condition.where, strict_boolean=True)
    return match


def _identity(condition: Condition) -> str:
    # Negation changes what a cohort does with the time, not the time itself.
    return repr((condition.event_name, condition.min_count, condition.where))


def _by_number(values: dict[int, float]) -> Column:
    """A value chosen by the condition number in ``_cond``."""
    picked = F.lit(None).cast("double")
    for number, value in values.items():
        picked = F.when(F.col("_cond") == number, F.lit(float(value))).otherwise(picked)
    return picked


def _nth_times(events: DataFrame, wanted: dict[int, Condition], hot: HotKeys) -> DataFrame:
    """``(user_id, _t<n>, ...)``: when the running event count reached each number.

    Counts are whole and at least 1, so the first ``n`` matching rows decide. Small
    numbers are ranked with a limit that every task applies before the shuffle; with
    hot users a salted ranking goes first, so their rows never meet in one task.
    Larger numbers are found by running sums over ranges of (user, time).
    """
    matches = {number: _condition_predicate(events, c) for number, c in wanted.items()}
    hits = F.array_compact(F.array(*[F.when(match, F.lit(number)) for number, match in matches.items()]))
    # The filter repeats the array's conditions for the scan's sake.
    relevant = events.where(any_of(matches.values()))
    rows = relevant.select("user_id", "event_time", "row_id", "event_count", F.explode(hits).alias("_cond"))
    parts = []
    small = {n: c.min_count for n, c in wanted.items() if c.min_count <= GROUP_LIMIT}
    large = {n: c.min_count for n, c in wanted.items() if c.min_count > GROUP_LIMIT}
    if small:
        limit, need = max(small.values()), _by_number(small)
        whole = Window.partitionBy("user_id", "_cond").orderBy("event_time", "row_id")
        chosen = rows.where(F.col("_cond").isin(list(small))) if large else rows
        if hot.salts is not None:
            near = Window.partitionBy("user_id", "_cond", "_salt").orderBy("event_time", "row_id")
            chosen = chosen.withColumn("_salt", row_salt(TOP_SALTS, "event_time", "row_id"))
            chosen = chosen.withColumn("_pos", F.row_number().over(near)).where((F.col("_pos") <= limit) & (F.col("_pos") <= need))
        running = F.sum("event_count").over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = chosen.withColumns({"_pos": F.row_number().over(whole), "_sum": running}).where(F.col("_pos") <= limit)
        parts.append(ranked.where(F.col("_sum") >= need).select("user_id", "_cond", "event_time"))
    if large:
        heavy = rows.where(F.col("_cond").isin(list(large))).withColumn("_need", _by_number(large))
        parts.append(crossing_time(heavy, ["user_id", "_cond"], "event_time", "event_count", "_need"))
    reached = reduce(DataFrame.unionByName, parts)
    return reached.groupBy("user_id").agg(
        *[F.min(F.when(F.col("_cond") == n, F.col("event_time"))).alias(f"_t{n}") for n in wanted]
    )


def build_membership(
    events: DataFrame, cohorts: Sequence[Cohort], include_hidden: bool = False, hot: HotKeys | None = None
) -> DataFrame:
    """``(cohort_id, user_id, join_time)`` for all cohorts together.

    Equal conditions are evaluated once. First-occurrence times of every condition
    come from one partially aggregated pass that also yields each user's first
    event; only conditions with a count above one need an ordered pass.
    """
    chosen = [c for c in cohorts if include_hidden or not c.hidden]
    distinct: dict[str, tuple[int, Condition]] = {}
    for cohort in chosen:
        for condition in cohort.conditions:
            distinct.setdefault(_identity(condition), (len(distinct), condition))

    once = {n: c for n, c in distinct.values() if c.min_count == 1}
    nth = {n: c for n, c in distinct.values() if c.min_count > 1}
    firsts = [F.min("event_time").alias("_first_seen")]
    for number, condition in once.items():
        firsts.append(F.min(F.when(_condition_predicate(events, condition), F.col("event_time"))).alias(f"_t{number}"))
    users = events.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(*firsts)
    if nth:
        times = _nth_times(events, nth, hot_keys(events) if hot is None else hot)
        users = users.join(times, "user_id", "left")

    entries = []
    for cohort in chosen:
        met, times = [], []
        for condition in cohort.conditions:
            time = F.col(f"_t{distinct[_identity(condition)][0]}")
            if condition.negated:
                met.append(time.isNull())
                times.append(F.when(time.isNull(), F.col("_first_seen")))
            else:
                met.append(time.isNotNull())
                times.append(time)
        if not times:
            member, joined = F.lit(True), F.col("_first_seen")
        else:
            member = all_of(met) if cohort.logic == "AND" else any_of(met)
            pick = F.greatest if cohort.logic == "AND" and cohort.all_met else F.least
            joined = pick(*times) if len(times) > 1 else times[0]
            if cohort.join_type == "first_event":
                joined = F.col("_first_seen")
        entries.append(F.when(member, F.struct(F.lit(cohort.cohort_id).alias("cohort_id"), joined.alias("join_time"))))
    return (
        users.select("user_id", F.explode(F.array_compact(F.array(*entries))).alias("m"))
        .select("m.cohort_id", "user_id", "m.join_time")
    )


def all_users(events: DataFrame, cohort_id: int = 1) -> DataFrame:
    """Everyone in scope, joined at their first event."""
    return (
        events.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.min("event_time").alias("join_time"))
        .select(F.lit(cohort_id).alias("cohort_id"), "user_id", "join_time")
    )


def activity(events: DataFrame, members: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Members' events at or after joining, with ``cohort_id`` and ``join_time``."""
    heavy = hot_keys(events) if hot is None else hot
    return join_per_key(events, members, heavy).where(F.col("event_time") >= F.col("join_time"))


def cohort_frame(spark: SparkSession, cohorts: Sequence[Cohort]) -> DataFrame:
    """The specs as a small table."""
    rows = [(c.cohort_id, c.name, c.logic, c.join_type, c.hidden) for c in cohorts]
    return spark.createDataFrame(rows, "cohort_id int, name string, logic string, join_type string, hidden boolean")


def cohort_sizes(members: DataFrame) -> DataFrame:
    """Membership is unique per cohort and user, so a plain count is the size."""
    return members.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("size"))


def list_cohorts(specs: DataFrame, members: DataFrame) -> DataFrame:
    """Every cohort with its size, empty ones included."""
    return specs.join(cohort_sizes(members), "cohort_id", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))


def active_flags(specs: DataFrame, linked: DataFrame) -> DataFrame:
    """A cohort is active if any event is linked to it."""
    counts = linked.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("linked_events"))
    joined = specs.select("cohort_id", "name").join(counts, "cohort_id", "left")
    return joined.select(
        "cohort_id",
        "name",
        F.coalesce("linked_events", F.lit(0).cast("long")).alias("linked_events"),
        (F.coalesce("linked_events", F.lit(0)) > 0).alias("is_active"),
    )


def estimate_size(events: DataFrame, cohort: Cohort) -> DataFrame:
    """Size of a definition and its share of all users, nothing stored."""
    everyone = Cohort(-1, "everyone")
    subject = Cohort(-2, cohort.name, cohort.conditions, cohort.logic, cohort.join_type)
    members = build_membership(events, [everyone, subject])
    counts = members.agg(
        F.count_if(F.col("cohort_id") == -2).alias("estimated_users"),
        F.count_if(F.col("cohort_id") == -1).alias("total_users"),
    )
    share = F.when(F.col("total_users") > 0, F.col("estimated_users") * 100.0 / F.col("total_users")).otherwise(0.0)
    return counts.withColumn("percentage", share)


def missing_names(events: DataFrame, cohort: Cohort) -> DataFrame:
    """Event names and properties a definition refers to that the data lacks."""
    spark = events.sparkSession
    names = sorted({c.event_name for c in cohort.conditions})
    columns = sorted({c.where.column for c in cohort.conditions if c.where is not None} - set(events.columns))
    wanted = spark.createDataFrame([(name,) for name in names], "name string")
    present = events.where(F.col("event_name").isin(names)).select(F.col("event_name").alias("name")).distinct()
    missing_events = wanted.join(present, "name", "left_anti").select(F.lit("event").alias("kind"), "name")
    missing_columns = spark.createDataFrame([("property", name) for name in columns], "kind string, name string")
    return missing_events.unionByName(missing_columns)
