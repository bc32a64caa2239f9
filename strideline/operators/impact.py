"""Experiment impact: variants against a baseline in a window after joining.

Everything derives from two staged-size frames: one row per cohort, user and
relative day, and one per cohort and user. Metrics, deltas and tests are small
aggregates of those.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.functions.predicates import event_set
from strideline.functions.stats import exact_sum, mann_whitney_p, two_proportion_p
from strideline.functions.times import DAY_MICROS, micros, seconds_between, shift_days
from strideline.operators.cohorts import cohort_sizes
from strideline.operators.ordering import hash_ranked, quantile_seconds, rank_sums
from strideline.operators.skew import HotKeys, hot_keys, join_per_key
from strideline.operators.staging import stage
from strideline.specs import EventMatch, SpecError

# Thresholds and the test each metric takes.
PAYER_FLOOR = 0.0001
MIN_SAMPLE = 30
SAMPLE_USERS = 50_000
ALPHA = 0.05
MEAN_TOLERANCE = 1e-9
Z_TEST, RANK_TEST = "z_test", "mwu"
TEST_BY_METRIC = {
    "exposure_rate": Z_TEST,
    "usage_rate": Z_TEST,
    "reuse_rate": Z_TEST,
    "revenue_conversion": Z_TEST,
    "reach": Z_TEST,
    "ctr": RANK_TEST,
    "engagement": RANK_TEST,
    "engagement_daily_avg": RANK_TEST,
    "time_to_first_interaction": RANK_TEST,
    "intensity": RANK_TEST,
    "revenue_per_user": RANK_TEST,
    "revenue_intensity": RANK_TEST,
    "revenue_daily_avg": RANK_TEST,
}


@dataclass(frozen=True)
class Experiment:
    baseline: int
    variants: Sequence[int]
    start_day: int
    end_day: int
    exposure: Sequence[EventMatch | str] = ()
    interaction: Sequence[EventMatch | str] = ()
    impact: Sequence[EventMatch | str] = ()
    monetization: Sequence[EventMatch | str] = ()
    retention_event: str | None = "any"

    def __post_init__(self) -> None:
        if self.start_day < 0 or self.end_day < self.start_day:
            raise SpecError("the window must end on or after its start day")
        if self.baseline in self.variants:
            raise SpecError("the baseline cannot be a variant")

    @property
    def cohorts(self) -> list[int]:
        return [self.baseline, *self.variants]

    @property
    def days(self) -> int:
        return self.end_day - self.start_day + 1

    @property
    def impact_names(self) -> list[str]:
        return [m.event_name if isinstance(m, EventMatch) else m for m in self.impact]


def _flag(events: DataFrame, matches: Sequence[EventMatch | str]) -> Column:
    return event_set(events.schema, matches) if matches else F.lit(False)


def impact_window(events: DataFrame, members: DataFrame, spec: Experiment, hot: HotKeys | None = None) -> DataFrame:
    """Members' events from ``start_day`` to the end of ``end_day`` after joining."""
    chosen = members.where(F.col("cohort_id").isin(spec.cohorts))
    heavy = hot_keys(events) if hot is None else hot
    joined = join_per_key(events, chosen, heavy)
    start, end = shift_days(F.col("join_time"), spec.start_day), shift_days(F.col("join_time"), spec.end_day + 1)
    day = F.floor((micros(F.col("event_time")) - micros(F.col("join_time"))) / F.lit(DAY_MICROS)).cast("int")
    return joined.where((F.col("event_time") >= start) & (F.col("event_time") < end)).withColumn("rel_day", day)


def user_days(events: DataFrame, members: DataFrame, spec: Experiment, hot: HotKeys | None = None) -> DataFrame:
    """``(cohort_id, user_id, rel_day)`` with every amount the metrics need."""
    window = impact_window(events, members, spec, hot)

    def amount(matches: Sequence[EventMatch | str], column: str = "event_count") -> Column:
        return F.sum(F.when(_flag(events, matches), F.coalesce(column, F.lit(0.0))).otherwise(0.0))

    name = spec.retention_event
    retained = F.lit(name == "any") if name in (None, "any") else F.col("event_name") == name
    exposed = _flag(events, spec.exposure)
    columns = [
        amount(spec.exposure).alias("exposures"),
        amount(spec.interaction).alias("interactions"),
        exact_sum(F.when(_flag(events, spec.monetization), F.coalesce("modified_revenue", F.lit(0.0)))).alias("revenue"),
        F.max(F.when(exposed, 1).otherwise(0)).alias("exposed"),
        F.max(F.when(_flag(events, spec.interaction), 1).otherwise(0)).alias("interacted"),
        F.max(F.when(retained, 1).otherwise(0)).alias("retained"),
        F.min(F.when(exposed, F.col("event_time"))).alias("first_exposure"),
    ]
    for i, match in enumerate(spec.impact):
        columns.append(amount([match]).alias(f"impact_{i}"))
        columns.append(F.max(F.when(_flag(events, [match]), 1).otherwise(0)).alias(f"reached_{i}"))
    return window.groupBy("cohort_id", "user_id", "rel_day").agg(*columns)


def user_totals(days: DataFrame, members: DataFrame, spec: Experiment) -> DataFrame:
    """One row per member, zero-filled, with per-user click-through and daily averages."""
    kept = F.col("retained") == 1
    sums = ["exposures", "interactions", "revenue", *[f"impact_{i}" for i in range(len(spec.impact))]]
    flags = ["exposed", "interacted", *[f"reached_{i}" for i in range(len(spec.impact))]]
    totals = days.groupBy("cohort_id", "user_id").agg(
        *[(exact_sum(F.col(name)) if name == "revenue" else F.sum(name)).alias(name) for name in sums],
        *[F.max(name).alias(name) for name in flags],
        F.min("first_exposure").alias("first_exposure"),
        F.sum("retained").alias("retained_days"),
        F.sum(F.when(kept, F.col("interactions")).otherwise(0.0)).alias("kept_interactions"),
        exact_sum(F.when(kept, F.col("revenue"))).alias("kept_revenue"),
    )
    chosen = members.where(F.col("cohort_id").isin(spec.cohorts))
    filled = chosen.join(totals, ["cohort_id", "user_id"], "left").na.fill(
        0, [*sums, *flags, "retained_days", "kept_interactions", "kept_revenue"]
    )

    def ratio(top: str, bottom: str) -> Column:
        return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)

    return (
        filled.withColumn("user_ctr", ratio("interactions", "exposures"))
        .withColumn("user_daily_interactions", ratio("kept_interactions", "retained_days"))
        .withColumn("user_daily_revenue", ratio("kept_revenue", "retained_days"))
    )


def interaction_times(events: DataFrame, totals: DataFrame, spec: Experiment, hot: HotKeys | None = None) -> DataFrame:
    """``(cohort_id, user_id, seconds)`` from first exposure to the first later interaction."""
    heavy = hot_keys(events) if hot is None else hot
    exposed = totals.where(F.col("first_exposure").isNotNull()).select("cohort_id", "user_id", "join_time", "first_exposure")
    joined = join_per_key(events.where(_flag(events, spec.interaction)), exposed, heavy)
    after = (F.col("event_time") > F.col("first_exposure")) & (
        F.col("event_time") < shift_days(F.col("join_time"), spec.end_day + 1)
    )
    firsts = joined.where(after).groupBy("cohort_id", "user_id").agg(
        F.min("event_time").alias("_first"), F.min("first_exposure").alias("_exposed")
    )
    return firsts.select("cohort_id", "user_id", seconds_between(F.col("_exposed"), F.col("_first")).alias("seconds"))


def daily_series(days: DataFrame, members: DataFrame, spec: Experiment) -> DataFrame:
    """Interactions and revenue per retained user for every relative day, 0 when none."""
    grid = cohort_sizes(members.where(F.col("cohort_id").isin(spec.cohorts))).withColumn(
        "rel_day", F.explode(F.sequence(F.lit(spec.start_day), F.lit(spec.end_day)))
    )
    sums = days.groupBy("cohort_id", "rel_day").agg(
        F.sum("retained").alias("active_users"), F.sum("interactions").alias("_i"), exact_sum(F.col("revenue")).alias("_r")
    )
    frame = grid.join(sums, ["cohort_id", "rel_day"], "left").na.fill(0, ["active_users", "_i", "_r"])

    def per_active(name: str) -> Column:
        return F.when(F.col("active_users") > 0, F.col(name) / F.col("active_users")).otherwise(0.0)

    return frame.select(
        "cohort_id", "rel_day", "active_users", per_active("_i").alias("engagement"), per_active("_r").alias("revenue")
    )


def daily_averages(series: DataFrame) -> DataFrame:
    """Means over all days of the window; NULL for a series that is all zero."""
    picks = []
    for name in ("engagement", "revenue"):
        some = F.max(F.when(F.col(name) != 0, 1).otherwise(0)) == 1
        picks.append(F.when(some, F.avg(name)).alias(f"{name}_daily_avg"))
    return series.groupBy("cohort_id").agg(*picks)


def cohort_totals(totals: DataFrame, spec: Experiment) -> DataFrame:
    """Counts per cohort: the numerators and denominators of all rates."""
    picks = [
        F.count(F.lit(1)).alias("total_users"),
        F.sum("exposed").alias("exposure_users"),
        F.sum("exposures").alias("exposure_count"),
        F.sum("interacted").alias("interaction_users"),
        F.sum("interactions").alias("interaction_count"),
        F.count_if((F.col("interactions") >= 2) & (F.col("interacted") == 1)).alias("reuse_users"),
        exact_sum(F.col("revenue")).alias("total_revenue"),
        F.count_if(F.col("revenue") > PAYER_FLOOR).alias("paying_users"),
    ]
    for i in range(len(spec.impact)):
        picks += [F.sum(f"reached_{i}").alias(f"reached_{i}"), F.sum(f"impact_{i}").alias(f"impact_{i}")]
    return totals.groupBy("cohort_id").agg(*picks)


def _share(top: str, bottom: str, empty: Column | None = None) -> Column:
    value = F.when(F.col(bottom) > 0, F.col(top) / F.when(F.col(bottom) > 0, F.col(bottom)))
    return value.otherwise(F.lit(0.0) if empty is None else empty).cast("double")


def rates(counts: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("double")
    return counts.select(
        "*",
        _share("exposure_users", "total_users").alias("exposure_rate"),
        _share("interaction_users", "exposure_users").alias("usage_rate"),
        _share("interaction_count", "exposure_count", nothing).alias("ctr"),
        _share("reuse_users", "interaction_users").alias("reuse_rate"),
        _share("interaction_count", "total_users").alias("engagement"),
    )


def monetization(counts: DataFrame) -> DataFrame:
    return counts.select(
        "cohort_id",
        "total_users",
        "total_revenue",
        "paying_users",
        _share("total_revenue", "total_users").alias("revenue_per_user"),
        _share("paying_users", "total_users").alias("revenue_conversion"),
        _share("total_revenue", "paying_users", F.lit(None).cast("double")).alias("revenue_intensity"),
    )


def reach_intensity(counts: DataFrame, spec: Experiment) -> DataFrame:
    """``(cohort_id, event, event_users, total_users, reach, intensity)``."""
    entries = [
        F.struct(
            F.lit(name).alias("event"),
            F.col(f"reached_{i}").alias("event_users"),
            _share(f"reached_{i}", "total_users").alias("reach"),
            _share(f"impact_{i}", "total_users").alias("intensity"),
        )
        for i, name in enumerate(spec.impact_names)
    ]
    return counts.select("cohort_id", "total_users", F.explode(F.array(*entries)).alias("e")).select(
        "cohort_id", "e.event", "e.event_users", "total_users", "e.reach", "e.intensity"
    )


@dataclass(frozen=True)
class ImpactBase:
    """The staged frames one run shares between metrics and tests."""

    spec: Experiment
    members: DataFrame
    days: DataFrame
    totals: DataFrame
    times: DataFrame


def prepare(events: DataFrame, members: DataFrame, spec: Experiment, hot: HotKeys | None = None) -> ImpactBase:
    """Read the events once and stage the per-user frames."""
    hot = hot_keys(events) if hot is None else hot
    days = stage(user_days(events, members, spec, hot))
    totals = stage(user_totals(days, members, spec))
    times = stage(interaction_times(events, totals, spec, hot))
    return ImpactBase(spec, members, days, totals, times)


def metrics_long(base: ImpactBase) -> DataFrame:
    """``(cohort_id, metric_key, value, delta)`` for every metric and cohort.

    ``delta`` is relative to the baseline; NULL for the baseline itself and where
    its value is 0 or missing.
    """
    spec = base.spec
    counts = cohort_totals(base.totals, spec)
    median = quantile_seconds(base.times, ["cohort_id"], "seconds", {"median_seconds": 0.5})
    averages = daily_averages(daily_series(base.days, base.members, spec))
    wide = rates(counts).join(median, "cohort_id", "left").join(averages, "cohort_id", "left")
    keys = {
        "exposure_rate": F.col("exposure_rate"),
        "usage_rate": F.col("usage_rate"),
        "ctr": F.col("ctr"),
        "reuse_rate": F.col("reuse_rate"),
        "time_to_first_interaction": F.col("median_seconds"),
        "engagement": F.col("engagement"),
        "engagement_daily_avg": F.col("engagement_daily_avg"),
    }
    if spec.monetization:
        keys["revenue_per_user"] = _share("total_revenue", "total_users")
        keys["revenue_conversion"] = _share("paying_users", "total_users")
        keys["revenue_intensity"] = _share("total_revenue", "paying_users", F.lit(None).cast("double"))
        keys["revenue_daily_avg"] = F.col("revenue_daily_avg")
    for i, name in enumerate(spec.impact_names):
        keys[f"{name}_reach"] = _share(f"reached_{i}", "total_users")
        keys[f"{name}_intensity"] = _share(f"impact_{i}", "total_users")
    entries = F.array(
        *[F.struct(F.lit(key).alias("metric_key"), value.cast("double").alias("value")) for key, value in keys.items()]
    )
    long_form = wide.select("cohort_id", F.explode(entries).alias("m")).select("cohort_id", "m.metric_key", "m.value")
    return with_deltas(long_form, spec.baseline)


def with_deltas(long_form: DataFrame, baseline: int) -> DataFrame:
    """Add the change relative to the baseline's value of the same metric."""
    # One row per metric key of the spec: a handful.
    base = long_form.where(F.col("cohort_id") == baseline).select("metric_key", F.col("value").alias("_base"))
    usable = (F.col("cohort_id") != baseline) & (F.col("_base") != 0)
    delta = F.when(usable, (F.col("value") - F.col("_base")) / F.when(F.col("_base") != 0, F.col("_base")))
    return long_form.join(base, "metric_key", "left").select("cohort_id", "metric_key", "value", delta.alias("delta"))


def rank_variants(long_form: DataFrame, metric_key: str, baseline: int) -> DataFrame:
    """Variants by their delta on one metric, missing ones last."""
    rows = long_form.where((F.col("metric_key") == metric_key) & (F.col("cohort_id") != baseline))
    return rows.orderBy(F.col("delta").desc_nulls_last(), "cohort_id")


def _count_pairs(base: ImpactBase) -> DataFrame:
    """``(cohort_id, metric_key, x, n)`` for the metrics that are proportions."""
    pairs = [
        ("exposure_rate", "exposure_users", "total_users"),
        ("usage_rate", "interaction_users", "exposure_users"),
        ("reuse_rate", "reuse_users", "interaction_users"),
    ]
    if base.spec.monetization:
        pairs.append(("revenue_conversion", "paying_users", "total_users"))
    pairs += [(f"{name}_reach", f"reached_{i}", "total_users") for i, name in enumerate(base.spec.impact_names)]
    entries = F.array(
        *[
            F.struct(F.lit(key).alias("metric_key"), F.col(x).cast("double").alias("x"), F.col(n).cast("double").alias("n"))
            for key, x, n in pairs
        ]
    )
    return cohort_totals(base.totals, base.spec).select("cohort_id", F.explode(entries).alias("m")).select("cohort_id", "m.*")


def user_values(base: ImpactBase) -> DataFrame:
    """``(cohort_id, user_id, metric_key, value)`` for the metrics that are ranked."""
    spec = base.spec
    columns = {"ctr": "user_ctr"} if spec.exposure and spec.interaction else {}
    if spec.interaction:
        columns["engagement"] = "interactions"
        if spec.retention_event:
            columns["engagement_daily_avg"] = "user_daily_interactions"
    if spec.monetization:
        columns["revenue_per_user"] = "revenue"
        if spec.retention_event:
            columns["revenue_daily_avg"] = "user_daily_revenue"
    for i, name in enumerate(spec.impact_names):
        columns[f"{name}_intensity"] = f"impact_{i}"
    entries = [F.struct(F.lit(key).alias("metric_key"), F.col(name).cast("double").alias("value")) for key, name in columns.items()]
    if spec.monetization:
        paying = F.struct(F.lit("revenue_intensity").alias("metric_key"), F.col("revenue").cast("double").alias("value"))
        entries.append(F.when(F.col("revenue") > 0, paying))
    long_form = base.totals.select("cohort_id", "user_id", F.explode(F.array_compact(F.array(*entries))).alias("m"))
    values = long_form.select("cohort_id", "user_id", "m.metric_key", "m.value")
    if spec.exposure and spec.interaction:
        times = base.times.select("cohort_id", "user_id", F.lit("time_to_first_interaction").alias("metric_key"), F.col("seconds").alias("value"))
        values = values.unionByName(times)
    return values


def significance(base: ImpactBase, min_sample: int = MIN_SAMPLE, tolerance: float = MEAN_TOLERANCE) -> DataFrame:
    """``(cohort_id, metric_key, test, p_value, significant, skip_reason)`` per variant.

    Rank tests use all users: only distinct values and their counts are ordered, so
    there is nothing to sample. ``p_value`` is NULL where there is a reason to skip it: under ``min_sample`` users
    (1 tests all), or means within ``tolerance`` (0: equal ones only).
    """
    spec = base.spec
    variants = F.array(*[F.lit(v) for v in spec.variants])
    is_base = F.col("cohort_id") == spec.baseline

    counts = _count_pairs(base)
    control = counts.where(is_base).select("metric_key", F.col("x").alias("x_b"), F.col("n").alias("n_b"))
    tested = counts.where(~is_base).join(control, "metric_key")
    p_z = two_proportion_p(F.col("x_b"), F.col("n_b"), F.col("x"), F.col("n"))
    reason = (
        F.when((F.col("n_b") == 0) | (F.col("n") == 0), "insufficient_data")
        .when((F.col("n_b") < min_sample) | (F.col("n") < min_sample), "low_sample")
        .when(F.col("x_b") / F.when(F.col("n_b") > 0, F.col("n_b")) == F.col("x") / F.when(F.col("n") > 0, F.col("n")), "no_difference")
    )
    z_rows = tested.select("cohort_id", "metric_key", F.lit(Z_TEST).alias("test"), p_z.alias("_p"), reason.alias("skip_reason"))

    # Baseline users take part once per variant, variant users once.
    values = user_values(base)
    facing = values.withColumn("variant", F.explode(F.when(is_base, variants).otherwise(F.array(F.col("cohort_id")))))
    keyed = facing.select("variant", "metric_key", is_base.alias("_is_base"), "value")
    sums = rank_sums(keyed, ["variant", "metric_key"], "_is_base", "value")
    means = keyed.groupBy("variant", "metric_key").agg(
        F.avg(F.when(F.col("_is_base"), F.col("value"))).alias("_mean_b"),
        F.avg(F.when(~F.col("_is_base"), F.col("value"))).alias("_mean_v"),
    )
    exposures = cohort_totals(base.totals, spec).select("cohort_id", "exposure_count")
    fewest = exposures.where(is_base).select(F.col("exposure_count").alias("_eb")).withColumn("variant", F.explode(variants)).join(
        exposures.select(F.col("cohort_id").alias("variant"), F.col("exposure_count").alias("_ev")), "variant"
    )
    all_pairs = fewest.withColumn("metric_key", F.explode(F.array(*[F.lit(k) for k in _ranked_keys(spec)])))
    joined = all_pairs.join(sums, ["variant", "metric_key"], "left").join(means, ["variant", "metric_key"], "left").na.fill(0, ["n_a", "n_b"])
    p_rank = mann_whitney_p(F.col("n_a"), F.col("n_b"), F.col("rank_sum_a"), F.col("tie_term"))
    rank_reason = (
        F.when((F.col("metric_key") == "ctr") & ((F.col("_eb") < min_sample) | (F.col("_ev") < min_sample)), "low_sample")
        .when((F.col("n_a") == 0) | (F.col("n_b") == 0), "insufficient_data")
        .when((F.col("n_a") < min_sample) | (F.col("n_b") < min_sample), "low_sample")
        .when(F.abs(F.col("_mean_b") - F.col("_mean_v")) <= tolerance, "no_difference")
    )
    rank_rows = joined.select(
        F.col("variant").alias("cohort_id"), "metric_key", F.lit(RANK_TEST).alias("test"), p_rank.alias("_p"), rank_reason.alias("skip_reason")
    )
    both = z_rows.unionByName(rank_rows)
    p_value = F.when(F.col("skip_reason").isNull(), F.col("_p"))
    return both.select(
        "cohort_id", "metric_key", "test", p_value.alias("p_value"), F.coalesce(p_value < ALPHA, F.lit(False)).alias("significant"), "skip_reason"
    )


def _ranked_keys(spec: Experiment) -> list[str]:
    keys = ["ctr"] if spec.exposure and spec.interaction else []
    if spec.interaction:
        keys += ["engagement"] + (["engagement_daily_avg"] if spec.retention_event else [])
    if spec.exposure and spec.interaction:
        keys.append("time_to_first_interaction")
    if spec.monetization:
        keys += ["revenue_per_user", "revenue_intensity"] + (["revenue_daily_avg"] if spec.retention_event else [])
    return keys + [f"{name}_intensity" for name in spec.impact_names]


def sample_users(values: DataFrame, limit: int = SAMPLE_USERS, seed: str = "42") -> DataFrame:
    """A repeatable sample of ``limit`` users per cohort: the smallest hashes."""
    return hash_ranked(values, ["cohort_id"], "user_id", seed, limit).drop("_rank", "_total")
