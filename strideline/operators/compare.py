"""Two cohorts side by side: a metric's per-user values and the tests on them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.predicates import text_predicate
from strideline.functions.stats import mann_whitney_p, two_proportion_p, welch_p
from strideline.functions.times import as_instant, bucket_index, elapsed_units
from strideline.operators.cohorts import activity
from strideline.operators.ordering import rank_sums
from strideline.operators.skew import HotKeys
from strideline.specs import Filter, SpecError

# The metrics by kind, and the limits of the tests.
RETENTION_METRICS = ("retention_rate",)
USAGE_METRICS = (
    "per_installed_user",
    "cumulative_per_installed_user",
    "per_retained_user",
    "per_event_firer",
    "unique_users_percent",
    "unique_users_cumulative_percent",
)
REVENUE_METRICS = (
    "revenue_per_acquired_user",
    "cumulative_revenue_per_acquired_user",
    "revenue_per_retained_user",
)
PROPORTION_METRICS = ("retention_rate", "unique_users_percent", "unique_users_cumulative_percent")
CUMULATIVE_METRICS = (
    "cumulative_per_installed_user",
    "unique_users_cumulative_percent",
    "cumulative_revenue_per_acquired_user",
)
RETAINED_METRICS = ("per_retained_user", "revenue_per_retained_user")
FISHER_TOLERANCE = 1e-10
ALPHA = 0.05
#: Tables this many deviations and steps from the mode weigh less than the smallest double.
FISHER_REACH = (40.0, 800.0)


def metric_values(
    events: DataFrame,
    members: DataFrame,
    until: datetime | Column,
    metric: str,
    day: int,
    event: str | None = None,
    unit: str = "day",
    kind: str = "classic",
    where: Filter | None = None,
    max_day: int | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """``(cohort_id, user_id, value)`` of every user the metric is defined for.

    One activity join and one aggregate per user; inactive members are added with 0
    from the membership. Nobody is counted before bucket ``day`` is observable,
    except by cumulative metrics, which sum what has been observed so far. Ever-after
    retention looks as far as ``max_day``, or to the end of observation.
    """
    if metric not in RETENTION_METRICS + USAGE_METRICS + REVENUE_METRICS:
        raise SpecError(f"unknown metric {metric!r}")
    if metric in USAGE_METRICS and not event:
        raise SpecError("usage metrics need an event")
    elapsed = elapsed_units(F.col("join_time"), as_instant(until), unit)
    bucketed = activity(events, members, hot).withColumn("bucket", bucket_index(F.col("join_time"), F.col("event_time"), unit))
    bucketed = bucketed.where(F.col("bucket") <= elapsed)
    later = kind == "ever_after" and metric in RETENTION_METRICS
    last = max_day if later else day
    if last is not None:
        bucketed = bucketed.where(F.col("bucket") <= last)

    counted = F.lit(True) if event in (None, "any") else F.col("event_name") == event
    if where is not None:
        counted = counted & text_predicate(where)
    if metric in REVENUE_METRICS and where is None:
        counted = F.lit(True)
    if metric in CUMULATIVE_METRICS:
        inside = F.col("bucket") <= day
    elif later:
        inside = F.col("bucket") >= day
    else:
        inside = F.col("bucket") == day

    if metric in PROPORTION_METRICS:
        value = F.max(F.when(inside & counted, 1.0).otherwise(0.0))
    else:
        amount = F.col("modified_revenue") if metric in REVENUE_METRICS else F.col("event_count")
        value = F.sum(F.when(inside & counted, amount).otherwise(0.0))
    on_day = F.max(F.when(F.col("bucket") == day, 1).otherwise(0))
    per_user = bucketed.groupBy("cohort_id", "user_id").agg(value.alias("value"), on_day.alias("_on_day"))

    observed = elapsed >= (0 if metric in CUMULATIVE_METRICS else day)
    values = (
        members.where(observed)
        .join(per_user, ["cohort_id", "user_id"], "left")
        .select("cohort_id", "user_id", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("_on_day", F.lit(0)).alias("_on_day"))
    )
    if metric in RETAINED_METRICS:
        values = values.where(F.col("_on_day") == 1)
    if metric == "per_event_firer":
        values = values.where(F.col("value") > 0)
    return values.drop("_on_day")


def side_by_side(values: DataFrame, cohort_a: int, cohort_b: int) -> DataFrame:
    """One row of size, sum, mean and variance for A and B."""
    picks = []
    for name, cohort in (("a", cohort_a), ("b", cohort_b)):
        own = F.when(F.col("cohort_id") == cohort, F.col("value").cast("double"))
        picks += [
            F.count(own).alias(f"n_{name}"),
            F.coalesce(F.sum(own), F.lit(0.0)).alias(f"sum_{name}"),
            F.coalesce(F.avg(own), F.lit(0.0)).alias(f"mean_{name}"),
            F.var_samp(own).alias(f"var_{name}"),
        ]
    return values.where(F.col("cohort_id").isin(cohort_a, cohort_b)).agg(*picks)


def proportion_test(pair: DataFrame) -> DataFrame:
    """Add ``p_z``, the two-proportion z-test."""
    return pair.withColumn("p_z", two_proportion_p(F.col("sum_a"), F.col("n_a"), F.col("sum_b"), F.col("n_b")))


def fisher_test(pair: DataFrame) -> DataFrame:
    """Add ``p_fisher``: the probability of all tables no likelier than the observed.

    Neighbouring tables differ by a known ratio; a running sum of its logarithm gives
    every table's probability up to a factor, which the total divides out. Only tables
    whose weight a double can hold are walked: some deviations around the mode, so
    their number grows with the root of the users at any cohort size.
    """
    numbered = pair.withColumn("_pair", F.xxhash64("n_a", "sum_a", "n_b", "sum_b"))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    hits = (F.col("sum_a") + F.col("sum_b")).cast("long")
    low = F.greatest(F.lit(0).cast("long"), hits - n_b)
    high = F.least(hits, n_a)
    total = (n_a + n_b).cast("double")
    mode = F.floor((hits + 1) * (n_a + 1).cast("double") / (total + 2))
    share = hits / total
    deviation = F.sqrt(n_a * share * (F.lit(1.0) - share) * n_b / F.greatest(total - 1, F.lit(1.0)))
    reach = F.ceil(F.lit(FISHER_REACH[0]) * deviation + F.lit(FISHER_REACH[1]))
    low, high = F.greatest(low, mode - reach), F.least(high, mode + reach)
    some = numbered.where((n_a + n_b > 0) & (hits > 0))
    tables = some.select("_pair", F.col("sum_a").cast("long").alias("_seen"), n_a.alias("_na"), n_b.alias("_nb"), hits.alias("_k"), low.alias("_low"), F.explode(F.sequence(low, high)).alias("_x"))
    x = F.col("_x").cast("double")
    ratio = (F.col("_na") - x + 1) * (F.col("_k") - x + 1) / (x * (F.col("_nb") - F.col("_k") + x))
    step = F.when(F.col("_x") == F.col("_low"), 0.0).otherwise(F.log(F.when(F.col("_x") > F.col("_low"), ratio)))
    running = Window.partitionBy("_pair").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("_pair")
    scaled = tables.withColumn("_log", F.sum(step).over(running)).withColumn("_w", F.exp(F.col("_log") - F.max("_log").over(whole)))
    shares = scaled.withColumn("_p", F.col("_w") / F.sum("_w").over(whole))
    seen = F.coalesce(F.max(F.when(F.col("_x") == F.col("_seen"), F.col("_p"))).over(whole), F.lit(0.0))
    tails = shares.withColumn("_obs", seen).groupBy("_pair").agg(
        F.least(F.lit(1.0), F.sum(F.when(F.col("_p") <= F.col("_obs") + FISHER_TOLERANCE, F.col("_p")))).alias("_tail")
    )
    return numbered.join(tails, "_pair", "left").withColumn("p_fisher", F.coalesce("_tail", F.lit(1.0))).drop("_pair", "_tail")


def welch_test(pair: DataFrame) -> DataFrame:
    """Add ``p_welch``."""
    names = ["n_a", "mean_a", "var_a", "n_b", "mean_b", "var_b"]
    return pair.withColumn("p_welch", welch_p(*[F.col(name) for name in names]))


def rank_test(
    values: DataFrame,
    cohort_a: int,
    cohort_b: int,
    tie_correction: bool = True,
    continuity: bool = True,
) -> DataFrame:
    """One row with the sizes, the rank sum of A, U and ``p_mwu``."""
    pair = values.where(F.col("cohort_id").isin(cohort_a, cohort_b)).select(
        F.lit(0).alias("_pair"), (F.col("cohort_id") == cohort_a).alias("_is_a"), "value"
    )
    sums = rank_sums(pair, ["_pair"], "_is_a", "value")
    u_a = F.col("rank_sum_a") - F.col("n_a") * (F.col("n_a") + 1) / 2
    p = mann_whitney_p(F.col("n_a"), F.col("n_b"), F.col("rank_sum_a"), F.col("tie_term"), tie_correction, continuity)
    return sums.select(
        F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"), "rank_sum_a", "tie_term",
        u_a.alias("u_a"), p.alias("p_mwu"),
    )


def compare_cohorts(values: DataFrame, metric: str, cohort_a: int, cohort_b: int) -> DataFrame:
    """Means, difference, lift and p-values of the tests that fit the metric.

    Under two users on a side there are no tests; two constant sides have no
    continuous p-value. ``values`` is read by several aggregates, so it
    should be staged. A cohort isn't compared with itself.
    """
    if cohort_a == cohort_b:
        raise SpecError(f"cohort {cohort_a} on both sides")
    pair = side_by_side(values, cohort_a, cohort_b)
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    empty = F.lit(None).cast("double")
    if metric in PROPORTION_METRICS:
        tested = fisher_test(proportion_test(pair))
        tested = tested.withColumn("p_welch", empty).withColumn("p_mwu", empty)
        p_value = F.least(F.col("p_z"), F.col("p_fisher"))
    else:
        ranks = rank_test(values, cohort_a, cohort_b).select(F.col("n_a").alias("_na"), F.col("n_b").alias("_nb"), "p_mwu")
        constant = (F.col("var_a") == 0) & (F.col("var_b") == 0)
        tested = welch_test(pair).join(ranks, (F.col("n_a") == F.col("_na")) & (F.col("n_b") == F.col("_nb")), "left")
        tested = tested.withColumn("p_z", empty).withColumn("p_fisher", empty)
        for name in ("p_welch", "p_mwu"):
            tested = tested.withColumn(name, F.when(~constant, F.col(name)))
        p_value = F.col("p_mwu")
    difference = F.col("mean_a") - F.col("mean_b")
    guarded = F.when(enough, p_value)
    return tested.select(
        F.lit(metric).alias("metric"),
        "n_a",
        "n_b",
        F.col("mean_a").alias("value_a"),
        F.col("mean_b").alias("value_b"),
        difference.alias("difference"),
        F.when(F.col("mean_b") != 0, difference / F.when(F.col("mean_b") != 0, F.col("mean_b"))).alias("relative_lift"),
        *[F.when(enough, F.col(name)).alias(name) for name in ("p_z", "p_fisher", "p_welch", "p_mwu")],
        guarded.alias("p_value"),
        F.coalesce(guarded < ALPHA, F.lit(False)).alias("significant"),
    )
