from __future__ import annotations

import math
import random
from datetime import datetime

import pytest
from conftest import at, by, rows_of
from pyspark.sql import functions as F

from strideline.operators import cohorts as C
from strideline.operators import compare, impact, retention, usage
from strideline.specs import Cohort, Condition, EventMatch, Filter, SpecError

LATE = datetime(2024, 6, 1)


def values_frame(spark, a, b):
    return spark.createDataFrame([(1, f"a{i}", float(v)) for i, v in enumerate(a)] + [(2, f"b{i}", float(v)) for i, v in enumerate(b)], "cohort_id int, user_id string, value double")


def _tail(z):
    return math.erfc(abs(z) / math.sqrt(2))


def _student(t, df):
    """One minus the density summed over [-|t|, |t|]."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    steps, width = 20_000, abs(t) / 20_000
    return 1 - 2 * sum(scale * (1 + ((i + 0.5) * width) ** 2 / df) ** (-(df + 1) / 2) * width for i in range(steps))


def _fisher(xa, na, xb, nb):
    def ways(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    total = ways(na + nb, xa + xb)
    probs = {x: math.exp(ways(na, x) + ways(nb, xa + xb - x) - total) for x in range(max(0, xa + xb - nb), min(xa + xb, na) + 1)}
    return min(1.0, sum(p for p in probs.values() if p <= probs[xa] + 1e-10))


@pytest.mark.parametrize("xa,na,xb,nb", [(3, 10, 7, 12), (0, 5, 5, 5), (50, 100, 61, 90), (0, 4, 0, 9), (4, 4, 9, 9), (1, 300, 9, 400)])
def test_proportion_tests(spark, xa, na, xb, nb):
    frame = values_frame(spark, [1] * xa + [0] * (na - xa), [1] * xb + [0] * (nb - xb))
    row = compare.compare_cohorts(frame, "retention_rate", 1, 2).first()
    assert row.p_fisher == pytest.approx(_fisher(xa, na, xb, nb), abs=1e-9)
    pooled = (xa + xb) / (na + nb)
    error = math.sqrt(pooled * (1 - pooled) * (1 / na + 1 / nb))
    expected = _tail((xa / na - xb / nb) / error) if error else 1.0
    assert row.p_z == pytest.approx(expected, abs=1e-6)
    assert row.p_value == min(row.p_z, row.p_fisher)
    assert row.significant == (row.p_value < 0.05)
    assert row.relative_lift == (pytest.approx((xa / na - xb / nb) / (xb / nb)) if xb else None)


@pytest.mark.parametrize("xa,na,xb,nb", [(100, 4000, 60, 2000), (2600, 9000, 2800, 9000), (1, 6000, 0, 6000)])
def test_fisher_of_large_samples(spark, xa, na, xb, nb):
    big = spark.createDataFrame([(na, float(xa), nb, float(xb))], "n_a long, sum_a double, n_b long, sum_b double")
    assert compare.fisher_test(big).first().p_fisher == pytest.approx(_fisher(xa, na, xb, nb), abs=1e-7)


def test_fisher_of_huge_samples(spark):
    sizes = [(10**9, 5e8, 10**9, 5e8), (10**9, 5e8, 10**9, 4e8)]
    big = spark.createDataFrame(sizes, "n_a long, sum_a double, n_b long, sum_b double")
    near, far = (row.p_fisher for row in compare.fisher_test(big).orderBy(F.desc("sum_b")).collect())
    assert near == pytest.approx(1.0) and far < 1e-3


def test_continuous_tests(spark):
    rng = random.Random(2)
    a, b = [rng.randrange(6) for _ in range(60)], [rng.randrange(8) for _ in range(45)]
    row = compare.compare_cohorts(values_frame(spark, a, b), "per_installed_user", 1, 2).first()
    n, m = len(a), len(b)
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    both = a + b
    ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
    sigma = math.sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1))))
    assert row.p_mwu == pytest.approx(_tail((abs(u - n * m / 2) - 0.5) / sigma), abs=1e-6)
    plain = compare.rank_test(values_frame(spark, a, b), 1, 2, tie_correction=False, continuity=False).first()
    assert plain.u_a == u
    assert plain.p_mwu == pytest.approx(_tail((u - n * m / 2) / math.sqrt(n * m * (n + m + 1) / 12)), abs=1e-6)

    def spread(v):
        mean = sum(v) / len(v)
        return mean, sum((x - mean) ** 2 for x in v) / (len(v) - 1) / len(v)

    (ma, va), (mb, vb) = spread(a), spread(b)
    df = (va + vb) ** 2 / (va**2 / (n - 1) + vb**2 / (m - 1))
    assert row.p_welch == pytest.approx(_student((ma - mb) / math.sqrt(va + vb), df), abs=1e-6)
    assert row.p_value == row.p_mwu


def test_guards(spark):
    same = compare.compare_cohorts(values_frame(spark, [2, 2, 2], [2, 2]), "per_installed_user", 1, 2).first()
    assert (same.p_value, same.p_welch, same.p_mwu, same.significant) == (None, None, None, False)
    tiny = compare.compare_cohorts(values_frame(spark, [2], [3, 4]), "per_installed_user", 1, 2).first()
    assert (tiny.n_a, tiny.p_value, tiny.value_b) == (1, None, 3.5)
    zero = compare.compare_cohorts(values_frame(spark, [1, 0], [0, 0]), "retention_rate", 1, 2).first()
    assert zero.relative_lift is None and zero.difference == 0.5


@pytest.fixture(scope="module")
def study(make_events):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        rows.append((f"u{i:02d}", "signup", at(0, i % 5)))
        rows += [(f"u{i:02d}", rng.choice(["open", "click", "buy"]), at(rng.randrange(6), rng.randrange(24)), {"revenue": rng.randrange(1, 9), "k": rng.randrange(3)}) for _ in range(rng.randrange(8))]
    return make_events(rows, k="int")


@pytest.fixture(scope="module")
def groups(study):
    return C.build_membership(study, [Cohort(1, "all", join_type="first_event"), Cohort(2, "clickers", [Condition("click")], join_type="first_event")])


def test_values_agree_with_tables(study, groups):
    until, day = at(5, 3), 2
    table = by(usage.usage_table(study, groups, until, 4, "click"), ["cohort_id", "bucket"], "eligible", "volume", "users", "adopted", "retained")
    kept = by(retention.retention_table(study, groups, until, 4), ["cohort_id", "bucket"], "active")

    def totals(metric, event="click", **options):
        values = compare.metric_values(study, groups, until, metric, day, event, **options)
        return {c: (n, s) for c, n, s in ((r.cohort_id, r.n, r.s) for r in values.groupBy("cohort_id").agg({"value": "sum", "user_id": "count"}).withColumnsRenamed({"sum(value)": "s", "count(user_id)": "n"}).collect())}

    for cohort in (1, 2):
        eligible, volume, users, adopted, retained = table[(cohort, day)]
        assert totals("per_installed_user")[cohort] == (eligible, volume)
        assert totals("unique_users_percent")[cohort] == (eligible, users)
        assert totals("per_event_firer")[cohort] == (users, volume)
        assert totals("per_retained_user")[cohort] == (retained, volume)
        assert totals("unique_users_cumulative_percent")[cohort][1] == adopted
        assert totals("cumulative_per_installed_user")[cohort][1] == sum(table[(cohort, d)][1] for d in range(day + 1))
        assert totals("retention_rate", None)[cohort] == (eligible, kept[(cohort, day)])
    filtered = totals("per_installed_user", where=Filter("k", "=", ["1"]))
    assert filtered[1][1] < table[(1, day)][1]
    with pytest.raises(SpecError):
        compare.metric_values(study, groups, until, "per_installed_user", 1)
    with pytest.raises(SpecError):
        compare.metric_values(study, groups, until, "mood", 1)


def _experiment(**options):
    settings = dict(baseline=1, variants=[2], start_day=0, end_day=6, exposure=["view"], interaction=["click"], retention_event="any")
    return impact.Experiment(**{**settings, **options})


def _long(rows, members, spec):
    return by(impact.metrics_long(impact.prepare(rows, members, spec)), ["metric_key", "cohort_id"], "value", "delta")


@pytest.fixture(scope="module")
def core(make_events):
    rows = []
    for i in range(100):
        rows.append((f"u{i:03d}", "view", at(0, 0, 1)))
        if i < 50:
            rows.append((f"u{i:03d}", "click", at(0, 0, 2)))
        if i < 25:
            rows.append((f"u{i:03d}", "click", at(0, 0, 3)))
    return make_events(rows)


def test_impact_rates(core):
    members = C.build_membership(core, [Cohort(1, "all"), Cohort(2, "clickers", [Condition("click")], join_type="first_event")])
    found = _long(core, members, _experiment())
    assert found[("exposure_rate", 1)] == (1.0, None)
    assert found[("usage_rate", 1)] == (0.5, None)
    assert found[("ctr", 1)] == (0.75, None)
    assert found[("reuse_rate", 1)] == (0.5, None)
    assert found[("usage_rate", 2)] == (1.0, 1.0)
    assert found[("time_to_first_interaction", 1)] == (60.0, None)


def test_impact_time_is_a_median(make_events):
    rows = []
    for i, delay in enumerate((10, 20, 30, 40, 50)):
        rows += [(f"u{i}", "view", at(0)), (f"u{i}", "click", at(0, seconds=delay))]
    frame = make_events(rows + [("u0", "click", at(-1)), ("u0", "click", at(0, seconds=90))])
    members = C.build_membership(frame, [Cohort(1, "v", [Condition("view")])])
    assert _long(frame, members, _experiment(variants=[]))[("time_to_first_interaction", 1)] == (30.0, None)


def test_impact_daily(make_events):
    rows = [("a", "click", at(0, 1)), ("b", "click", at(0, 1)), ("a", "click", at(1, 2)), ("a", "click", at(1, 3)), ("b", "open", at(0))]
    rows += [("a", "open", at(0)), ("a", "buy", at(0, 2), {"revenue": 20}), ("a", "buy", at(1, 4), {"revenue": 10})]
    frame = make_events(rows)
    members = C.all_users(frame)
    spec = _experiment(variants=[], end_day=1, monetization=["buy"], retention_event="click")
    days = impact.user_days(frame, members, spec)
    series = impact.daily_series(days, members, spec)
    assert by(series, "rel_day", "active_users", "engagement", "revenue") == {0: (2, 1.0, 10.0), 1: (1, 2.0, 10.0)}
    assert tuple(impact.daily_averages(series).first())[1:] == (1.5, 10.0)
    users = by(impact.user_totals(days, members, spec), "user_id", "user_daily_interactions", "user_daily_revenue")
    assert users == {"a": (1.5, 15.0), "b": (1.0, 0.0)}


def test_impact_money(make_events):
    rows = [(f"u{i:03d}", "open", at(0)) for i in range(100)] + [(f"u{i:03d}", "buy", at(1), {"revenue": 41}) for i in range(5)]
    frame = make_events(rows + [("u000", "buy", at(9), {"revenue": 1000})])
    found = _long(frame, C.all_users(frame), _experiment(variants=[], exposure=["open"], monetization=["buy"], impact=["buy", EventMatch("never")]))
    assert found[("revenue_per_user", 1)][0] == 2.05
    assert found[("revenue_conversion", 1)][0] == 0.05
    assert found[("revenue_intensity", 1)][0] == 41.0
    assert found[("buy_reach", 1)][0] == found[("buy_intensity", 1)][0] == 0.05
    assert found[("never_reach", 1)][0] == 0.0
    assert found[("engagement_daily_avg", 1)][0] is None


def test_significance_rules(core):
    members = C.build_membership(
        core, [Cohort(1, "all"), Cohort(2, "same"), Cohort(3, "clickers", [Condition("click")], join_type="first_event"), Cohort(4, "few", [Condition("click", 2)], join_type="first_event")]
    )
    small = members.where("cohort_id < 4 OR user_id < 'u010'")
    found = by(impact.significance(impact.prepare(core, small, _experiment(variants=[2, 3, 4]))), ["cohort_id", "metric_key"], "test", "p_value", "skip_reason")
    assert found[(2, "usage_rate")] == ("z_test", None, "no_difference")
    assert found[(2, "engagement")] == ("mwu", None, "no_difference")
    assert found[(4, "engagement")][2] == found[(4, "exposure_rate")][2] == "low_sample"
    assert found[(4, "ctr")][2] == "low_sample"
    assert found[(3, "engagement")][1] < 0.001
    assert {key for _, key in found} == {"exposure_rate", "usage_rate", "reuse_rate", "ctr", "engagement", "engagement_daily_avg", "time_to_first_interaction"}
    nobody = by(impact.significance(impact.prepare(core, small, _experiment(variants=[3], interaction=["never"]))), "metric_key", "skip_reason")
    assert nobody["time_to_first_interaction"] == "insufficient_data"
    assert nobody["reuse_rate"] == "insufficient_data"


def test_every_metric_has_its_test(study, groups):
    spec = _experiment(exposure=["signup"], interaction=["click"], impact=["open"], monetization=["buy"])
    base = impact.prepare(study, groups, spec)
    tests = by(impact.significance(base), "metric_key", "test")
    for key, test in tests.items():
        plain = key.removeprefix("open_") if key.startswith("open_") else key
        assert impact.TEST_BY_METRIC[plain] == test
    assert set(tests) == {r.metric_key for r in impact.metrics_long(base).collect()}


def test_variants_are_ordered_by_delta(spark):
    rows = spark.createDataFrame([(1, "m", 1.0, None), (2, "m", 2.0, 1.0), (3, "m", 4.0, 3.0), (4, "m", None, None)], "cohort_id int, metric_key string, value double, delta double")
    assert [r.cohort_id for r in impact.rank_variants(rows, "m", 1).collect()] == [3, 2, 4]


def test_experiment_checks():
    with pytest.raises(SpecError):
        _experiment(start_day=3, end_day=2)
    with pytest.raises(SpecError):
        _experiment(variants=[1])


def test_impact_of_hot_users_is_the_same(study, groups, salted):
    spec = _experiment(exposure=["open"], impact=["signup"], monetization=["buy"])

    def results():
        base = impact.prepare(study, groups, spec)
        return rows_of(base.times), rows_of(impact.metrics_long(base))

    plain = results()
    with salted():
        assert results() == plain


def test_sample_is_repeatable(study, groups):
    values = groups.select("cohort_id", "user_id")
    first = rows_of(impact.sample_users(values, 5))
    assert first == rows_of(impact.sample_users(values.repartition(7), 5))
    assert len([r for r in first if r[0] == 1]) == 5
    assert len(rows_of(impact.sample_users(values, 1000))) == values.count()


def test_a_cohort_is_not_compared_with_itself(spark):
    values = spark.createDataFrame([], "cohort_id int, user_id string, value double")
    with pytest.raises(SpecError):
        compare.compare_cohorts(values, "retention", 1, 1)
