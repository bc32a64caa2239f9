from __future__ import annotations

from datetime import datetime

import pytest
from conftest import at, by, rows_of
from pyspark.sql import functions as F

from strideline.functions.predicates import text_predicate
from strideline.functions.stats import student_two_sided, two_proportion_p, wilson_bounds
from strideline.functions.times import bucket_index
from strideline.operators import cohorts as C
from strideline.operators import ltv, monetization, retention, usage, vectors
from strideline.operators.revenue import modified_revenue
from strideline.specs import Cohort, Condition, Filter, RevenueRule

LATE = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def four(make_events):
    """Four users signed up on day 0; one is back on day 1, another on day 2."""
    rows = [(f"u{i}", "signup", at(0, i)) for i in range(4)]
    rows += [("u0", "open", at(0, 5)), ("u1", "open", at(1, 2)), ("u2", "open", at(2, 3)), ("u0", "open", at(0, 6))]
    return make_events(rows)


def test_classic_and_ever_after(four):
    members = C.all_users(four)
    classic = retention.retention_table(four, members, LATE, 3)
    assert by(classic, "bucket", "size", "active", "retention") == {0: (4, 4, 100.0), 1: (4, 1, 25.0), 2: (4, 1, 25.0), 3: (4, 0, 0.0)}
    ever = retention.retention_table(four, members, LATE, 3, kind="ever_after")
    assert by(ever, "bucket", "retention") == {0: 100.0, 1: 50.0, 2: 25.0, 3: 0.0}
    opens = retention.retention_table(four, members, LATE, 3, event="open")
    assert by(opens, "bucket", "active") == {0: 1, 1: 1, 2: 1, 3: 0}


def test_days_are_windows_from_joining(make_events):
    rows = make_events([("u", "e", at(0, 23, 50)), ("u", "e", at(1, 0, 10))])
    table = retention.retention_table(rows, C.all_users(rows), at(1, 0, 10), 1)
    assert by(table, "bucket", "eligible", "active", "retention") == {0: (1, 1, 100.0), 1: (0, 0, None)}


def test_buckets_count_crossed_seconds(spark):
    pair = spark.createDataFrame([(at(0, seconds=0.9), at(1, seconds=0.1)), (at(0), at(0, 23, 59, 59.9))], "j timestamp_ntz, e timestamp_ntz")
    assert [r[0] for r in pair.select(bucket_index(F.col("j"), F.col("e"))).collect()] == [1, 0]


def test_hourly(make_events):
    rows = make_events([("u", "e", at(0, h, 1)) for h in range(4)] + [("v", "e", at(0, h, 2)) for h in range(4)])
    table = retention.retention_table(rows, C.all_users(rows), LATE, 1, unit="hour")
    values = by(table, "bucket", "retention")
    assert len(values) == 25
    assert [values[h] for h in range(5)] == [100.0, 100.0, 100.0, 100.0, 0.0]


def test_vectors_are_dense_and_agree_with_tables(four):
    members = C.all_users(four)
    for kind in ("classic", "ever_after"):
        vector = vectors.retention_vector(four, members, at(2, 2), 3, kind=kind)
        cells = rows_of(vector, "user_id", "bucket")
        assert len(cells) == len(set(cells)) == 4 * 4
        table = retention.retention_table(four, members, at(2, 2), 3, kind=kind)
        sums = by(vector.groupBy("bucket").agg(F.sum("value").alias("a"), F.sum("is_eligible").alias("e")), "bucket", "a", "e")
        assert sums == by(table, "bucket", "active", "eligible")


def test_horizon(four):
    members = C.all_users(four)
    assert retention.useful_horizon(retention.retention_table(four, members, LATE, 5)).first()[0] == 2
    assert retention.useful_horizon(retention.retention_table(four, members, LATE, 2)).first()[0] == 2
    assert retention.useful_horizon(retention.retention_table(four, members, LATE, 3, event="never")).first()[0] == 1


def test_sparse_counts(four):
    members = C.all_users(four)
    assert by(retention.ever_after_counts(four, members, 1), "bucket", "active_users") == {0: 4, 1: 2}
    assert by(retention.eligibility_counts(members, at(1, 1), 3), "bucket", "eligible_users") == {0: 4, 1: 2}


@pytest.mark.parametrize("x,n,expected", [(400, 1000, (0.3701, 0.4307)), (0, 100, (0.0, 0.0370)), (0, 0, (None, None)), (5, 5, (0.5655, 1.0))])
def test_wilson(spark, x, n, expected):
    row = spark.createDataFrame([(x, n)], "x long, n long").select(*wilson_bounds(F.col("x"), F.col("n"))).first()
    assert tuple(row) == tuple(v if v is None else pytest.approx(v, abs=1e-4) for v in expected)


def test_wilson_widens_with_confidence(spark):
    frame = spark.createDataFrame([(40, 100)], "x long, n long")
    widths = []
    for level in (0.90, 0.95, 0.99):
        low, high = frame.select(*wilson_bounds(F.col("x"), F.col("n"), level)).first()
        widths.append(high - low)
    assert widths == sorted(widths)


def test_observation_end_is_capped(make_events):
    rows = make_events([("u", "e", at(d)) for d in range(3)] + [("u", "e", datetime(2037, 1, 1))])
    now = datetime(2024, 6, 1, 12, 0, 0, 5)
    assert vectors.observed_until(rows, now) == datetime(2024, 6, 1, 12)
    assert vectors.observation_end(rows, now).first()[0] == datetime(2024, 6, 1, 12)
    assert datetime(2024, 6, 1) < vectors.observed_until(rows) < datetime(2037, 1, 1)
    assert datetime(2024, 6, 1) < vectors.observation_end(rows).first()[0] < datetime(2037, 1, 1)
    assert vectors.observation_end(rows.where("false")).where("observation_end is not null").count() == 0
    assert vectors.observed_until(rows.where("false")) is None


@pytest.fixture(scope="module")
def clicks(make_events):
    rows = [("a", "open", at(0)), ("b", "open", at(0)), ("c", "open", at(0))]
    rows += [("a", "click", at(0, 1), {"k": 1}), ("a", "click", at(0, 2), {"k": 2, "count": 3}), ("b", "click", at(1, 1), {"k": 1})]
    rows += [("a", "click", at(1, 2), {"k": 1}), ("c", "open", at(2, 1))]
    return make_events(rows, k="int")


def test_usage(clicks):
    members = C.all_users(clicks)
    table = usage.usage_table(clicks, members, LATE, 2, "click")
    assert by(table, "bucket", "volume", "users", "adopted", "retained") == {0: (4.0, 1, 1, 3), 1: (2.0, 2, 2, 2), 2: (0.0, 0, 2, 1)}
    derived = by(usage.derived_volume(table), "bucket", "cumulative_count", "per_installed_user", "cumulative_per_installed_user", "per_event_firer", "per_active_user")
    assert derived[1] == (6.0, pytest.approx(2 / 3), 2.0, 1.0, 1.0)
    assert derived[2] == (6.0, 0.0, 2.0, 0.0, 0.0)
    shares = by(usage.derived_users(table), "bucket", "count", "percent", "adoption_count", "adoption_percent")
    assert shares[1] == (2, pytest.approx(200 / 3), 2, pytest.approx(200 / 3))
    assert by(usage.usage_by_day(clicks, members, LATE, 2, "click"), "bucket", "volume", "users") == {0: (4.0, 1), 1: (2.0, 2), 2: (0.0, 0)}
    assert by(usage.adoption_by_day(clicks, members, LATE, 2, "click"), "bucket", "adopted") == {0: 1, 1: 2, 2: 2}
    assert by(usage.retained_by_day(clicks, members, LATE, 2, "click"), "bucket", "retained") == {0: 1, 1: 2, 2: 0}


def test_usage_property_filter_keeps_only_matching_rows(clicks):
    members = C.all_users(clicks)
    only = text_predicate(Filter("k", "=", ["1"]))
    assert by(usage.usage_by_day(clicks, members, LATE, 1, "click", only), "bucket", "volume") == {0: 1.0, 1: 2.0}
    vector = vectors.usage_vector(clicks, members, LATE, 1, "click", where=only)
    assert by(vector, ["user_id", "bucket"], "value") == {("a", 0): 1.0, ("a", 1): 1.0, ("b", 0): 0.0, ("b", 1): 1.0, ("c", 0): 0.0, ("c", 1): 0.0}


def test_usage_frequency(make_events):
    rows = make_events(
        [("a", "open", at(0))] + [(u, "signup", at(1)) for u in "abcd"] + [("b", "open", at(2))] + [("c", "open", at(2, i)) for i in range(5)]
    )
    members = C.build_membership(rows, [Cohort(1, "s", [Condition("signup")])])
    found = by(usage.usage_frequency(rows, members, "open"), "frequency", "users", "share")
    assert found == {"0": (2, 0.5), "1": (1, 0.25), "2-5": (1, 0.25), "6-10": (0, 0.0), "11-20": (0, 0.0), "20+": (0, 0.0)}


@pytest.fixture(scope="module")
def sales(make_events):
    rows = [("a", "open", at(0), {"region": "EU"}), ("a", "buy", at(0, 1), {"revenue": 5.5, "region": "US"}), ("b", "buy", at(0), {"revenue": 5.0, "region": "US"})]
    rows += [("b", "buy", at(1, 1), {"revenue": 5.0, "region": "EU"}), ("b", "refund", at(1, 2), {"revenue": -2.25, "region": "US"})]
    return make_events(rows, region="string")


def test_monetization(sales):
    rules = [RevenueRule("buy"), RevenueRule("refund")]
    priced = modified_revenue(sales, rules)
    members = C.all_users(sales)
    table = monetization.monetization_table(priced, members, LATE, 2)
    assert by(table, "bucket", "revenue", "event_count", "retained") == {0: (10.5, 3.0, 2), 1: (2.75, 2.0, 1), 2: (0.0, 0.0, 0)}
    assert by(monetization.revenue_table(priced, members, LATE, 1), "bucket", "revenue") == {0: 10.5, 1: 2.75}
    derived = by(monetization.derived_revenue(table), "bucket", "cumulative_revenue", "revenue_per_acquired_user", "cumulative_revenue_per_acquired_user", "revenue_per_retained_user")
    assert derived == {0: (10.5, 5.25, 5.25, 5.25), 1: (13.25, 1.375, 6.625, 2.75), 2: (13.25, 0.0, 6.625, 0.0)}
    calendar = monetization.calendar_day_revenue(priced, members, [RevenueRule("buy"), RevenueRule("refund", False)], 5)
    assert by(calendar, "day_number", "revenue", "event_volume") == {0: (10.5, 2.0), 1: (5.0, 1.0)}


def test_equal_purchases_all_count(make_events):
    rows = make_events([("a", "buy", at(0, i), {"revenue": 5.0}) for i in range(3)])
    vector = vectors.revenue_vector(rows, C.all_users(rows), LATE, 0)
    assert by(vector, "bucket", "value", "event_count") == {0: (15.0, 3.0)}


def _power_fit(days, values):
    """The search in plain Python."""
    low, high, best = 0.01, 1.5, None
    for _ in range(7):
        for i in range(64):
            b = low + (high - low) * (i / 63)
            basis = [d**b if d > 0 else 0.0 for d in days]
            a = max(0.0, sum(v * p for v, p in zip(values, basis)) / sum(p * p for p in basis))
            sse = sum((v - a * p) ** 2 for v, p in zip(values, basis))
            if best is None or sse < best[0]:
                best = (sse, b, a)
        margin = (high - low) / 4
        low, high = (min(1.5, max(0.01, best[1] + s * margin)) for s in (-1, 1))
    return best


def test_power_law(spark):
    exact = [(1, d, 3.0 * d**0.7 if d else 0.0) for d in range(12)]
    noisy = [(2, d, 10 + 2.5 * d + (-1) ** d) for d in range(9)]
    curves = spark.createDataFrame(exact + noisy + [(3, 0, 1.0)], "cohort_id int, bucket int, y double")
    fits = by(ltv.fit_power_law(curves, "y"), "cohort_id", "a", "b", "residual_variance", "points", "last_day")
    assert set(fits) == {1, 2}
    assert fits[1][:3] == (pytest.approx(3.0, rel=1e-2), pytest.approx(0.7, abs=1e-2), pytest.approx(0.0, abs=1e-2))
    sse, b, a = _power_fit([d for _, d, _ in noisy], [v for *_, v in noisy])
    assert fits[2] == (pytest.approx(a), pytest.approx(b), pytest.approx(sse / 7), 9, 8)
    projected = by(ltv.project(ltv.fit_power_law(curves, "y"), 10).where("cohort_id = 2"), "day", "projected", "lower", "upper")
    assert set(projected) == {9, 10}
    band = 1.96 * (sse / 7) ** 0.5 * 1.2**0.5
    assert projected[10] == (pytest.approx(a * 10**b), pytest.approx(a * 10**b - band), pytest.approx(a * 10**b + band))
    common = by(ltv.project(ltv.fit_power_law(curves, "y"), 12, last_day=11).where("cohort_id = 2"), "day", "projected", "upper")
    band = 1.96 * (sse / 7) ** 0.5 * 1.1**0.5
    assert common == {12: (pytest.approx(a * 12**b), pytest.approx(a * 12**b + band))}
    tuned = by(ltv.reproject(ltv.fit_power_law(curves, "y"), 2.0, 9.0, 9).where("cohort_id = 2"), "day", "projected")
    assert tuned == {9: pytest.approx(2.0 * 9**1.5)}


@pytest.mark.parametrize("t,df,p", [(12.706, 1, 0.05), (2.776, 4, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (0.0, 5, 1.0), (2.0421, 30, 0.05), (2.0211, 40, 0.05), (1.9799, 120, 0.05), (2.6174, 120, 0.01), (1.9623, 1000, 0.05), (1.96, 1e6, 0.05), (1.96, 1e9, 0.05), (60.0, 1e4, 0.0), (2.5, 2.5, 0.1047)])
def test_student_tail(spark, t, df, p):
    got = spark.range(1).select(student_two_sided(F.lit(float(t)), F.lit(float(df)))).first()[0]
    assert got == pytest.approx(p, abs=2e-4 if df != 2.5 else 3e-3)


def test_degenerate_proportions(spark):
    rows = spark.createDataFrame([(0, 10, 0, 10), (10, 10, 10, 10), (1, 0, 2, 5), (12, 10, 9, 8)], "a long, b long, c long, d long")
    assert [r[0] for r in rows.select(two_proportion_p(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [1.0] * 4


def test_hot_users_do_not_change_tables(make_events, salted):
    rows = make_events([("u%d" % (i * i % 5), ("open", "click", "buy")[i % 3], at(i % 6, i % 7, i), {"revenue": i % 4}) for i in range(80)])
    members = C.build_membership(rows, [Cohort(1, "all"), Cohort(2, "b", [Condition("buy", 2)])])

    def results():
        return [
            rows_of(retention.retention_table(rows, members, at(6), 4)),
            rows_of(usage.usage_table(rows, members, at(6), 4, "click")),
            rows_of(monetization.monetization_table(rows, members, at(6), 4)),
            rows_of(usage.usage_frequency(rows, members, "click")),
        ]

    plain = results()
    with salted():
        assert results() == plain
