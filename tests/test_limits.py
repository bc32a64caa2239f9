"""What used to be cut off: values beyond a hundred, short curves, small groups, unreadable times."""

from __future__ import annotations

from datetime import datetime

import pytest
from conftest import at

from strideline.operators import events as E
from strideline.operators import ltv, paths, scope
from strideline.specs import PathStep, SpecError


def test_all_values_can_be_listed(make_events):
    rows = make_events([("u", f"e{i:03}", at(0), {"k": f"v{i}"}) for i in range(150)] + [("u", "e000", at(1), {"k": f"w{i}"}) for i in range(40)], k="string")
    for found in (scope.column_values, scope.distinct_values):
        assert len(found(rows, "event_name").collect()) == 100 and len(found(rows, "event_name", limit=None).collect()) == 150
        assert len(found(rows, "event_name", limit=120).collect()) == 120
        with pytest.raises(SpecError):
            found(rows, "event_name", limit=0)
    assert len(scope.event_property_values(rows, "e000", "k").collect()) == 25
    assert len(scope.event_property_values(rows, "e000", "k", limit=None).collect()) == 41


def test_short_curves_are_reported(spark):
    curves = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (1, 4, 5.0), (2, 1, 2.0), (3, 1, None), (3, 2, float("nan"))], "cohort_id int, bucket int, v double")
    fitted = {r["cohort_id"]: r for r in ltv.fit_power_law(curves, "v").collect()}
    report = {r["cohort_id"]: r for r in ltv.fit_report(curves, "v").collect()}
    assert set(fitted) == {1} and {k: (r["points"], r["fitted"]) for k, r in report.items()} == {1: (3, True), 2: (1, False), 3: (0, False)}
    assert report[1]["a"] == fitted[1]["a"] and report[2]["a"] is None and report[3]["last_day"] is None


def test_small_groups_show_percentiles_on_request(make_events):
    rows = make_events([("a", "x", at(0)), ("a", "y", at(0, minutes=1)), ("b", "x", at(0)), ("b", "y", at(0, minutes=3))])
    members = rows.selectExpr("1 AS cohort_id", "user_id", "timestamp_ntz '2024-01-01' AS join_time").distinct()
    steps = [PathStep.of("x"), PathStep.of("y")]
    trails = paths.path_trails(rows, members, steps)
    second = lambda frame: next(r for r in frame.collect() if r["step"] == 2)
    assert second(paths.path_conversion(trails, members, steps))["p80_seconds"] is None
    shown = second(paths.path_conversion(trails, members, steps, percentile_floor=1))
    assert (shown["p20_seconds"], shown["p80_seconds"]) == (84.0, 156.0)


def test_more_than_three_cohorts_can_be_compared(spark):
    rows = [(c, 1, 100 - c, float(20 * c)) for c in range(1, 6)]
    conversion = spark.createDataFrame(rows, "cohort_id int, step int, size long, conversion_pct double")
    assert paths.cohort_gaps(conversion).count() == 3
    assert paths.cohort_gaps(conversion, compared=None).count() == 10


def test_times_left_out_are_counted(spark):
    raw = spark.createDataFrame([("u", "e", t, i) for i, t in enumerate(["2024-01-01", " ", None, "soon", "2024-13-01", "2024-02-01 10"])], "u string, e string, t string, row_id long")
    mapping = E.ColumnMapping("u", "e", "t")
    report = E.time_report(raw, mapping, datetime(2024, 1, 15)).first().asDict()
    assert report == {"rows": 6, "empty_times": 2, "unreadable_times": 2, "future_times": 1}
    kept = E.map_events(raw.where("row_id NOT IN (1, 2)"), mapping, now=datetime(2024, 1, 15)).count()
    assert kept == 6 - sum(report[k] for k in ("empty_times", "unreadable_times", "future_times"))
