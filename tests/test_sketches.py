"""Quantile sketches per day: merged, replaced by day, and held against exact ranks."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strideline.operators import sketches


@pytest.fixture(scope="module")
def values(spark):
    chance = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", date(2024, 1, 1 + i % 9), int(chance.lognormvariate(8, 2))) for i in range(20_000)]
    rows += [(None, date(2024, 1, 2), 5), ("k1", None, 7), ("none", date(2024, 1, 3), None)]
    return spark.createDataFrame(rows, "k string, at date, v long")


def test_merged_sketches_stay_within_the_bound(spark, values, tmp_path):
    path = str(tmp_path / "s")
    sketches.save(sketches.sketch_by_day(values, ["k"], "at", "v").repartition(5), path)
    named = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    found = {r["k"]: r for r in sketches.quantiles(sketches.merged(sketches.load(spark, path), ["k"]), ["k"], named).collect()}
    held = {}
    for r in values.collect():
        if r["v"] is not None:
            held.setdefault(r["k"], []).append(r["v"])
    assert set(found) == set(held)
    for key, own in held.items():
        assert found[key]["n"] == len(own)
        for name, f in named.items():
            low, high = sum(v < found[key][name] for v in own) / len(own), sum(v <= found[key][name] for v in own) / len(own)
            assert max(0, low - f, f - high) <= 2 * sketches.rank_error()


def test_a_day_saved_again_is_replaced(spark, values, tmp_path):
    path = str(tmp_path / "s")
    sketches.save(sketches.sketch_by_day(values, ["k"], "at", "v"), path)
    before = {r["day"]: r["n"] for r in sketches.load(spark, path).groupBy("day").agg(F.sum("n").alias("n")).collect()}
    again = values.where("at = '2024-01-04'").unionAll(spark.createDataFrame([("late", date(2024, 1, 4), 1)], "k string, at date, v long"))
    sketches.save(sketches.sketch_by_day(again, ["k"], "at", "v"), path)
    after = {r["day"]: r["n"] for r in sketches.load(spark, path).groupBy("day").agg(F.sum("n").alias("n")).collect()}
    assert after == {**before, date(2024, 1, 4): before[date(2024, 1, 4)] + 1}


def test_few_values_are_exact(spark):
    rows = spark.createDataFrame([("a", date(2024, 1, 1 + i % 3), i) for i in range(1, 101)], "k string, at date, v long")
    found = sketches.quantiles(sketches.merged(sketches.sketch_by_day(rows, ["k"], "at", "v"), ["k"]), ["k"], {"p50": 0.5, "all": 1.0}).first()
    assert (found["n"], found["p50"], found["all"]) == (100, 50, 100)


def test_observed_end_finds_the_exact_day(spark):
    start = datetime(2024, 1, 1)
    times = [start + timedelta(minutes=7 * i) for i in range(5_000)] + [start + timedelta(days=90)] * 3
    rows = spark.createDataFrame([(t,) for t in times] + [(None,)], "event_time timestamp_ntz")
    by_day = sketches.time_sketches(rows)
    for fraction in (0.0, 0.2, 0.5, 0.999, 1.0):
        found = sketches.observed_end(by_day, fraction).first()
        exact = sorted(times)[int(fraction * (len(times) - 1))]
        assert found["n"] == len(times) and found["day"] == exact.date()
        assert abs((found["instant"] - exact).total_seconds()) <= 86_400 * 4 * sketches.rank_error() + 420
    assert sketches.observed_end(sketches.time_sketches(rows.where("false")), 0.5).collect() == []


def test_a_bad_estimate_is_out_of_bounds(spark):
    one = spark.range(1).select(sketches.within(0.5, F.lit(0.4), F.lit(0.49), 0.005).alias("bad"), sketches.within(0.5, F.lit(0.4), F.lit(0.6), 0.0).alias("good")).first()
    assert (one["bad"], one["good"]) == (False, True)
