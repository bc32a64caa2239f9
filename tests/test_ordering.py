from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import at
from pyspark.sql import functions as F

from strideline.functions.times import micros
from strideline.operators import ordering as O


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(3)
    data = []
    for key in ("a", "b", "c"):
        for _ in range({"a": 301, "b": 50, "c": 1}[key]):
            data.append((key, rng.choice([0.0, 1.0, -2.5, rng.uniform(-1e6, 1e6), rng.expovariate(1) * 1e-3])))
    data.append(("a", None))
    return data, spark.createDataFrame(data, "key string, v double").repartition(5)


FRACTIONS = [0.0, 0.2, 0.5, 0.8, 0.999, 1.0]


@pytest.mark.parametrize("collapse", [True, False])
def test_exact_quantiles(sample, collapse):
    data, frame = sample
    groups = defaultdict(list)
    for key, v in data:
        if v is not None:
            groups[key].append(v)
    got = {(r.key, r.fraction): r.quantile for r in O.exact_quantiles(frame, ["key"], "v", FRACTIONS, collapse=collapse).collect()}
    assert len(got) == 3 * len(FRACTIONS)
    for (key, fraction), value in got.items():
        assert value == pytest.approx(np.quantile(groups[key], fraction), rel=1e-12, abs=1e-12)


def test_quantile_columns(sample):
    _, frame = sample
    named = {"low": 0.2, "mid": 0.5}
    picks = [F.percentile("v", F.lit(f)).alias(name) for name, f in named.items()]
    buffered = {r.key: (r.low, r.mid) for r in frame.where("v IS NOT NULL").groupBy("key").agg(*picks).collect()}
    located = {r.key: (r.low, r.mid) for r in O.quantile_columns(frame, ["key"], "v", named).collect()}
    assert located.keys() == buffered.keys()
    for key in buffered:
        assert located[key] == pytest.approx(buffered[key])


@pytest.mark.parametrize("count", [1, 2, 3, 250])
def test_quantile_instant(spark, count):
    rng = random.Random(count)
    times = [at(rng.randrange(40), seconds=rng.random() * 86_400) for _ in range(count)] + [None]
    frame = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    for fraction in (0.0, 0.3, 0.5, 0.999):
        value = frame.agg(F.percentile(micros(F.col("t")), F.lit(fraction))).first()[0]
        buffered = datetime(1970, 1, 1) + timedelta(microseconds=int(value))
        assert abs(O.quantile_instant(frame, "t", fraction) - buffered) <= timedelta(microseconds=1)
        lazy = O.exact_quantiles(frame.select(micros(F.col("t")).alias("us")), [], "us", [fraction], "micros", collapse=False).first().quantile
        assert abs(datetime(1970, 1, 1) + timedelta(microseconds=int(lazy)) - buffered) <= timedelta(microseconds=1)
    assert O.quantile_instant(frame.where("t IS NULL"), "t", 0.5) is None


def test_rank_sums(sample):
    data, frame = sample
    tagged = frame.withColumn("side", F.pmod(F.xxhash64("v", "key"), F.lit(3)) == 0)
    rows = [r for r in tagged.collect() if r.v is not None]
    got = {r.key: r for r in O.rank_sums(tagged, ["key"], "side", "v").collect()}
    for key in got:
        own = [(round(r.v, 6), r.side) for r in rows if r.key == key]
        values = [v for v, _ in own]
        ranks = [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]
        ties = sum(values.count(v) ** 3 - values.count(v) for v in set(values))
        assert got[key].n_a == sum(s for _, s in own)
        assert got[key].n_b == sum(not s for _, s in own)
        assert got[key].rank_sum_a == pytest.approx(sum(r for r, (_, s) in zip(ranks, own) if s))
        assert got[key].tie_term == pytest.approx(ties)


def test_levels_grow_with_the_value(spark):
    rng = random.Random(1)
    values = sorted({0.0, 1.0, 2.0, -1.0, 1e-300, -1e300, 0.1, 0.3, *[rng.gauss(0, 10 ** rng.randint(-9, 9)) for _ in range(500)]})
    coarse, fine = O._double_levels(F.col("v"))
    frame = spark.createDataFrame([(v,) for v in values], "v double").select("v", coarse.alias("c"), fine.alias("f"))
    cells = [(r.c, r.f) for r in sorted(frame.collect(), key=lambda r: r.v)]
    assert cells == sorted(cells)


@pytest.mark.parametrize("group_limit", [1_000, 5])
def test_first_per_key_and_crossing(spark, monkeypatch, group_limit):
    rng = random.Random(5)
    data = [("k%d" % (i * i % 3), at(seconds=rng.randrange(200_000), days=rng.randrange(3)), i, float(rng.randint(1, 3))) for i in range(300)]
    frame = spark.createDataFrame(data, "key string, t timestamp_ntz, id long, w double")
    monkeypatch.setattr(O, "GROUP_LIMIT", group_limit)
    first = O.first_per_key(frame, ["key"], "t", ["id"], 20).collect()
    for key in {d[0] for d in data}:
        own = sorted((d[1], d[2]) for d in data if d[0] == key)
        assert [r.id for r in sorted((r for r in first if r.key == key), key=lambda r: r._pos)] == [i for _, i in own[:20]]
    crossed = {r.key: r.t for r in O.crossing_time(frame.withColumn("need", F.lit(75.0)), ["key"], "t", "w", "need").collect()}
    for key in {d[0] for d in data}:
        total, expected = 0.0, None
        for moment, _, weight in sorted((d[1], d[2], d[3]) for d in data if d[0] == key):
            total += weight
            if total >= 75:
                expected = moment
                break
        assert crossed.get(key) == expected


def test_rank_limit_applies_before_the_shuffle(spark):
    frame = spark.range(100).selectExpr("id % 3 AS key", "id AS t")
    plan = O.first_per_key(frame, ["key"], "t", [], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3


def test_hash_ranks_are_complete_and_limited(spark):
    frame = spark.createDataFrame([("a" if i % 3 else "b", f"u{i}") for i in range(200)], "key string, user string")
    ranked = O.hash_ranked(frame, ["key"], "user", "s").collect()
    for key in "ab":
        own = sorted(r._rank for r in ranked if r.key == key)
        assert own == list(range(len(own))) and {r._total for r in ranked if r.key == key} == {len(own)}
    limited = O.hash_ranked(frame, ["key"], "user", "s", 7).collect()
    assert sorted((r.key, r.user) for r in limited) == sorted((r.key, r.user) for r in ranked if r._rank < 7)
