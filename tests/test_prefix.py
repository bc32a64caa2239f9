"""Running sums over ranges against plain Python, bursts included."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from conftest import at
from pyspark.sql import functions as F

from strideline.operators import cohorts, prefix, timeline
from strideline.specs import Cohort, Condition


@pytest.fixture(scope="module")
def burst(spark):
    """Most rows are one user's, within one second of one day; also null keys and null times."""
    chance = random.Random(4)
    rows = [("hot", at(5, seconds=chance.randrange(1_000) / 1_000), i, 1) for i in range(3_000)]
    rows += [(chance.choice(["a", "b", None]), at(chance.randrange(10)), 3_000 + i, chance.randrange(4)) for i in range(300)]
    rows += [("a", None, 4_000, 2)]
    return spark.createDataFrame(rows, "user_id string, event_time timestamp_ntz, row_id long, w int").repartition(3)


def in_order(rows):
    return sorted(rows, key=lambda r: (r["event_time"] is not None, r["event_time"] or at(0), r["row_id"]))


@pytest.mark.parametrize("ranges", [1, 7, 50, None])
def test_running_sums(burst, ranges):
    got = prefix.running_sum(burst, ["user_id"], ["event_time", "row_id"], F.col("w").cast("long"), ranges=ranges).collect()
    assert len(got) == burst.count() and set(got[0].asDict()) == {"user_id", "event_time", "row_id", "w", "_upto"}
    by_key = defaultdict(list)
    for r in got:
        by_key[r["user_id"]].append(r)
    for own in by_key.values():
        total = 0
        for r in in_order(own):
            total += r["w"]
            assert r["_upto"] == total


def test_a_burst_is_split_over_ranges(spark, burst):
    dealt = burst.repartitionByRange(8, "user_id", "event_time", "row_id").select("user_id", F.spark_partition_id().alias("p"))
    sizes = [r["count"] for r in dealt.groupBy("p").count().collect()]
    assert len(sizes) == 8 and max(sizes) < burst.count() / 3


def test_dense_ids(burst):
    got = prefix.dense_row_ids(burst, ["event_time", "row_id"], "number").collect()
    assert [r["row_id"] for r in sorted(got, key=lambda r: r["number"])] == [r["row_id"] for r in in_order(burst.collect())]
    assert sorted(r["number"] for r in got) == list(range(1, len(got) + 1))


def test_crossing(burst):
    counted = burst.withColumns({"one": F.lit(1).cast("long"), "need": F.lit(2_500).cast("long")})
    hot = in_order(r for r in burst.collect() if r["user_id"] == "hot")
    assert [tuple(r) for r in prefix.crossing(counted, ["user_id"], "event_time", "one", "need").collect()] == [("hot", hot[2_499]["event_time"])]


def test_deep_occurrences_and_pages(burst):
    events = burst.withColumns({"event_name": F.lit("e"), "event_count": F.lit(1.0)})
    hot = in_order(r for r in burst.collect() if r["user_id"] == "hot")
    members = cohorts.build_membership(events, [Cohort(1, "deep", [Condition("e", 2_000)])]).collect()
    assert [(r["user_id"], r["join_time"]) for r in members] == [("hot", hot[1_999]["event_time"])]
    page = timeline.timeline_page(events, 1_300, 2).collect()
    assert sorted((r["position"], r["row_id"]) for r in page) == [(2_599, hot[2_598]["row_id"]), (2_600, hot[2_599]["row_id"])]


def test_of_nothing(burst):
    assert prefix.running_sum(burst.where("false"), ["user_id"], ["event_time"]).collect() == []
    assert prefix.dense_row_ids(burst.where("false"), ["event_time"]).collect() == []
