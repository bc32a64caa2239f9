"""The bucketed canonical table: read back whole, and read by the analyses without moving events."""

from __future__ import annotations

import uuid

import pytest
from conftest import at

from strideline.operators import canonical, cohorts, flow, paths, retention, vectors
from strideline.plans.base import COHORTS, events
from strideline.specs import PathStep

STEPS = [PathStep.of("view"), PathStep.of("click")]


@pytest.fixture(scope="module")
def no_broadcast(spark):
    """Small tables would be broadcast, which hides how large ones are joined."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def name():
    return f"canonical_test_{uuid.uuid4().hex}"


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_analyses_read_buckets_in_place(spark, sf_dir, tmp_path, no_broadcast):
    plain = events(spark, sf_dir)
    store = canonical.load(spark, canonical.save(plain, name(), str(tmp_path / "e"), buckets=5).table)
    assert (store.buckets, store.has_hot) == (5, False)
    rows, hot = store.events(), store.hot()
    assert collected(rows) == collected(plain)

    members = cohorts.build_membership(rows, COHORTS, hot=hot)
    stored = store.save_members(members, name(), str(tmp_path / "m"))
    until = vectors.observed_until(rows)
    for made in (
        members,
        cohorts.activity(rows, stored, hot),
        retention.retention_table(rows, stored, until, 7, hot=hot),
        paths.path_trails(rows, stored, STEPS, hot=hot),
        flow.transitions(rows, flow.flow_root(rows, stored, "view", hot=hot), 1, hot=hot),
    ):
        assert canonical.moves_events(made) == []

    # The same from plain files moves them, and gives the same rows.
    before = cohorts.build_membership(plain, COHORTS)
    assert canonical.moves_events(before) and canonical.moves_events(cohorts.activity(plain, before))
    assert collected(before) == collected(stored)
    assert collected(retention.retention_table(plain, before, until, 7)) == collected(retention.retention_table(rows, stored, until, 7, hot=hot))


def test_a_hot_user_makes_plain_files(spark, make_events, tmp_path):
    rows = make_events([("hot", "a", at(0, minutes=i)) for i in range(200)] + [(f"u{i}", "a", at(1)) for i in range(5)] + [(None, "a", at(2))])
    store = canonical.load(spark, canonical.save(rows, name(), str(tmp_path / "e"), buckets=4, hot_rows=100).table)
    assert store.has_hot and collected(store.events()) == collected(rows)
    sizes = [r["count"] for r in store.events().selectExpr("_metadata.file_path AS f").groupBy("f").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 100
    members = cohorts.build_membership(store.events(), COHORTS[:1], hot=store.hot())
    assert collected(store.save_members(members, name(), str(tmp_path / "m"))) == collected(members)


def test_saving_again_replaces(spark, make_events, tmp_path):
    table = name()
    canonical.save(make_events([("u", "a", at(0))]), table, str(tmp_path / "e"))
    store = canonical.save(make_events([("v", "b", at(1)), ("w", "b", at(1))]), table, str(tmp_path / "e"))
    assert sorted(r["user_id"] for r in store.events().collect()) == ["v", "w"] and store.buckets == 1


def test_of_nothing_and_of_other_tables(spark, make_events, tmp_path):
    store = canonical.save(make_events([]), name(), str(tmp_path / "e"))
    assert store.events().collect() == []
    other = name()
    make_events([("u", "a", at(0))]).write.option("path", str(tmp_path / "o")).saveAsTable(other)
    with pytest.raises(ValueError, match="no canonical table"):
        canonical.load(spark, other)
