"""Revenue priced again by partition, and search by index against a scan."""

from __future__ import annotations

import os
import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from strideline.functions.predicates import search_predicate
from strideline.operators import revenue, revenue_store, text_index, timeline
from strideline.specs import RevenueRule, SpecError

RULES = [RevenueRule("buy"), RevenueRule("7", override=2.0)]


def files(path):
    return {os.path.join(folder, name): os.stat(os.path.join(folder, name)).st_mtime_ns for folder, _, names in os.walk(f"{path}/events") for name in names if name.endswith(".parquet")}


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture
def rows(make_events):
    names = ["buy", "7", "see", "a/b=c %", None]
    return make_events([(f"u{i % 9}", names[i % 5], at(i % 4), {"revenue": i, "count": 1 + i % 3}) for i in range(100)])


def test_only_changed_events_are_written_again(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    store = revenue_store.save(rows, RULES, path)
    assert collected(store.events()) == collected(revenue.modified_revenue(rows, RULES))
    before = files(path)
    updates = [RevenueRule("buy"), RevenueRule("7", included=False, override=2.0), RevenueRule("see", override=4.0), RevenueRule("new")]
    assert store.upsert(updates) == ["7", "new", "see"]
    after = files(path)
    same = {name for name in before if after.get(name) == before[name]}
    assert {name.split("event_name=")[1].split("/")[0] for name in same} == {"buy", "a%2Fb%3Dc %25", "__HIVE_DEFAULT_PARTITION__"}
    assert not {name for name in after if "event_name=see" in name or "event_name=7" in name} & set(before)
    assert collected(store.events()) == collected(revenue.modified_revenue(rows, updates))
    assert sorted(r["event_name"] for r in store.rules().collect()) == ["7", "buy", "new", "see"]


def test_the_same_rules_change_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    store = revenue_store.save(rows, RULES, path)
    before = files(path)
    assert store.upsert(RULES) == [] and files(path) == before
    with pytest.raises(SpecError):
        store.upsert([RevenueRule("buy"), RevenueRule("buy", override=1.0)])
    assert revenue_store.save(rows.where("false"), RULES, str(tmp_path / "none")).schema == rows.schema


@pytest.fixture(scope="module")
def words(spark):
    chance = random.Random(6)
    rows = [("".join(chance.choice("abcÄß%_\\ I1") for _ in range(chance.randrange(0, 30))), 1.0 + i % 3) for i in range(400)]
    rows += [("common value", 2.0)] * 300 + [(None, 1.0), ("", 1.0), ("x", 1.0)]
    return spark.createDataFrame(rows, "v string, w double")


def test_a_search_by_index_is_a_scan(spark, words, tmp_path):
    index = text_index.build(words, "v", str(tmp_path / "i"), "w")
    values = [r["v"] for r in words.where("length(v) > 2").limit(60).collect()]
    chance = random.Random(7)
    texts = ["", "a", "X", "%", "_", "\\", "ß", "zz", "ab", "common", "ON VAL", "no such text at all"]
    for value in values:
        begin = chance.randrange(len(value))
        texts.append(value[begin : begin + chance.randrange(1, 21)].swapcase())
    scanned = words.where("v is not null").groupBy(F.col("v").alias("value")).agg(F.sum("w").alias("frequency")).cache()
    for text in texts[:40]:
        assert collected(index.column_search(text)) == collected(scanned.where(search_predicate(F.col("value"), text) if text else F.lit(True))), text
        assert collected(index.search(text)) == collected(scanned.where(timeline.F.col("value").ilike("%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"))), text


def test_users_by_index(spark, make_events, tmp_path):
    events = make_events([(f"user{i}", "e", at(0)) for i in range(50)] + [(None, "e", at(0))])
    index = text_index.build(events, "user_id", str(tmp_path / "i"))
    for text in ("1", "R4", "user49", "x"):
        assert collected(text_index.search_users(index, text)) == collected(timeline.search_users(events, text))
    members = events.where("user_id like '%7'").selectExpr("1 AS cohort_id", "user_id")
    assert [r["user_id"] for r in text_index.search_users(index, "user", None, members, 1).collect()] == ["user17", "user27", "user37", "user47", "user7"]
    plan = text_index.search_users(index, "ser4")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "In(gram" in plan


def test_an_index_of_nothing(spark, words, tmp_path):
    index = text_index.build(words.where("false"), "v", str(tmp_path / "i"))
    assert index.search("a").collect() == [] and index.search("").collect() == []
