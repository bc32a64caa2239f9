from __future__ import annotations

import pytest
from conftest import at, by, rows_of
from pyspark.sql import functions as F

from strideline.operators import cohorts as C
from strideline.operators import splits
from strideline.specs import Cohort, Condition, Filter, SpecError


def membership(rows, *conditions, **options):
    return {r.user_id: r.join_time for r in C.build_membership(rows, [Cohort(1, "c", conditions, **options)]).collect()}


@pytest.fixture(scope="module")
def basics(make_events):
    return make_events(
        [
            ("u1", "purchase", at(0), {"channel": "ads"}),
            ("u1", "purchase", at(2), {"channel": "web"}),
            ("u2", "purchase", at(1), {"channel": "web"}),
            ("u3", "signup", at(0), {"channel": "ads"}),
            ("u3", "purchase", at(3), {"channel": "ads"}),
        ],
        channel="string",
    )


def test_frequency(basics):
    assert membership(basics, Condition("purchase")) == {"u1": at(0), "u2": at(1), "u3": at(3)}
    assert membership(basics, Condition("purchase", 2)) == {"u1": at(2)}


def test_counts_accumulate_within_rows(make_events):
    rows = make_events([("u1", "purchase", at(0), {"count": 5}), ("u2", "purchase", at(0)), ("u2", "purchase", at(1))])
    assert membership(rows, Condition("purchase", 2)) == {"u1": at(0), "u2": at(1)}


def test_property_conditions(basics):
    assert membership(basics, Condition("purchase", 1, Filter("channel", "=", "web"))) == {"u1": at(2), "u2": at(1)}
    assert membership(basics, Condition("purchase", 1, Filter("event_time", "AFTER", {"date": "2024-01-03"}))) == {"u1": at(2), "u3": at(3)}


def test_negation(basics):
    assert membership(basics, Condition("signup", negated=True)) == {"u1": at(0), "u2": at(1)}
    assert membership(basics, Condition("purchase"), Condition("signup", negated=True), logic="AND") == {"u1": at(0), "u2": at(1)}
    no_web = Condition("purchase", 1, Filter("channel", "=", "web"), negated=True)
    assert membership(basics, no_web) == {"u3": at(0)}
    assert membership(basics, Condition("purchase", 2, negated=True)) == {"u2": at(1), "u3": at(0)}


def test_logic_and_join_types(basics):
    pair = (Condition("signup"), Condition("purchase"))
    assert membership(basics, *pair, logic="AND") == {"u3": at(0)}
    assert membership(basics, *pair, logic="AND", all_met=True) == {"u3": at(3)}
    assert membership(basics, *pair, logic="OR") == {"u1": at(0), "u2": at(1), "u3": at(0)}
    assert membership(basics, Condition("purchase", 2), join_type="first_event") == {"u1": at(0)}
    assert membership(basics) == {"u1": at(0), "u2": at(1), "u3": at(0)}


def test_one_row_per_user_when_all_conditions_match(basics):
    rows = C.build_membership(basics, [Cohort(1, "c", [Condition("purchase")] * 5)]).collect()
    assert len(rows) == len({r.user_id for r in rows}) == 3


def test_batch_equals_single_and_skips_hidden(basics):
    specs = [
        Cohort(1, "all"),
        Cohort(2, "two", [Condition("purchase", 2)]),
        Cohort(3, "not two", [Condition("purchase", 2, negated=True)]),
        Cohort(4, "secret", [Condition("purchase")], hidden=True),
    ]
    batch = rows_of(C.build_membership(basics, specs))
    single = sorted(r for s in specs[:3] for r in rows_of(C.build_membership(basics, [s])))
    assert sorted(batch) == single
    assert {r[0] for r in rows_of(C.build_membership(basics, specs, include_hidden=True))} == {1, 2, 3, 4}


def test_large_counts_take_the_narrowing_route(make_events, monkeypatch):
    moments = [("u%d" % (i % 7), "x" if i % 3 else "y", at(i % 5, i % 24, seconds=(i * 37) % 600 / 10), {"count": 1 + i % 2}) for i in range(400)]
    rows = make_events(moments)
    conditions = [Condition("x", n) for n in (2, 17, 30, 60)] + [Condition("y", 5)]
    specs = [Cohort(i, str(i), [c]) for i, c in enumerate(conditions)]
    ranked = rows_of(C.build_membership(rows, specs))
    monkeypatch.setattr(C, "GROUP_LIMIT", 4)
    assert rows_of(C.build_membership(rows, specs)) == ranked
    assert len(ranked) > 10


def test_activity_and_flags(spark, basics):
    specs = [Cohort(1, "two", [Condition("purchase", 2)]), Cohort(2, "nobody", [Condition("refund")])]
    members = C.build_membership(basics, specs)
    linked = C.activity(basics, members)
    assert rows_of(linked, "cohort_id", "user_id", "event_time") == [(1, "u1", at(2))]
    frame = C.cohort_frame(spark, specs)
    assert by(C.active_flags(frame, linked), "cohort_id", "is_active") == {1: True, 2: False}
    assert by(C.list_cohorts(frame, members), "cohort_id", "size") == {1: 1, 2: 0}


def test_estimate_and_missing(basics):
    assert tuple(C.estimate_size(basics, Cohort(9, "x", [Condition("signup")])).first()) == (1, 3, pytest.approx(100 / 3))
    saved = Cohort(9, "x", [Condition("signup"), Condition("ghost", 1, Filter("plan", "=", "a"))])
    assert rows_of(C.missing_names(basics, saved)) == [("event", "ghost"), ("property", "plan")]


def test_activity_of_hot_users_is_the_same(make_events, salted):
    rows = make_events([("u%d" % (i * i % 4), "e", at(i % 9, i % 5)) for i in range(60)])
    members = C.all_users(rows)
    plain = rows_of(C.activity(rows, members), "user_id", "row_id", "join_time")
    with salted():
        assert rows_of(C.activity(rows, members), "user_id", "row_id", "join_time") == plain


def test_spec_limits():
    with pytest.raises(SpecError):
        Cohort(1, "x", [Condition("a")] * 6)
    with pytest.raises(SpecError):
        Condition("a", 0)
    with pytest.raises(SpecError):
        Cohort(1, "x", logic="XOR")


@pytest.fixture(scope="module")
def countries(make_events):
    names = ["US"] * 10 + ["India"] * 5 + ["UK"] * 5
    return make_events([(f"u{i:02d}", "open", at(0, minutes=i), {"country": c}) for i, c in enumerate(names)], country="string")


def sizes(children, label):
    return {r[label]: r["size"] for r in splits.split_preview(children, label).collect()}


def test_property_split(countries):
    members = C.all_users(countries)
    assert sizes(splits.property_split(members, countries, "country", ["US", "India"]), "split_value") == {"US": 10, "India": 5, "_other": 5}
    assert sizes(splits.property_split(members, countries, "country", ["US", "India", "UK"]), "split_value") == {"US": 10, "India": 5, "UK": 5}
    kept = splits.property_split(members, countries, "country", ["US"]).select("user_id", "join_time")
    assert rows_of(kept) == rows_of(members, "user_id", "join_time")


def test_random_split_is_balanced_and_repeatable(countries):
    members = C.all_users(countries)
    for groups in (2, 3, 4, 7):
        children = splits.random_split(members, groups, "seed")
        expected = [0] * groups
        for rank in range(20):
            expected[rank * groups // 20] += 1
        assert sizes(children, "group_index") == dict(enumerate(expected))
    again = splits.random_split(members.orderBy(F.rand()), 3, "seed")
    assert rows_of(again) == rows_of(splits.random_split(members, 3, "seed"))
    assert rows_of(again, "user_id", "group_index") != rows_of(splits.random_split(members, 3, "other"), "user_id", "group_index")


def test_random_split_needs_eight_users(make_events):
    rows = make_events([(f"u{i}", "e", at(0)) for i in range(7)])
    assert splits.random_split(C.all_users(rows), 2, "s").count() == 0
    with pytest.raises(SpecError):
        splits.random_split(C.all_users(rows), 1, "s")


def test_hash_split_covers_everybody(make_events):
    rows = make_events([(f"u{i:03d}", "e", at(0)) for i in range(400)])
    members = C.all_users(rows)
    groups = sizes(splits.hash_split(members, 4, "s"), "group_index")
    assert set(groups) == {0, 1, 2, 3} and sum(groups.values()) == 400
    assert all(60 < n < 140 for n in groups.values())
