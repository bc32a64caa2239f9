"""Cohorts derived from others: order, preconditions, and following a change of scope."""

from __future__ import annotations

import pytest
from conftest import at
from pyspark.sql import functions as F

from strideline.operators import lineage
from strideline.operators.lineage import Derived, PathWalk, PropertyValues, RandomGroups
from strideline.specs import Cohort, Condition, PathStep, SpecError

COHORTS = [Cohort(1, "All"), Cohort(2, "Buyers", [Condition("buy")]), Cohort(3, "Nobody", [Condition("never")]), Cohort(4, "Hidden", [Condition("see")], hidden=True)]
WALK = PathWalk((PathStep.of("see"), PathStep.of("buy")))
HALVES = RandomGroups(2, "s")


@pytest.fixture(scope="module")
def rows(make_events):
    out = []
    for i in range(20):
        out.append((f"u{i}", "see", at(i % 3), {"place": "a" if i % 2 else "b"}))
        if i % 4:
            out.append((f"u{i}", "buy", at(3 + i % 2), {"place": "c" if i % 4 == 1 else None}))
    return make_events(out, place="string")


def held(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["cohort_id"], {})[r["user_id"]] = r["join_time"]
    return out


def test_split_children_keep_join_times_and_share_out_the_parent(rows):
    derived = lineage.split(rows, COHORTS, [], 2, HALVES, 10)
    found = held(lineage.build_all(rows, COHORTS, derived))
    assert set(found) == {1, 2, 10, 11}
    assert found[10].keys() | found[11].keys() == found[2].keys() and not found[10].keys() & found[11].keys()
    assert abs(len(found[10]) - len(found[11])) <= 1
    assert all(found[2][u] == t for c in (10, 11) for u, t in found[c].items())


def test_children_follow_the_scope(rows):
    derived = [*lineage.split(rows, COHORTS, [], 1, PropertyValues("place", ("a", "c")), 10), Derived(20, "left", 1, WALK, ("dropped", 2)), Derived(21, "came", 1, WALK, ("reached", 2))]
    assert [d.part for d in derived[:3]] == ["a", "c", "_other"]
    everything = held(lineage.build_all(rows, COHORTS, derived))
    assert everything[20].keys() == {f"u{i}" for i in range(0, 20, 4)} and len(everything[21]) == 15
    scoped = held(lineage.build_all(rows, COHORTS, derived, F.col("place").isNotNull()))
    assert scoped[20].keys() == {f"u{i}" for i in range(20) if i % 4 != 1}
    assert scoped[21].keys() == {f"u{i}" for i in range(20) if i % 4 == 1}
    assert all(set(scoped[c]) <= set(scoped[1]) for c in (10, 11, 12, 20, 21))


def test_generations_and_hidden_parents(rows):
    split_of_left = [Derived(30 + i, "part", 20, HALVES, i) for i in range(2)]
    derived = [*split_of_left, Derived(20, "left", 4, WALK, ("dropped", 2), hidden=True)]
    assert [[d.cohort_id for d in g] for g in lineage.generations(COHORTS, derived)] == [[20], [30, 31]]
    found = held(lineage.build_all(rows, COHORTS, derived))
    assert set(found) == {1, 2, 30, 31}
    assert found[30].keys() | found[31].keys() == {f"u{i}" for i in range(0, 20, 4)}


@pytest.mark.parametrize("parent, message", [(3, "no members"), (4, "hidden"), (10, "sub-cohort"), (99, "no cohort")])
def test_parents_that_cannot_be_split(rows, parent, message):
    derived = [Derived(10, "half", 2, HALVES, 0)]
    for rule in (HALVES, PropertyValues("place", ("a",))):
        with pytest.raises(SpecError, match=message):
            lineage.split(rows, COHORTS, derived, parent, rule, 50)


def test_too_few_users(rows):
    with pytest.raises(SpecError, match="at least 8"):
        lineage.split(rows.where(F.col("user_id").isin("u1", "u2")), COHORTS, [], 1, HALVES, 10)


def test_a_new_split_replaces_the_old_one_with_what_came_from_it(rows):
    derived = lineage.split(rows, COHORTS, [], 1, HALVES, 10)
    derived += [Derived(20, "left", 10, WALK, ("dropped", 2)), Derived(21, "left", 2, WALK, ("dropped", 2))]
    again = lineage.split(rows, COHORTS, derived, 1, PropertyValues("place", ("a",)), 40)
    assert sorted(d.cohort_id for d in again) == [21, 40, 41]
    assert lineage.with_descendants([1], derived) == {1, 10, 11, 20}


def test_no_other_child_where_nobody_is_left(rows):
    parts = [d.part for d in lineage.split(rows, COHORTS, [], 1, PropertyValues("place", ("a", "b")), 10)]
    assert parts == ["a", "b"]


def test_graphs_that_make_no_sense():
    with pytest.raises(SpecError, match="no parent"):
        lineage.generations(COHORTS, [Derived(10, "x", 77, HALVES, 0)])
    with pytest.raises(SpecError, match="each other"):
        lineage.generations(COHORTS, [Derived(10, "x", 11, HALVES, 0), Derived(11, "y", 10, HALVES, 1)])
    with pytest.raises(SpecError, match="twice"):
        lineage.generations(COHORTS, [Derived(1, "x", 2, HALVES, 0)])
    for rule, part in ((HALVES, 2), (PropertyValues("p", ("a",)), "b"), (WALK, ("reached", 3))):
        with pytest.raises(SpecError, match="no part"):
            Derived(10, "x", 1, rule, part)


def test_empty_parents_give_empty_children(rows):
    derived = [Derived(10 + i, "half", 3, HALVES, i) for i in range(2)]
    assert set(held(lineage.build_all(rows, COHORTS, derived))) == {1, 2}
