from __future__ import annotations

import pytest
from conftest import at, by, rows_of

from strideline.operators import cohorts as C
from strideline.operators import timeline as T
from strideline.specs import Cohort, Condition, SpecError


@pytest.fixture(scope="module")
def rows(make_events):
    return make_events(
        [
            ("alice", "open", at(0), {"plan": "free"}),
            ("alice", "buy", at(1), {"plan": "pro", "count": 2}),
            ("alice", "open", at(2), {"plan": "pro"}),
            ("alice", "view", at(2), {"plan": "max"}),
            ("Bob_1", "open", at(3), {"plan": "free"}),
        ],
        plan="string",
    )


def test_search(rows):
    assert [r[0] for r in T.search_users(rows, "B").collect()] == ["Bob_1"]
    assert [r[0] for r in T.search_users(rows, "LI").collect()] == ["alice"]
    assert [r[0] for r in T.search_users(rows, "_").collect()] == ["Bob_1"]
    members = C.build_membership(rows, [Cohort(2, "buyers", [Condition("buy")])])
    assert T.search_users(rows, "o", 5, members, 2).count() == 0
    with pytest.raises(SpecError):
        T.search_users(rows, "x", 101)


def test_summary(rows):
    found = by(T.user_summary(rows), "user_id", "first_event_time", "last_event_time", "total_events", "plan")
    assert found == {"alice": (at(0), at(2), 5, "max"), "Bob_1": (at(3), at(3), 1, "free")}
    assert T.user_summary(rows, "alice").count() == 1


def test_pages(rows):
    def page(number):
        return [(r.position, r.event_name) for r in T.timeline_page(rows, number, 3, "alice").orderBy("position").collect()]

    assert page(1) == [(1, "open"), (2, "buy"), (3, "open")]
    assert page(2) == [(4, "view")]
    assert page(3) == []
    with pytest.raises(SpecError):
        T.timeline_page(rows, 1, 201)


def test_jumps(rows):
    assert rows_of(T.jump_to(rows, at(1, 1), "alice"), "event_time", "event_name") == [(at(2), "open")]
    assert rows_of(T.next_event(rows, "open", at(0), "alice"), "event_time") == [(at(2),)]
    assert rows_of(T.next_event(rows, "open", at(2), "alice")) == []
    assert rows_of(T.previous_event(rows, "open", at(2), "alice"), "event_time") == [(at(0),)]
    assert by(T.page_of(rows, T.jump_to(rows, at(2)), 2), "user_id", "page") == {"alice": 2, "Bob_1": 1}


def test_join_tags(rows, salted):
    specs = [
        Cohort(1, "All Users"),
        Cohort(2, "buyers", [Condition("buy")]),
        Cohort(3, "viewers", [Condition("view")]),
        Cohort(4, "second open", [Condition("open", 2)]),
        Cohort(5, "secret", [Condition("open")], hidden=True),
    ]
    members = C.build_membership(rows, specs, include_hidden=True)
    expected = {("alice", "buy"): ["buyers"], ("alice", "open"): ["second open", "viewers"]}
    assert by(T.cohort_join_tags(rows, members, specs), ["user_id", "event_name"], "cohort_joins") == expected
    with salted():
        assert by(T.cohort_join_tags(rows, members, specs), ["user_id", "event_name"], "cohort_joins") == expected
