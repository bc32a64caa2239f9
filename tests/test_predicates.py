from __future__ import annotations

from datetime import datetime

import pytest
from conftest import at
from pyspark.sql import functions as F

from strideline.functions import predicates as P
from strideline.specs import EventMatch, Filter, SpecError


@pytest.fixture(scope="module")
def rows(make_events):
    return make_events(
        [
            ("u1", "a", at(0), {"plan": "pro", "score": 1, "vip": True}),
            ("u2", "b", at(1, 5), {"plan": "free", "score": 5, "vip": False}),
            ("u3", "c", at(2), {"plan": None, "score": None, "vip": None}),
        ],
        plan="string",
        score="int",
        vip="boolean",
    )


def users(rows, *filters, **options):
    return sorted(r.user_id for r in rows.where(P.scope_predicate(rows.schema, filters, **options)).collect())


def test_null_never_matches(rows):
    assert users(rows, Filter("plan", "!=", "pro")) == ["u2"]
    assert users(rows, Filter("plan", "NOT IN", ["pro"])) == ["u2"]
    assert users(rows, Filter("score", "<=", 5)) == ["u1", "u2"]


def test_filters_combine_with_and(rows):
    assert users(rows, Filter("score", ">", 0), Filter("plan", "IN", ["free", "x"])) == ["u2"]


def test_date_range_includes_end_day(rows):
    assert users(rows, date_from="2024-01-02", date_to="2024-01-02") == ["u2"]
    with pytest.raises(SpecError):
        P.scope_predicate(rows.schema, date_from="2024-01-03", date_to="2024-01-02")


@pytest.mark.parametrize(
    "operator,value,expected",
    [
        ("BEFORE", {"date": "2024-01-02"}, ["u1"]),
        ("AFTER", {"date": "2024-01-02", "time": "05"}, ["u2", "u3"]),
        ("ON", {"date": "2024-01-02"}, ["u2"]),
        ("=", "2024-01-02T23:00:00Z", ["u2"]),
        ("BETWEEN", {"startDate": "2024-01-01", "endDate": "2024-01-02"}, ["u1", "u2"]),
        ("BETWEEN", {"startDate": "2024-01-01", "endDate": "2024-01-02", "endTime": "05:00"}, ["u1"]),
        ("BETWEEN", {"startDate": "2024-01-01", "endDate": "2024-01-02", "endTime": "  "}, ["u1", "u2"]),
        ("IN", ["2024-01-03", "2024-01-01 00:00:00"], ["u1", "u3"]),
        ("NOT IN", ["2024-01-03"], ["u1", "u2"]),
    ],
)
def test_timestamp_operators(rows, operator, value, expected):
    assert users(rows, Filter("event_time", operator, value)) == expected


@pytest.mark.parametrize(
    "spec",
    [
        Filter("plan", "<", "x"),
        Filter("missing", "=", 1),
        Filter("event_time", ">", "2024-01-01"),
        Filter("event_time", "BETWEEN", {"startDate": "2024-01-02", "endDate": "2024-01-01"}),
        Filter("plan", "IN", []),
        Filter("plan", "IN", [["a"]]),
        Filter("plan", "=", ["a", "b"]),
        Filter("vip", ">", True),
    ],
)
def test_bad_filters_are_rejected(rows, spec):
    with pytest.raises(SpecError):
        P.predicate(rows.schema, spec)


def test_boolean_sets(rows):
    assert users(rows, Filter("vip", "IN", [True])) == ["u1"]
    with pytest.raises(SpecError):
        P.predicate(rows.schema, Filter("vip", "IN", [True]), strict_boolean=True)


def test_one_element_list_is_a_scalar(rows):
    assert users(rows, Filter("plan", "=", ["pro"])) == ["u1"]


def test_instants_lose_zone_and_fraction():
    expected = datetime(2024, 3, 1, 10, 30)
    for text in ("2024-03-01 10:30", "2024-03-01T10:30:00Z", "2024-03-01 10:30:00+05:30", "2024-03-01 10:30:00.75", "2024-03-01 10:30 UTC"):
        assert P.parse_instant(text) == expected
    assert P.parse_instant("2024-03-01 10") == datetime(2024, 3, 1, 10)
    with pytest.raises(SpecError):
        P.parse_instant("soon")


def test_text_and_root_predicates(rows):
    assert [r.user_id for r in rows.where(P.text_predicate(Filter("score", "in", [5]))).collect()] == ["u2"]
    assert rows.where(P.root_predicate(rows.schema, Filter("score", "=", []))).count() == 3
    with pytest.raises(SpecError):
        P.text_predicate(Filter("score", ">", [5]))


def test_event_sets(rows):
    either = P.event_set(rows.schema, ["c", EventMatch("a", {"score": "1", "plan": "pro"})])
    assert sorted(r.user_id for r in rows.where(either).collect()) == ["u1", "u3"]
    with pytest.raises(SpecError):
        P.event_set(rows.schema, ["x"] * 11)
    for filters in ({"score": "many"}, {"score": None}, {"nope": 1}):
        with pytest.raises(SpecError):
            P.event_predicate(rows.schema, EventMatch("a", filters))


def test_search_is_prefix_then_substring(spark):
    names = spark.createDataFrame([("Apple",), ("Pineapple",), ("100%",), ("a_b",)], "name string")

    def found(text):
        return sorted(r.name for r in names.where(P.search_predicate(F.col("name"), text)).collect())

    assert found("ap") == ["Apple"]
    assert found("app") == ["Apple", "Pineapple"]
    assert found("0%") == []
    assert found("00%") == ["100%"]
    assert found("a_") == ["a_b"]
