from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import at, by, rows_of
from pyspark.sql import functions as F

from strideline.operators import events as E
from strideline.operators import revenue as R
from strideline.operators import scope as S
from strideline.sources.csv import read_csv_events, with_row_id
from strideline.sources.export import ResultTable, export_results
from strideline.specs import Filter, RevenueRule, SpecError, merge_rules


def test_csv_quotes_lines_and_bad_rows(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('uid,event,at\nu1,"say ""hi""",2024-01-01\nu2,"two\nlines",2024-01-02\nu3,x\nu4,y,2024-01-03,extra\n')
    loaded = read_csv_events(spark, str(path), multi_line=True)
    assert rows_of(loaded.rows) == [("u1", 'say "hi"', "2024-01-01"), ("u2", "two\nlines", "2024-01-02")]
    assert tuple(loaded.load_report().first()) == (2, 2)
    ids = [r.row_id for r in with_row_id(loaded.rows).collect()]
    assert len(set(ids)) == 2


def test_csv_needs_three_columns(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(SpecError):
        read_csv_events(spark, str(path))


def test_detect_types_order(spark):
    raw = spark.createDataFrame(
        [("true", "2024-01-01 10", "1.5", "x", " ", "2024"), ("FALSE ", "2024-02-01T10:00:00Z", "-2e3", "1", None, "1"), (None, "", "7", "true", "", "2")],
        "flag string, at string, number string, mixed string, blank string, year string",
    )
    kinds = by(E.detect_types(raw), "column_name", "kind")
    assert kinds == {"flag": "BOOLEAN", "at": "TIMESTAMP", "number": "NUMERIC", "mixed": "TEXT", "blank": "TEXT", "year": "NUMERIC"}


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2024-01-05 10:20:30", datetime(2024, 1, 5, 10, 20, 30)),
        ("2024-01-05T10:20:30Z", datetime(2024, 1, 5, 10, 20, 30)),
        ('"2024-01-05 10:20:30.250 UTC"', datetime(2024, 1, 5, 10, 20, 30, 250000)),
        ("2024-01-05 10:20:30-0800", datetime(2024, 1, 5, 10, 20, 30)),
        ("2024-01-05 10", datetime(2024, 1, 5, 10)),
        ("2024-01-05", datetime(2024, 1, 5)),
        ("yesterday", None),
        ("12", None),
        ("", None),
    ],
)
def test_timestamps(spark, text, expected):
    row = spark.range(1).select(E.normalize_timestamp(F.lit(text)).alias("t")).first()
    assert row.t == expected


def _raw(spark, rows):
    return spark.createDataFrame(rows, "uid string, event string, at string, n string, price string, plan string, row_id long")


MAPPING = E.ColumnMapping("uid", "event", "at", "n", "price", kinds={"plan": "TEXT"})


def test_mapping_casts_and_groups(spark):
    raw = _raw(
        spark,
        [
            (" u1 ", "buy", "2024-01-01T00:00:00Z", "2", "5.5", "pro", 7),
            ("u1", "buy", "2024-01-01 00:00:00", "1", "1.0", "pro", 8),
            ("", "buy", "2024-01-01", "1", None, " ", 9),
        ],
    )
    mapped = E.map_events(raw, MAPPING)
    assert mapped.columns == ["user_id", "event_name", "event_time", "plan", "event_count", "original_revenue", "modified_revenue", "row_id"]
    assert mapped.count() == 3
    grouped = E.normalize_events(mapped)
    assert rows_of(grouped) == [("u1", "buy", at(0), "pro", 3.0, 6.5, 6.5, 7)]
    assert tuple(E.dataset_totals(mapped).first()) == (4.0, 1)


def test_mapping_defaults(spark):
    raw = spark.createDataFrame([("u", "e", at(0), 1)], "uid string, event string, at timestamp_ntz, row_id long")
    row = E.map_events(raw, E.ColumnMapping("uid", "event", "at")).first()
    assert (row.event_count, row.original_revenue) == (1.0, 0.0)


@pytest.mark.parametrize("bad", ["0", "1.5", "x", None])
def test_bad_counts_are_rejected(spark, bad):
    with pytest.raises(SpecError):
        E.map_events(_raw(spark, [("u", "e", "2024-01-01", bad, "1", "p", 1)]), MAPPING)


@pytest.mark.parametrize("bad", ["", "  ", None])
def test_empty_times_are_rejected(spark, bad):
    with pytest.raises(SpecError):
        E.map_events(_raw(spark, [("u", "e", bad, "1", "1", "p", 1)]), MAPPING)


def test_future_rows_are_cut(spark):
    raw = _raw(spark, [("u", "e", "2024-01-01", "1", "1", "p", 1), ("u", "e", "2037-01-01", "1", "1", "p", 2)])
    assert E.map_events(raw, MAPPING, now=datetime(2024, 1, 1)).count() == 1
    assert E.map_events(raw, MAPPING).count() == 2


def test_wrong_roles_are_rejected(spark):
    raw = _raw(spark, [("u", "e", "2024-01-01", "1", "1", "p", 1)])
    with pytest.raises(SpecError):
        E.map_events(raw, E.ColumnMapping("uid", "event", "nope"))
    with pytest.raises(SpecError):
        E.map_events(raw, E.ColumnMapping("uid", "event", "at", kinds={"uid": "NUMERIC"}))


def test_written_table_reads_back(spark, tmp_path, make_events):
    rows = make_events([("u", "a", at(0)), ("v", "b", at(1))])
    E.write_events(rows, str(tmp_path / "events"))
    assert rows_of(spark.read.parquet(str(tmp_path / "events"))) == rows_of(rows)


def test_revenue_rules(spark, make_events):
    rows = make_events(
        [
            ("u", "buy", at(0), {"revenue": 5}),
            ("u", "renew", at(0), {"revenue": 3, "count": 2}),
            ("u", "refund", at(0), {"revenue": 4}),
            ("u", "gift", at(0), {"revenue": 4, "count": 2}),
            ("u", "open", at(0)),
        ]
    )
    rules = [RevenueRule("buy"), RevenueRule("renew", override=10.0), RevenueRule("refund", False), RevenueRule("gift", False, 10.0)]
    expected = {"buy": 5.0, "renew": 20.0, "refund": 0.0, "gift": 0.0, "open": 0.0}
    assert by(R.modified_revenue(rows, rules), "event_name", "modified_revenue") == expected
    table = R.rules_frame(spark, rules)
    assert by(R.modified_revenue_from(rows, table), "event_name", "modified_revenue") == expected
    assert rows_of(R.default_rules(rows), "event_name") == [("buy",), ("gift",), ("refund",), ("renew",)]
    assert rows_of(R.addable_events(rows, table), "event_name") == [("open",)]
    changed = R.upsert_rules(table, R.rules_frame(spark, [RevenueRule("gift"), RevenueRule("open")]))
    assert by(changed, "event_name", "is_included") == {"buy": True, "renew": True, "refund": False, "gift": True, "open": True}
    merged = {r.event_name: r.included for r in merge_rules(rules, [RevenueRule("gift"), RevenueRule("open")])}
    assert merged == {"buy": True, "renew": True, "refund": False, "gift": True, "open": True}


def test_scope_shrinks_and_discovers(make_events):
    rows = make_events(
        [("u1", "a", at(d), {"country": c}) for d, c in ((0, "US"), (1, "US"), (2, "IN"))]
        + [("u2", "b", at(3), {"country": ""}), ("u2", "b", at(4), {"country": None}), ("u3", "a", at(5), {"country": "UK", "count": 9})],
        country="string",
    )
    summary = S.scope_summary(rows, [Filter("country", "=", "US")]).first()
    assert tuple(summary) == (6, 2, 2.0, 1, pytest.approx(100 / 3))
    assert S.apply_scope(rows, [Filter("country", "=", "US")], date_to="2024-01-01").count() == 1
    assert [tuple(r) for r in S.column_values(rows, "country").collect()] == [("UK", 9.0), ("US", 2.0), ("IN", 1.0)]
    assert S.count_values(rows, "country").first()[0] == 3
    assert [r.value for r in S.column_values(rows, "user_id", limit=2).collect()] == ["u1", "u2"]
    assert [tuple(r) for r in S.event_property_values(rows, "a", "country").collect()] == [("US", 2), ("IN", 1), ("UK", 1)]
    assert tuple(S.date_range(rows).first()) == (at(0).date(), at(5).date())
    assert [r[0] for r in S.list_events(rows).collect()] == ["a", "b"]
    with pytest.raises(SpecError):
        S.column_values(rows, "nope")


def test_export_writes_manifest(spark, tmp_path, make_events):
    rows = S.list_events(make_events([("u", "a", at(0))]))
    out = str(tmp_path / "out")
    for fmt in ("csv", "json"):
        export_results(spark, {"names": ResultTable("Names", rows, {"limit": 5}, {"country": "US"})}, out, fmt)
        assert getattr(spark.read.option("header", True), fmt)(f"{out}/names").collect()[0].event_name == "a"
        manifest = spark.read.json(f"{out}/manifest").first()
        assert (manifest.name, manifest.title, manifest.format, manifest.settings) == ("names", "Names", fmt, '{"limit": 5}')
    with pytest.raises(SpecError):
        export_results(spark, {}, out, "xlsx")


def test_now_bound_keeps_one_day(spark):
    now = datetime(2024, 1, 1, 12)
    raw = _raw(spark, [("u", "e", str(now + timedelta(hours=h)), "1", "1", "p", h) for h in (0, 24, 25)])
    assert E.map_events(raw, MAPPING, now=now).count() == 2
