"""Multi-line CSV records from many splits, against Spark's own one-split reader and Python's."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import types as T

from strideline.sources import records
from strideline.sources.csv import read_csv_events
from strideline.sources.records import read_records

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("a", "b", "c", "_bad")])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two files with line breaks, quotes and commas in quotes, blank lines, and lines of four fields."""
    path = tmp_path_factory.mktemp("records")
    chance = random.Random(1)
    for name in ("one", "two"):
        with open(path / f"{name}.csv", "w", newline="") as out:
            writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\r\n" if name == "two" else "\n")
            writer.writerow(["a", "b", "c"])
            for i in range(200):
                text = "".join(chance.choice(["a", '"', "\n", ",", "é", "x y", "\n\n"]) for _ in range(chance.randrange(1, 30)))
                writer.writerow([f"{name}{i}", text, "e"])
                if i % 50 == 0:
                    out.write("\n")
                if i % 70 == 0:
                    out.write("1,2,3,4\n")
    return str(path)


def expected(folder):
    rows, bad = [], 0
    for name in ("one", "two"):
        with open(f"{folder}/{name}.csv", newline="") as source:
            for row in list(csv.reader(source))[1:]:
                if len(row) == 3:
                    rows.append(tuple(row))
                bad += len(row) == 4
    return sorted(rows), bad


@pytest.mark.parametrize("split_bytes", [None, 5_000, 150])
def test_equal_rows_at_any_number_of_splits(spark, folder, split_bytes):
    rows = read_records(spark, folder, SCHEMA, "_bad", split_bytes).collect()
    good = sorted(tuple(r)[:3] for r in rows if r["_bad"] is None)
    assert (good, sum(r["_bad"] is not None for r in rows)) == expected(folder)


def test_joined_splits_keep_the_order_of_lines(spark, folder, monkeypatch):
    monkeypatch.setattr(records, "BROADCAST_SPLITS", -1)
    rows = read_records(spark, folder, SCHEMA, "_bad", 1_000).collect()
    assert sorted(tuple(r)[:3] for r in rows if r["_bad"] is None) == expected(folder)[0]


def test_many_splits_in_the_plan(spark, folder):
    before = spark.conf.get(records._SPLIT_BYTES)
    with records._splits_of(spark, 500):
        assert records._lines(spark, folder).select("file", "block").distinct().count() > 20
    assert spark.conf.get(records._SPLIT_BYTES) == before


def test_load_report(spark, folder):
    report = read_csv_events(spark, folder, multi_line=True, split_bytes=700).load_report().first()
    rows, bad = expected(folder)
    assert (report["imported_rows"], report["skipped_rows"]) == (len(rows), bad)


def test_records_not_lines_are_counted(spark, tmp_path):
    (tmp_path / "x.csv").write_text('user,event,time\nu1,"signup\nmobile",2024-01-01\n')
    found = read_csv_events(spark, str(tmp_path), multi_line=True)
    assert found.load_report().first().asDict() == {"imported_rows": 1, "skipped_rows": 0}
    assert found.rows.collect() == [("u1", "signup\nmobile", "2024-01-01")]


def test_a_header_longer_than_its_split_and_a_record_over_many(spark, tmp_path):
    long = "x\n" * 300
    (tmp_path / "x.csv").write_text(f'user,"eve\n\nnt","ti{"m" * 100}\ne"\nu1,"{long}",1\nu2,b,2\n')
    rows = read_records(spark, str(tmp_path), T.StructType([T.StructField(n, T.StringType()) for n in ("u", "e", "t", "_bad")]), "_bad", 20).collect()
    assert sorted(tuple(r) for r in rows) == [("u1", long, "1", None), ("u2", "b", "2", None)]


def test_header_alone_and_open_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n")
    assert read_records(spark, str(tmp_path / "a.csv"), SCHEMA, "_bad").collect() == []
    (tmp_path / "b.csv").write_text('a,b,c\n1,2,"3\n4,5,6\n')
    assert len(read_records(spark, str(tmp_path / "b.csv"), SCHEMA, "_bad").collect()) == 1
