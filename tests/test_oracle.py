"""Every registered query against its SQL on the smallest dataset."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import check
from strideline.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check.connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(ORACLE) == set(QUERIES)


def test_entry_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["cohort_id", "bucket", "size", "eligible", "active", "retention"]
    assert frame.count() > 0


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, sf_dir, key):
    frame = QUERIES[key](spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    result = duck.execute(ORACLE[key])
    names = [d[0] for d in result.description]
    assert check.compare(frame.columns, rows, names, result.fetchall()) is None
