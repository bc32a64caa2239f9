from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from strideline.session import local_session  # noqa: E402

START = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def at(days: float = 0, hours: float = 0, minutes: float = 0, seconds: float = 0) -> datetime:
    return START + timedelta(days=days, hours=hours, minutes=minutes, seconds=seconds)


@pytest.fixture(scope="session")
def make_events(spark):
    """Canonical events from ``(user, name, time[, extras])`` tuples."""

    def build(rows, count=None, revenue=None, **properties):
        data = []
        for i, row in enumerate(rows):
            extra = row[3] if len(row) > 3 else {}
            money = float(extra.get("revenue", 0.0))
            data.append(
                (row[0], row[1], row[2], *[extra.get(p) for p in properties], float(extra.get("count", 1)), money, money, extra.get("row_id", i))
            )
        props = "".join(f", {name} {kind}" for name, kind in properties.items())
        schema = (
            f"user_id string, event_name string, event_time timestamp_ntz{props}, event_count double, "
            "original_revenue double, modified_revenue double, row_id long"
        )
        return spark.createDataFrame(data, schema)

    return build


@pytest.fixture(scope="session")
def salted():
    """Make every user with more than two rows a hot one."""
    from contextlib import contextmanager

    from strideline.operators import skew

    @contextmanager
    def switch():
        before = skew.HOT_ROWS, skew.ROWS_PER_SALT
        skew.HOT_ROWS, skew.ROWS_PER_SALT = 2, 3
        try:
            yield
        finally:
            skew.HOT_ROWS, skew.ROWS_PER_SALT = before

    return switch


def rows_of(frame, *columns):
    picked = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def by(frame, key, *values):
    """``{key: value or values}`` of a small result."""
    out = {}
    for row in frame.collect():
        name = tuple(row[k] for k in key) if isinstance(key, (list, tuple)) else row[key]
        out[name] = tuple(row[v] for v in values) if len(values) > 1 else row[values[0]]
    return out


def numbers(frame, column):
    return frame.select(F.col(column)).first()[0]
