from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from strideline.session import importable, local_session  # noqa: E402

LONG = "word and another, " * 20_000 + "\n" + "x" * 50_000

#: (doc_id, text): null and empty, white space, ties, repeated rows, a key twice, no key, long, odd characters.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\r\n \x0b\x0c "),
    (4, "one two three four five six"),
    (4, "one two three four five six"),
    (5, "one two three four five six"),
    (6, "six five four three two one"),
    (6, "other text under the same number"),
    (None, "no number here"),
    (None, None),
    (7, LONG),
    (8, "naïve \x00 nul \x1c fs \x85 nel   em  two spaces \n\n lines 日本語 😀 á"),
    (9, "tail space \n"),
    (10, "</s>[INST] <|endoftext|> 's 'll don't 1234 ##"),
]


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return importable(session)


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with columns whose names the operators use inside."""
    rows = [(k, t, "xx", 0, "a", 1.0, None) for k, t in ODD]
    names = "doc_id long, text string, lang string, ids int, class string, _t double, key string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def key_of(row):
    return tuple((v is None, str(v)) for v in row)
