"""Ranked lexical search against its definition."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strideline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(key, Counter(words(t))) for key, t in docs if words(t)]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for key, text in items:
        asked.setdefault(key, set()).update(words(text))
    out = []
    for item, own in asked.items():
        scores = []
        for key, c in held:
            n = sum(c.values())
            m = 50 + 50 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, key is None, key or 0))
        out += [(item, n, None if unknown else key, -s) for n, (s, unknown, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got_of(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "item_id long, text string, rank int, doc_id int")


ODD_ITEMS = [(1, None), (2, ""), (3, "!?,"), (4, "One two THREE words"), (4, "number six"), (5, "One two THREE words"), (None, "naïve 日本語"), (6, "word another other under"), (7, "absentterm")]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_odd_rows(spark, odd, block):
    got = got_of(lexical.rank(odd, items_of(spark, ODD_ITEMS), 3, block_items=block))
    assert got == brute([(r["doc_id"], r["text"]) for r in odd.collect()], ODD_ITEMS, 3)


def test_documents(spark, documents, monkeypatch):
    monkeypatch.setattr(lexical, "BATCH_DOCS", 17)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = brute([(r["doc_id"], r["text"]) for r in documents.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 20)
    assert got_of(lexical.rank(documents, items, 20)) == expected


def test_of_nothing(spark, odd, empty):
    assert lexical.rank(empty, items_of(spark, ODD_ITEMS), 5).collect() == []
    assert lexical.rank(odd, items_of(spark, []), 5).collect() == []
    assert lexical.rank(odd, items_of(spark, [(1, None)]), 5).collect() == []


def test_many_equal_documents(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(300)], "doc_id long, text string").repartition(7)
    got = got_of(lexical.rank(docs, items_of(spark, [(1, "words")]), 5))
    assert [(n, d) for _, n, d, _ in got] == [(n, n - 1) for n in range(1, 6)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1).map(sorted), min_size=1, max_size=12), st.integers(0, 30))
def test_the_graph_adds_each_term_once(sets, mined):
    graph = lexical.Graph.mine(sets, 26, mined=mined)
    accumulators = np.zeros((graph.nodes, 3), np.int64)
    values = np.random.default_rng(1).integers(1, 2**40, (26, 3))
    accumulators[:26] = values
    assert (graph.evaluate(accumulators) == np.array([values[s].sum(0) for s in sets])).all()


def test_the_graph_shares_work():
    random = np.random.default_rng(4)
    themes = [random.choice(400, 25, replace=False) for _ in range(6)]
    sets = [sorted({*themes[i % 6].tolist(), *random.integers(0, 400, 5).tolist()}) for i in range(60)]
    assert lexical.Graph.mine(sets, 400).additions() < sum(map(len, sets)) / 3


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_terms_are_those_of_the_pattern(text):
    clean = text.encode("utf-8", "ignore").decode()
    assert lexical.terms(clean) == [w.encode() for w in words(clean)]
