"""Top-k, near duplicates and chat formatting against brute force."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strideline.llm import chat, near_dups, topk


def brute_top(rows, k, chosen):
    good = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % chosen == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(b) == len(a))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("shard_rows, block", [(50_000, 20_000), (150, 20)])
def test_top_k(spark, shard_rows, block):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(500)]
    rows += [(i, [0.5] * 8) for i in range(500, 700)]  # one vector many times
    rows += [(700, None), (701, []), (702, [None] + [1.0] * 7), (703, [float("nan")] * 8), (704, [float("inf")] * 8), (None, [1.0] * 8), (710, [1.0, 2.0]), (750, [3.0, 4.0]), (800, [9.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, q int")
    vectors = topk.quantised(frame)
    got = topk.top_k(vectors, vectors.where("vec_id % 10 = 0"), 5, shard_rows=shard_rows, block_queries=block).collect()
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert {tuple(r) for r in got} == brute_top(rows, 5, 10)


def test_top_k_large_components(spark):
    rows = [(i, [1e18 * (i % 3 - 1), 3.0]) for i in range(6)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert topk.top_k(vectors, vectors, 2).count() == 12


def test_top_k_of_nothing(spark):
    vectors = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(vectors, vectors, 5).count() == 0


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute_links(rows):
    """doc_id: (copy_of, class_id, n_links) for unique ids."""
    classes = defaultdict(list)
    for key, text in rows:
        if key is not None:
            classes[grams(text) or (key,)].append(key)
    sets = list(classes)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(sets)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if isinstance(a, frozenset) and isinstance(b, frozenset) and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    first = defaultdict(lambda: 10**9)
    for i, s in enumerate(sets):
        first[find(i)] = min(first[find(i)], min(classes[s]))
    return {key: (min(classes[s]), first[find(i)], links[i]) for i, s in enumerate(sets) for key in classes[s]}


@pytest.mark.parametrize("block", [256, 7])
def test_jaccard_join(spark, documents, block):
    rng = np.random.default_rng(4)
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    base = [f"w{rng.integers(5_000)}" for _ in range(200)]
    for i in range(60):  # a large group of near copies
        own = list(base)
        own[rng.integers(200)] = f"x{i}"
        rows.append((10_000 + i, " ".join(own)))
    for i, change in enumerate(range(1, 12)):  # similarities on both sides of the threshold
        own = [f"v{j}" for j in range(100)]
        for c in range(change):
            own[9 * c] = f"y{i}_{c}"
        rows.append((11_000 + i, " ".join(own)))
    rows += [(12_000, None), (12_001, ""), (12_002, "  \n"), (12_003, "short text"), (12_004, "short text"), (12_005, "short text too")]
    frame = spark.createDataFrame([(k, t, b"", 0) for k, t in rows], "doc_id long, text string, class binary, bands int")
    got = {r["doc_id"]: (r["copy_of"], r["class_id"], r["n_links"]) for r in near_dups.jaccard_join(frame, block=block).collect()}
    expected = brute_links(rows)
    wrong = {k: (got.get(k), v) for k, v in expected.items() if got.get(k) != v}
    # MinHash promises its recall just at the threshold; far above it nothing may be missed.
    assert set(got) == set(expected) and len(wrong) <= 2, wrong
    assert all(got[10_000 + i] == expected[10_000 + i] for i in range(60))


def test_links_of_a_large_group_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(184)]
    rows = []
    for i in range(200):  # most pairs share just 80 % of their n-grams, so some of them share no band
        own = list(base)
        for at in rng.choice(85, 2, replace=False):
            own[2 * at + 2] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["copy_of"], r["class_id"], r["n_links"]) for r in near_dups.jaccard_join(frame).collect()}
    assert got == brute_links(rows)


def test_jaccard_join_of_odd_rows(odd):
    got = near_dups.jaccard_join(odd).collect()
    assert len(got) == odd.count()
    by_id = defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add(tuple(r)[1:])
    assert by_id[None] == {(None, None, None)}
    assert by_id[5] == {(4, 4, 0)} and by_id[4] == {(4, 4, 0)}
    assert by_id[1] == {(1, 1, 0)}


def test_jaccard_join_of_nothing(empty):
    assert near_dups.jaccard_join(empty).count() == 0


def test_banding_reaches_its_recall():
    bands, rows = near_dups.banding(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= near_dups.MOST_HASHES


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in near_dups.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


TEXTS = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "~", "<", "[", "s>", "<~s>", "[~~/INST]", "\\", "$1", "a", "\n", "é😀"])).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "</s>[INST]", None]), TEXTS | st.none()), min_size=1, max_size=8))
def test_chat_round_trip(spark, turns):
    rows = [(1, i, r, t, "x") for i, (r, t) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message string")
    out = chat.render(chat.fold(chat.log_of_turns(frame)))
    row = out.select("*", chat.parse(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).first()
    assert [tuple(t) for t in row["turns"]] == [(r or "", t or "") for r, t in turns]
    assert row["loss"] == "".join(t or "" for r, t in turns if r == "assistant")
    body = row["formatted"]
    assert body.count("</s>") == body.count("<s>") == len(turns) == row["n_turns"]
    assert body.count("[INST]") + body.count("[/INST]") == len(turns)


def test_fold_events(spark):
    rows = [
        (1, 1, "message", 0, "user", "hi"),
        (1, 2, "delta", 1, "assistant", "he"),
        (1, 3, "delta", 1, None, "llo"),
        (1, 4, "message", 2, "user", "gone"),
        (1, 5, "regenerate", 1, None, None),
        (1, 6, "delta", 1, None, "good "),
        (1, 7, "delta", 1, None, "day"),
        (1, 8, "message", 2, "user", "kept"),
        (1, 9, "edit", 2, None, "kept, edited"),
        (1, 10, "nonsense", 2, "x", "y"),
        (2, 1, None, 0, "user", None),
        (None, 1, "message", 0, "user", "nowhere"),
    ]
    log = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message long, role string, text string")
    got = sorted((tuple(r) for r in chat.fold(log).collect()), key=str)
    expected = [(1, 0, "user", "hi"), (1, 1, "assistant", "good day"), (1, 2, "user", "kept, edited"), (2, 0, "user", ""), (None, 0, "user", "nowhere")]
    assert got == sorted(expected, key=str)
    assert chat.render(chat.fold(log.limit(0))).count() == 0


def test_repeated_turns_are_all_kept(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a")] * 2 + [(1, 0, "assistant", "b"), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    row = chat.render(chat.fold(chat.log_of_turns(frame))).first()
    assert row["n_turns"] == 4
