"""Centroid clustering and approximate neighbours against brute force."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strideline.llm import ann, clusters

SCHEMA = "vec_id long, embedding array<float>, cluster int, x double, q string"


def frame_of(spark, rows):
    """Rows of (vec_id, embedding) beside columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, 7, 0.5, "a") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def clustered():
    random = np.random.default_rng(5)
    centers = random.normal(size=(8, 64))
    return [(i, (centers[i % 8] + random.normal(size=64) * 0.3).tolist()) for i in range(1200)]


ODD_VECTORS = [
    (1, None),
    (2, []),
    (3, [1.0] * 63),
    (4, [1.0] * 63 + [None]),
    (5, [float("nan")] * 64),
    (6, [float("inf")] + [0.0] * 63),
    (7, [0.0] * 64),
    (8, [-0.001] * 64),
    (8, [0.5] * 64),
    (None, [0.25] * 64),
    (None, [0.25] * 64),
    (9, [0.5] * 64),
    (10, [0.5] * 64),
    (11, [0.5, -0.5] * 32),
    (12, [1.0] * 32),
]


def brute_k_means(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, hashlib.sha256(f"2:{kept[r][0]}".encode()).hexdigest(), kept[r][1]))
    centers = [kept[r][1] for r in order[:k]]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        held = {}
        for _, q in kept:
            held.setdefault(nearest(q)[1], []).append(q)
        centers = [[sum(x) // len(held[j]) for x in zip(*held[j], strict=True)] if j in held else c for j, c in enumerate(centers)]
    out = [(i, *reversed(nearest(q))) for i, q in kept]
    return out, centers


def check_k_means(frame, rows, k, rounds):
    got = clusters.k_means(clusters.quantised(frame), k, rounds).withColumn("hash", clusters.centroid_hash("centroid")).collect()
    expected, centers = brute_k_means(rows, k, rounds)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == sorted(expected, key=str)
    for r in got:
        assert r["centroid"] == centers[r["cluster"]]
        assert r["hash"] == hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest()
        assert r["cluster_inertia"] == sum(d for _, c, d in expected if c == r["cluster"])
        assert r["inertia"] == sum(d for _, _, d in expected)
    return got


def test_clusters(spark, clustered):
    got = check_k_means(frame_of(spark, clustered), [(i, np.float32(v).tolist()) for i, v in clustered], 12, 4)
    assert sum(r["scanned"] for r in got) < len(got) / 2  # the bounds spare most vectors


def test_clusters_of_odd_rows(spark):
    fine = [(i, v) for i, v in ODD_VECTORS if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    for k in (1, 3, 40):
        check_k_means(frame_of(spark, ODD_VECTORS), [(i, np.float32(v).tolist()) for i, v in fine], k, 3)


def test_clusters_of_huge_components(spark):
    rows = [(i, [float(x)] * 64) for i, x in enumerate([2**60, -(2**60), 2**45, 2**45 + 2**24, 3e38, 0])]
    got = clusters.k_means(clusters.quantised(frame_of(spark, rows)), 3, 2).collect()
    assert len(got) == len(rows) and all(0 <= r["distance"] <= 2**63 - 1 for r in got)


def test_clusters_of_nothing(spark):
    assert clusters.k_means(clusters.quantised(frame_of(spark, [])), 40, 5).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 6), st.floats(0, 3))
def test_no_point_of_a_sphere_comes_nearer_than_loosened(seed, dims, radius):
    random = np.random.default_rng(seed)
    old = random.normal(size=(5, dims)) * 3
    new = old + random.normal(size=(5, dims)) * random.uniform(0, 2, (5, 1))
    loose = clusters.loosening(old, new, np.full(5, radius))
    drift = np.sqrt(((new - old) ** 2).sum(1))
    for i in range(5):
        away = random.normal(size=(200, dims))
        points = old[i] + away / np.linalg.norm(away, axis=1)[:, None] * radius * random.uniform(0, 1, (200, 1)) ** (1 / dims)
        for j in range(5):
            if j != i:
                nearer = np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)
                assert nearer.max() <= loose[i] + 1e-9
        assert loose[i] <= np.delete(drift, i).max() + 1e-9


def test_loosening_is_less_than_the_drift():
    old = np.array([[0.0, 0], [10, 0], [0, 10]])
    new = np.array([[0.0, 0], [11, 0], [1, 10]])  # one moves straight away, one past
    assert clusters.loosening(old, new, np.full(3, 1.0))[0] < 0.3


def brute_neighbours(rows, queries, k):
    out = {}
    for i, q in queries:
        best = {}
        for j, v in rows:
            if j != i and len(v) == len(q):
                score = math.fsum(a * b for a, b in zip(q, v, strict=True))
                best[j] = max(score, best.get(j, -math.inf))
        out[i] = sorted(((-s, j) for j, s in best.items()))[:k]
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall(spark, sf):
    vectors = ann.usable(spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet"))
    rows = {r["vec_id"]: np.array(r["x"]) for r in vectors.collect()}
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()
    ids, matrix = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)])
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
        assert abs(r["score"] - float(rows[r["query_id"]] @ rows[r["vec_id"]])) < 1e-12
    assert sorted(found) == [i for i in sorted(rows) if i % 20 == 0]
    hits = 0
    for query, held in found.items():
        held.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in held] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in held] == sorted((-r["score"], r["vec_id"]) for r in held)
        assert query not in {r["vec_id"] for r in held} and len({r["vec_id"] for r in held}) == 20
        scores = matrix @ rows[query]
        scores[ids == query] = -np.inf
        hits += len({r["vec_id"] for r in held} & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert hits / (20 * len(found)) >= 0.9


def test_neighbours_of_odd_rows(spark, monkeypatch):
    fine = [(i, np.float32(v).tolist()) for i, v in ODD_VECTORS if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    vectors = ann.usable(frame_of(spark, ODD_VECTORS))
    assert sorted(r["vec_id"] for r in vectors.collect()) == sorted(i for i, _ in fine)
    got = {}
    for r in ann.nearest(vectors, vectors, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for query in {i for i, _ in fine}:
        best = {}
        for i, v in fine:  # several vectors of one query id: the best over all
            if i == query:
                for s, j in brute_neighbours(fine, [(i, v)], 3)[i]:
                    best[j] = min(s, best.get(j, math.inf))
        expected = sorted((s, j) for j, s in best.items())[:3]
        assert [(n, j, pytest.approx(-s)) for n, (s, j) in enumerate(expected, 1)] == sorted(got.get(query, []))


def test_hot_vectors_and_split_units(spark, clustered, monkeypatch):
    """Many equal vectors, and buckets that are split on both sides, give the same rows."""
    monkeypatch.setattr(ann, "UNIT_ROWS", 20)
    monkeypatch.setattr(ann, "UNIT_QUERIES", 10)
    monkeypatch.setattr(ann, "SHARD_ROWS", 100)
    rows = [(i, v) for i, v in clustered[:300]] + [(1000 + i, clustered[0][1]) for i in range(200)]
    vectors = ann.usable(frame_of(spark, rows))
    queries = vectors.where("vec_id % 10 = 0")
    got = {}
    for r in ann.nearest(vectors, queries, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    plain = [(i, np.float32(v).tolist()) for i, v in rows]
    expected = brute_neighbours(plain, [p for p in plain if p[0] % 10 == 0], 5)
    hits = sum(len({j for _, j in got[q]} & {j for _, j in best}) for q, best in expected.items())
    assert hits >= 0.9 * 5 * len(expected)
    assert [j for _, j in sorted(got[1000])] == [0, 1001, 1002, 1003, 1004]


def test_neighbours_of_nothing(spark):
    none = ann.usable(frame_of(spark, []))
    assert ann.nearest(none, none, 20).collect() == []
    one = ann.usable(frame_of(spark, [(1, [1.0, 2.0])]))
    assert ann.nearest(one, one, 20).collect() == []


def test_norms_may_differ(spark):
    random = np.random.default_rng(2)
    rows = [(i, (random.normal(size=16) * random.uniform(0.01, 30)).tolist()) for i in range(400)]
    plain = [(i, np.float32(v).tolist()) for i, v in rows]
    vectors = ann.usable(frame_of(spark, rows))
    got = {}
    for r in ann.nearest(vectors, vectors.where("vec_id < 40"), 5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    expected = brute_neighbours(plain, plain[:40], 5)
    assert sum(len(got[q] & {j for _, j in best}) for q, best in expected.items()) >= 0.9 * 5 * 40


def test_crossings_go_by_cost_and_never_cross_both_sides():
    sets = ann.crossings(5, 200)
    assert not sets[0].any() and len({tuple(s) for s in sets}) == len(sets)
    assert not (sets & sets[:, ::-1]).any()
    assert len(ann.crossings(2, 100)) == 9


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**32))
def test_probes_are_the_cheapest_buckets(seed):
    random = np.random.default_rng(seed)
    sets = ann.crossings(3, 100)  # all 27
    hashes = ann.replace(ann.Hashes.draw(6, 3, 2, 1.0, seed), probes=20)
    query = random.normal(size=(1, 6))
    table, bucket = hashes.probed(query, sets)
    place = hashes.places(query, query=True)[0]
    costs = []
    for t in range(2):
        own = place[3 * t : 3 * t + 3]
        for step in np.ndindex(3, 3, 3):
            move = np.array(step) - 1
            inside = own - np.floor(own)
            cost = np.where(move == 0, 0, np.where(move < 0, inside**2, (1 - inside) ** 2)).sum()
            floors = np.floor(place).copy()
            floors[3 * t : 3 * t + 3] += move
            costs.append((cost, t, int(hashes.buckets(floors[None])[0, t])))
    expected = [(t, b) for _, t, b in sorted(costs)[:20]]
    assert list(zip(table[0].tolist(), bucket[0].tolist(), strict=True)) == expected


def test_schema(spark, clustered):
    vectors = ann.usable(frame_of(spark, clustered[:30]))
    types = dict(ann.nearest(vectors, vectors.where(F.col("vec_id") == 3), 2).dtypes)
    assert types == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}


def test_probes_are_weighed_against_comparisons(spark):
    random = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(random.normal(size=(6_000, 64)))]
    vectors = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    hashes, sets = ann.fit(vectors, vectors.where("vec_id % 20 = 0"), 20)
    # Far vectors: a query sees most rows whatever the setting, so a probe is worth more than a few rows.
    assert hashes.probes <= 64
    found = ann.search(vectors, vectors.where("vec_id % 20 = 0"), hashes, sets, 20).collect()
    x = np.array([v for _, v in rows])
    asked = np.arange(0, 6_000, 20)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    true = {(int(q), int(i)) for q, best in zip(asked, np.argsort(-scores, 1)[:, :20], strict=True) for i in best}
    assert len(true & {(r["query_id"], r["vec_id"]) for r in found}) >= 0.9 * len(true)
