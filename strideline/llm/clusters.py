"""Exact k-means over whole-number vectors, with bounds that spare most vectors the scan of all centroids.

Each vector keeps its cluster and a lower bound on its distance to every other centroid. When the centroids
have moved, the members of a cluster lie in a sphere about its old centroid, and the distance of a point to
another centroid c that moves to c' can shrink by less than the whole drift |c c'|. In the plane through c, c'
and the sphere's centre, the points that come nearer by drift * cos(t) or more lie inside a branch of a
hyperbola, which lies inside the cone of half-angle t at the middle of c c'. The bound of a cluster is therefore
loosened by drift * cos(t), t being the least angle under which its sphere is seen from there, and not at all by
a centroid that moves away from it. A vector whose own centroid is nearer than its bound stays; the others are
ambiguous and compared with all centroids in whole numbers.

The centroids, their moves and the loosening are a few numbers for each pair of centroids, and live on the
driver. Vectors and their state are stored after each round in the staging folder, the round before is dropped
then. Sums follow the vectors that changed their cluster, added up in the tasks first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.operators.staging import discard, stage

_LONG = 2**63 - 1
_STATE = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("q", T.ArrayType(T.LongType())),
        T.StructField("was", T.IntegerType()),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("own", T.LongType()),
        T.StructField("lower", T.DoubleType()),
        T.StructField("scanned", T.BooleanType()),
    ]
)


def quantised(embeddings: DataFrame, *, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: float = 256.0) -> DataFrame:
    """``vec_id`` and ``q`` (floor of scale times each component), of vectors with exactly ``dims`` components, none
    of them null or non-finite. Ids may be null or repeated; other columns are dropped."""
    v = F.col("_v")
    frame = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return frame.where((F.size(v) == dims) & fine).select("vec_id", F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("q"))


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, the most by which a point of its sphere can come nearer to any other moving centroid."""
    drift = np.sqrt(((new - old) ** 2).sum(1))
    middle = (old + new) / 2
    axis = np.divide(new - old, drift[:, None], out=np.zeros_like(old), where=drift[:, None] > 0)
    to = old[:, None] - middle[None]  # from the middle of each move to each cluster's old centroid
    distance = np.sqrt((to**2).sum(2))
    along = (to * axis[None]).sum(2)
    outside = distance > radius[:, None]
    safe = np.where(outside, distance, 1.0)
    angle = np.arccos(np.clip(along / safe, -1, 1)) - np.arcsin(np.where(outside, radius[:, None] / safe, 1.0))
    share = np.where(outside & (angle > 0), np.maximum(np.cos(np.maximum(angle, 0)), 0.0), 1.0)
    np.fill_diagonal(share, 0.0)
    return (share * drift[None]).max(1)


def _distances(vectors: np.ndarray, centers: list[list[int]]) -> np.ndarray:
    """Squared distances of whole numbers, exact; a row for each vector. Beyond a long, held at its end."""
    top = max(int(np.abs(vectors.astype(float)).max(initial=0)), max((abs(x) for c in centers for x in c), default=0))
    if 4 * vectors.shape[1] * top * top < 2**53:
        x, c = vectors.astype(float), np.array(centers, float)
        return ((x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * (x @ c.T)).astype(np.int64)
    x, out = vectors.astype(object), np.zeros((len(vectors), len(centers)), np.int64)
    for j, center in enumerate(centers):
        apart = x - np.array(center, object)
        out[:, j] = [min(int(d), _LONG) for d in (apart * apart).sum(1)]
    return out


def _pass(frame: DataFrame, centers: list[list[int]], loosen: np.ndarray, half: np.ndarray) -> DataFrame:
    """Assign every row to its nearest centroid; rows whose ``cluster`` is null have no bound yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(centers))
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            was = batch.column("cluster").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            lower = batch.column("lower").fill_null(-np.inf).to_numpy(zero_copy_only=False) - np.append(loosen, 0.0)[was]
            known = np.flatnonzero(was >= 0)
            own = np.full(len(was), _LONG)
            for j in np.unique(was[known]):
                mine = np.flatnonzero(was == j)
                own[mine] = _distances(vectors[mine], [centers[j]])[:, 0]
            bound = np.maximum(lower, np.append(half, -np.inf)[was])
            # Bounds are rounded, distances are not: what comes near a bound counts as ambiguous.
            unsure = np.flatnonzero((was < 0) | ~(np.sqrt(own.astype(float)) * (1 + 1e-9) + 1e-6 < bound))
            cluster = was.copy()
            if len(unsure):
                distance = _distances(vectors[unsure], centers)
                first = distance.argmin(1)  # of equal ones, the smaller number
                cluster[unsure], own[unsure] = first, distance[np.arange(len(unsure)), first]
                others = np.where(every == first[:, None], _LONG, distance)
                lower[unsure] = np.sqrt(others.min(1).astype(float)) * (1 - 1e-12) if len(centers) > 1 else np.inf
            scanned = np.zeros(len(was), bool)
            scanned[unsure] = True
            columns = [batch.column("vec_id"), batch.column("q"), pa.array(was.astype(np.int32)), pa.array(cluster.astype(np.int32)), pa.array(own), pa.array(lower), pa.array(scanned)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in _STATE])

    return frame.select("vec_id", "q", "cluster", "lower").mapInArrow(run, _STATE)


def _changes(state: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """(cluster, component) to the change of (members, sum), from the rows that changed their cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            small = int(np.abs(vectors.astype(float)).max()) < 2**40
            for sign, name in ((1, "cluster"), (-1, "was")):
                where = batch.column(name).to_numpy(zero_copy_only=False)
                for j in np.unique(where[where >= 0]).tolist():
                    mine = vectors[where == j]
                    added = mine.sum(0) if small and len(mine) < 2**22 else mine.astype(object).sum(0)
                    count[j] = count.get(j, 0) + sign * len(mine)
                    total[j] = total.get(j, 0) + sign * added.astype(object)
        rows = [(j, i, count[j], int(x)) for j, sums in total.items() for i, x in enumerate(sums)]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "component", "n", "total"])

    moved = state.where("was <> cluster").select("q", "cluster", "was")
    partial = moved.mapInArrow(run, "cluster int, component int, n long, total decimal(38,0)")
    # One row for each component of each centroid.
    summed = partial.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    return {(r["cluster"], r["component"]): (int(r["n"]), int(r["total"])) for r in summed}


def first_centers(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors of the k smallest sha256 of ``<salt>:<vec_id>``, by that hash; rows without an id come last,
    rows of one id by their components."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "q")
    return [list(r["q"]) for r in hashed.orderBy(F.col("hash").asc_nulls_last(), "q").limit(k).collect()]


def k_means(vectors: DataFrame, k: int, rounds: int, *, salt: str = "2", centers: list[list[int]] | None = None) -> DataFrame:
    """Assign, then move the centroids, ``rounds`` times; then assign once more. ``vectors`` as by :func:`quantised`.

    Gives ``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid`` (its components)
    and ``scanned``: whether the last assignment compared the row with all centroids. Ties go to the smaller number; a
    centroid without members stays; with fewer than k vectors each is a centroid. Repeated rows and null ids count as
    any other row, an empty table gives no rows. Squared distances and inertias beyond a long are held at its end.
    """
    vectors = vectors.select("vec_id", "q")
    now = first_centers(vectors, k, salt) if centers is None else [list(c) for c in centers]
    size = len(now)
    if not size:
        return _finished(vectors.sparkSession.createDataFrame([], _STATE), [], {})
    loosen, half = np.zeros(size), np.full(size, -np.inf)
    count, total = [0] * size, [[0] * len(now[0]) for _ in now]
    frame = vectors.withColumn("cluster", F.lit(None).cast("int")).withColumn("lower", F.lit(None).cast("double"))
    state = None
    for turn in range(rounds + 1):
        after = stage(_pass(frame, now, loosen, half))
        if state is not None:
            discard(state)
        state = frame = after
        if turn == rounds:
            break
        for (j, i), (n, change) in _changes(state).items():
            total[j][i] += change
            count[j] += n if i == 0 else 0
        radius = np.zeros(size)
        for row in state.groupBy("cluster").agg(F.max("own").alias("own")).collect():  # one row for each centroid
            radius[row["cluster"]] = math.sqrt(row["own"]) * (1 + 1e-9) + 1e-6
        moved = [[x // n for x in sums] if n else old for sums, n, old in zip(total, count, now, strict=True)]
        old, new = np.array(now, float), np.array(moved, float)
        loosen = loosening(old, new, radius) * (1 + 1e-9) + 1e-9
        apart = np.sqrt(np.maximum(((new[:, None] - new[None]) ** 2).sum(2), 0))
        np.fill_diagonal(apart, np.inf)
        half = apart.min(1) / 2 * (1 - 1e-9)
        now = moved
    inertia = state.groupBy("cluster").agg(F.sum(F.col("own").cast("decimal(38,0)")).alias("own"))
    return _finished(state, now, {r["cluster"]: int(r["own"]) for r in inertia.collect()})  # one row for each centroid


def _finished(state: DataFrame, centers: list[list[int]], inertia: dict[int, int]) -> DataFrame:
    rows = [(j, c, min(inertia.get(j, 0), _LONG), min(sum(inertia.values()), _LONG)) for j, c in enumerate(centers)]
    table = state.sparkSession.createDataFrame(rows, "cluster int, centroid array<long>, cluster_inertia long, inertia long")
    joined = state.join(F.broadcast(table), "cluster")  # as many rows as centroids
    return joined.select("vec_id", "cluster", F.col("own").alias("distance"), "cluster_inertia", "inertia", "centroid", "scanned")


def centroid_hash(centroid) -> F.Column:
    """Lowercase hex sha256 of the components in decimal, joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)

