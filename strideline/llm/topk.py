"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Rows are dealt to shards by a hash of the vector; equal vectors keep their k+1 smallest ids,
which is all a query can return of them, so a vector that a third of the rows share costs no
more than others. A task gets one shard and one block of queries, both of bounded size.

A ball bounds the inner product of every vector in it by q.c + |q| r. Nodes wait in a heap
ordered by that bound, with the queries they still matter to; a query leaves a node as soon
as the bound is below its k-th score. The search runs twice: each query first visits one
shard, and its k-th score there is the bar it brings to all the others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideline.operators.staging import stage

#: Rows of a shard, queries of a block, vectors of a leaf.
SHARD_ROWS = 50_000
BLOCK_QUERIES = 20_000
LEAF = 64

_FOUND = "query_id long, vec_id long, score long"
_LONG = np.iinfo(np.int64)


class BallTree:
    """Balls over the rows of ``points``; ``order`` lists the rows leaf by leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.begin, self.end, self.child = [0], [len(points)], [0]
        self.center, self.radius = [], []
        at = 0
        while at < len(self.begin):
            begin, end = self.begin[at], self.end[at]
            own = points[self.order[begin:end]]
            center = own.mean(0)
            distance = ((own - center) ** 2).sum(1)
            self.center.append(center)
            self.radius.append(float(np.sqrt(distance.max())))
            if end - begin > leaf and distance.max() > 0:
                # Split at the median along the line between two far points.
                far = own[distance.argmax()]
                other = own[((own - far) ** 2).sum(1).argmax()]
                half = (end - begin) // 2
                place = np.argpartition(own @ (far - other), half)
                self.order[begin:end] = self.order[begin:end][place]
                self.child[at] = len(self.begin)
                self.begin += [begin, begin + half]
                self.end += [begin + half, end]
                self.child += [0, 0]
            at += 1
        self.centers, self.radii = np.array(self.center), np.array(self.radius)


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query row, id, score) of what can still be among the k best of each query.

    ``bars`` holds scores a query has k of elsewhere (the least long: none). Whole-number
    arithmetic is exact: in doubles while every product fits 53 bits, else in Python numbers,
    with scores beyond a long held at its ends.
    """
    size = vectors.shape[1]
    top = int(np.abs(vectors).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(size, 1)
    if top >= 2**53:
        out = []
        for row, query in enumerate(queries.astype(object)):
            scores = [min(max(int(s), _LONG.min), _LONG.max) for s in vectors.astype(object) @ query]
            best = sorted((-s, i) for s, i in zip(scores, ids.tolist(), strict=True) if i != query_ids[row])[:k]
            out += [(row, i, -s) for s, i in best]
        return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    points, asked = vectors.astype(float), queries.astype(float)
    norms = np.sqrt((asked**2).sum(1))
    tree = BallTree(points)
    ids, points = ids[tree.order], points[tree.order]
    best = np.full((len(asked), k), -np.inf)
    best_id = np.full((len(asked), k), _LONG.max)
    bar = np.where(bars == _LONG.min, -np.inf, bars.astype(float))
    slack = 1e-6 + 1e-9 * top  # the bounds are rounded, the scores are not

    def bound(node: int, who: np.ndarray) -> np.ndarray:
        return asked[who] @ tree.centers[node] + norms[who] * tree.radii[node] + slack

    everyone = np.arange(len(asked))
    heap = [(-float(bound(0, everyone).max()), 0, everyone, bound(0, everyone))] if len(ids) and len(asked) else []
    while heap:
        _, node, who, upper = heapq.heappop(heap)
        live = upper >= np.maximum(bar[who], best[who, -1])
        who = who[live]
        if not len(who):
            continue
        if tree.child[node]:
            for child in (tree.child[node], tree.child[node] + 1):
                upper = bound(child, who)
                live = upper >= np.maximum(bar[who], best[who, -1])
                if live.any():
                    heapq.heappush(heap, (-float(upper[live].max()), child, who[live], upper[live]))
            continue
        begin, end = tree.begin[node], tree.end[node]
        scores = asked[who] @ points[begin:end].T
        scores[query_ids[who][:, None] == ids[begin:end]] = -np.inf
        better = scores.max(1) >= np.maximum(bar[who], best[who, -1])
        who, scores = who[better], scores[better]
        all_scores = np.concatenate([best[who], scores], 1)
        all_ids = np.concatenate([best_id[who], np.broadcast_to(ids[begin:end], scores.shape)], 1)
        first = np.lexsort((all_ids, -all_scores))[:, :k]
        best[who] = np.take_along_axis(all_scores, first, 1)
        best_id[who] = np.take_along_axis(all_ids, first, 1)
    row, column = np.nonzero((best > -np.inf) & (best >= bar[:, None]))
    return row, best_id[row, column], best[row, column].astype(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _few_of_each(frame: DataFrame, keep: int) -> DataFrame:
    """Of equal vectors in a batch, the ``keep`` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("vec_id").to_numpy(), batch.column("hash").to_numpy()
            order = np.lexsort((ids, hashes))
            starts = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]]) if len(ids) else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, len(ids)])
            nth = np.arange(len(ids)) - np.repeat(starts, sizes)
            yield batch.take(pa.array(np.sort(order[nth < keep])))

    return frame.mapInArrow(run, frame.schema)


def _visit(shards: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Search each (size, shard, block) of ``shards`` with the queries sent there."""

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        ids, vectors = left["vec_id"].to_numpy(), _matrix(left["q"])
        _, same = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, same.ravel()))  # by vector, then id: keep k+1 of each vector
        starts = np.flatnonzero(np.r_[True, np.diff(same.ravel()[order]) != 0])
        nth = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
        pick = order[nth <= k]
        query_ids = right["vec_id"].to_numpy()
        row, found, score = search(ids[pick], vectors[pick], query_ids, _matrix(right["q"]), right["bar"].to_numpy(), k)
        return pa.table({"query_id": query_ids[row], "vec_id": found, "score": score})

    keys = ("size", "shard", "block")
    return shards.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, _FOUND)


def quantised(embeddings: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``vec_id``, ``q`` (floor of scale times each component), ``size``, ``hash``, without rows whose
    id or vector is null or empty, or whose vector holds a null or non-finite component."""
    v = F.col("_v")
    frame = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    frame = frame.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine)
    frame = frame.select("vec_id", F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("q"))
    return frame.select("vec_id", "q", F.size("q").alias("size"), F.xxhash64("q").alias("hash"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k rows of the highest inner product
    with each query, its own id left out, ties to the smaller id. Both inputs as by :func:`quantised`;
    only vectors of the query's size compete. Fewer rows than k give fewer results, none give none.
    An id that occurs more than once competes with each of its rows; a query id with several vectors
    gets the best k over all of them.
    """
    total, asked_for = vectors.count(), queries.count()
    shards = max(1, -(-total // shard_rows))
    blocks = max(1, -(-asked_for // block_queries))
    none = F.lit(int(_LONG.min))
    home = F.pmod(F.col("hash"), F.lit(shards)).cast("int")
    dealt = _few_of_each(vectors, k + 1).select("vec_id", "q", "size", home.alias("shard"))
    asked = queries.dropDuplicates(["vec_id", "hash"]).select("vec_id", "q", "size", home.alias("home"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))

    # First one shard for each query; a shard gets its own share of them, about as many as any other.
    near = asked.select("vec_id", "q", "size", F.col("home").alias("shard"), F.lit(0).alias("block"), none.alias("bar"))
    first = stage(_visit(dealt.withColumn("block", F.lit(0)), near, k))
    bars = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("score") == k, F.min("score")).alias("bar"))
    single = asked.groupBy("vec_id").count().where("count = 1").select("vec_id")
    bars = bars.join(single, "vec_id")  # several vectors of one id have no common bar
    others = asked.join(bars, "vec_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
    others = others.select("vec_id", "q", "size", "shard", "block", F.coalesce("bar", none).alias("bar"))
    everywhere = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = first.unionByName(_visit(everywhere, others, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
