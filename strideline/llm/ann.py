"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

The largest inner product becomes the least Euclidean distance when every vector is divided by the longest norm and
gets one more component that completes it to length one. Each of ``TABLES`` tables hashes it by ``width`` functions
floor((a.x + b) / W), the rows of a Gaussian (2-stable) matrix, made orthogonal in blocks. A query does not only visit
its own buckets: beside each function's boundary lies another bucket, and the set of boundaries crossed costs the sum
of the squared distances to them. Probes of all tables go by ascending cost, that is by falling estimated success.

``fit`` chooses how many functions a table has and how many probes a query makes: it finds the true neighbours of
at most ``TUNING_QUERIES`` queries by one pass over all rows, and takes the cheapest setting that reaches ``target``
of them. Every row is indexed.

Rows and probes meet in units: a bucket, split where it holds more than ``UNIT_ROWS`` rows or is visited by more than
``UNIT_QUERIES`` queries. Many units share a shard, to which a query's vector travels once. Scores are recomputed on
the original vectors in one fixed order of addition, the best of all tables are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideline.operators.staging import stage

TABLES = 4
#: Share of the tuning queries' true neighbours that a setting must reach.
TARGET = 0.95
TUNING_QUERIES = 64
#: Rows looked at to estimate how much a setting scans.
SAMPLE_ROWS = 2_000
#: Perturbed buckets of a table that are considered at most, besides the query's own.
MAX_PROBES = 1_500
#: Rows of a unit, queries of a unit, rows of a shard.
UNIT_ROWS = 10_000
UNIT_QUERIES = 10_000
SHARD_ROWS = 40_000
#: Split units that are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_UNITS = 100_000
#: Rows that could be compared in the time a probe takes to be stored, counted, joined and shuffled (measured on vectors
#: of 64 components: 31 to 47 ns a row, over 15 microseconds a probe).
PROBE_ROWS = 300
#: Queries that are compared with all rows at once where hashing found too few.
EXACT_QUERIES = 4_096

_FOUND = "query_id long, vec_id long, score double"


def crossings(width: int, most: int) -> np.ndarray:
    """Sets of boundaries by expected cost, one a row of booleans over the 2 * width boundaries of a table sorted
    by distance; the first set is empty. The two boundaries of one function are never crossed together: they stand
    at places that mirror each other."""
    z = np.arange(1, 2 * width + 1)
    low, back = z <= width, 2 * width + 1 - z
    scale = 4 * (width + 1) * (width + 2)
    cost = np.where(low, z * (z + 1) / scale, 1 - back / (width + 1) + back * (back + 1) / scale)
    sets, heap = [()], [(cost[0], (0,))]
    while heap and len(sets) <= most:
        total, held = heapq.heappop(heap)
        if len({min(i, 2 * width - 1 - i) for i in held}) == len(held):
            sets.append(held)
        last = held[-1]
        if last + 1 < 2 * width:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*held[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*held, last + 1)))
    out = np.zeros((len(sets), 2 * width), bool)
    for row, held in enumerate(sets):
        out[row, list(held)] = True
    return out


@dataclass(frozen=True)
class Hashes:
    """The functions of all tables, and how many probes a query makes."""

    directions: np.ndarray  # (components + 1) x (tables * width)
    offsets: np.ndarray
    odd: np.ndarray  # a table's bucket is a number: the sum of its function values times these
    step: float
    longest: float
    width: int
    probes: int

    @staticmethod
    def draw(dims: int, width: int, tables: int, longest: float, seed: int) -> Hashes:
        random = np.random.default_rng(seed)
        blocks = []
        while sum(b.shape[1] for b in blocks) < tables * width:
            blocks.append(np.linalg.qr(random.normal(size=(dims + 1, dims + 1)))[0])
        directions = np.concatenate(blocks, 1)[:, : tables * width] * np.sqrt(dims + 1)
        offsets = random.uniform(0, 1, tables * width)
        odd = random.integers(0, 2**63, tables * width, np.uint64) * np.uint64(2) + np.uint64(1)
        return Hashes(directions, offsets, odd, 2.0 / np.sqrt(dims + 1), longest, width, 1)

    @property
    def tables(self) -> int:
        return len(self.offsets) // self.width

    def places(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Each vector's value under each function, before rounding down."""
        norms = _norms(vectors)
        if query:
            whole = np.concatenate([vectors / norms[:, None], np.zeros((len(vectors), 1))], 1)
        else:
            scaled = vectors / self.longest
            whole = np.concatenate([scaled, np.sqrt(np.maximum(0.0, 1 - (norms / self.longest) ** 2))[:, None]], 1)
        return whole @ self.directions / np.sqrt(len(self.directions)) / self.step + self.offsets

    def buckets(self, floors: np.ndarray) -> np.ndarray:
        """Bucket number in each table (rows x tables)."""
        with np.errstate(over="ignore"):
            return (floors.astype(np.int64).astype(np.uint64) * self.odd).reshape(len(floors), self.tables, self.width).sum(2).view(np.int64)

    def probed(self, vectors: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(table, bucket) of each query's probes by ascending cost, queries x probes."""
        place = self.places(vectors, query=True)
        floors = np.floor(place)
        home = self.buckets(floors).view(np.uint64)
        inside = (place - floors).reshape(len(place), self.tables, self.width)
        odd = self.odd.reshape(self.tables, self.width)
        costs, numbers = [], []
        for table in range(self.tables):
            distance = np.concatenate([inside[:, table] ** 2, (1 - inside[:, table]) ** 2], 1)  # to the lower, to the upper one
            change = np.concatenate([np.zeros(self.width, np.uint64) - odd[table], odd[table]])
            order = np.argsort(distance, 1, kind="stable")
            # Mirrored places belong to one function only as long as ties don't mix them up.
            order[:, self.width :] = (order[:, : self.width][:, ::-1] + self.width) % (2 * self.width)
            costs.append(np.take_along_axis(distance, order, 1) @ sets.T)
            with np.errstate(over="ignore"):
                numbers.append(home[:, table, None] + _wrapped(change[order], sets))
        costs, numbers = np.concatenate(costs, 1), np.concatenate(numbers, 1)
        first = np.argsort(costs, 1, kind="stable")[:, : self.probes]
        return (first // len(sets)).astype(np.int32), np.take_along_axis(numbers, first, 1).view(np.int64)


def _wrapped(change: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """For each query and set, the sum of the changes in the set, modulo 2**64."""
    out = np.zeros((len(change), len(sets)), np.uint64)
    for at in range(sets.shape[1]):
        out[:, sets[:, at]] += change[:, at, None]
    return out


def _norms(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(1)
    return top * np.sqrt(((vectors / top[:, None]) ** 2).sum(1))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """(query row, id, score) of the k best of some vectors for each query, ties to the smaller id.

    A matrix product picks them with some slack; the score is the sum of the products in a fixed order.
    """
    out = []
    step = max(1, (4 << 20) // max(1, len(ids)))
    for begin in range(0, len(queries), step):
        asked, own = queries[begin : begin + step], query_ids[begin : begin + step]
        rough = asked @ vectors.T
        rough[own[:, None] == ids] = -np.inf
        if len(ids) > k:
            bar = np.partition(rough, len(ids) - k, 1)[:, len(ids) - k]
            bar -= 1e-9 * (1 + np.abs(bar))
        else:
            bar = np.full(len(asked), -np.inf)
        row, column = np.nonzero((rough >= bar[:, None]) & (rough > -np.inf))
        score = (asked[row] * vectors[column]).sum(1)
        found, order = ids[column], np.lexsort((ids[column], -score, row))
        nth = np.arange(len(row)) - np.searchsorted(row, row[order])
        keep = order[nth < k]
        out.append(np.stack([row[keep] + begin, found[keep], score[keep].view(np.int64)]))
    return out


def _best(parts: list[np.ndarray], k: int) -> np.ndarray:
    """The k best rows of each query over several units; an id found twice counts once, with its best."""
    rows = np.concatenate([np.zeros((3, 0), np.int64), *parts], 1)
    rows = rows[:, np.lexsort((-rows[2].view(np.float64), rows[1], rows[0]))]
    rows = rows[:, ~((rows[0] == np.r_[-1, rows[0][:-1]]) & (rows[1] == np.r_[0, rows[1][:-1]]))]
    rows = rows[:, np.lexsort((rows[1], -rows[2].view(np.float64), rows[0]))]
    return rows[:, np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0]) < k]


def _table(parts: list[np.ndarray], query_ids: np.ndarray, k: int) -> pa.Table:
    row, found, bits = _best(parts, k)
    return pa.table({"query_id": pa.array(query_ids[row], pa.int64()), "vec_id": pa.array(found), "score": pa.array(np.ascontiguousarray(bits).view(np.float64))})


def _few_of_each(ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """The rows to keep: of equal vectors those of the ``keep`` smallest ids."""
    _, same = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    starts = np.searchsorted(same[order], same[order])
    return np.sort(order[np.arange(len(ids)) - starts < keep])


def usable(embeddings: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``x`` and ``size``, without rows whose id or vector is null or empty, or whose vector is zero or
    holds a null or non-finite component. Other columns are dropped."""
    v = F.col("_v")
    frame = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    frame = frame.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine)
    return frame.select("vec_id", F.col("_v").alias("x"), F.size("_v").alias("size"))


def scan(vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The exact k nearest of a bounded set of queries, by comparing them with all rows: each task keeps the best
    it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held += _nearest(batch.column("vec_id").to_numpy(), _matrix(batch.column("x")), query_ids, queries, k)
                if len(held) > 8:
                    held = [_best(held, k)]
        yield from _table(held, query_ids, k).to_batches()

    return _ranked(vectors.select("vec_id", "x").mapInArrow(run, _FOUND), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """One row for each id a query has found, the k best of them."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fit(vectors: DataFrame, queries: DataFrame, k: int, *, tables: int = TABLES, target: float = TARGET, seed: int = 1) -> tuple[Hashes, np.ndarray]:
    """The cheapest setting found to reach the target, and the sets of boundaries its probes cross."""
    total = vectors.count()
    row = vectors.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)))).first()
    longest = float(row[0]) * (1 + 1e-12)
    by_hash = lambda frame, n: frame.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(n).collect()  # noqa: E731  n is a bound
    tuning = by_hash(queries.select("vec_id", "x"), TUNING_QUERIES)
    sample = np.array([r["x"] for r in by_hash(vectors.select("vec_id", "x"), SAMPLE_ROWS)])
    ids, asked = np.array([r["vec_id"] for r in tuning]), np.array([r["x"] for r in tuning])
    true = scan(vectors, ids, asked, k).select("query_id", "vec_id")
    near = vectors.join(F.broadcast(true), "vec_id").select("query_id", "x").collect()  # k a tuning query, repeated ids apart
    by_id = np.argsort(ids, kind="stable")
    who = by_id[np.searchsorted(ids[by_id], np.array([r["query_id"] for r in near], np.int64))]
    close = np.array([r["x"] for r in near]).reshape(len(near), asked.shape[1])

    # About a bucket in 2.6 a function is in use; from 16 rows a bucket on, ever coarser ones.
    finest = int(np.clip(round(np.log2(max(total, 2) / 16) / 1.37), 2, 24))
    best = None
    for width in range(finest, 1, -1):
        # Coarser still only while that helps.
        if width < finest - 5 and best is not None and not best[0] and best[2].width > width + 1:
            break
        hashes = Hashes.draw(asked.shape[1], width, tables, longest, seed)
        sets = crossings(width, MAX_PROBES)
        hashes = replace(hashes, probes=tables * len(sets))
        table, bucket = hashes.probed(asked, sets)
        own, other = (hashes.buckets(np.floor(hashes.places(v, query=False))) for v in (close, sample))
        hit = np.full(len(close), table.shape[1])
        visited = np.zeros(table.shape[1])
        for i in range(len(asked)):
            mine = np.flatnonzero(who == i)
            for t in range(tables):
                at = np.flatnonzero(table[i] == t)  # ascending cost
                order = np.argsort(bucket[i, at])
                numbers = bucket[i, at][order]
                for rows, where in ((own[mine, t], "near"), (other[:, t], "all")):
                    place = np.minimum(np.searchsorted(numbers, rows), len(numbers) - 1)
                    found = numbers[place] == rows
                    probe = at[order[place]]
                    if where == "near":
                        hit[mine[found]] = np.minimum(hit[mine[found]], probe[found])
                    else:
                        visited += np.bincount(probe[found], minlength=len(visited))
        reached = np.arange(1, len(visited) + 1)
        share = np.searchsorted(np.sort(hit), reached, "left") / max(1, len(hit))
        enough = np.flatnonzero(share >= target)
        probes = int(enough[0]) + 1 if len(enough) else len(visited)
        # Rows compared, and the cost of a probe itself as so many rows.
        work = visited[:probes].sum() / len(asked) / len(sample) * total + PROBE_ROWS * probes
        choice = (not len(enough), -share[probes - 1] if not len(enough) else work, replace(hashes, probes=probes), sets)
        if best is None or choice[:2] < best[:2]:
            best = choice
    return best[2], best[3]


def _split_units(counts: DataFrame) -> DataFrame:
    """Of (table, bucket, rows, visits): into how many parts each side of a unit is split, where it is at all."""
    parts = F.ceil(F.col("rows") / UNIT_ROWS).cast("int").alias("parts")
    blocks = F.ceil(F.col("visits") / UNIT_QUERIES).cast("int").alias("blocks")
    return counts.where((F.col("rows") > UNIT_ROWS) | (F.col("visits") > UNIT_QUERIES)).select("table", "bucket", parts, blocks)


def search(vectors: DataFrame, queries: DataFrame, hashes: Hashes, sets: np.ndarray, k: int) -> DataFrame:
    """What hashing finds: ``query_id``, ``rank``, ``vec_id``, ``score``; a query may have found fewer than k."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # A query returns at most k of equal vectors, and leaves out its own id.
                batch = batch.take(pa.array(_few_of_each(batch.column("vec_id").to_numpy(), _matrix(batch.column("x")), k + 1)))
                buckets = hashes.buckets(np.floor(hashes.places(_matrix(batch.column("x")), query=False)))
                for table in range(hashes.tables):
                    number = pa.array(np.full(batch.num_rows, table, np.int32))
                    yield pa.RecordBatch.from_arrays([number, pa.array(np.ascontiguousarray(buckets[:, table])), batch.column("vec_id"), batch.column("x")], ["table", "bucket", "vec_id", "x"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                some = batch.slice(begin, 200)
                table, bucket = hashes.probed(_matrix(some.column("x")), sets)
                ids = np.repeat(some.column("query").to_numpy(), table.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(table.ravel()), pa.array(bucket.ravel())], ["query", "table", "bucket"])

    spark = vectors.sparkSession
    # A number for each query row: ids may repeat.
    asked = stage(queries.select(F.monotonically_increasing_id().alias("query"), "vec_id", "x"))
    rows = vectors.select("vec_id", "x").mapInArrow(index, "table int, bucket long, vec_id long, x array<double>")
    probes = stage(asked.select("query", "x").mapInArrow(probe, "query long, table int, bucket long"))
    held = rows.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    counts = stage(held.join(probes.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("visits")), ["table", "bucket"]))
    split = stage(_split_units(counts))
    split = F.broadcast(split) if split.count() <= BROADCAST_UNITS else split
    kept = counts.agg(F.sum("rows"), F.sum("visits")).first()
    shards = max(1, -(-(kept[0] or 0) // SHARD_ROWS))

    one = F.lit(1)
    block_of = lambda number, column: F.pmod(F.xxhash64(column), number).cast("int")
    unit = F.xxhash64("table", "bucket", "part", "block").alias("unit")
    left = rows.join(split, ["table", "bucket"], "left").withColumn("part", block_of(F.coalesce("parts", one), "vec_id"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", one) - 1))).select(unit, "vec_id", "x")
    right = probes.join(counts.select("table", "bucket"), ["table", "bucket"]).join(split, ["table", "bucket"], "left")
    right = right.withColumn("block", block_of(F.coalesce("blocks", one), "query"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", one) - 1))).select("query", unit)
    shard = F.pmod(F.col("unit"), F.lit(shards)).cast("int").alias("shard")
    visits = right.select("query", "unit", shard).groupBy("query", "shard").agg(F.collect_list("unit").alias("units"))  # at most the probes of a query
    visits = visits.join(asked, "query")

    def meet(_, rows: pa.Table, visits: pa.Table) -> pa.Table:
        if not rows.num_rows or not visits.num_rows:
            return _table([], np.zeros(0, np.int64), k)
        units = visits["units"].combine_chunks()
        units = pa.concat_arrays(units.chunks) if isinstance(units, pa.ChunkedArray) else units
        who = np.repeat(np.arange(len(units)), np.diff(units.offsets.to_numpy()))
        number = units.flatten().to_numpy()
        by_unit = np.argsort(number, kind="stable")
        who, number = who[by_unit], number[by_unit]
        query_ids, queries = visits["vec_id"].to_numpy(), _matrix(visits["x"])
        order = np.argsort(rows["unit"].to_numpy(), kind="stable")
        unit, ids, vectors = rows["unit"].to_numpy()[order], rows["vec_id"].to_numpy()[order], _matrix(rows["x"])[order]
        found, size = [], 0
        begins = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        for begin, end in zip(begins, np.r_[begins[1:], len(unit)], strict=True):
            first, last = np.searchsorted(number, unit[begin], "left"), np.searchsorted(number, unit[begin], "right")
            if first == last:
                continue
            mine = who[first:last]
            keep = begin + _few_of_each(ids[begin:end], vectors[begin:end], k + 1)
            for part in _nearest(ids[keep], vectors[keep], query_ids[mine], queries[mine], k):
                part[0] = mine[part[0]]
                found.append(part)
                size += part.shape[1]
            if size > 2_000_000:
                found = [_best(found, k)]
                size = found[0].shape[1]
        return _table(found, query_ids, k)

    dealt = left.withColumn("shard", shard)
    met = dealt.groupBy("shard").cogroup(visits.select("shard", "vec_id", "x", "units").groupBy("shard")).applyInArrow(meet, _FOUND)
    return _ranked(met, k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, tables: int = TABLES, target: float = TARGET, seed: int = 1) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: about the k rows of the largest inner product with each
    query, its own id left out, ties to the smaller id. Both inputs as by :func:`usable`; only vectors of the query's
    number of components compete. A query for which hashing finds fewer than k rows is compared with all of them, so
    fewer come back only where there are no more. An id with several vectors competes with each and counts
    once, with its best; a query id with several vectors gets the best k over all. Without rows or queries the result is
    empty. Norms and products are doubles: components beyond about 1e150 leave their range.
    """
    spark = vectors.sparkSession
    vectors, queries = stage(vectors), stage(queries)
    out = []
    for row in queries.select("size").distinct().orderBy("size").collect():  # the different numbers of components
        own, asked = (frame.where(F.col("size") == row["size"]) for frame in (vectors, queries))
        if own.isEmpty():
            continue
        hashes, sets = fit(own, asked, k, tables=tables, target=target, seed=seed)
        found = stage(search(own, asked, hashes, sets, k))
        complete = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
        few = stage(asked.join(complete, "vec_id", "left_anti"))
        blocks = -(-few.count() // EXACT_QUERIES)
        exact = []
        for number in range(blocks):
            some = few.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).select("vec_id", "x").collect()  # EXACT_QUERIES about
            if some:
                exact.append(scan(own, np.array([r["vec_id"] for r in some]), np.array([r["x"] for r in some]), k))
        found = found.join(few.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti") if exact else found
        for part in exact:
            found = found.unionByName(part)
        out.append(found)
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
