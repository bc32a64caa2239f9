"""Packing documents into as few fixed-length sequences as possible, by linear grouping.

Lengths are whole numbers up to the capacity, so the whole problem is a histogram of at
most that many entries, however large the corpus: the plan is made from it, and the
documents only look their places up.

1. Pieces longer than a third of the capacity are large. Sorted by length they fall
   into groups of equal cardinality; each length counts as the largest of its group.
2. The few sizes make a cutting-stock problem: configurations come from column generation
   (simplex on the group sizes, knapsack for pricing), used as often as the rounded-down
   solution says.
3. Each configuration takes actual lengths from its groups, longest first. They are no
   longer than the size they stand for, so they fit.
4. What is left of the large ones, then the small ones, goes by falling length into the
   fullest sequence that has room; a new one is opened only if none has.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideline.llm.arrow import binary, texts_of
from strideline.llm.units import UnitEncoder
from strideline.operators.staging import staging_path

GROUPS = 256
LARGE_SHARE = 3

Run = tuple[int, int]  # length, how many
Bins = tuple[tuple[int, ...], int]  # the lengths in a sequence, how many such sequences


def linear_groups(runs: list[Run], groups: int) -> list[list[Run]]:
    """Split runs, longest first, into at most so many groups of equal cardinality."""
    size = -(-sum(n for _, n in runs) // groups)
    out: list[list[Run]] = []
    room = 0
    for length, n in runs:
        while n:
            if not room:
                out.append([])
                room = size
            part = min(n, room)
            out[-1].append((length, part))
            room, n = room - part, n - part
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 1000) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (how many of each size) with how often each is used, rounded down.

    Column generation for the fractional cutting-stock problem: the basis holds one
    configuration a size; a new one enters while the knapsack finds one worth over 1.
    """
    m = len(sizes)
    need = np.array(demand, float)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    amount = need / basis.diagonal()
    order, least = np.array(sizes), min(sizes)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(m))
        # Every size is at least ``least``, so a block of that many rooms needs earlier blocks alone.
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for begin in range(least, capacity + 1, least):
            room = np.arange(begin, min(begin + least, capacity + 1))
            before = room[:, None] - order
            values = np.where(before >= 0, best[np.maximum(before, 0)] + worth, -1.0)
            item = values.argmax(1)
            value = values[np.arange(len(room)), item]
            best[room] = np.maximum(np.maximum.accumulate(value), best[begin - 1])
            pick[room] = np.where(value >= best[room], item, -1)
        if best[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(m), capacity
        while room > 0:
            if pick[room] < 0:
                room -= 1
            else:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        change = np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(ratio.argmin())
        step = ratio[leaves]
        amount = np.maximum(amount - step * change, 0)
        amount[leaves], basis[:, leaves] = step, column
    return [(tuple(int(k) for k in basis[:, j]), int(amount[j] + 1e-9)) for j in range(m) if amount[j] + 1e-9 >= 1]


def _take(queue: list[Run], wanted: int) -> list[Run]:
    out = []
    while wanted and queue:
        length, n = queue[0]
        part = min(n, wanted)
        out.append((length, part))
        wanted -= part
        queue[:1] = [(length, n - part)] if n > part else []
    return out


def fill(slots: list[list[Run]], times: int) -> list[Bins]:
    """``times`` sequences, each with one length from each slot; a slot may run out early."""
    cuts = sorted({times, *(c for runs in slots for c in np.cumsum([n for _, n in runs]).tolist())})
    out, begin, places = [], 0, [[0, 0] for _ in slots]
    for end in cuts:
        items = []
        for runs, place in zip(slots, places, strict=True):
            if place[0] < len(runs):
                length, n = runs[place[0]]
                items.append(length)
                place[1] += end - begin
                if place[1] == n:
                    place[:] = [place[0] + 1, 0]
        if items:
            out.append((tuple(items), end - begin))
        begin = end
    return out


def best_fit(bins: list[Bins], runs: list[Run], capacity: int) -> list[Bins]:
    """Put the runs, longest first, into the fullest sequences with room, opening new ones as needed."""
    by_gap: dict[int, list[Bins]] = {}
    gaps: list[int] = []

    def put(items: tuple[int, ...], times: int) -> None:
        if times:
            gap = capacity - sum(items)
            if gap not in by_gap:
                by_gap[gap] = []
            if not by_gap[gap]:
                insort(gaps, gap)
            by_gap[gap].append((items, times))

    for items, times in bins:
        put(items, times)
    for length, n in runs:
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                put((), -(-n // (capacity // length)))
                continue
            gap = gaps[at]
            items, times = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps.pop(at)
            each = gap // length
            whole = min(times, n // each)
            put(items + (length,) * each, whole)
            n -= whole * each
            left = times - whole
            if left and n and whole * each + n < times * each:
                put(items + (length,) * n, 1)
                left, n = left - 1, 0
            put(items, left)
    return [b for held in by_gap.values() for b in held if b[0]]


def plan(histogram: Mapping[int, int], capacity: int, groups: int = GROUPS) -> list[Bins]:
    """Sequences for the pieces of a histogram (length: how many), all lengths within the capacity."""
    runs = sorted(((length, n) for length, n in histogram.items() if n), reverse=True)
    bins: list[Bins] = [((length,), n) for length, n in runs if length == capacity]
    large = [(length, n) for length, n in runs if capacity // LARGE_SHARE < length < capacity]
    small = [(length, n) for length, n in runs if length <= capacity // LARGE_SHARE]
    left: list[Run] = []
    if large:
        queues: dict[int, list[Run]] = {}
        for group in linear_groups(large, groups):
            queues.setdefault(group[0][0], []).extend(group)
        sizes = list(queues)
        for counts, times in configurations(sizes, [sum(n for _, n in queues[s]) for s in sizes], capacity):
            slots = [_take(queues[s], times) for s, k in zip(sizes, counts, strict=True) for _ in range(k)]
            bins += fill([slot for slot in slots if slot], times)
        rest: dict[int, int] = {}
        for queue in queues.values():
            for length, n in queue:
                rest[length] = rest.get(length, 0) + n
        left = sorted(rest.items(), reverse=True)
    return best_fit(bins, [*left, *small], capacity)


def places(bins: list[Bins]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a sequence, offset), sorted: the piece
    of ``rank`` r among those of its length lies in sequence first + (r - first rank) // copies."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for items, times in bins:
        offset = 0
        for length in sorted(set(items), reverse=True):
            copies = items.count(length)
            rows.append((length, used.get(length, 0), first, copies, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += copies * length
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts, append ``end_id``, cut what is longer than the capacity.

    Gives ``doc_id``, ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit),
    and where the row was made: ``part`` (task) and ``local`` (its rank among the task's pieces
    of that length). Write the result before use: the last two must not be computed twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = UnitEncoder.of(tokenizer_file)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        names = ["doc_id", "piece", "start", "length", "part", "local", "ids"]
        for batch in batches:
            for begin, texts in texts_of(batch, "text", 8 << 20):
                keys, rows = batch.column("key").slice(begin, len(texts)), []
                for at, value in enumerate(own.encode(texts)):
                    ids = np.append(np.frombuffer(value, own.dtype).astype("<u4"), np.uint32(end_id))
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        some = ids[start : start + capacity]
                        rows.append((at, piece, start, len(some), seen[len(some)], some.tobytes()))
                        seen[len(some)] += 1
                at, piece, start, length, local, ids = zip(*rows, strict=True)
                numbers = [pa.array(np.array(x, np.int64)) for x in (piece, start, length, [part] * len(rows), local)]
                numbers[0] = numbers[0].cast(pa.int32())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *numbers, binary(list(ids))], names)

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, part long, local long, ids binary")


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int, *, key: str = "doc_id", text: str = "text", groups: int = GROUPS) -> tuple[DataFrame, DataFrame]:
    """Pack all documents; returns (pieces, placement), to be joined on ``part``, ``length`` and ``local``.

    ``pieces`` is the table of :func:`cut`; ``placement`` adds ``doc_id``, ``piece``, ``start``,
    ``crc32`` (of the piece's ids), ``sequence_id`` and ``offset``, and leaves the ids where they are. A null text is empty: one piece
    of the end id alone. Repeated and null keys are packed like any other row. An empty table packs to nothing.
    """
    spark = docs.sparkSession
    path = staging_path(spark)
    cut(docs, tokenizer_file, end_id, capacity, key=key, text=text).write.option("compression", "zstd").parquet(path)
    pieces = spark.read.parquet(path)

    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # At most one row for each length up to the capacity.
    histogram = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(histogram, capacity, groups))

    # Ranks over all tasks: a piece's rank in its task after the pieces of earlier tasks.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = pieces.select("doc_id", "piece", "start", "length", "part", "local", F.crc32("ids").alias("crc32"))
    ranked = own.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local")).drop("base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            row = np.empty(len(length), np.int64)
            for one in np.unique(length):
                mine, begin = length == one, first_of[one]
                row[mine] = begin + np.searchsorted(table[begin : first_of[one + 1], 1], rank[mine], "right") - 1
            inside = rank - table[row, 1]
            sequence = table[row, 2] + inside // table[row, 3]
            offset = table[row, 4] + inside % table[row, 3] * length
            keep = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "part", "local", "crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "part", "local", "crc32", "sequence_id", "offset"])

    placement = ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, part long, local long, crc32 long, sequence_id long, offset long")
    return pieces, placement


def sequences(pieces: DataFrame, placement: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and ``ids``, at most a capacity each."""
    joined = pieces.select("part", "length", "local", "ids").join(placement.select("part", "length", "local", "sequence_id", "offset"), ["part", "length", "local"])
    held = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    return held.select("sequence_id", F.aggregate("held", F.lit(b""), lambda all_, one: F.concat(all_, one["ids"])).alias("ids"))
