"""Ranked lexical search for many items at once, with shared parts of their scores computed once.

A document's score for an item is a sum over the item's terms, so items that share terms share partial sums.
For a block of items the driver mines which term sets they share: terms that occur in the same items become one
node, then the pair of nodes that most items hold becomes a node of its own and takes the pair's place in them,
until no pair is shared. The result is a graph: leaves are terms, inner nodes add two or more nodes, an item adds
what is left to it. A task evaluates the graph for a batch of documents at a time: each node's accumulator, one
number for each document, is filled once and read by all nodes and items above it.

Two passes: the first splits the texts into terms, stores what a document holds of the block's terms and counts; the
second scores what was stored. Each task gives an item's best documents of its own, so what is shuffled is bounded
by tasks, items and k. Items are taken in blocks of ``BLOCK_ITEMS``, so that neither the driver nor a task holds
more of them, however many there are.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideline.llm.arrow import release, texts_of
from strideline.operators.staging import stage

#: Items that are evaluated together; each block scans the documents.
BLOCK_ITEMS = 1_000
#: Nodes among which shared pairs are looked for, those of the most items first; the others are added one by one.
MINED_NODES = 4_096
#: Documents whose accumulators a task holds at once.
BATCH_DOCS = 512

# Fixed values of the score.
_SATURATION = (1_000_000_000, 1_000, 20)
_LENGTH = (50, 50)

#: Letters and digits of ASCII and everything beyond it belong to terms; only A-Z are lowered.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Graph:
    """Which nodes are added to which. Nodes 0 to ``leaves`` - 1 are terms; the others come by levels.

    ``levels`` holds (first node, child numbers, where each node's children begin) of inner nodes, ``items`` the
    same of the items' own sums.
    """

    leaves: int
    nodes: int
    levels: list[tuple[int, np.ndarray, np.ndarray]]
    items: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def mine(sets: list[list[int]], leaves: int, *, mined: int = MINED_NODES) -> Graph:
        """The graph of items given as lists of distinct terms, none of them empty."""
        holders: dict[int, list[int]] = {}
        for item, held in enumerate(sets):
            for term in held:
                holders.setdefault(term, []).append(item)
        same: dict[tuple[int, ...], list[int]] = {}
        for term in sorted(holders):
            same.setdefault(tuple(holders[term]), []).append(term)

        parts: list[list[int]] = []  # children of inner node ``leaves + i``
        rows: list[tuple[int, tuple[int, ...]]] = []  # (node, the items that hold it)
        for items, members in same.items():
            if len(members) > 1:
                parts.append(members)
                rows.append((leaves + len(parts) - 1, items))
            else:
                rows.append((members[0], items))
        rows.sort(key=lambda r: (-len(r[1]), r[0]))
        tops: list[list[int]] = [[] for _ in sets]
        for node, items in rows[mined:]:
            for item in items:
                tops[item].append(node)
        names = [node for node, _ in rows[:mined]]
        held = [sum(1 << item for item in items) for _, items in rows[:mined]]

        # The most shared pair first. Entries of the heap may be outdated: they are counted again when they come up.
        of_item: list[set[int]] = [set() for _ in sets]
        for at, (_, items) in enumerate(rows[:mined]):
            for item in items:
                of_item[item].add(at)
        matrix = np.zeros((len(names), len(sets)), np.float32)
        for at, (_, items) in enumerate(rows[:mined]):
            matrix[at, list(items)] = 1
        heap: list[tuple[int, int, int]] = []
        for begin in range(0, len(names), 512):
            shared = matrix[begin : begin + 512] @ matrix.T
            one, two = np.nonzero(shared >= 2)
            keep = one + begin < two
            heap += zip((-shared[one[keep], two[keep]]).astype(int).tolist(), (one[keep] + begin).tolist(), two[keep].tolist(), strict=True)
        heapq.heapify(heap)
        while heap:
            count, one, two = heapq.heappop(heap)
            both = held[one] & held[two]
            now = both.bit_count()
            if now != -count:
                if now >= 2:
                    heapq.heappush(heap, (-now, one, two))
                continue
            parts.append([names[one], names[two]])
            new = len(names)
            names.append(leaves + len(parts) - 1)
            held[one] &= ~both
            held[two] &= ~both
            held.append(both)
            beside: Counter[int] = Counter()
            for item in _bits(both):
                of_item[item] -= {one, two}
                beside.update(of_item[item])
                of_item[item].add(new)
            for other, n in beside.items():
                if n >= 2:
                    heapq.heappush(heap, (-n, other, new))
        for item, nodes in enumerate(of_item):
            tops[item] += [names[n] for n in sorted(nodes)]
        return Graph._levelled(leaves, parts, tops)

    @staticmethod
    def _levelled(leaves: int, parts: list[list[int]], tops: list[list[int]]) -> Graph:
        """Renumber inner nodes by level, so that a level is filled by one sum over its children."""
        depth: list[int] = []
        for children in parts:  # children come before their node
            depth.append(1 + max((depth[c - leaves] if c >= leaves else 0) for c in children))
        order = sorted(range(len(parts)), key=lambda i: (depth[i], i))
        number = {leaves + i: leaves + at for at, i in enumerate(order)}
        renamed = lambda children: [number.get(c, c) for c in children]
        levels, at = [], 0
        while at < len(order):
            end = at
            while end < len(order) and depth[order[end]] == depth[order[at]]:
                end += 1
            levels.append((leaves + at, *_joined([renamed(parts[i]) for i in order[at:end]])))
            at = end
        return Graph(leaves, leaves + len(parts), levels, _joined([renamed(t) for t in tops]))

    def additions(self) -> int:
        """How many accumulators are added for a batch of documents."""
        return sum(len(children) for _, children, _ in self.levels) + len(self.items[0])

    def evaluate(self, accumulators: np.ndarray) -> np.ndarray:
        """Fill the inner nodes' rows of ``accumulators`` (nodes x documents), return the items' sums."""
        for first, children, begins in self.levels:
            accumulators[first : first + len(begins)] = np.add.reduceat(accumulators[children], begins, axis=0)
        out = np.empty((len(self.items[1]), accumulators.shape[1]), accumulators.dtype)
        children, begins = self.items
        for a in range(0, len(begins), 64):  # some items at a time: their children need not be copied all at once
            b = min(a + 64, len(begins))
            low, high = begins[a], begins[b] if b < len(begins) else len(children)
            out[a:b] = np.add.reduceat(accumulators[children[low:high]], begins[a:b] - low, axis=0)
        return out


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(one) for one in lists]
    return np.array([x for one in lists for x in one], np.int64), np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0, np.int64)


def _bits(number: int) -> Iterator[int]:
    while number:
        low = number & -number
        yield low.bit_length() - 1
        number ^= low


@dataclass
class _Best:
    """An item's best documents so far: by score, then document."""

    k: int
    items: int

    def __post_init__(self):
        self.rows = np.zeros((0, 4), np.int64)  # item, score, document has no id, document id
        self.bar = np.ones(self.items, np.int64)

    def add(self, scores: np.ndarray, keys: np.ndarray, unknown: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.bar[:, None])
        if not len(item):
            return
        fresh = np.stack([item, scores[item, doc], unknown[doc], keys[doc]], 1)
        rows = np.concatenate([self.rows, fresh])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        starts = np.searchsorted(rows[:, 0], np.arange(self.items + 1))
        nth = np.arange(len(rows)) - starts[rows[:, 0]]
        self.rows = rows[nth < self.k]
        last = self.rows[nth[nth < self.k] == self.k - 1]
        self.bar[last[:, 0]] = last[:, 1]


def _block(items: DataFrame, number: int) -> tuple[list[int | None], list[list[int]], list[bytes]]:
    """Ids, term lists and vocabulary of one block; rows of one id are one item with the terms of all."""
    found: dict[int | None, set[bytes]] = {}
    for row in items.where(F.col("block") == number).select("id", "text").toLocalIterator():  # BLOCK_ITEMS about
        found.setdefault(row["id"], set()).update(terms(row["text"] or ""))
    held = {key: own for key, own in found.items() if own}
    vocabulary = sorted(set().union(*held.values())) if held else []
    place = {term: i for i, term in enumerate(vocabulary)}
    return list(held), [sorted(place[t] for t in own) for own in held.values()], vocabulary


def _postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id``, ``n`` (its terms with repeats) and the block's terms in it with how often they occur;
    documents without any term are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        place = {term: i for i, term in enumerate(vocabulary)}
        for batch in batches:
            for begin, texts in texts_of(batch, "text"):
                sizes, held, times = [], [], []
                for text in texts:
                    words = terms(text)
                    own = Counter(words)
                    known = [(place[t], n) for t, n in own.items() if t in place] if len(own) < len(place) else [(i, own[t]) for t, i in place.items() if t in own]
                    sizes.append(len(words))
                    held.append([i for i, _ in known])
                    times.append([n for _, n in known])
                columns = [batch.column("key").slice(begin, len(texts)), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "times"]).filter(pa.array([n > 0 for n in sizes], pa.bool_()))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def _frequencies(postings: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, all their terms, and how many documents hold each of the block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, length, counts = 0, 0, np.zeros(size, np.int64)
        for batch in batches:
            docs += batch.num_rows
            length += int(batch.column("n").to_numpy().sum())
            counts += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64), minlength=size)
        seen = np.flatnonzero(counts)
        keys, values = np.r_[-1, -2, seen], np.r_[docs, length, counts[seen]]
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(values.astype(np.int64))], ["term", "n"])

    partial = postings.select("n", "terms").mapInArrow(run, "term int, n long")
    found = {r["term"]: r["n"] for r in partial.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the block
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(i, 0) for i in range(size)], np.int64)


def weights(documents: int, held_by: np.ndarray) -> np.ndarray:
    """Of terms, from the number of documents and of those that hold each."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held_by], np.int64)


def _best_of(postings: DataFrame, graph: Graph, k: int, documents: int, length: int, weight: np.ndarray) -> DataFrame:
    """(item, doc_id, score) of each task's best documents for each item of the block."""
    top, by_times, by_length = _SATURATION
    flat, share = _LENGTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        best = _Best(k, len(graph.items[1]))
        accumulators = np.zeros((graph.nodes, BATCH_DOCS), np.int64)
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(begin, BATCH_DOCS)
                rows = batch.num_rows
                n = batch.column("n").to_numpy()
                held = batch.column("terms")
                doc = np.repeat(np.arange(rows), np.diff(held.offsets.to_numpy()))
                term = held.flatten().to_numpy(zero_copy_only=False)
                times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                # In Python numbers: 50 * n * N may leave a long.
                m = np.array([flat + share * x * documents // length for x in n.tolist()], np.int64)
                accumulators[: graph.leaves] = 0
                accumulators[term, doc] = weight[term] * ((top * times) // (by_times * times + by_length * m[doc]))
                scores = graph.evaluate(accumulators)[:, :rows]
                keys = batch.column("doc_id")
                best.add(scores, keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False).astype(np.int64))
        item, score, unknown, doc = best.rows.T
        columns = [pa.array(item.astype(np.int32)), pa.array(doc, mask=unknown.astype(bool)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return postings.mapInArrow(run, "item int, doc_id long, score long")


def rank(
    docs: DataFrame, items: DataFrame, k: int, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: each item's k documents of the highest score above 0.

    Equal scores go by ascending ``doc_id``, documents without an id last; each row of ``docs`` is a document of its
    own, also where ids or texts repeat. Null and empty texts have no terms: such documents are not counted, such items
    get no rows. Rows of ``items`` with one id (null is one too) are one item with the terms of all of them. Other
    columns are ignored. No documents or no items give no rows.
    """
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    blocks = max(1, -(-asked.select("id").distinct().count() // block_items))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    out = []
    for number in range(blocks):
        ids, sets, vocabulary = _block(asked, number)
        if not sets:
            continue
        postings = stage(_postings(source, vocabulary))
        documents, length, held_by = _frequencies(postings, len(vocabulary))
        if not documents:
            continue
        found = _best_of(postings, Graph.mine(sets, len(vocabulary)), k, documents, length, weights(documents, held_by))
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = docs.sparkSession.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # a block's items
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
