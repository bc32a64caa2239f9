"""N-gram Jaccard join: documents whose sets of word n-grams are similar.

MinHash signatures are cut into bands; documents that agree on a band are candidates, and
candidates are verified on their full n-gram sets. Numbers of bands and rows follow from the
threshold and the recall asked for.

Equal sets are one class from the start. Members of a band
bucket are linked to its smallest member only; connected components of these links bring
everything that could be similar together, and within a component blocks of bounded size meet
in pairs inside a task, which compares all sets whose sizes allow it and gives back counts and
a spanning forest, never the pairs. So links are exact within a component; what MinHash can miss
is a link between components, with the recall asked for where a single pair would join them.
A component of n different sets sends each of them once for each of its n / BLOCK blocks, and
compares n * n pairs at most: it is quadratic in the size of components, linear in their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.arrow import binary, held, texts_of
from strideline.operators.staging import stage

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
#: Hash functions a signature may take, and classes in a block of verification.
MOST_HASHES = 150
BLOCK = 256
#: Words whose hashes a worker keeps.
CACHE_WORDS = 500_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NONE = np.zeros(0, np.uint64)


def banding(similarity: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest false candidates, for which some number of bands
    within the hashes allowed finds a pair at the threshold with the recall asked for."""
    best = None
    for rows in range(1, most + 1):
        hit = similarity**rows
        bands = 1 if hit >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-hit)))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("too few hash functions for this recall")
    return best


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = value = xxhash.xxh3_64_intdigest(word.encode())
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def ngram_set(text: str, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the word n-grams; a text of fewer words is one n-gram, none is no n-gram."""
    hashes = held("word hashes", _WordHash)
    if len(hashes) > CACHE_WORDS:
        hashes.clear()
    found = _WORD.findall(text)
    if not found:
        return _NONE
    own = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(own))
    grams = np.full(len(own) - size + 1, size, np.uint64)
    for at in range(size):
        grams = _mixed(grams + own[at : len(own) - size + 1 + at])
    return np.unique(grams)


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_101)
    return rng.integers(0, 2**32, count, np.uint32) | np.uint32(1), rng.integers(0, 2**32, count, np.uint32)


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of minima."""
    factor, shift = _functions(bands * rows)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    minima = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(low), 2048):
        with np.errstate(over="ignore"):
            values = low[begin : begin + 2048, None] * factor + shift
        np.minimum(minima, values.min(0), out=minima)
    out = np.arange(bands, dtype=np.uint64)
    for row in minima.reshape(bands, rows).T:
        out = _mixed(out + row)
    return out


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``class`` (128 bits of the n-gram set; null without n-grams) and ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for begin, texts in texts_of(batch, "text"):
                sets = [ngram_set(t, words) for t in texts]
                classes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                signed = [signature(s, bands, rows).view(np.int64) if len(s) else None for s in sets]
                keys = batch.column("doc_id").slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([keys, binary(classes), pa.array(signed, pa.list_(pa.int64()))], ["doc_id", "class", "bands"])

    return docs.mapInArrow(run, "doc_id long, class binary, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for begin, texts in texts_of(batch, "text"):
                sets = [ngram_set(t, words) for t in texts]
                classes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                keys = batch.column("doc_id").slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([keys, binary(classes), binary([s.tobytes() for s in sets])], ["doc_id", "class", "grams"])

    return docs.mapInArrow(run, "doc_id long, class binary, grams binary")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node of its connected component, of links (``a``, ``b``).

    Large-star and small-star steps in turn: every step hangs neighbours onto the smallest node it can
    see, until all hang on roots. A step is aggregates by node and joins back, so a node with very many
    neighbours is combined before the shuffle and split by adaptive execution after it.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(rounds):
        # Large star: neighbours greater than a node go to the smallest in its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        large = stage(large)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = mark
    raise RuntimeError("the components did not settle")


def _compare(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        """Links between the two blocks of a group, or inside it if there is one block only."""
        classes = table["class"].to_pylist()
        sets = [np.frombuffer(s, np.uint64) for s in table["grams"].to_pylist()]
        side = table["side"].to_numpy()
        same = bool(table["same"][0].as_py())
        sizes = np.array([len(s) for s in sets], np.int64)
        # Sets share n-grams through their places in the group's vocabulary; each place lists the sets that hold it.
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        vocabulary, start = np.unique(flat[order], return_index=True)
        code = np.empty(len(flat), np.int64)
        code[order] = np.repeat(np.arange(len(vocabulary)), np.diff(np.r_[start, len(flat)]))
        holders, held_by = owner[order], np.diff(np.r_[start, len(flat)])
        count = np.zeros(len(sets), np.int64)
        parent = list(range(len(sets)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        ends = np.cumsum(sizes)
        left = range(len(sets)) if same else np.flatnonzero(side == 0).tolist()
        others = np.arange(len(sets)) if same else np.flatnonzero(side == 1)
        edges = []
        for i in left:
            rest = others[others > i] if same else others
            rest = rest[(np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i]) - 1e-9)]
            if not len(rest):
                continue
            own = code[ends[i] - sizes[i] : ends[i]]
            many = held_by[own]
            places = np.repeat(start[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            common = np.bincount(holders[places], minlength=len(sets))[rest]
            linked = rest[common >= similarity * (sizes[i] + sizes[rest] - common) - 1e-9]
            count[i] += len(linked)
            count[linked] += 1
            for j in linked.tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    edges.append((i, j))
        some = np.flatnonzero(count).tolist()
        a = [classes[i] for i in some] + [classes[i] for i, _ in edges]
        b = [None] * len(some) + [classes[j] for _, j in edges]
        n = [int(count[i]) for i in some] + [0] * len(edges)
        return pa.table({"a": binary(a), "b": binary(b), "links": pa.array(n, pa.int64())})

    return run


def jaccard_join(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """``doc_id``, ``copy_of``, ``class_id`` and ``n_links`` for every row with a key.

    ``copy_of`` is the smallest id among documents with the same n-gram set, ``class_id`` the smallest in
    the connected component of links, ``n_links`` the number of other sets at the similarity or above
    (in its component of candidates, see above).
    Texts without words, null ones too, are classes of their own. Rows without a key take no part and come
    back with nulls. A key with several texts stands for each of them.
    """
    bands, rows = banding(similarity, recall)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = stage(_signed(source, words, bands, rows))
    known = signed.where("doc_id is not null and class is not null")
    classes = stage(known.groupBy("class").agg(F.min("doc_id").alias("copy_of"), F.first("bands").alias("bands")))

    # Each bucket links its members to the smallest one. The aggregate combines before its shuffle.
    entries = classes.select("class", F.posexplode("bands").alias("band", "hash"))
    heads = entries.groupBy("band", "hash").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    links = entries.join(heads, ["band", "hash"]).where("class <> head").select(F.col("class").alias("a"), F.col("head").alias("b"))
    candidates = components(links)

    # Blocks of a component, in an order that any task would find again; then pairs of blocks.
    candidates = stage(candidates.select(F.col("node").alias("class"), F.col("root").alias("cluster")))
    sizes = candidates.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    picked = candidates.join(sizes, "cluster").join(classes.drop("bands"), "class")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    picked = picked.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    texts = source.where("doc_id is not null").join(picked.select(F.col("copy_of").alias("doc_id")).distinct(), "doc_id")
    sets = _sets(texts, words).dropDuplicates(["class"]).drop("doc_id")
    ready = picked.join(sets, "class").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ready = ready.select(
        "cluster", "class", "grams",
        F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("same"),
    )
    found = stage(ready.groupBy("cluster", "low", "high").applyInArrow(_compare(similarity), "a binary, b binary, links long"))

    counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("n_links"))
    linked = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("class"), "root")
    own = classes.select("class", "copy_of").join(linked, "class", "left").withColumn("root", F.coalesce("root", "class"))
    first = own.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    own = own.join(first, "root").join(counts, "class", "left").select("class", "copy_of", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = signed.select("doc_id", "class").join(own, "class", "left")
    alone = F.when(F.col("class").isNull(), F.col("doc_id"))
    return out.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("copy_of", alone)).alias("copy_of"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", alone)).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"),
    )
