"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The unit is the byte: its alphabet is fixed, every text is covered, and an n-gram is a whole
number. The work per document is a sum over its n-grams, but documents don't travel as n-gram
rows. A chunk of documents asks once for each distinct n-gram it holds; the questions meet
the corpus counts in shards keyed by the last two context bytes, where an n-gram, its shorter
forms and all their contexts are together; the answers go back to the chunk. What a chunk and a
shard have for one another is one row: sorted n-grams as compressed differences, log probabilities
in 2048ths of a nat.

A document's own text must not speak for it where the threshold is found: every text belongs to
one of ``FOLDS`` folds by its hash, and besides the model of all trusted text there is one without
each fold. A chunk says of each n-gram which folds hold it, and is answered under their models
only; ``held_out`` is the perplexity under the model that has not seen the document, nor any equal one.

Three passes read the documents: one that counts the trusted ones, in whatever tasks the labels'
join puts them; one that asks; and one that sends them, compressed, to meet their answers. The
last two are the same plain scan, so that their chunks are the same whatever the size of the labels.
Counts are merged shard by shard, at most ``FAN_IN`` chunks at a time, in as many rounds as that takes;
questions meet a shard's model in groups of ``FAN_IN`` chunks too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.arrow import binary, release
from strideline.operators.staging import discard, stage

ORDER = 6
#: Parts of the trusted text; the models without one of them give the held-out scores.
FOLDS = 4
#: Trusted ids that are broadcast at most; beyond it the labels are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of text a chunk holds about (and at least one document).
CHUNK_BYTES = 24 << 20
#: Bytes of text whose n-grams are held at once.
RUN_BYTES = 2 << 20
#: Text a shard of the model stands for about, the fewest and the most shards.
SHARD_BYTES = 256 << 20
SHARDS = (32, 4_096)
#: Chunks whose rows for one shard meet in one task.
FAN_IN = 256
#: Log probabilities travel in this part of a nat, up to 32 nats.
STEPS = 2_048
#: A document is rejected above this quantile of the held-out scores of its language's trusted documents.
QUANTILE = 0.98
#: Short texts scatter: a text of n bytes is judged by its log perplexity less SHORT / sqrt(n).
SHORT = 2.0

_CODEC = pa.Codec("zstd", compression_level=3)
_PAD = b"\n" * (ORDER - 1)


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram (an unsigned number, the last byte lowest) that ends at each byte of each text,
    the start padded with line feeds, and how many each text has."""
    raw = np.frombuffer(b"".join(_PAD + t for t in texts), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    grams = raw[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        grams |= raw[ORDER - 1 - back : len(raw) - back] << np.uint64(8 * back)
    inside = np.ones(len(grams), bool)  # not those that end in the padding between two texts
    ends = np.cumsum(sizes + ORDER - 1)[:-1]
    for pad in range(ORDER - 1):
        inside[ends - (ORDER - 1) + pad] = False
    return grams[inside], sizes


@dataclass(frozen=True)
class Discounts:
    """What is taken from counts of 1, 2 and more, per order from the second up."""

    by_order: dict[int, tuple[float, float, float]]

    @staticmethod
    def of(ones: list[int]) -> tuple[float, float, float]:
        """From the numbers of n-grams seen once to four times."""
        n1, n2, n3, n4 = (max(n, 0) for n in ones)
        if not (n1 and n2 and n3):
            return (0.5, 0.75, 0.9)  # too little text to estimate them
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        return tuple(min(max(d, 0.05), c - 0.05) for d, c in zip(found, (1, 2, 3), strict=True))  # type: ignore[return-value]


def bigram_table(continuations: np.ndarray, discount: tuple[float, float, float]) -> np.ndarray:
    """p(b | a) of the two lowest orders, 256 x 256, from the continuation counts of byte pairs."""
    followed = (continuations > 0).sum(0).astype(float)  # in how many contexts a byte comes
    one = (followed + 1) / (followed.sum() + 256)
    cut = np.choose(np.minimum(continuations, 3).astype(int), [np.zeros(1), *(np.full(1, d) for d in discount)])
    total = continuations.sum(1, keepdims=True)
    seen = np.maximum(total, 1)
    left = np.where(total > 0, cut.sum(1, keepdims=True) / seen, 1.0)
    return np.maximum(continuations - cut, 0) / seen + left * one


def _level(asked: np.ndarray, grams: np.ndarray, counts: np.ndarray, discount: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
    """Interpolated probabilities of one order; ``grams`` sorted, ``lower`` those of the shorter forms."""
    if not len(grams):
        return lower
    cut = np.array([0.0, *discount])[np.minimum(counts, 3)]
    contexts, start = np.unique(grams >> np.uint64(8), return_index=True)
    total = np.add.reduceat(counts.astype(float), start)
    left = np.add.reduceat(cut, start) / total
    at = np.minimum(np.searchsorted(grams, asked), len(grams) - 1)
    own = np.where(grams[at] == asked, counts[at] - cut[at], 0.0)
    where = np.minimum(np.searchsorted(contexts, asked >> np.uint64(8)), len(contexts) - 1)
    known = contexts[where] == asked >> np.uint64(8)
    return np.where(known, own / total[where] + left[where] * lower, lower)


def probabilities(asked: np.ndarray, grams: np.ndarray, counts: np.ndarray, discounts: Discounts, bigrams: np.ndarray) -> np.ndarray:
    """p(last byte | the bytes before) of asked n-grams, given all n-grams that share two context bytes with them.

    Below the highest order a count is the number of different bytes seen before the shorter form.
    """
    levels = [(grams, counts)]
    for order in range(ORDER - 1, 2, -1):
        shorter, n = np.unique(levels[-1][0] & np.uint64((1 << 8 * order) - 1), return_counts=True)
        levels.append((shorter, n))
    p = bigrams[((asked >> np.uint64(8)) & np.uint64(0xFF)).astype(int), (asked & np.uint64(0xFF)).astype(int)]
    for order, (keys, n) in zip(range(3, ORDER + 1), reversed(levels), strict=True):
        p = _level(asked & np.uint64((1 << 8 * order) - 1), keys, n, discounts.by_order[order], p)
    return p


def _trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a label calls good."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("key")).where("key is not null").distinct()
    small = good.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(good) if small else good, "key", "left_semi")


def _fold():
    """The fold of a text: equal texts share one."""
    return F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows of about a chunk's size with their number: the task in the upper bits."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        lengths = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = lengths[begin - 1] if begin else 0
            # One row at least, but not at the start of each batch: chunks don't depend on where batches end.
            end = max(begin + (not held), int(np.searchsorted(lengths, before + CHUNK_BYTES - size, "right")))
            if end == begin:
                yield number, pa.Table.from_batches(held)
                number, held, size = number + 1, [], 0
                continue
            held.append(batch.slice(begin, end - begin))
            size += int(lengths[end - 1] - before)
            begin = end
            if size >= CHUNK_BYTES or begin < batch.num_rows:
                yield number, pa.Table.from_batches(held)
                number, held, size = number + 1, [], 0
    if held:
        yield number, pa.Table.from_batches(held)


def _utf8(table: pa.Table) -> list[bytes]:
    return table["text"].cast(pa.binary()).fill_null(b"").to_pylist()


def _runs(texts: list[bytes]) -> Iterator[slice]:
    """Runs of about ``RUN_BYTES``, one text at least: what numpy makes of a byte takes some dozens."""
    begin = size = 0
    for at, text in enumerate(texts):
        if size and size + len(text) > RUN_BYTES:
            yield slice(begin, at)
            begin, size = at, 0
        size += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


def _distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of some texts, and how often each occurs."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for run in _runs(texts):
        found, n = np.unique(ngrams(texts[run])[0], return_counts=True)
        keys.append(found)
        counts.append(n)
    both, at = np.unique(np.concatenate(keys), return_inverse=True)
    return both, np.bincount(at, np.concatenate(counts), len(both)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers, compressed with equal bytes of all of them side by side."""
    raw = np.ascontiguousarray(values)
    return _CODEC.compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes(), asbytes=True)


def _numbers(body: bytes, n: int, dtype) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(_CODEC.decompress(body, n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


def _pack_grams(grams: np.ndarray) -> bytes:
    return _planes(np.diff(grams, prepend=np.uint64(0)))


def _unpack_grams(body: bytes, n: int) -> np.ndarray:
    return np.cumsum(_numbers(body, n, "<u8"), dtype=np.uint64)


def _by_shard(grams: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of sorted n-grams by shard of their last two context bytes, each still sorted."""
    shard = (((grams >> np.uint64(8)) * np.uint64(40_503) & np.uint64(0xFFFF)) * np.uint64(shards) >> np.uint64(16)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    begins = np.searchsorted(shard[order], np.arange(shards + 1))
    for one in np.flatnonzero(np.diff(begins)):
        yield int(one), order[begins[one] : begins[one + 1]]


def _folded(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different n-grams of a chunk, and how often each occurs in each fold."""
    texts, folds = _utf8(table), table["fold"].to_numpy()
    parts = [_distinct([texts[i] for i in np.flatnonzero(folds == fold)]) for fold in range(FOLDS)]
    both, at = np.unique(np.concatenate([grams for grams, _ in parts]), return_inverse=True)
    out, begin = [], 0
    for grams, n in parts:
        counts = np.zeros(len(both), np.int64)
        counts[at[begin : begin + len(grams)]] = n
        out.append(counts)
        begin += len(grams)
    return both, out


_COUNTED = "shard int, chunk long, n long, grams binary, " + ", ".join(f"n{i} binary" for i in range(1, FOLDS + 1))
_STATS = "part int, ctx int, next int, n long"


def _merge(table: pa.Table) -> pa.Table:
    """Counts of some chunks, added up."""
    held = [(_unpack_grams(r["grams"], r["n"]), [_numbers(r[f"n{i}"], r["n"], "<i8") for i in range(1, FOLDS + 1)]) for r in table.to_pylist()]
    grams, at = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
    out = {"shard": table["shard"][:1], "chunk": table["chunk"][:1], "n": pa.array([len(grams)], pa.int64()), "grams": binary([_pack_grams(grams)])}
    for i in range(FOLDS):
        counts = np.zeros(len(grams), np.int64)
        np.add.at(counts, at, np.concatenate([n[i] for _, n in held]))
        out[f"n{i + 1}"] = binary([_planes(counts)])
    return pa.table(out)


def _parts_of(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """A shard's n-grams with their counts in all trusted text and without each fold."""
    folds = [_numbers(row[f"n{i}"], row["n"], "<i8") for i in range(1, FOLDS + 1)]
    total = sum(folds)
    return _unpack_grams(row["grams"], row["n"]), [total, *(total - one for one in folds)]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of n-grams by count (``ctx`` is -order, ``next`` the count from 1 to 4) and of bytes before byte pairs."""
    release()
    for batch in batches:
        rows: list[tuple[int, int, int, int]] = []
        for row in batch.to_pylist():
            grams, parts = _parts_of(row)
            for part, counts in enumerate(parts):
                level = grams[counts > 0], counts[counts > 0]
                for order in range(ORDER, 2, -1):
                    if order < ORDER:
                        level = np.unique(level[0] & np.uint64((1 << 8 * order) - 1), return_counts=True)
                    rows += [(part, -order, c, int((level[1] == c).sum())) for c in (1, 2, 3, 4)]
                pair, n = np.unique(level[0] & np.uint64(0xFFFF), return_counts=True)
                rows += zip([part] * len(pair), (pair >> np.uint64(8)).tolist(), (pair & np.uint64(255)).tolist(), n.tolist(), strict=True)
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["part", "ctx", "next", "n"])


def _models(model: DataFrame) -> list[tuple[Discounts, np.ndarray]]:
    """Discounts and the table of the two lowest orders, for all trusted text and without each fold."""
    # At most 65,536 byte pairs and a few counts for each of the models.
    found = model.mapInArrow(_statistics, _STATS).groupBy("part", "ctx", "next").agg(F.sum("n").alias("n")).toArrow()
    part, ctx, after, n = (found[c].to_numpy() for c in ("part", "ctx", "next", "n"))
    out = []
    for number in range(FOLDS + 1):
        mine, pairs = part == number, np.zeros((256, 256))
        counted = {(-int(c), int(x)): int(v) for c, x, v in zip(ctx[mine & (ctx < 0)], after[mine & (ctx < 0)], n[mine & (ctx < 0)], strict=True)}
        own = mine & (ctx >= 0)
        pairs[ctx[own], after[own]] = n[own]
        ones = {order: [counted.get((order, c), 0) for c in (1, 2, 3, 4)] for order in range(3, ORDER + 1)}
        ones[2] = [int((pairs == c).sum()) for c in (1, 2, 3, 4)]
        discounts = Discounts({order: Discounts.of(values) for order, values in ones.items()})
        out.append((discounts, bigram_table(pairs, discounts.by_order[2])))
    return out


def score(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id``, ``lang``, ``n_bytes``, ``log_perplexity`` (nats per byte; null for empty texts) and ``held_out``,
    the same under the trusted text without the document's fold.

    ``docs`` must be a stored table, as it is read more than once and its rows have to come in the same tasks;
    an n-gram without an answer, which anything else would show as, ends the job. ``labels`` has
    ``doc_id`` and ``quality``; repeated labels count once. Without any trusted text all bytes are
    equally likely. Rows without an id or a language, repeated rows and empty or null texts are scored like any
    other; a text longer than a chunk is a chunk of its own. Other columns are ignored.
    """
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(min(max(-(-size // SHARD_BYTES), SHARDS[0]), SHARDS[1]))
    source = source.withColumn("fold", _fold())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for chunk, table in _chunks(batches):
            grams, folds = _folded(table)
            for shard, at in _by_shard(grams, shards):
                columns = [pa.array([shard], pa.int32()), pa.array([chunk]), pa.array([len(at)]), binary([_pack_grams(grams[at])]), *(binary([_planes(n[at])]) for n in folds)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "chunk", "n", "grams", *(f"n{i}" for i in range(1, FOLDS + 1))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for chunk, table in _chunks(batches):
            grams, folds = _folded(table)
            held_by = sum(((n > 0).astype(np.uint8) << np.uint8(i) for i, n in enumerate(folds)), np.zeros(len(grams), np.uint8))
            for shard, at in _by_shard(grams, shards):
                columns = [pa.array([shard], pa.int32()), pa.array([chunk]), pa.array([len(at)]), binary([_pack_grams(grams[at])]), binary([_planes(held_by[at])])]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "chunk", "n", "grams", "held_by"])

    trusted = _trusted(source.select("key", "text", "fold"), labels).select("text", "fold")
    counted = stage(trusted.mapInArrow(count, _COUNTED))
    model, groups = counted, max(1, counted.select("chunk").distinct().count())
    while True:
        groups = -(-groups // FAN_IN)
        merged = stage(model.withColumn("chunk", F.pmod(F.xxhash64("chunk"), F.lit(groups))).groupBy("shard", "chunk").applyInArrow(_merge, _COUNTED))
        discard(model)
        model = merged
        if groups == 1:
            break
    models = _models(model)

    def answer(_, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["chunk", "n", "grams", "held_by", *(f"p{i}" for i in range(FOLDS + 1))]
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), *[pa.binary()] * (FOLDS + 3)), strict=True)})
        row = right.to_pylist()[0] if right.num_rows else None
        grams, parts = _parts_of(row) if row else (np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * (FOLDS + 1))
        asked = [_unpack_grams(body, n) for body, n in zip(left["grams"].to_pylist(), left["n"].to_pylist(), strict=True)]
        once = np.unique(np.concatenate(asked))  # a shard answers each n-gram once, however many chunks ask for it
        logs = []
        for counts, (discounts, bigrams) in zip(parts, models, strict=True):
            p = probabilities(once, grams[counts > 0], counts[counts > 0], discounts, bigrams)
            logs.append(np.minimum(np.rint(-np.log(p) * STEPS), 65_535).astype("<u2"))
        out: list[list[bytes]] = [[] for _ in range(FOLDS + 1)]
        for own, body in zip(asked, left["held_by"].to_pylist(), strict=True):
            at, held_by = np.searchsorted(once, own), _numbers(body, len(own), np.uint8)
            out[0].append(_planes(logs[0][at]))
            for fold in range(FOLDS):
                out[fold + 1].append(_planes(logs[fold + 1][at[(held_by >> fold) & 1 > 0]]))
        return pa.table([left["chunk"], left["n"], left["grams"], left["held_by"], *(binary(bodies) for bodies in out)], names)

    # A shard's model is repeated for each group of chunks; there is one up to the text of FAN_IN chunks.
    questions = source.mapInArrow(ask, "shard int, chunk long, n long, grams binary, held_by binary")
    asking = max(1, -(-size // (CHUNK_BYTES * FAN_IN)))
    left = questions.withColumn("asking", F.pmod(F.xxhash64("chunk"), F.lit(asking)).cast("int"))
    right = model.withColumn("asking", F.explode(F.sequence(F.lit(0), F.lit(asking - 1))))
    answers = left.groupBy("shard", "asking").cogroup(right.groupBy("shard", "asking")).applyInArrow(answer, "chunk long, n long, grams binary, held_by binary, " + ", ".join(f"p{i} binary" for i in range(FOLDS + 1)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        codec = pa.Codec("zstd", compression_level=6)
        for chunk, table in _chunks(batches):
            for begin in range(0, table.num_rows, 2_000):
                some = table.slice(begin, 2_000)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as stream:
                    stream.write_table(some)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), binary([sink.getvalue().to_pybytes()])], ["chunk", "rows"])

    def add(_, left: pa.Table, right: pa.Table) -> pa.Table:
        held = [(_unpack_grams(r["grams"], r["n"]), _numbers(r["held_by"], r["n"], np.uint8), r) for r in right.to_pylist()]
        known = np.concatenate([np.zeros(0, np.uint64), *(grams for grams, _, _ in held)])
        order = np.argsort(known)
        known = np.append(known[order], np.uint64(1 << 8 * ORDER))  # the last one no text holds
        logs = []
        for part in range(FOLDS + 1):
            own = np.zeros(len(known), np.float32)
            begin = 0
            for grams, held_by, row in held:
                where = np.arange(begin, begin + len(grams))
                where = where if part == 0 else where[(held_by >> (part - 1)) & 1 > 0]
                own[where] = _numbers(row[f"p{part}"], len(where), "<u2") / np.float32(STEPS)
                begin += len(grams)
            own[:-1] = own[:-1][order]
            logs.append(own)
        out = []
        for body in left["rows"].to_pylist():
            table = pa.ipc.open_stream(body).read_all()
            texts, folds, means = _utf8(table), table["fold"].to_numpy(), []
            for run in _runs(texts):
                grams, sizes = ngrams(texts[run])
                at = np.searchsorted(known, grams)
                if (known[at] != grams).any():
                    raise RuntimeError("the documents came in other tasks than before: store them first")
                # A held-out probability comes from the model without the text's own fold.
                begins, some = np.cumsum(sizes) - sizes, sizes > 0
                held_out = np.empty(len(grams), np.float32)
                fold = np.repeat(folds[run].astype(np.int8), sizes)
                for number in range(FOLDS):
                    mine = fold == number
                    held_out[mine] = logs[number + 1][at[mine]]
                own = np.zeros((2, len(sizes)))
                if some.any():
                    for row, each in enumerate((logs[0][at], held_out)):
                        own[row, some] = np.add.reduceat(each.astype(float), begins[some])
                means.append(np.where(some, own / np.maximum(sizes, 1), np.nan))
            sizes = np.array([len(t) for t in texts], np.int64)
            means = [pa.array(values, from_pandas=True) for values in (np.concatenate(means, 1) if means else np.zeros((2, 0)))]
            out.append(pa.table({"doc_id": table["key"], "lang": table["lang"], "n_bytes": sizes, "log_perplexity": means[0], "held_out": means[1]}))
        types = (("doc_id", pa.int64()), ("lang", pa.string()), ("n_bytes", pa.int64()), ("log_perplexity", pa.float64()), ("held_out", pa.float64()))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in types})

    sent = source.mapInArrow(send, "chunk long, rows binary")
    return sent.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add, "doc_id long, lang string, n_bytes long, log_perplexity double, held_out double")


def judge(scored: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE) -> DataFrame:
    """Add ``score`` (log perplexity with the allowance for short texts), ``threshold`` (of the document's
    language, the quantile of the held-out scores of its trusted documents) and ``kept``.

    Languages without trusted documents, the null one too unless it has some, take the threshold of all
    trusted documents; without any, everything is kept but empty texts, which are always rejected.
    """
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    allowance = SHORT / F.sqrt("n_bytes")
    scored = stage(scored.withColumn("score", F.col("log_perplexity") - allowance))
    limit = F.percentile_approx(F.col("held_out") - allowance, F.lit(quantile), F.lit(10_000))
    trusted = scored.join(good, "doc_id", "left_semi").where("held_out is not null")
    scored = scored.drop("held_out")
    by_lang = trusted.groupBy("lang").agg(limit.alias("threshold"))
    overall = trusted.agg(limit.alias("threshold")).first()["threshold"]
    lang = by_lang.select(F.col("lang").alias("_lang"), "threshold")
    judged = scored.join(lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    judged = judged.withColumn("threshold", F.coalesce("threshold", F.lit(overall).cast("double")))
    return judged.withColumn("kept", F.col("log_perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("score") <= F.col("threshold"))))
