"""Token-id files: frequency-ranked ids in byte-aligned variable-length code.

Ids are replaced by their frequency rank in the corpus, so that the common ones take one
byte. A rank takes 1 to 4 bytes; two bits for its length stand in separate control bytes,
four ranks to one. Decoding looks whole control bytes up in a table of byte masks.

A corpus is a folder of two tables: ``ranks`` (rank, id) and ``segments``. A segment is one
binary value, readable alone:

    magic ``SLT1``, u32 documents
    per document: u8 has id, i64 id
    per document: u32 tokens
    control bytes, document after document, each document starting a byte
    data bytes, document after document

Segments are numbered inside buckets, buckets are ranges of document ids; bucket, segment
and place in the segment give the ascending order of the corpus. They are stored through
Spark's own writer: any shared store will do, and a lost task is simply written again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm.arrow import binary, texts_of
from strideline.llm.units import UnitEncoder
from strideline.operators.staging import staging_path

MAGIC = b"SLT1"
#: Raw bytes of ids in a bucket (one task), and bytes of code in a segment.
BUCKET_BYTES = 24 << 20
SEGMENT_BYTES = 4 << 20

_STEP = np.arange(4, dtype=np.uint8)
_CODES = (np.arange(256)[:, None] >> (2 * np.arange(4))) & 3
#: For each control byte, which of the 4 x 4 bytes of its ranks are present.
_PRESENT = (_STEP <= _CODES[:, :, None]).reshape(256, 16)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    values = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    values[: len(ranks)] = ranks
    codes = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    shifts = codes.reshape(-1, 4).astype(np.uint8) << np.array([0, 2, 4, 6], np.uint8)
    present = _STEP <= codes[: len(ranks), None]
    return shifts.sum(1, dtype=np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[: len(ranks)][present].tobytes()


def encode_all(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """:func:`encode_ranks` of many documents, given one after another, at once."""
    groups = -(-counts // 4)
    first = 4 * (np.cumsum(groups) - groups)  # a document starts a control byte
    values = np.zeros(4 * int(groups.sum()), "<u4")
    place = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(ranks))
    values[place] = ranks
    codes = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()
    present = _STEP <= codes[:, None]
    padding = np.ones(len(values), bool)
    padding[place] = False
    present[padding] = False
    data = values.view(np.uint8).reshape(-1, 4)[present].tobytes()
    ends = np.concatenate([[0], np.cumsum(codes[place].astype(np.int64) + 1)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    marks = np.concatenate([[0], np.cumsum(groups)]).tolist()
    return [control[a:b] for a, b in zip(marks, marks[1:], strict=False)], [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def decode_ranks(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The numbers; ``data`` may go on beyond them."""
    return decode_all(control, data, np.array([count]))


def decode_all(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of many documents, one after another."""
    present = _PRESENT[control].reshape(-1, 4)
    groups = -(-counts // 4)
    ends = 4 * np.cumsum(groups)
    real = np.ones(len(present), bool)
    for pad in (1, 2, 3):  # padding ranks have no data byte
        real[ends[(4 * groups - counts) >= pad] - pad] = False
    present[~real] = False
    out = np.zeros((len(present), 4), np.uint8)
    out[present] = data[: int(present.sum())]
    return out.view("<u4").ravel()[real]


def pack_segment(rows: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    """(document id, tokens, control, data) of each document in order."""
    ids = b"".join(struct.pack("<Bq", key is not None, key or 0) for key, _, _, _ in rows)
    counts = np.array([n for _, n, _, _ in rows], "<u4").tobytes()
    return b"".join([MAGIC, struct.pack("<I", len(rows)), ids, counts, *(c for _, _, c, _ in rows), *(d for _, _, _, d in rows)])


def unpack_segment(body: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, how many ranks each document has, and all ranks in order."""
    if body[:4] != MAGIC:
        raise ValueError("not a token segment")
    (n,) = struct.unpack_from("<I", body, 4)
    keys = [key if has else None for has, key in struct.iter_unpack("<Bq", body[8 : 8 + 9 * n])]
    counts = np.frombuffer(body, "<u4", n, 8 + 9 * n).astype(np.int64)
    begin = 8 + 13 * n
    end = begin + int((-(-counts // 4)).sum())
    raw = np.frombuffer(body, np.uint8)
    return keys, counts, decode_all(raw[begin:end], raw[end:], counts)


def tokenize(docs: DataFrame, tokenizer_file: str, end_id: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key (long) and ``ids``: little-endian ids of the whole text, then ``end_id``; two bytes
    each if the vocabulary allows, else four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = UnitEncoder.of(tokenizer_file)
        end = np.array([end_id], own.dtype).tobytes()
        for batch in batches:
            for begin, texts in texts_of(batch, "text", 8 << 20):
                ids = [value + end for value in own.encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(begin, len(texts)), binary(ids)], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def _runs(column: pa.Array) -> Iterator[list[bytes]]:
    """Values in runs of about a megabyte: what numpy makes of them is several times as large."""
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(column):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + (1 << 20), "right")))
        yield column.slice(begin, end - begin).to_pylist()
        begin = end


def frequency_ranks(tokens: DataFrame, dtype: np.dtype, vocabulary: int) -> np.ndarray:
    """The ids by falling frequency, ties to the smaller id. As long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for values in _runs(batch.column("ids")):
                counts += np.bincount(np.frombuffer(b"".join(values), dtype), minlength=vocabulary)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], ["id", "n"])

    total = np.zeros(vocabulary, np.int64)
    # At most one row for each id of the vocabulary.
    for row in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[row["id"]] = row["n"]
    return np.lexsort((np.arange(vocabulary), -total)).astype(np.int32)


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, *, key: str = "doc_id", text: str = "text") -> None:
    """Encode all documents and write the corpus to ``folder``.

    Null texts are empty (their only id is ``end_id``); documents without an id come first,
    and equal ids are ordered by their code, so that the order never depends on the tasks.
    Encoding happens once, into a staged table that is read again after the frequencies are known.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer_file).get_vocab_size(with_added_tokens=True), end_id + 1)
    dtype = np.dtype("<u2") if vocabulary <= 65_536 else np.dtype("<u4")
    staged = staging_path(spark)
    tokenize(docs, tokenizer_file, end_id, key=key, text=text).write.option("compression", "zstd").parquet(staged)
    tokens = spark.read.parquet(staged)

    order = frequency_ranks(tokens, dtype, vocabulary)
    spark.createDataFrame(pa.table({"rank": np.arange(vocabulary, dtype=np.int32), "id": order})).coalesce(1).write.parquet(f"{folder}/ranks")
    ranks = np.empty(vocabulary, "<u4")
    ranks[order] = np.arange(vocabulary)

    size = tokens.agg(F.sum(F.length("ids"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    inner = [i / buckets for i in range(1, buckets)]
    bounds = np.array(tokens.approxQuantile("doc_id", inner, 0.1 / buckets) if inner else [], np.float64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            control, data, sizes = [], [], []
            for values in _runs(batch.column("ids")):
                counts = np.array([len(v) // dtype.itemsize for v in values], np.int64)
                some = encode_all(ranks[np.frombuffer(b"".join(values), dtype)], counts)
                control += some[0]
                data += some[1]
                sizes += counts.tolist()
            keys = batch.column("doc_id")
            place = np.searchsorted(bounds, keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), "right").astype(np.int32)
            place[keys.is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), keys, pa.array(sizes, pa.int64()), binary(control), binary(data)],
                ["bucket", "doc_id", "n", "control", "data"],
            )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, bucket, number = 0, None, 0

        def flush() -> pa.RecordBatch:
            columns = [[bucket], [number], [sum(r[1] for r in held)], [pack_segment(held)]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "segment", "n_tokens", "body"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != bucket or size > SEGMENT_BYTES):
                    yield flush()
                    number = number + 1 if row[0] == bucket else 0
                    held, size = [], 0
                bucket = row[0]
                held.append(row[1:])
                size += len(row[3]) + len(row[4])
        if held:
            yield flush()

    coded = tokens.mapInArrow(code, "bucket int, doc_id long, n long, control binary, data binary")
    placed = coded.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "control", "data")
    placed.mapInArrow(segments, "bucket int, segment long, n_tokens long, body binary").write.option("compression", "zstd").parquet(f"{folder}/segments")


def segment_starts(spark: SparkSession, folder: str) -> DataFrame:
    """For each (bucket, segment), ``first``: the ids of all documents before the segment."""
    sums = spark.read.parquet(f"{folder}/segments").select("bucket", "segment", "n_tokens")
    # From sums alone: the segments of a bucket are few, and one row a bucket is left in the end.
    inside = Window.partitionBy("bucket").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    of_bucket = sums.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    of_bucket = of_bucket.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = sums.select("bucket", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("own")).join(of_bucket, "bucket")
    return own.select("bucket", "segment", (F.col("first") + F.col("own")).alias("first"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a corpus: ``bucket``, ``segment``, ``inner`` (ids before it in its segment),
    ``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit). An empty corpus gives no rows."""
    table = spark.read.parquet(f"{folder}/ranks").collect()  # one row for each id of the vocabulary
    order = np.empty(len(table), "<u4")
    for row in table:
        order[row["rank"]] = row["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "segment", "inner", "doc_id", "n_tokens", "ids"]
        for batch in batches:
            for bucket, segment, body in zip(*batch.columns, strict=True):
                keys, counts, found = unpack_segment(body.as_py())
                same = [pa.array([v.as_py()] * len(keys), v.type) for v in (bucket, segment)]
                ids, ends = order[found].tobytes(), np.cumsum(counts)
                values = binary([ids[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*same, pa.array(ends - counts), pa.array(keys, pa.int64()), pa.array(counts), values], names)

    stored = spark.read.parquet(f"{folder}/segments").select("bucket", "segment", "body")
    return stored.mapInArrow(run, "bucket int, segment long, inner long, doc_id long, n_tokens long, ids binary")


def with_start(docs: DataFrame, starts: DataFrame) -> DataFrame:
    """Replace ``bucket``, ``segment`` and ``inner`` by ``start``, the ids of all documents before.
    Drop or digest ``ids`` first where they aren't needed: the rows are joined to the starts."""
    joined = docs.join(starts, ["bucket", "segment"])
    return joined.withColumn("start", F.col("first") + F.col("inner")).drop("bucket", "segment", "inner", "first")
