"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm.arrow import binary, release, texts_of

#: Longer texts are cut at safe places into parts of at least so many characters.
LONG_TEXT = 100_000
# A token pattern either matches white space alone or ends before white space, so a
# non-space character followed by white space is always the border of two matches, and
# the part that starts there is matched as it would be in the whole text.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")


@cache
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file; one per Python worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = LONG_TEXT) -> list[str]:
    """Parts of a text whose encodings join to the encoding of the text."""
    parts, begin = [], 0
    while len(text) - begin > size:
        found = _SAFE.search(text, begin + size)
        if not found:
            break
        parts.append(text[begin : found.start()])
        begin = found.start()
    return [*parts, text[begin:]]


def encode(docs: DataFrame, rank_file: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text without special tokens.

    Returns the key, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers as
    binary). A null text is the empty one: no ids. Keys pass through, null and repeated
    ones too; other columns are dropped. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = encoding(rank_file, pattern)
        for batch in batches:
            for begin, texts in texts_of(batch, "text"):
                ids = [np.array([i for part in safe_parts(t) for i in own.encode_ordinary(part)], "<u4") for t in texts]
                keys = batch.column("key").slice(begin, len(texts))
                counts = pa.array([len(i) for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, counts, binary([i.tobytes() for i in ids])], [key, "n_tokens", "ids"])

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Add ``decoded``: the raw bytes of ``ids``, which need not be valid UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = encoding(rank_file, pattern)
        for batch in batches:
            ids = (np.frombuffer(value or b"", "<u4") for value in batch.column("ids").to_pylist())
            decoded = binary([own.decode_bytes(i.tolist()) for i in ids])
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, "decoded"])

    source = encoded.drop("decoded")
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("decoded", T.BinaryType())]))
