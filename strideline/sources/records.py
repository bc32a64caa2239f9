"""CSV records with line breaks inside quotes, read from many splits of one file.

Where a split begins, nothing in it tells whether the place is inside quotes: that depends on the number of quotes
before it. So the file is read twice, in the same splits.

1. Each split counts its quotes. Their running sum over the splits of a file, one small row a split, says for each
   whether it begins inside a field.
2. With that, a split cuts its lines into records by itself: a line ends a record where the quotes up to it are even.
   What it has of a record that began before it, or that ends after it, is a fragment.

Whole records are parsed where they are read and stored; fragments are joined by their place, one group for each record
that crosses a border, parsed likewise and added. Splits with an odd number of quotes before them are the only thing
that is sent to all tasks; it is broadcast up to ``BROADCAST_SPLITS`` of them and otherwise joined, after which the
lines are put back into the order of their split.

Quotes are doubled inside quoted fields; any quote counts, also one inside a field that does not begin with one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.operators.staging import stage

#: Splits that begin inside quotes and are broadcast at most.
BROADCAST_SPLITS = 500_000

_SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"
_WHOLE, _HEAD, _TAIL, _MIDDLE, _HEADER = range(5)
_CUT = "file string, block long, kind int, first boolean, record string"


@contextmanager
def _splits_of(spark: SparkSession, split_bytes: int | None) -> Iterator[None]:
    """Plan scans with splits of about this size."""
    before = spark.conf.get(_SPLIT_BYTES)
    if split_bytes is not None:
        spark.conf.set(_SPLIT_BYTES, str(split_bytes))
    try:
        yield
    finally:
        spark.conf.set(_SPLIT_BYTES, before)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line with its file, the place its split begins, and whether its number of quotes is odd."""
    text = spark.read.option("lineSep", "\n").text(path)
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), odd.alias("odd"))


def splits_inside_quotes(lines: DataFrame) -> DataFrame:
    """``(file, block)`` of the splits that begin inside a quoted field."""
    parity = lines.groupBy("file", "block").agg((F.count_if("odd") % 2).alias("n"))  # one row a split
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return parity.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") % 2 == 1).select("file", "block")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in the order of their splits to records and fragments."""
    split: tuple[str, int] | None = None
    held: list[str] = []  # lines of a record that is not complete yet
    inside = began_before = False
    first = False  # no record of the split has ended yet
    names = ["file", "block", "kind", "first", "record"]

    def rows(found: list[tuple[int, bool, str]]) -> pa.RecordBatch:
        kinds, firsts, records = zip(*found, strict=True)
        file, block = split
        columns = [pa.array([file] * len(found)), pa.array([block] * len(found), pa.int64()), pa.array(kinds, pa.int32()), pa.array(firsts), pa.array(records, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names)

    def rest() -> Iterator[pa.RecordBatch]:
        if held:
            yield rows([(_MIDDLE if began_before else _TAIL, first and split[1] == 0, "\n".join(held))])

    for batch in batches:
        if not batch.num_rows:
            continue
        starts, files = batch.column("block").to_numpy(zero_copy_only=False), batch.column("file")
        changed = np.flatnonzero(np.r_[True, (starts[1:] != starts[:-1]) | pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False)])
        for begin, end in zip(changed.tolist(), [*changed[1:].tolist(), batch.num_rows], strict=True):
            here = (files[begin].as_py(), int(starts[begin]))
            if here != split:
                yield from rest()
                split, held = here, []
                inside = began_before = bool(batch.column("inside")[begin].as_py())
                first = True
            lines = batch.column("line").slice(begin, end - begin).to_pylist()
            found = []
            for line, odd in zip(lines, batch.column("odd").slice(begin, end - begin).to_pylist(), strict=True):
                inside ^= odd
                if inside:
                    held.append(line)
                    continue
                if held:
                    line = "\n".join([*held, line])
                    held = []
                found.append((_HEAD if began_before else _HEADER if first and split[1] == 0 else _WHOLE, False, line))
                began_before = first = False
            if found:
                yield rows(found)
    yield from rest()


def read_records(spark: SparkSession, path: str, schema: T.StructType, corrupt: str, split_bytes: int | None = None) -> DataFrame:
    """The records of CSV files with a header, parsed by ``schema``, in which ``corrupt`` names the column that holds
    the text of a malformed record. Blank records are left out, as Spark's own reader does; a record whose quotes are
    never closed reaches to the end of its file. Runs now; the result is a stored table.

    ``split_bytes`` overrides the session's size of splits. Neither it nor the number of files changes the rows.
    """
    with _splits_of(spark, split_bytes):
        lines = _lines(spark, path)
        odd = stage(splits_inside_quotes(lines)).withColumn("inside", F.lit(True))
        numbered = lines
        if odd.count() <= BROADCAST_SPLITS:
            joined = lines.join(F.broadcast(odd), ["file", "block"], "left")
        else:
            numbered = lines.withColumn("at", F.monotonically_increasing_id())
            joined = numbered.join(odd, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "at")
        cut = joined.select("file", "block", "line", "odd", F.coalesce("inside", F.lit(False)).alias("inside")).mapInArrow(_cut, _CUT)
        # A carriage return before the last line break is part of the break.
        bare = F.regexp_replace("record", "\r$", "")
        parsed = F.from_csv(bare, schema.simpleString(), {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
        whole = F.when(F.col("kind") == _WHOLE, parsed)
        stored = stage(cut.where(F.col("kind") != _HEADER).select("file", "block", "kind", "first", F.when(F.col("kind") != _WHOLE, F.col("record")).alias("record"), F.trim(bare).alias("_t"), whole.alias("parsed")).where((F.col("kind") != _WHOLE) | (F.col("_t") != "")).drop("_t"))

    # Fragments, at most two a split: a record begins with a tail; a head ends the one before it.
    order = Window.partitionBy("file").orderBy("block", (F.col("kind") == _TAIL).cast("int"))
    pieces = stored.where(F.col("kind") != _WHOLE).withColumn("number", F.count_if(F.col("kind") == _TAIL).over(order))
    joined = pieces.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", (F.col("kind") == _TAIL).alias("tail"), "record"))).alias("parts"), F.max("first").alias("first"))
    record = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    crossing = joined.where(~F.col("first")).select(record.alias("record")).where(F.trim(bare) != "").select(parsed.alias("parsed"))
    return stored.where(F.col("kind") == _WHOLE).select("parsed.*").unionByName(crossing.select("parsed.*"))
