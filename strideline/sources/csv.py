"""CSV event files: quoted, multi-line, with malformed rows counted and skipped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.sources.records import read_records
from strideline.specs import SpecError

_CORRUPT = "_malformed"
MIN_COLUMNS = 3


@dataclass(frozen=True)
class CsvEvents:
    """``rows`` are the parsed records as text columns; ``tagged`` also has the bad ones."""

    rows: DataFrame
    tagged: DataFrame

    def load_report(self) -> DataFrame:
        """One row: imported and skipped record counts."""
        # A scan of the malformed-record column alone is not allowed, so one data
        # column takes part; no text equals a lone NUL.
        first = ~F.col(self.rows.columns[0]).eqNullSafe(F.lit("\u0000"))
        bad = F.col(_CORRUPT).isNotNull()
        return self.tagged.agg(
            F.count_if(first & ~bad).alias("imported_rows"), F.count_if(first & bad).alias("skipped_rows")
        )


def read_csv_events(spark: SparkSession, path: str, multi_line: bool = False, split_bytes: int | None = None) -> CsvEvents:
    """Read every column as text; types are decided later, on all values.

    A file is read in many splits. ``multi_line`` allows line breaks inside quotes; the records
    are then found by counting quotes (:mod:`strideline.sources.records`), parsed and stored now,
    in splits of ``split_bytes`` if given. Without it nothing is read yet.
    """
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line}
    header = spark.read.options(**options).csv(path).columns
    if len(header) < MIN_COLUMNS:
        raise SpecError(f"an event file needs at least {MIN_COLUMNS} columns")
    fields = [T.StructField(name, T.StringType()) for name in header]
    schema = T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])
    if multi_line:
        tagged = read_records(spark, path, schema, _CORRUPT, split_bytes)
        return CsvEvents(tagged.where(F.col(_CORRUPT).isNull()).drop(_CORRUPT), tagged)
    tagged = (
        spark.read.schema(schema)
        .options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT, enforceSchema=True)
        # Whole records are parsed, so what counts as malformed never depends on the
        # columns a query happens to use.
        .option("columnPruning", False)
        .csv(path)
    )
    return CsvEvents(tagged.where(F.col(_CORRUPT).isNull()).drop(_CORRUPT), tagged)


def with_row_id(rows: DataFrame, row_id: str | None = None) -> DataFrame:
    """Use an existing id column, else number rows by partition.

    Generated ids are unique but depend on the file splits: write the table once
    (:func:`strideline.operators.events.write_events`) and read it back.
    """
    if row_id is not None:
        return rows.withColumn("row_id", F.col(row_id).cast("long"))
    return rows.withColumn("row_id", F.monotonically_increasing_id())
