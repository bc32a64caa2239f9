"""From raw columns to the canonical event table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.functions.times import as_instant
from strideline.specs import SpecError

# The canonical columns and the kinds of the required ones.
CORE = ("user_id", "event_name", "event_time")
METRICS = ("event_count", "original_revenue", "modified_revenue")
CANONICAL = (*CORE, *METRICS, "row_id")
REQUIRED_KINDS = {"user_id": "TEXT", "event_name": "TEXT", "event_time": "TIMESTAMP"}

# Fixed pattern: a zone suffix, which is dropped without shifting the time.
_ZONE_SUFFIX = r"(?i)\s*(UTC|Z|[+-]\d{2}:?\d{2})$"
# Fixed pattern: the accepted shapes of a timestamp text, zone removed.
_TIMESTAMP_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}( \d{1,2}(:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?)?)?$"


@dataclass(frozen=True)
class ColumnMapping:
    """Which raw column plays which role, and the kind of each raw column."""

    user_id: str
    event_name: str
    event_time: str
    event_count: str | None = None
    revenue: str | None = None
    row_id: str = "row_id"
    kinds: Mapping[str, str] = field(default_factory=dict)

    def core(self) -> dict[str, str]:
        return {"user_id": self.user_id, "event_name": self.event_name, "event_time": self.event_time}

    def properties(self, columns: Sequence[str]) -> list[str]:
        used = {*self.core().values(), self.event_count, self.revenue, self.row_id}
        return [name for name in columns if name not in used]


def properties_of(events: DataFrame) -> list[str]:
    """Every column that is not one of the canonical ones."""
    return [name for name in events.columns if name not in CANONICAL]


def timestamp_text(column: Column) -> Column:
    """The text without quotes, zone suffix and the ISO separator."""
    bare = F.trim(F.btrim(F.trim(column.cast("string")), F.lit('"')))
    return F.replace(F.trim(F.regexp_replace(bare, _ZONE_SUFFIX, "")), F.lit("T"), F.lit(" "))


def normalize_timestamp(column: Column) -> Column:
    """Zone-free timestamp of a text, NULL if it is not one; hour-only times count."""
    text = timestamp_text(column)
    return F.when(text.rlike(_TIMESTAMP_SHAPE), F.coalesce(
        text.try_cast("timestamp_ntz"), F.concat(text, F.lit(":00:00")).try_cast("timestamp_ntz")
    ))


def detect_types(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, kind)`` from one aggregate over all values.

    A column is the first of BOOLEAN, TIMESTAMP, NUMERIC that all its non-blank
    values satisfy, else TEXT; a blank column is TEXT.
    """
    names = list(columns or rows.columns)
    counts = []
    for name in names:
        text = F.trim(F.col(name).cast("string"))
        filled = text.isNotNull() & (text != "")
        counts.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count_if(filled).alias("filled"),
                F.count_if(filled & F.lower(text).isin("true", "false")).alias("booleans"),
                F.count_if(filled & normalize_timestamp(text).isNotNull()).alias("timestamps"),
                F.count_if(filled & text.try_cast("double").isNotNull()).alias("numbers"),
            ).alias(f"_{len(counts)}")
        )
    summary = rows.agg(*counts).select(F.explode(F.array(*[f"_{i}" for i in range(len(names))])).alias("s")).select("s.*")
    kind = (
        F.when(F.col("filled") == 0, "TEXT")
        .when(F.col("booleans") == F.col("filled"), "BOOLEAN")
        .when(F.col("timestamps") == F.col("filled"), "TIMESTAMP")
        .when(F.col("numbers") == F.col("filled"), "NUMERIC")
        .otherwise("TEXT")
    )
    return summary.select("column_name", "filled", kind.alias("kind"))


def typed(column: Column, data_type: T.DataType, kind: str) -> Column:
    """Cast to a semantic kind. Bad numbers and booleans raise; bad times are NULL."""
    if kind == "TEXT":
        return F.nullif(F.trim(column.cast("string")), F.lit(""))
    if kind == "NUMERIC":
        return column.cast("double")
    if kind == "BOOLEAN":
        return column.cast("boolean")
    if isinstance(data_type, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return column.cast("timestamp_ntz")
    return normalize_timestamp(column)


def check_rows(rows: DataFrame, mapping: ColumnMapping) -> DataFrame:
    """One row with the numbers of blank times and of invalid event counts."""
    time = F.col(mapping.event_time).cast("string")
    blank = time.isNull() | (F.trim(time) == "")
    bad_count = F.lit(False)
    if mapping.event_count:
        number = F.col(mapping.event_count).cast("string").try_cast("double")
        bad_count = F.coalesce((number != F.floor(number)) | (number < 1), F.lit(True))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(blank).alias("empty_times"),
        F.count_if(bad_count).alias("bad_counts"),
    )


def time_report(rows: DataFrame, mapping: ColumnMapping, now: datetime | None = None) -> DataFrame:
    """One row: ``rows``, and how many have an empty time, one that cannot be read, or one more than a day past
    ``now`` (0 without it). The last two are left out by :func:`map_events`; all others stay or raise."""
    raw = F.col(mapping.event_time)
    text = raw.cast("string")
    blank = text.isNull() | (F.trim(text) == "")
    read = typed(raw, rows.schema[mapping.event_time].dataType, "TIMESTAMP")
    late = F.lit(False) if now is None else F.coalesce(read > as_instant(now + timedelta(days=1)), F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(blank).alias("empty_times"),
        F.count_if(~blank & read.isNull()).alias("unreadable_times"),
        F.count_if(late).alias("future_times"),
    )


def map_events(rows: DataFrame, mapping: ColumnMapping, now: datetime | None = None, check: bool = True) -> DataFrame:
    """The canonical table, one row per source row.

    With ``check`` the two data rules are verified by one aggregate before the lazy
    result is returned. Times more than a day past ``now`` are dropped.
    """
    missing = [name for name in mapping.core().values() if name not in rows.columns]
    if missing:
        raise SpecError(f"unknown columns {missing}")
    for role, kind in REQUIRED_KINDS.items():
        given = mapping.kinds.get(mapping.core()[role], kind)
        if given != kind:
            raise SpecError(f"{role} must be {kind}, not {given}")
    if check:
        report = check_rows(rows, mapping).first()
        if report["empty_times"]:
            raise SpecError(f"{report['empty_times']} rows have an empty event time")
        if report["bad_counts"]:
            raise SpecError(f"{report['bad_counts']} rows have an event count that is not a whole number of at least 1")

    types = {f.name: f.dataType for f in rows.schema.fields}
    columns = [
        typed(F.col(raw), types[raw], REQUIRED_KINDS[role]).alias(role) for role, raw in mapping.core().items()
    ]
    for name in mapping.properties(rows.columns):
        kind = mapping.kinds.get(name)
        columns.append(F.col(name) if kind is None else typed(F.col(name), types[name], kind).alias(name))
    count = F.col(mapping.event_count).cast("double") if mapping.event_count else F.lit(1.0)
    revenue = F.coalesce(F.col(mapping.revenue).cast("double"), F.lit(0.0)) if mapping.revenue else F.lit(0.0)
    columns += [
        count.alias("event_count"),
        revenue.alias("original_revenue"),
        revenue.alias("modified_revenue"),
        F.col(mapping.row_id).cast("long").alias("row_id"),
    ]
    mapped = rows.select(*columns)
    # min(newest event, now + 1 day) as an upper bound only ever cuts at now + 1 day.
    if now is not None:
        return mapped.where(F.col("event_time") <= as_instant(now + timedelta(days=1)))
    return mapped.where(F.col("event_time").isNotNull())


def normalize_events(events: DataFrame) -> DataFrame:
    """The grouped grain: equal user, name, time and properties become one row."""
    complete = events.where(" AND ".join(f"{name} IS NOT NULL" for name in CORE))
    return complete.groupBy(*CORE, *properties_of(events)).agg(
        *[F.sum(name).cast("double").alias(name) for name in METRICS], F.min("row_id").alias("row_id")
    )


def dataset_totals(events: DataFrame) -> DataFrame:
    return events.agg(
        F.coalesce(F.sum("event_count"), F.lit(0.0)).cast("double").alias("total_events"),
        F.count_distinct("user_id").alias("total_users"),
    )


def write_events(events: DataFrame, path: str, user_buckets: int | None = None, table: str | None = None) -> None:
    """Persist the canonical table; bucketed by user when saved as a named table."""
    if table is None:
        events.write.mode("overwrite").parquet(path)
        return
    writer = events.write.mode("overwrite").option("path", path).format("parquet")
    if user_buckets:
        writer = writer.bucketBy(user_buckets, "user_id").sortBy("user_id", "event_time")
    writer.saveAsTable(table)
