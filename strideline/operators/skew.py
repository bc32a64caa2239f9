"""Joining many rows per key to a few rows per key when some keys are huge.

A user may own a third of all events. Hashing on the user alone would send those
events to one task. So the rows per user are counted first, from the key column
alone and combined map-side. If no user is hot, which is the usual answer, plans
stay plain. Otherwise the events of the hot users are spread over several salts and
their few per-user rows are repeated once per salt; other users keep salt 0.
Salts are hashes of row content: a lost task recomputes the same placement.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# When a key counts as hot, how many rows one salt should carry,
# and the most keys that are ever salted (which bounds the broadcast below).
HOT_ROWS = 2_000_000
ROWS_PER_SALT = 1_000_000
MAX_HOT_KEYS = 50_000


@dataclass(frozen=True)
class HotKeys:
    """The heaviest keys with their number of salts, or nothing to do; and the row count."""

    key: str
    salts: DataFrame | None = None
    rows: int = 0


def hot_keys(rows: DataFrame, key: str = "user_id", hot_rows: int | None = None) -> HotKeys:
    """Count rows per key now and keep the hot ones, at most ``MAX_HOT_KEYS``.

    A key outside the list holds under 1/MAX_HOT_KEYS of the rows, so leaving it
    unsalted changes neither results nor balance.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    per_salt = max(1, min(ROWS_PER_SALT, limit))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    most, total = counts.agg(F.max("_rows"), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    if most is None or most <= limit:
        return HotKeys(key, None, total)
    heavy = (
        counts.where(F.col("_rows") > limit)
        .orderBy(F.col("_rows").desc(), key)
        .limit(MAX_HOT_KEYS)
        .select(key, F.ceil(F.col("_rows") / F.lit(per_salt)).cast("int").alias("_salts"))
    )
    return HotKeys(key, rows.sparkSession.createDataFrame(heavy.collect(), heavy.schema), total)


def _with_salts(frame: DataFrame, hot: HotKeys) -> DataFrame:
    if hot.salts is None:
        return frame.withColumn("_salts", F.lit(1))
    # Size bound of this broadcast: MAX_HOT_KEYS rows of a key and an int.
    joined = frame.join(F.broadcast(hot.salts), hot.key, "left")
    return joined.withColumn("_salts", F.coalesce("_salts", F.lit(1)))


def spread(rows: DataFrame, hot: HotKeys, by: tuple[str, ...] = ("event_time", "row_id")) -> DataFrame:
    """Add ``_salt``: a content hash for rows of hot keys, 0 for all others."""
    if hot.salts is None:
        return rows.withColumn("_salt", F.lit(0))
    salt = F.pmod(F.xxhash64(*by), F.col("_salts").cast("long")).cast("int")
    placed = F.when(F.col("_salts") > 1, salt).otherwise(F.lit(0))
    return _with_salts(rows, hot).withColumn("_salt", placed).drop("_salts")


def mark(per_key: DataFrame, hot: HotKeys) -> DataFrame:
    """Add ``_salts``, the number of copies :func:`fan_out` makes."""
    return _with_salts(per_key, hot)


def fan_out(marked: DataFrame, hot: HotKeys) -> DataFrame:
    """One copy of each row per salt of its key."""
    if hot.salts is None:
        return marked.withColumn("_salt", F.lit(0))
    return marked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))


def join_per_key(rows: DataFrame, per_key: DataFrame, hot: HotKeys) -> DataFrame:
    """Inner join of ``rows`` to ``per_key`` on the key, hot keys spread out."""
    if hot.salts is None:
        return rows.join(per_key, hot.key)
    right = fan_out(mark(per_key, hot), hot).drop("_salts")
    return spread(rows, hot).join(right, [hot.key, "_salt"]).drop("_salt")


def row_salt(buckets: int, *by: str) -> Column:
    """A fixed number of salts, from row content."""
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")
