"""Quantile sketches per day and key: stored once, merged for any span of days, without a second scan of the events.

A sketch (KLL, Spark's own) of a million values takes a few kilobytes and is combined map-side, so a key that holds
most rows costs no more than others. Sketches of different days merge to one of about the same error: the rank of
what is returned for a fraction is off by at most :func:`rank_error` of the values, with 99 % confidence. Up to ``k``
values the answer is exact.

Stored sketches are partitioned by day. Saving a day again replaces it, so late data means sketching that day anew and
nothing else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideline.functions.times import from_micros, micros

#: Size parameter of a sketch: about 3 * K values are kept.
K = 800
#: Steps in which a day's sketch is asked for a place inside it.
_GRID = 1_000


def rank_error(k: int = K) -> float:
    """Normalised rank error of one quantile at 99 % confidence, as the sketch library states it."""
    return 2.296 / k**0.9723


def sketch_by_day(rows: DataFrame, keys: Sequence[str], day: str, value: str, k: int = K) -> DataFrame:
    """``(*keys, day, n, sketch)`` of a whole-number column; null values are left out, null keys and days are kept."""
    known = rows.where(F.col(value).isNotNull()).withColumn("day", F.col(day).cast("date"))
    return known.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(F.col(value).cast("long"), F.lit(k)).alias("sketch"))


def save(sketches: DataFrame, path: str) -> None:
    """Write sketches by day; days already there are replaced, others stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Stored sketches; a filter on ``day`` reads only those days."""
    return spark.read.parquet(path)


def merged(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """``(*keys, n, sketch)`` over all days given."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"))


def quantiles(sketches: DataFrame, keys: Sequence[str], named: Mapping[str, float]) -> DataFrame:
    """``(*keys, n)`` and a column for each named fraction, from merged sketches."""
    picked = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(f))).alias(name) for name, f in named.items()]
    return sketches.select(*keys, "n", *picked)


def time_sketches(events: DataFrame, time: str = "event_time", k: int = K) -> DataFrame:
    """``(day, n, sketch)`` of the instants of each day, in microseconds; rows without a time are left out."""
    at = events.select(F.col(time).alias("_time"), micros(F.col(time)).alias("_micros"))
    return sketch_by_day(at, [], "_time", "_micros", k)


def observed_end(sketches: DataFrame, fraction: float) -> DataFrame:
    """``(n, day, instant)``: the quantile of event time from :func:`time_sketches`. The day is exact, as the numbers of
    rows are; only the place inside it is estimated, so the rank is off by the sketch's error, and a step of the grid, times that day's share.
    No rows for no events."""
    days = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a day
    counted = sketches.withColumns({"upto": F.sum("n").over(days), "total": F.sum("n").over(Window.partitionBy())})
    rank = F.floor(F.lit(float(fraction)) * (F.col("total") - 1))
    before = F.col("upto") - F.col("n")
    found = counted.where((rank >= before) & (rank < F.col("upto")))
    inside = F.least(F.lit(1.0), (rank - before + 1) / F.col("n"))
    # A sketch takes constant fractions only: a grid of them is asked for, and the one next above is taken.
    steps = F.kll_sketch_get_quantile_bigint("sketch", F.lit([i / _GRID for i in range(_GRID + 1)]))
    instant = F.element_at(steps, F.ceil(inside * _GRID).cast("int") + 1)
    return found.select(F.col("total").alias("n"), "day", from_micros(instant).alias("instant"))


def rank_bounds(rows: DataFrame, keys: Sequence[str], value: str, found: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(*keys, <name>_low, <name>_high)``: the share of values below, and up to, each estimate. Reads the values, to
    judge a sketch by; an estimate of fraction f has the rank error ``max(0, low - f, f - high)``."""
    joined = rows.where(F.col(value).isNotNull()).join(found.select(*keys, *names), list(keys))
    shares = []
    for name in names:
        shares += [F.avg((F.col(value) < F.col(name)).cast("int")).alias(f"{name}_low"), F.avg((F.col(value) <= F.col(name)).cast("int")).alias(f"{name}_high")]
    return joined.groupBy(*keys).agg(*shares)


def within(fraction: float, low, high, error: float) -> F.Column:
    """Whether an estimate's rank is off by at most ``error``."""
    return F.greatest(F.lit(0.0), low - F.lit(fraction), F.lit(fraction) - high) <= F.lit(error)

