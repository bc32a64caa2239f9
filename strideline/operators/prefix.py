"""Running sums over any number of rows: by ranges, with one small offset for each range.

Rows are dealt to ranges of (key, order), so a key with most rows, or one day of it, lies in many ranges and no task
holds more than one. Each range adds up its rows; the totals of the ranges before it, needed only for keys that lie in
several, are broadcast: at most two rows for each range. Inside a range an ordinary window does the rest. The ranges are
stored before they are used, because their borders come from a sample.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.operators.staging import stage


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column | None = None, name: str = "_upto", ranges: int | None = None) -> DataFrame:
    """Add ``name``: the sum of ``weight`` (default: the number of rows) of the key's rows up to and with this one.

    ``order`` should tell rows apart: those equal in all of it stay in one range, and which comes first is open. Null
    keys are one key; nulls in ``order`` come first. Runs the dealing now. ``ranges`` defaults to the number of shuffle
    partitions.
    """
    weighed = rows.withColumn("_w", F.lit(1).cast("long") if weight is None else weight)
    sorting = [*keys, *order]
    dealt = weighed.repartitionByRange(ranges, *sorting) if ranges else weighed.repartitionByRange(*sorting)
    dealt = stage(dealt.withColumn("_range", F.spark_partition_id()))

    named = [f"_k{i}" for i in range(len(keys))]
    totals = dealt.groupBy("_range", *[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)]).agg(F.sum("_w").alias("_total"))
    before = Window.partitionBy(*named).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # Only ranges that continue a key have an offset; a range continues one key at most.
    offsets = totals.withColumn("_offset", F.sum("_total").over(before)).where(F.col("_offset").isNotNull())
    offsets = stage(offsets.select(F.col("_range").alias("_r"), *named, "_offset"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named, strict=True)], F.col("_range") == F.col("_r"))
    joined = dealt.join(F.broadcast(offsets), same, "left").drop("_r", *named)
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("_w").over(inside) + F.coalesce(F.col("_offset"), F.lit(0))
    return joined.withColumn(name, upto).drop("_w", "_range", "_offset")


def dense_row_ids(rows: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Number the rows 1, 2, 3, ... in a total order, whatever the files and splits they come from."""
    return running_sum(rows, [], order, name="_n").withColumn(name, F.col("_n")).drop("_n")


def slice_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str], first: int, last: int, name: str = "_pos") -> DataFrame:
    """Each key's rows from position ``first`` to ``last``, with the position: a page at any depth."""
    return running_sum(rows, keys, order, name=name).where(F.col(name).between(first, last))


def crossing(rows: DataFrame, keys: Sequence[str], order: str, weight: str, need: str) -> DataFrame:
    """``(*keys, order)``: where each key's running sum first reaches ``need``. Weights must not be negative; rows of one
    place in the order are added up first."""
    places = rows.groupBy(*keys, order).agg(F.sum(weight).alias("_weight"), F.max(need).alias("_need"))
    summed = running_sum(places, keys, [order], F.col("_weight"))
    reached = (F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_weight") < F.col("_need"))
    return summed.where(reached).groupBy(*keys).agg(F.min(order).alias(order))
