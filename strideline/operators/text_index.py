"""Substring search by an index of short character sequences, instead of a scan of all events.

The index holds the distinct values of a column with their frequency, and for every sequence of one to three characters
the values that hold it. A search looks up the rarest sequences of its text, intersects their values and verifies those
by the same predicate a scan would use, so its result is a scan's. Both tables are sorted, so that a lookup reads the few
row groups it needs. Upper and lower case are one, as in the predicate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.specs import SpecError

WIDTH = 3
#: Sequences of a search text that are looked up: the rarest ones.
LOOKED_UP = 4


@dataclass(frozen=True)
class TextIndex:
    """A stored index."""

    spark: SparkSession
    path: str

    def values(self) -> DataFrame:
        """``(value, frequency)``, by value."""
        return self.spark.read.parquet(f"{self.path}/values")

    def postings(self) -> DataFrame:
        """``(gram, value, frequency)``, by gram."""
        return self.spark.read.parquet(f"{self.path}/postings")

    def candidates(self, text: str) -> DataFrame:
        """``(value, frequency)`` of the values that hold the rarest sequences of the text; all of them for an empty one."""
        if not text:
            return self.values()
        low = self.spark.range(1).select(F.lower(F.lit(text))).first()[0]  # as the predicate lowers it
        width = min(WIDTH, len(low))
        grams = sorted({low[i : i + width] for i in range(len(low) - width + 1)})
        counts = {r["gram"]: r["n"] for r in self.spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(grams)).collect()}
        if len(counts) < len(grams):
            return self.values().where(F.lit(False))  # one of them occurs nowhere
        rarest = sorted(grams, key=lambda g: (counts[g], g))[:LOOKED_UP]
        held = self.postings().where(F.col("gram").isin(rarest)).groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.first("frequency").alias("frequency"))
        return held.where(F.col("n") == len(rarest)).select("value", "frequency")

    def search(self, text: str, prefix: bool = False) -> DataFrame:
        """``(value, frequency)`` of the values that hold the text, or begin with it."""
        return self.candidates(text).where(_holds(F.col("value"), text, prefix))

    def column_search(self, text: str) -> DataFrame:
        """By the rule of :func:`strideline.functions.predicates.search_predicate`: up to two characters at the
        begin, longer texts anywhere."""
        return self.search(text, prefix=len(text) <= 2)


def _holds(column: Column, text: str, prefix: bool) -> Column:
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"{escaped}%" if prefix else f"%{escaped}%")


def build(rows: DataFrame, column: str, path: str, weight: str | None = None) -> TextIndex:
    """Index the values of a column as text, null ones left out. ``frequency`` is the sum of ``weight``, or the number
    of rows. A value that most rows hold is one value; a sequence that most values hold is spread over many files."""
    if column not in rows.columns:
        raise SpecError(f"unknown column {column!r}")
    spark = rows.sparkSession
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    values = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(amount.alias("frequency"))
    values.repartitionByRange("value").sortWithinPartitions("value").write.mode("overwrite").parquet(f"{path}/values")
    values = spark.read.parquet(f"{path}/values")
    low = F.lower("value")
    places = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))

    def pieces(width: int) -> Column:
        begins = F.slice(places, F.lit(1), F.greatest(F.length(low) - (width - 1), F.lit(0)))
        return F.transform(begins, lambda i: F.substring(low, i, F.lit(width)))

    grams = [F.when(F.length(low) >= width, pieces(width)) for width in range(1, WIDTH + 1)]
    each = F.array_distinct(F.flatten(F.array_compact(F.array(*grams))))
    held = values.where(F.length(low) > 0).select(F.explode(each).alias("gram"), "value", "frequency")
    held.repartitionByRange("gram", "value").sortWithinPartitions("gram", "value").write.mode("overwrite").parquet(f"{path}/postings")
    counted = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counted.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")
    return TextIndex(spark, path)


def search_users(index: TextIndex, text: str, limit: int | None = 20, members: DataFrame | None = None, cohort_id: int | None = None) -> DataFrame:
    """User ids containing the text, in order, from an index of the user column; optionally only of one cohort."""
    found = index.search(text).select(F.col("value").alias("user_id"))
    if members is not None and cohort_id is not None:
        found = found.join(members.where(F.col("cohort_id") == cohort_id), "user_id", "left_semi")
    ordered = found.orderBy("user_id")
    return ordered if limit is None else ordered.limit(limit)
