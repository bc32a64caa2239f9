"""The canonical table stored for its readers: bucketed by user, each bucket sorted by user and time.

Most analyses group or join on the user. Over a table bucketed by user they do so without moving any event: membership,
activity, and every step of a flow or path read a bucket and its members side by side. Members stored with
:meth:`Canonical.save_members` have the same buckets.

A bucket is read by one task, which suits every user but one who owns much of the table. Where there is such a user, the
store says so and is read as plain files; the operators then spread that user's rows as they do for any other input.
Neither way changes results.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strideline.operators.skew import HotKeys, hot_keys

#: Rows a bucket should hold about.
BUCKET_ROWS = 5_000_000
MAX_BUCKETS = 100_000
_PROPERTY = "strideline.canonical"


@dataclass(frozen=True)
class Canonical:
    """A stored canonical table: its name, the folder of its files, its buckets, and whether a user is hot."""

    spark: SparkSession
    table: str
    path: str
    buckets: int
    has_hot: bool

    def events(self) -> DataFrame:
        """The rows, as written; bucketed unless a user is hot."""
        return self.spark.read.parquet(self.path) if self.has_hot else self.spark.table(self.table)

    def hot(self) -> HotKeys:
        """What the operators take as ``hot``: known without a count where nobody is."""
        return hot_keys(self.events()) if self.has_hot else HotKeys("user_id")

    def save_members(self, members: DataFrame, table: str, path: str) -> DataFrame:
        """Store per-user rows in the same buckets and return them."""
        _write(members, table, path, self.buckets, ["user_id"])
        return self.spark.read.parquet(path) if self.has_hot else self.spark.table(table)


def _write(frame: DataFrame, table: str, path: str, buckets: int, order: list[str]) -> None:
    # Rows meet in their bucket's task first, so that a bucket is one file.
    dealt = frame.repartition(buckets, "user_id").sortWithinPartitions(*order)
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "user_id").sortBy(*order).saveAsTable(table)


def save(events: DataFrame, table: str, path: str, buckets: int | None = None, hot_rows: int | None = None) -> Canonical:
    """Store the canonical rows as ``table`` in ``path``, replacing what is there.

    The number of buckets follows the number of rows if none is given. A user of more than ``hot_rows`` rows
    (default: as in :mod:`strideline.operators.skew`) makes the store one to be read as plain files; its rows are then
    dealt by user and time, so that no task writes them alone. Rows without a user are kept.
    """
    spark = events.sparkSession
    hot = hot_keys(events, hot_rows=hot_rows)
    count = buckets or min(MAX_BUCKETS, max(1, -(-hot.rows // BUCKET_ROWS)))
    has_hot = hot.salts is not None
    if has_hot:
        dealt = events.repartition(count, "user_id", "event_time", "row_id").sortWithinPartitions("user_id", "event_time")
        dealt.write.mode("overwrite").format("parquet").option("path", path).saveAsTable(table)
    else:
        _write(events, table, path, count, ["user_id", "event_time"])
    described = json.dumps({"buckets": count, "hot": has_hot})
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_PROPERTY}' = '{described}')")
    return Canonical(spark, table, path, count, has_hot)


def load(spark: SparkSession, table: str) -> Canonical:
    """A table that :func:`save` stored."""
    rows = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if _PROPERTY not in rows:
        raise ValueError(f"{table} is no canonical table")
    described = json.loads(rows[_PROPERTY])
    place = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}["Location"]
    return Canonical(spark, table, place, described["buckets"], described["hot"])


def moves_events(frame: DataFrame) -> list[str]:
    """The exchanges of a plan that deal rows by user: none where both sides are in buckets."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "user_id" in line]

