"""The canonical table partitioned by event name, so that a changed rule rewrites only the events it is about.

Revenue depends on the rule of a row's own event name and on nothing else. When rules change, the partitions of the
names whose rule is now another are computed anew from what was recorded, and replaced one by one; all other files stay.
The rules in force are stored beside the rows. If a job dies half-way, saying the same rules again completes it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.operators.revenue import RULE_SCHEMA, modified_revenue_from, rules_frame, upsert_rules
from strideline.operators.staging import discard, stage
from strideline.specs import RevenueRule, SpecError


@dataclass(frozen=True)
class RevenueStore:
    """Priced rows and their rules in a folder."""

    spark: SparkSession
    path: str
    schema: T.StructType

    def events(self) -> DataFrame:
        """The rows; a filter on ``event_name`` reads only those partitions."""
        # With the schema given, names that look like numbers stay text.
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/events").select(*self.schema.names)

    def rules(self) -> DataFrame:
        return self.spark.read.schema(RULE_SCHEMA).parquet(f"{self.path}/rules")

    def upsert(self, updates: Sequence[RevenueRule]) -> list[str]:
        """Replace the rules of the named events and price those whose rule is now another; returns their names."""
        if len({u.event_name for u in updates}) < len(updates):
            raise SpecError("an event has one rule")
        rules = stage(upsert_rules(self.rules(), rules_frame(self.spark, updates)))
        now = {r["event_name"]: (r["is_included"], r["override_revenue"]) for r in rules.where(F.col("event_name").isin([u.event_name for u in updates])).collect()}
        before = {r["event_name"]: (r["is_included"], r["override_revenue"]) for r in self.rules().where(F.col("event_name").isin(list(now))).collect()}
        changed = sorted(name for name in now if now[name] != before.get(name))
        if changed:
            rows = stage(modified_revenue_from(self.events().where(F.col("event_name").isin(changed)), rules))
            _write(rows, self.path)
            discard(rows)
        rules.write.mode("overwrite").parquet(f"{self.path}/rules")
        discard(rules)
        return changed


def _write(rows: DataFrame, path: str) -> None:
    # Rows of a name are dealt over tasks by content, so a name with most rows is written by many.
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_name").parquet(f"{path}/events")


def save(events: DataFrame, rules: Sequence[RevenueRule], path: str) -> RevenueStore:
    """Price all rows by the rules and store them; what the folder held is replaced where names are the same, so use a
    folder of its own. Names without a rule have no revenue; rows without a name are kept, with none."""
    spark = events.sparkSession
    table = rules_frame(spark, rules)
    _write(modified_revenue_from(events, table), path)
    table.write.mode("overwrite").parquet(f"{path}/rules")
    return RevenueStore(spark, path, events.schema)
