"""Revenue rules and the revenue they leave each event with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.specs import RevenueRule

RULE_SCHEMA = "event_name string, is_included boolean, override_revenue double"


def rules_frame(spark: SparkSession, rules: Sequence[RevenueRule]) -> DataFrame:
    return spark.createDataFrame([(r.event_name, r.included, r.override) for r in rules], RULE_SCHEMA)


def default_rules(events: DataFrame) -> DataFrame:
    """Every event name that ever had revenue is included, without an override."""
    return (
        events.where((F.col("original_revenue") != 0) & F.col("event_name").isNotNull())
        .select("event_name")
        .distinct()
        .select("event_name", F.lit(True).alias("is_included"), F.lit(None).cast("double").alias("override_revenue"))
    )


def addable_events(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Event names without a rule yet."""
    return events.where(F.col("event_name").isNotNull()).select("event_name").distinct().join(rules, "event_name", "left_anti")


def upsert_rules(rules: DataFrame, updates: DataFrame) -> DataFrame:
    """Rules of the named events replaced, all others kept."""
    return rules.join(updates, "event_name", "left_anti").unionByName(updates)


def modified_revenue(events: DataFrame, rules: Sequence[RevenueRule]) -> DataFrame:
    """Included with override: price times count; included: as recorded; else 0.

    The rules are a hand-written spec, so they become one expression rather than a
    join; for a rule table as large as the data use :func:`modified_revenue_from`.
    """
    included = [r for r in rules if r.included]
    price = F.lit(0.0)
    plain = [r.event_name for r in included if r.override is None]
    if plain:
        price = F.when(F.col("event_name").isin(plain), F.col("original_revenue")).otherwise(price)
    for rule in included:
        if rule.override is not None:
            price = F.when(F.col("event_name") == rule.event_name, F.lit(float(rule.override)) * F.col("event_count")).otherwise(price)
    return events.withColumn("modified_revenue", price.cast("double"))


def modified_revenue_from(events: DataFrame, rules: DataFrame) -> DataFrame:
    """The same with the rules as a table: an equi-join that Spark may broadcast."""
    value = F.when(F.col("is_included") & F.col("override_revenue").isNotNull(), F.col("override_revenue") * F.col("event_count"))
    value = value.when(F.col("is_included"), F.col("original_revenue")).otherwise(F.lit(0.0))
    joined = events.join(rules, "event_name", "left").withColumn("modified_revenue", value.cast("double"))
    return joined.select(*events.columns)
