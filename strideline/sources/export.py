"""Writing result tables with a manifest that says how they were made."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from strideline.specs import SpecError


@dataclass(frozen=True)
class ResultTable:
    title: str
    rows: DataFrame
    settings: Mapping[str, Any] = field(default_factory=dict)
    filters: Mapping[str, Any] = field(default_factory=dict)


def export_results(spark: SparkSession, tables: Mapping[str, ResultTable], path: str, fmt: str = "csv") -> None:
    """One directory per table plus ``manifest``; files are written by the executors."""
    if fmt not in ("csv", "json"):
        raise SpecError("results are exported as csv or json")
    entries = []
    for name, table in tables.items():
        writer = table.rows.write.mode("overwrite")
        target = f"{path}/{name}"
        if fmt == "csv":
            writer.option("header", True).csv(target)
        else:
            writer.json(target)
        entries.append(
            (name, table.title, fmt, json.dumps(dict(table.settings), sort_keys=True), json.dumps(dict(table.filters), sort_keys=True))
        )
    schema = "name string, title string, format string, settings string, filters string"
    spark.createDataFrame(entries, schema).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
