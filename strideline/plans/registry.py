"""All registered queries. Importing a module registers what it defines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strideline.plans import dataset, experiments, metrics, sequences, users  # noqa: F401
from strideline.plans.base import ORACLE, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
