"""The two event streams of the test data, shared cohorts, and SQL helpers.

Every registered query has a Spark side built from the operators and, where SQL can
say it, an independent naive SQL side: dense grids, windows and cross products that
would never scale but are easy to check by reading.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.operators.cohorts import build_membership
from strideline.operators.skew import HotKeys, hot_keys
from strideline.operators.staging import stage
from strideline.operators.vectors import observed_until
from strideline.session import configure
from strideline.specs import Cohort, Condition, Filter, RevenueRule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MAX_DAY = 7


def tidy(frame: DataFrame) -> DataFrame:
    """Whole numbers as long and doubles at six decimals, so engines compare equal."""
    columns = []
    for field in frame.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("long")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # Adding zero turns a negative zero into a plain one.
            column = F.round(column.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), "|")
        columns.append(column.alias(field.name))
    return frame.select(*columns)


def query(key: str, columns: str | None = None, body: str | None = None, *ctes: str):
    """Register a Spark function with the SQL that must give the same rows.

    ``columns`` lists ``name:type`` with i (bigint), d (double), s, b, t (timestamp)
    or e (date).
    """

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: tidy(function(configure(spark), sf_dir))
        if columns is not None:
            ORACLE[key] = oracle_text(columns, body, *ctes)
        return function

    return register


_CASTS = {
    "i": "CAST({0} AS BIGINT) AS {0}",
    "d": "ROUND(CAST({0} AS DOUBLE), 6) + 0.0 AS {0}",
    "s": "CAST({0} AS VARCHAR) AS {0}",
    "b": "CAST({0} AS BOOLEAN) AS {0}",
    "t": "CAST({0} AS TIMESTAMP) AS {0}",
    "e": "CAST({0} AS DATE) AS {0}",
}


def oracle_text(columns: str, body: str, *ctes: str) -> str:
    picks = ", ".join(_CASTS[kind].format(name) for name, kind in (item.split(":") for item in columns.split()))
    head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    return f"{head}SELECT {picks} FROM (\n{body}\n) result"


# --- the streams --------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("event_name"),
        F.col("ts").alias("event_time"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.lit(1.0).alias("event_count"),
        F.col("value").alias("original_revenue"),
        F.col("value").alias("modified_revenue"),
        F.col("event_id").alias("row_id"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return raw.select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderstatus").alias("event_name"),
        F.col("o_orderdate").alias("event_time"),
        F.col("o_orderpriority").alias("priority"),
        F.lit(1.0).alias("event_count"),
        F.col("o_totalprice").alias("original_revenue"),
        F.col("o_totalprice").alias("modified_revenue"),
        F.col("o_orderkey").alias("row_id"),
    )


EV = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS event_name, ts AS event_time,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(1.0 AS DOUBLE) AS event_count,
         value AS original_revenue, value AS modified_revenue, event_id AS row_id
  FROM events)"""

OD = """od AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, o_orderstatus AS event_name, o_orderdate AS event_time,
         o_orderpriority AS priority, CAST(1.0 AS DOUBLE) AS event_count,
         o_totalprice AS original_revenue, o_totalprice AS modified_revenue, o_orderkey AS row_id
  FROM orders)"""


# --- shared cohorts -----------------------------------------------------------

HEAVY_BUYER = Condition("purchase", 14)
HIGH_CLICKS = Condition("click", 2, Filter("k", ">=", 90))
LOW_SIGNUP = Condition("signup", 1, Filter("k", "<", 5))
NO_BIG_ERROR = Condition("error", 1, Filter("k", ">", 90), negated=True)
TEN_PURCHASES = Condition("purchase", 10)

COHORTS = [
    Cohort(1, "All Users"),
    Cohort(2, "Heavy buyers", [HEAVY_BUYER]),
    Cohort(3, "Engaged", [HIGH_CLICKS, LOW_SIGNUP], "OR"),
    Cohort(4, "Smooth buyers", [NO_BIG_ERROR, TEN_PURCHASES], "AND"),
    Cohort(5, "Hidden", [Condition("view", 3)], hidden=True),
]

RULES = [
    RevenueRule("purchase"),
    RevenueRule("signup", override=2.5),
    RevenueRule("click", included=False, override=9.0),
]


@dataclass(frozen=True)
class Study:
    """What the analyses of one dataset share: hot users, stored membership, and the end."""

    rows: DataFrame
    hot: HotKeys
    members: DataFrame

    @property
    def until(self) -> datetime:
        return observed_until(self.rows)


def study(rows: DataFrame) -> Study:
    hot = hot_keys(rows)
    return Study(rows, hot, stage(build_membership(rows, COHORTS, hot=hot)))


def members(rows: DataFrame) -> DataFrame:
    return study(rows).members


def nth(source: str, where: str, n: int) -> str:
    """When the running event count of matching rows reaches ``n``, per user."""
    return f"""(SELECT user_id, MIN(event_time) AS t FROM (
      SELECT user_id, event_time, SUM(event_count) OVER (
        PARTITION BY user_id ORDER BY event_time, event_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
      FROM {source} WHERE {where}) WHERE c >= {n} GROUP BY user_id)"""


FIRST_SEEN = "first_seen AS (SELECT user_id, MIN(event_time) AS t FROM ev GROUP BY user_id)"
C2 = "c2 AS " + nth("ev", "event_name = 'purchase'", 14)
C3A = "c3a AS " + nth("ev", "event_name = 'click' AND k >= 90", 2)
C3B = "c3b AS " + nth("ev", "event_name = 'signup' AND k < 5", 1)
C4A = """c4a AS (SELECT f.user_id, f.t FROM first_seen f
  WHERE f.user_id NOT IN (SELECT user_id FROM ev WHERE event_name = 'error' AND k > 90))"""
C4B = "c4b AS " + nth("ev", "event_name = 'purchase'", 10)
M = """m AS (
  SELECT 1 AS cohort_id, user_id, t AS join_time FROM first_seen
  UNION ALL SELECT 2, user_id, t FROM c2
  UNION ALL SELECT 3, user_id, MIN(t) FROM (SELECT * FROM c3a UNION ALL SELECT * FROM c3b) GROUP BY user_id
  UNION ALL SELECT 4, c4a.user_id, LEAST(c4a.t, c4b.t) FROM c4a JOIN c4b ON c4a.user_id = c4b.user_id)"""
MEMBERS = (EV, FIRST_SEEN, C2, C3A, C3B, C4A, C4B, M)

OBS = "obs AS (SELECT date_trunc('second', quantile_cont(event_time, 0.999)) AS t FROM ev)"


def quantile_seconds_sql(fraction: float, seconds: str = "seconds") -> str:
    """A quantile of elapsed seconds in whole microseconds, halves up."""
    return f"floor(quantile_cont(CAST(round({seconds} * 1000000) AS BIGINT), {fraction}) + 0.5) / 1000000.0"


def act(unit_seconds: int = 86_400) -> str:
    return f"""act AS (
  SELECT m.cohort_id, m.join_time, ev.*,
         CAST(GREATEST(0, floor(date_diff('second', m.join_time, ev.event_time) / {unit_seconds}.0)) AS INTEGER) AS bucket
  FROM m JOIN ev ON m.user_id = ev.user_id WHERE ev.event_time >= m.join_time)"""


def grid(top: int = MAX_DAY, unit: str = "DAY") -> str:
    return f"""g AS (
  SELECT m.cohort_id, m.user_id, m.join_time, CAST(b.i AS INTEGER) AS bucket,
         CASE WHEN m.join_time + CAST(b.i AS INTEGER) * INTERVAL 1 {unit} <= obs.t THEN 1 ELSE 0 END AS ok
  FROM m CROSS JOIN generate_series(0, {top}) b(i) CROSS JOIN obs)"""


SIZES = "sizes AS (SELECT cohort_id, COUNT(*) AS size FROM m GROUP BY cohort_id)"


def two_sided_sql(z: str) -> str:
    """The polynomial normal tail, two-sided, for a non-negative ``z``."""
    t = f"(1.0 / (1.0 + 0.2316419 * {z}))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"(2.0 * (1.0 / sqrt(2.0 * pi()) * exp(-0.5 * {z} * {z}) * ({poly})))"
