"""Dividing a cohort into children that keep their parent's join times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.operators.ordering import hash_ranked
from strideline.specs import SpecError

MIN_SPLIT_USERS = 8  # fixed value
OTHER = "_other"


def random_split(members: DataFrame, groups: int, seed: str, min_users: int = MIN_SPLIT_USERS) -> DataFrame:
    """``(cohort_id, user_id, join_time, group_index)`` in groups of near-equal size.

    Users are ranked by a hash of id and seed and cut into equal shares of the ranks.
    A cohort of fewer than ``min_users`` users yields nothing; :func:`strideline.operators.lineage.split`
    looks first and raises.
    """
    if groups < 2:
        raise SpecError("a split needs at least 2 groups")
    ranked = hash_ranked(members, ["cohort_id"], "user_id", seed).where(F.col("_total") >= min_users)
    index = F.floor(F.col("_rank") * F.lit(groups) / F.col("_total")).cast("int")
    return ranked.select("cohort_id", "user_id", "join_time", index.alias("group_index"))


def hash_split(members: DataFrame, groups: int, seed: str) -> DataFrame:
    """Approximately equal groups without any ordering or shuffle."""
    digits = F.substring(F.md5(F.concat(F.col("user_id"), F.lit(seed))), 1, 8)
    index = F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(groups)).cast("int")
    return members.withColumn("group_index", index)


def property_split(members: DataFrame, events: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One child per value the user ever had, and ``_other`` for users with none.

    A user may be in several children. ``_other`` has no rows when nobody is left.
    """
    if column not in events.columns:
        raise SpecError(f"unknown column {column!r}")
    shown = F.col(column).cast("string")
    had = events.where(shown.isin([str(v) for v in values])).groupBy("user_id").agg(
        F.collect_set(shown).alias("_values")  # at most len(values) entries
    )
    joined = members.join(had, "user_id", "left")
    children = F.coalesce(F.col("_values"), F.array(F.lit(OTHER)))
    return joined.select("cohort_id", "user_id", "join_time", F.explode(children).alias("split_value"))


def split_preview(children: DataFrame, label: str) -> DataFrame:
    """Sizes a split would give, by the split's own rule."""
    return children.groupBy("cohort_id", label).agg(F.count(F.lit(1)).alias("size"))
