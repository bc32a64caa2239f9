"""Transitions: what users do right after (or before) a chain of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.predicates import root_predicate
from strideline.functions.times import seconds_between
from strideline.operators.cohorts import cohort_sizes
from strideline.operators import sketches
from strideline.operators.ordering import quantile_seconds
from strideline.operators.sequences import next_rows, start_states
from strideline.operators.skew import HotKeys, hot_keys, spread
from strideline.operators.staging import stage
from strideline.specs import MAX_FLOW_DEPTH, MAX_TOP_N, Filter, SpecError

# Names of the synthetic targets.
OTHER = "__OTHER__"
NO_FURTHER = "No further action"

TIMINGS = {"p20_seconds": 0.2, "median_seconds": 0.5, "p80_seconds": 0.8}


def _forward(direction: str) -> bool:
    if direction not in ("forward", "reverse"):
        raise SpecError("direction is forward or reverse")
    return direction == "forward"


def _spread_events(events: DataFrame, hot: HotKeys, extra: Sequence[str] = ()) -> DataFrame:
    return spread(events.select("user_id", "event_time", "row_id", "event_name", *extra), hot)


def flow_root(events: DataFrame, members: DataFrame, start: str, where: Filter | None = None, hot: HotKeys | None = None) -> DataFrame:
    """States at each member's first start event at or after joining.

    The property filter applies to this event only.
    """
    heavy = hot_keys(events) if hot is None else hot
    extra = [where.column] if where is not None and where.column not in ("user_id", "event_time", "row_id", "event_name") else []
    rows = _spread_events(events, heavy, extra)
    match = (F.col("event_name") == start) & root_predicate(events.schema, where)
    return next_rows(rows, start_states(members, heavy), heavy, 0, match, keep_unmatched=False)


def flow_anchors(
    events: DataFrame,
    members: DataFrame,
    path: Sequence[str],
    direction: str = "forward",
    where: Filter | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """States of the users who completed the whole parent path."""
    if not path or len(path) >= MAX_FLOW_DEPTH:
        raise SpecError(f"a parent path has 1 to {MAX_FLOW_DEPTH - 1} events")
    if NO_FURTHER in path or OTHER in path:
        raise SpecError("a synthetic target cannot be expanded")
    heavy = hot_keys(events) if hot is None else hot
    forward = _forward(direction)
    states = flow_root(events, members, path[0], where, heavy)
    rows = _spread_events(events, heavy)
    for done, name in enumerate(path[1:], start=1):
        states = next_rows(rows, states, heavy, done, F.col("event_name") == name, forward=forward, keep_unmatched=False)
    return states


def transitions(
    events: DataFrame,
    anchors: DataFrame,
    done: int,
    direction: str = "forward",
    hot: HotKeys | None = None,
    keys: Sequence[str] = ("cohort_id", "user_id"),
) -> DataFrame:
    """``(*keys, next_event, seconds, day)``, one row per anchored user; NULL if nothing follows.
    ``day`` is the date on which the transition begins."""
    heavy = hot_keys(events) if hot is None else hot
    moved = next_rows(_spread_events(events, heavy), anchors, heavy, done, forward=_forward(direction), keys=keys)
    here, there = F.get("trail", F.lit(done - 1)), F.get("trail", F.lit(done))
    return moved.select(
        *keys, there["name"].alias("next_event"), F.abs(seconds_between(here["time"], there["time"])).alias("seconds"),
        here["time"].cast("date").alias("day"),
    )


def rank_targets(moves: DataFrame, node: Sequence[str] = ()) -> DataFrame:
    """Targets of a node by distinct users over all cohorts, ties by name."""
    totals = (
        moves.where(F.col("next_event").isNotNull())
        .groupBy(*node, "next_event")
        .agg(F.count_distinct("user_id").alias("total_users"))
    )
    by_users = Window.partitionBy(*(node or [F.lit(0)])).orderBy(F.col("total_users").desc(), "next_event")
    return totals.withColumn("rank", F.row_number().over(by_users))


def _top_n(top_n: int) -> int:
    if not 1 <= top_n <= MAX_TOP_N:
        raise SpecError(f"top_n is 1 to {MAX_TOP_N}")
    return top_n


def target_counts(moves: DataFrame, top_n: int = 3, node: Sequence[str] = ()) -> DataFrame:
    """``(*node, cohort_id, next_event, position, users, anchor_users)``.

    The top targets in rank order, the rest summed as ``__OTHER__``, and the users
    without any transition. The last row is always present for an anchored cohort.
    """
    top = _top_n(top_n)
    keys = [*node, "cohort_id"]
    # One row per cohort and target: everything below works on these counts.
    counts = moves.groupBy(*keys, "next_event").agg(F.count(F.lit(1)).alias("users"))
    ranked = rank_targets(moves, node).where(F.col("rank") <= top).select(*node, "next_event", "rank")
    placed = counts.join(ranked, [*node, "next_event"], "left")
    name = F.when(F.col("next_event").isNull(), NO_FURTHER).when(F.col("rank").isNull(), OTHER).otherwise(F.col("next_event"))
    position = F.when(F.col("next_event").isNull(), top + 2).otherwise(F.coalesce("rank", F.lit(top + 1)))
    grouped = (
        placed.select(*keys, name.alias("next_event"), position.alias("position"), "users")
        .groupBy(*keys, "next_event", "position")
        .agg(F.sum("users").alias("users"))
    )
    anchors = counts.groupBy(*keys).agg(F.sum("users").alias("anchor_users"))
    stopped = anchors.select(*keys, F.lit(NO_FURTHER).alias("next_event"), F.lit(top + 2).alias("position"), F.lit(0).cast("long").alias("users"))
    complete = grouped.unionByName(stopped).groupBy(*keys, "next_event", "position").agg(F.sum("users").alias("users"))
    return complete.join(anchors, keys)


def transition_timing(moves: DataFrame, keys: Sequence[str] = ("cohort_id",)) -> DataFrame:
    """Exact 20th, 50th and 80th percentile of the seconds, per cohort and target."""
    happened = moves.where(F.col("next_event").isNotNull())
    return quantile_seconds(happened, [*keys, "next_event"], "seconds", TIMINGS)


def timing_sketches(moves: DataFrame, keys: Sequence[str] = ("cohort_id",), k: int = sketches.K) -> DataFrame:
    """Mergeable sketches of the microseconds, per cohort, target and day of the transition's begin: stored once
    (:func:`strideline.operators.sketches.save`), they give the timing of any span of days."""
    happened = moves.where(F.col("next_event").isNotNull())
    whole = happened.withColumn("micros", F.round(F.col("seconds") * 1_000_000.0).cast("long"))
    return sketches.sketch_by_day(whole, [*keys, "next_event"], "day", "micros", k)


def target_types(moves: DataFrame) -> DataFrame:
    """How many different events follow."""
    return moves.agg(F.count_distinct("next_event").alias("event_types"))


def flow_level(
    events: DataFrame,
    members: DataFrame,
    path: Sequence[str],
    direction: str = "forward",
    top_n: int = 3,
    where: Filter | None = None,
    timing: bool = True,
    hot: HotKeys | None = None,
) -> DataFrame:
    """The transition table of one node, for every cohort at once."""
    hot = hot_keys(events) if hot is None else hot
    anchors = flow_anchors(events, members, path, direction, where, hot)
    moves = stage(transitions(events, anchors, len(path), direction, hot))
    counts = target_counts(moves, top_n)
    if not timing:
        return counts
    return counts.join(transition_timing(moves), ["cohort_id", "next_event"], "left")


def flow_edges(
    events: DataFrame,
    members: DataFrame,
    start: str,
    depth: int = 2,
    direction: str = "forward",
    top_n: int = 3,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Edges of the expanded tree, level by level, for export.

    A level's top targets (at most ``top_n`` per node) become the next level's
    nodes, and all nodes of a level are walked by the same join.
    """
    if not 1 <= depth < MAX_FLOW_DEPTH:
        raise SpecError(f"depth is 1 to {MAX_FLOW_DEPTH - 1}")
    hot = hot_keys(events) if hot is None else hot
    keys = ["node", "cohort_id", "user_id"]
    forward = _forward(direction)
    states = stage(flow_root(events, members, start, hot=hot).withColumn("node", F.array(F.lit(start))))
    levels = []
    for step in range(1, depth + 1):
        moves = stage(transitions(events, states, step, direction, hot, keys))
        counts = target_counts(moves, top_n, ["node"])
        levels.append(
            counts.select(
                "cohort_id",
                (F.size("node") - 1).alias("source_step"),
                F.element_at("node", -1).alias("source_event"),
                F.array_join("node", " > ").alias("source_path"),
                F.col("anchor_users").alias("source_users"),
                F.size("node").alias("target_step"),
                F.col("next_event").alias("target_event"),
                F.col("users").alias("target_users"),
            )
        )
        if step < depth:
            targets = rank_targets(moves, ["node"]).where(F.col("rank") <= top_n)
            names = targets.groupBy("node").agg(F.collect_set("next_event").alias("_names"))  # at most top_n
            wanted = states.join(names, "node").withColumn("expected", F.explode("_names")).drop("_names")
            grown = next_rows(
                _spread_events(events, hot), wanted, hot, step, forward=forward, keep_unmatched=False,
                keys=[*keys, "expected"], expected=True,
            )
            states = stage(grown.withColumn("node", F.array_append("node", F.col("expected"))).drop("expected"))
    edges = levels[0]
    for level in levels[1:]:
        edges = edges.unionByName(level)
    share = F.when(F.col("source_users") > 0, F.col("target_users") / F.col("source_users")).otherwise(0.0)
    sized = edges.join(cohort_sizes(members).withColumnRenamed("size", "cohort_size"), "cohort_id")
    return sized.withColumn("transition_pct", share)
