"""Registered queries: flows and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideline.operators import flow, lineage, paths, sketches
from strideline.operators.staging import stage, staging_path
from strideline.plans.base import COHORTS, EV, MEMBERS, OD, SIZES, act, events, orders, quantile_seconds_sql, query, study
from strideline.operators.cohorts import all_users
from strideline.specs import EventMatch, Filter, PathStep

# --- naive SQL for chains ---------------------------------------------------------


def chain(steps: list[tuple[str, str]], forward: bool = True, gap_minutes: int | None = None) -> list[str]:
    """CTEs s1..sk over ``act``: rank all candidates per cohort and user, keep the first.

    Each step is (row condition, branch expression), both over alias ``e``.
    """
    ctes = []
    for n, (condition, branch) in enumerate(steps, start=1):
        if n == 1:
            ctes.append(f"""s1 AS (SELECT cohort_id, user_id, event_time AS t1, row_id AS id1, event_time AS t, row_id AS id, [row_id] AS used,
              branch AS b1 FROM (SELECT e.*, {branch} AS branch, ROW_NUMBER() OVER (PARTITION BY cohort_id, user_id ORDER BY event_time, row_id) AS rn
              FROM act e WHERE {condition}) WHERE rn = 1)""")
            continue
        way, direction = (">", "ASC") if forward else ("<", "DESC")
        gap = f"AND e.event_time <= s.t + INTERVAL {gap_minutes} MINUTE" if gap_minutes is not None else ""
        kept = ", ".join(f"s.t{i}, s.id{i}, s.b{i}" for i in range(1, n))
        ctes.append(f"""s{n} AS (SELECT * EXCLUDE (rn) FROM (
          SELECT s.cohort_id, s.user_id, {kept}, e.event_time AS t{n}, e.row_id AS id{n}, {branch} AS b{n}, e.event_time AS t, e.row_id AS id,
                 list_append(s.used, e.row_id) AS used, e.event_name AS name,
                 ROW_NUMBER() OVER (PARTITION BY e.cohort_id, e.user_id ORDER BY e.event_time {direction}, e.row_id {direction}) AS rn
          FROM s{n - 1} s JOIN act e ON e.cohort_id = s.cohort_id AND e.user_id = s.user_id
          WHERE ({condition}) AND NOT list_contains(s.used, e.row_id)
            AND (e.event_time {way} s.t OR (e.event_time = s.t AND e.row_id <> s.id)) {gap}) WHERE rn = 1)""")
    return ctes


def _named(*names: str) -> list[tuple[str, str]]:
    return [(f"e.event_name = '{name}'", "0") for name in names]


def moves_sql(names: list[str], forward: bool = True) -> list[str]:
    """The chain, one more step of any name, and one row per anchored user."""
    k = len(names)
    steps = _named(*names) + [("TRUE", "0")]
    return [
        *chain(steps, forward),
        f"""moves AS (SELECT a.cohort_id, a.user_id, n.name AS next_event, ABS(epoch_us(n.t{k + 1}) - epoch_us(n.t{k})) / 1000000.0 AS seconds
        FROM s{k} a LEFT JOIN s{k + 1} n ON n.cohort_id = a.cohort_id AND n.user_id = a.user_id)""",
        """ranked AS (SELECT next_event, total_users, ROW_NUMBER() OVER (ORDER BY total_users DESC, next_event) AS rank FROM (
        SELECT next_event, COUNT(DISTINCT user_id) AS total_users FROM moves WHERE next_event IS NOT NULL GROUP BY 1))""",
        "anchors AS (SELECT cohort_id, COUNT(*) AS anchor_users FROM moves GROUP BY 1)",
    ]


def level_sql(top: int) -> str:
    return f"""SELECT cohort_id, next_event, position, users, anchor_users FROM (
      SELECT m.cohort_id, m.next_event, r.rank AS position, COUNT(*) AS users FROM moves m JOIN ranked r ON r.next_event = m.next_event AND r.rank <= {top} GROUP BY 1, 2, 3
      UNION ALL SELECT m.cohort_id, '__OTHER__', {top + 1}, COUNT(*) FROM moves m JOIN ranked r ON r.next_event = m.next_event AND r.rank > {top} GROUP BY 1
      UNION ALL SELECT cohort_id, 'No further action', {top + 2}, COUNT(*) FILTER (next_event IS NULL) FROM moves GROUP BY 1
    ) JOIN anchors USING (cohort_id)"""


_LEVEL = "cohort_id:i next_event:s position:i users:i anchor_users:i"


def _base(spark, sf):
    base = study(events(spark, sf))
    return base.rows, base.members, base.hot


# --- flows ------------------------------------------------------------------------


@query(
    "flow_root",
    "cohort_id:i user_id:s root_time:t root_id:i",
    "SELECT cohort_id, user_id, t1 AS root_time, id1 AS root_id FROM s1",
    *MEMBERS,
    act(),
    *chain([("e.event_name = 'view' AND e.k > 50", "0")]),
)
def flow_root(spark, sf):
    rows, joined, hot = _base(spark, sf)
    states = flow.flow_root(rows, joined, "view", Filter("k", ">", 50), hot=hot)
    first = F.element_at("trail", 1)
    return states.select("cohort_id", "user_id", first["time"].alias("root_time"), first["id"].alias("root_id"))


@query("flow_l1_forward", _LEVEL, level_sql(3), *MEMBERS, act(), *moves_sql(["view"]))
def flow_l1_forward(spark, sf):
    rows, joined, hot = _base(spark, sf)
    return flow.flow_level(rows, joined, ["view"], timing=False, hot=hot)


@query("flow_l1_reverse", _LEVEL, level_sql(3), *MEMBERS, act(), *moves_sql(["purchase"], forward=False))
def flow_l1_reverse(spark, sf):
    rows, joined, hot = _base(spark, sf)
    return flow.flow_level(rows, joined, ["purchase"], "reverse", timing=False, hot=hot)


@query(
    "flow_ties",
    _LEVEL,
    level_sql(3),
    OD,
    "m AS (SELECT 1 AS cohort_id, user_id, MIN(event_time) AS join_time FROM od GROUP BY user_id)",
    act().replace("ev.", "od.").replace("JOIN ev", "JOIN od"),
    *moves_sql(["O", "F"]),
)
def flow_ties(spark, sf):
    rows = orders(spark, sf)
    return flow.flow_level(rows, all_users(rows), ["O", "F"], timing=False)


def _moves(spark, sf, *path):
    rows, joined, hot = _base(spark, sf)
    anchors = flow.flow_anchors(rows, joined, list(path), hot=hot)
    return stage(flow.transitions(rows, anchors, len(path), hot=hot))


@query(
    "flow_transition_timing",
    "cohort_id:i next_event:s p20_seconds:d median_seconds:d p80_seconds:d",
    f"""SELECT cohort_id, next_event, {quantile_seconds_sql(0.2)} AS p20_seconds, {quantile_seconds_sql(0.5)} AS median_seconds,
       {quantile_seconds_sql(0.8)} AS p80_seconds FROM moves WHERE next_event IS NOT NULL GROUP BY 1, 2""",
    *MEMBERS,
    act(),
    *moves_sql(["view"]),
)
def flow_transition_timing(spark, sf):
    return flow.transition_timing(_moves(spark, sf, "view"))


_BOUND = 2 * sketches.rank_error()  # twice the 99 % error: no chance of note is left


@query(
    "flow_timing_sketches",
    "cohort_id:i next_event:s n:i p20_within:b median_within:b p80_within:b",
    """SELECT cohort_id, next_event, COUNT(*) AS n, TRUE AS p20_within, TRUE AS median_within, TRUE AS p80_within
       FROM moves WHERE next_event IS NOT NULL GROUP BY 1, 2""",
    *MEMBERS,
    act(),
    *moves_sql(["view"]),
)
def flow_timing_sketches(spark, sf):
    """Day sketches, stored, read back and merged; each estimate's rank is held against the exact one."""
    keys, moves = ["cohort_id", "next_event"], _moves(spark, sf, "view")
    path = staging_path(spark)
    sketches.save(flow.timing_sketches(moves), path)
    found = stage(sketches.quantiles(sketches.merged(sketches.load(spark, path), keys), keys, flow.TIMINGS))
    values = moves.withColumn("micros", F.round(F.col("seconds") * 1_000_000.0).cast("long"))
    shares = sketches.rank_bounds(values, keys, "micros", found, list(flow.TIMINGS))
    marks = [
        sketches.within(f, F.col(f"{name}_low"), F.col(f"{name}_high"), _BOUND).alias(name.replace("_seconds", "_within"))
        for name, f in flow.TIMINGS.items()
    ]
    return found.join(shares, keys).select(*keys, "n", *marks)


@query("flow_top_n", "next_event:s total_users:i rank:i", "SELECT * FROM ranked WHERE rank <= 2", *MEMBERS, act(), *moves_sql(["view"]))
def flow_top_n(spark, sf):
    return flow.rank_targets(_moves(spark, sf, "view")).where(F.col("rank") <= 2)


@query("flow_event_types", "event_types:i", "SELECT COUNT(DISTINCT next_event) AS event_types FROM moves", *MEMBERS, act(), *moves_sql(["view"]))
def flow_event_types(spark, sf):
    return flow.target_types(_moves(spark, sf, "view"))


@query("flow_other_bucket", _LEVEL, f"SELECT * FROM ({level_sql(1)}) WHERE next_event = '__OTHER__'", *MEMBERS, act(), *moves_sql(["click"]))
def flow_other_bucket(spark, sf):
    return flow.target_counts(_moves(spark, sf, "click"), 1).where(F.col("next_event") == flow.OTHER)


@query("flow_no_further", _LEVEL, f"SELECT * FROM ({level_sql(3)}) WHERE next_event = 'No further action'", *MEMBERS, act(), *moves_sql(["view", "purchase", "error", "signup"]))
def flow_no_further(spark, sf):
    moves = _moves(spark, sf, "view", "purchase", "error", "signup")
    return flow.target_counts(moves, 3).where(F.col("next_event") == flow.NO_FURTHER)


@query("flow_l2", _LEVEL, level_sql(3), *MEMBERS, act(), *moves_sql(["view", "click"]))
def flow_l2(spark, sf):
    rows, joined, hot = _base(spark, sf)
    return flow.flow_level(rows, joined, ["view", "click"], timing=False, hot=hot)


_EDGE_LEVEL_ONE = """l1 AS (SELECT cohort_id, 0 AS source_step, 'view' AS source_event, 'view' AS source_path, anchor_users AS source_users,
  1 AS target_step, next_event AS target_event, users AS target_users FROM (""" + level_sql(3) + "))"
_EDGES = (
    *moves_sql(["view"]),
    _EDGE_LEVEL_ONE,
    """x1 AS (SELECT * FROM (SELECT s.cohort_id, s.user_id, r.next_event AS node, e.event_time AS t, e.row_id AS id, list_append(s.used, e.row_id) AS used,
         ROW_NUMBER() OVER (PARTITION BY s.cohort_id, s.user_id, r.next_event ORDER BY e.event_time, e.row_id) AS rn
       FROM s1 s CROSS JOIN (SELECT next_event FROM ranked WHERE rank <= 3) r
       JOIN act e ON e.cohort_id = s.cohort_id AND e.user_id = s.user_id AND e.event_name = r.next_event
       WHERE NOT list_contains(s.used, e.row_id) AND e.event_time >= s.t) WHERE rn = 1)""",
    """x2 AS (SELECT * FROM (SELECT s.cohort_id, s.user_id, s.node, e.event_name AS name,
         ROW_NUMBER() OVER (PARTITION BY s.cohort_id, s.user_id, s.node ORDER BY e.event_time, e.row_id) AS rn
       FROM x1 s JOIN act e ON e.cohort_id = s.cohort_id AND e.user_id = s.user_id
       WHERE NOT list_contains(s.used, e.row_id) AND e.event_time >= s.t) WHERE rn = 1)""",
    """y AS (SELECT a.cohort_id, a.user_id, a.node, b.name AS next_event FROM x1 a LEFT JOIN x2 b USING (cohort_id, user_id, node))""",
    """yr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY node ORDER BY u DESC, next_event) AS rank FROM (
         SELECT node, next_event, COUNT(DISTINCT user_id) AS u FROM y WHERE next_event IS NOT NULL GROUP BY 1, 2))""",
    """yt AS (SELECT y.cohort_id, y.node, CASE WHEN y.next_event IS NULL THEN 'No further action' WHEN yr.rank <= 3 THEN y.next_event ELSE '__OTHER__' END AS target_event,
         COUNT(*) AS users FROM y LEFT JOIN yr ON yr.node = y.node AND yr.next_event = y.next_event GROUP BY 1, 2, 3)""",
    """l2 AS (SELECT n.cohort_id, 1 AS source_step, n.node AS source_event, 'view > ' || n.node AS source_path, n.total AS source_users, 2 AS target_step,
         t.target_event, COALESCE(t.users, 0) AS target_users
       FROM (SELECT cohort_id, node, COUNT(*) AS total FROM y GROUP BY 1, 2) n
       JOIN (SELECT cohort_id, node, target_event, users FROM yt
             UNION ALL SELECT cohort_id, node, 'No further action', 0 FROM (SELECT DISTINCT cohort_id, node FROM y)
               WHERE (cohort_id, node) NOT IN (SELECT (cohort_id, node) FROM yt WHERE target_event = 'No further action')) t
         ON t.cohort_id = n.cohort_id AND t.node = n.node)""",
    SIZES,
)


@query(
    "flow_edge_list",
    "cohort_id:i cohort_size:i source_step:i source_event:s source_path:s source_users:i target_step:i target_event:s target_users:i transition_pct:d",
    """SELECT e.*, s.size AS cohort_size, CASE WHEN source_users > 0 THEN target_users * 1.0 / source_users ELSE 0 END AS transition_pct
       FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) e JOIN sizes s ON s.cohort_id = e.cohort_id""",
    *MEMBERS,
    act(),
    *_EDGES,
)
def flow_edge_list(spark, sf):
    rows, joined, hot = _base(spark, sf)
    return flow.flow_edges(rows, joined, "view", depth=2, top_n=3, hot=hot)


# --- paths ------------------------------------------------------------------------

_GAP = 2_880  # minutes
_STEPS = [
    PathStep.of("view"),
    PathStep((EventMatch("click", {"k": 10}), EventMatch("signup"), EventMatch("click"))),
    PathStep.of("purchase"),
]
_CHAIN = [
    ("e.event_name = 'view'", "0"),
    ("e.event_name IN ('click', 'signup')", "CASE WHEN e.event_name = 'click' AND e.k = 10 THEN 0 WHEN e.event_name = 'signup' THEN 1 ELSE 2 END"),
    ("e.event_name = 'purchase'", "0"),
]
_LABELS = ["view", "click (k=10) OR signup OR click", "purchase"]


def _trails_frame(trails, steps):
    times = [F.get("trail", F.lit(i))["time"].alias(f"t{i + 1}") for i in range(steps)]
    return trails.select("cohort_id", "user_id", F.size("trail").alias("reached"), *times)


def _trails_sql(steps: int) -> str:
    joins = "".join(f" LEFT JOIN s{n} ON s{n}.cohort_id = m.cohort_id AND s{n}.user_id = m.user_id" for n in range(1, steps + 1))
    reached = " + ".join(f"CASE WHEN s{n}.t IS NULL THEN 0 ELSE 1 END" for n in range(1, steps + 1))
    times = ", ".join(f"s{n}.t AS t{n}" for n in range(1, steps + 1))
    return f"SELECT m.cohort_id, m.user_id, {reached} AS reached, {times} FROM m{joins}"


_TRAIL = "cohort_id:i user_id:s reached:i t1:t t2:t t3:t"


@query("path_three_steps", _TRAIL, _trails_sql(3), *MEMBERS, act(), *chain(_named("view", "click", "purchase")))
def path_three_steps(spark, sf):
    rows, joined, hot = _base(spark, sf)
    steps = [PathStep.of(name) for name in ("view", "click", "purchase")]
    return _trails_frame(paths.path_trails(rows, joined, steps, hot=hot), 3)


@query(
    "path_ties",
    _TRAIL,
    _trails_sql(3),
    OD,
    "m AS (SELECT 1 AS cohort_id, user_id, MIN(event_time) AS join_time FROM od GROUP BY user_id)",
    act().replace("ev.", "od.").replace("JOIN ev", "JOIN od"),
    *chain(_named("O", "F", "O")),
)
def path_ties(spark, sf):
    rows = orders(spark, sf)
    return _trails_frame(paths.path_trails(rows, all_users(rows), [PathStep.of(n) for n in ("O", "F", "O")]), 3)


@query(
    "path_or_groups",
    "cohort_id:i user_id:s step:i branch:i seconds:d",
    """SELECT cohort_id, user_id, 1 AS step, b1 AS branch, CAST(NULL AS DOUBLE) AS seconds FROM s1
       UNION ALL SELECT cohort_id, user_id, 2, b2, (epoch_us(t2) - epoch_us(t1)) / 1000000.0 FROM s2
       UNION ALL SELECT cohort_id, user_id, 3, b3, (epoch_us(t3) - epoch_us(t2)) / 1000000.0 FROM s3""",
    *MEMBERS,
    act(),
    *chain(_CHAIN),
)
def path_or_groups(spark, sf):
    rows, joined, hot = _base(spark, sf)
    return paths.reached_steps(paths.path_trails(rows, joined, _STEPS, hot=hot))


@query("path_max_gap", _TRAIL, _trails_sql(3), *MEMBERS, act(), *chain(_CHAIN, gap_minutes=_GAP))
def path_max_gap(spark, sf):
    rows, joined, hot = _base(spark, sf)
    return _trails_frame(paths.path_trails(rows, joined, _STEPS, _GAP, hot=hot), 3)


_CASES = " ".join(f"WHEN {n} THEN '{label}'" for n, label in enumerate(_LABELS, start=1))
_REACHED = """reached AS (
  SELECT cohort_id, user_id, 1 AS step, b1 AS branch, CAST(NULL AS DOUBLE) AS seconds FROM s1
  UNION ALL SELECT cohort_id, user_id, 2, b2, (epoch_us(t2) - epoch_us(t1)) / 1000000.0 FROM s2
  UNION ALL SELECT cohort_id, user_id, 3, b3, (epoch_us(t3) - epoch_us(t2)) / 1000000.0 FROM s3)"""
_CONVERSION_CTE = f"""conversion AS (
  SELECT cohort_id, step, CASE step {_CASES} END AS event, size, users, round_even(users * 100.0 / size, 1) AS conversion_pct,
         CASE WHEN prev > 0 THEN round_even((prev - users) * 100.0 / prev, 1) WHEN prev IS NOT NULL THEN 0.0 END AS drop_off_pct,
         round_even(mean_seconds, 1) AS mean_seconds, round_even(CASE WHEN users >= 50 THEN p20 END, 1) AS p20_seconds,
         round_even(CASE WHEN users >= 50 THEN p80 END, 1) AS p80_seconds
  FROM (SELECT z.cohort_id, z.step, z.size, COALESCE(c.users, 0) AS users, mean_seconds, p20, p80,
               LAG(COALESCE(c.users, 0)) OVER (PARTITION BY z.cohort_id ORDER BY z.step) AS prev
        FROM (SELECT s.cohort_id, s.size, i.step FROM sizes s CROSS JOIN (VALUES (1), (2), (3)) i(step)) z
        LEFT JOIN (SELECT cohort_id, step, COUNT(*) AS users, AVG(seconds) AS mean_seconds, {quantile_seconds_sql(0.2)} AS p20,
                          {quantile_seconds_sql(0.8)} AS p80 FROM reached GROUP BY 1, 2) c
          ON c.cohort_id = z.cohort_id AND c.step = z.step))"""
_CONVERSION = (*MEMBERS, act(), *chain(_CHAIN, gap_minutes=_GAP), _REACHED, SIZES, _CONVERSION_CTE)


def _conversion(spark, sf):
    rows, joined, hot = _base(spark, sf)
    return paths.path_conversion(paths.path_trails(rows, joined, _STEPS, _GAP, hot=hot), joined, _STEPS)


@query(
    "path_conversion",
    "cohort_id:i step:i event:s size:i users:i conversion_pct:d drop_off_pct:d mean_seconds:d p20_seconds:d p80_seconds:d",
    "SELECT * FROM conversion",
    *_CONVERSION,
)
def path_conversion(spark, sf):
    return _conversion(spark, sf)


@query(
    "path_group_breakdown",
    "cohort_id:i step:i branch:i event:s step_users:i users:i share_pct:d",
    """SELECT t.cohort_id, 2 AS step, o.branch, o.event, t.n AS step_users, COUNT(r.user_id) AS users, round_even(COUNT(r.user_id) * 100.0 / t.n, 1) AS share_pct
       FROM (SELECT cohort_id, COUNT(*) AS n FROM reached WHERE step = 2 GROUP BY 1) t
       CROSS JOIN (VALUES (0, 'click'), (1, 'signup'), (2, 'click')) o(branch, event)
       LEFT JOIN reached r ON r.cohort_id = t.cohort_id AND r.step = 2 AND r.branch = o.branch GROUP BY 1, 3, 4, 5""",
    *_CONVERSION,
)
def path_group_breakdown(spark, sf):
    rows, joined, hot = _base(spark, sf)
    shares = paths.group_breakdown(paths.path_trails(rows, joined, _STEPS, _GAP, hot=hot), _STEPS)
    return shares.select("cohort_id", "step", "branch", "event", "step_users", "users", "share_pct")


@query(
    "path_insights",
    "cohort_id:i step:i insight:s amount:d",
    """SELECT cohort_id, step, 'drop_off' AS insight, drop_off_pct AS amount FROM conversion WHERE drop_off_pct > 20
       UNION ALL SELECT cohort_id, step, 'slow_progression', p80_seconds FROM conversion WHERE p80_seconds > 120
       UNION ALL SELECT cohort_id, step, 'high_variability', p80_seconds / p20_seconds FROM conversion WHERE p20_seconds > 0 AND p80_seconds / p20_seconds > 5
       UNION ALL SELECT cohort_id, step, 'not_started', round_even((size - users) * 100.0 / size, 1) FROM conversion
                 WHERE step = 1 AND (size - users) * 1.0 / size > 0.2""",
    *_CONVERSION,
)
def path_insights(spark, sf):
    return paths.path_insights(_conversion(spark, sf))


@query(
    "path_cohort_gaps",
    "step:i higher_cohort:i lower_cohort:i points:d",
    """SELECT a.step, CASE WHEN a.conversion_pct > b.conversion_pct THEN a.cohort_id ELSE b.cohort_id END AS higher_cohort,
       CASE WHEN a.conversion_pct > b.conversion_pct THEN b.cohort_id ELSE a.cohort_id END AS lower_cohort,
       round_even(ABS(a.conversion_pct - b.conversion_pct), 1) AS points
       FROM conversion a JOIN conversion b ON a.step = b.step AND a.cohort_id < b.cohort_id
       WHERE ABS(a.conversion_pct - b.conversion_pct) > 10
         AND a.cohort_id IN (SELECT cohort_id FROM sizes ORDER BY size DESC, cohort_id LIMIT 3)
         AND b.cohort_id IN (SELECT cohort_id FROM sizes ORDER BY size DESC, cohort_id LIMIT 3)""",
    *_CONVERSION,
)
def path_cohort_gaps(spark, sf):
    return paths.cohort_gaps(stage(_conversion(spark, sf)))


_MEMBER = "cohort_id:i user_id:s join_time:t"


@query(
    "path_dropoff_cohort",
    _MEMBER,
    """SELECT m.* FROM m JOIN s2 ON s2.cohort_id = m.cohort_id AND s2.user_id = m.user_id
       WHERE NOT EXISTS (SELECT 1 FROM s3 WHERE s3.cohort_id = m.cohort_id AND s3.user_id = m.user_id)""",
    *MEMBERS,
    act(),
    *chain(_CHAIN, gap_minutes=_GAP),
)
def path_dropoff_cohort(spark, sf):
    rows, joined, hot = _base(spark, sf)
    return paths.dropoff_cohort(rows, joined, _STEPS, 3, _GAP, hot=hot)


@query(
    "path_reached_cohort",
    _MEMBER,
    "SELECT m.* FROM m WHERE EXISTS (SELECT 1 FROM s2 WHERE s2.cohort_id = m.cohort_id AND s2.user_id = m.user_id)",
    *MEMBERS,
    act(),
    *chain(_CHAIN, gap_minutes=_GAP),
)
def path_reached_cohort(spark, sf):
    rows, joined, hot = _base(spark, sf)
    return paths.reached_cohort(rows, joined, _STEPS, 2, _GAP, hot=hot)


# --- derived cohorts under a filter -------------------------------------------------

_IN_SCOPE = "k < 70"
_SCOPED = (EV.replace("ev AS", "all_events AS", 1), f"ev AS (SELECT * FROM all_events WHERE {_IN_SCOPE})", *MEMBERS[1:])
_GROUPS = lineage.RandomGroups(3, "derived")


def _in_groups(source: str) -> str:
    return f"""(SELECT *, floor(rn * 3 / total) AS part FROM (
       SELECT *, ROW_NUMBER() OVER (ORDER BY md5(user_id || 'derived'), user_id) - 1 AS rn, COUNT(*) OVER () AS total FROM {source}))"""


@query(
    "cohort_derived_split",
    _MEMBER,
    f"SELECT 21 + part AS cohort_id, user_id, join_time FROM {_in_groups('(SELECT * FROM m WHERE cohort_id = 3)')}",
    *_SCOPED,
)
def cohort_derived_split(spark, sf):
    """A split made over all events, evaluated again under a filter."""
    rows = events(spark, sf)
    derived = lineage.split(rows, COHORTS, [], 3, _GROUPS, 21)
    return lineage.build_all(rows, COHORTS, derived, F.expr(_IN_SCOPE)).where("cohort_id >= 21")


@query(
    "cohort_derived_dropoff",
    _MEMBER,
    f"""SELECT * FROM left_path UNION ALL SELECT 32 + part, user_id, join_time FROM {_in_groups('left_path')}""",
    *_SCOPED,
    act(),
    *chain(_CHAIN, gap_minutes=_GAP),
    """left_path AS (SELECT 31 AS cohort_id, m.user_id, m.join_time FROM m JOIN s1 ON s1.cohort_id = m.cohort_id AND s1.user_id = m.user_id
       WHERE m.cohort_id = 1 AND NOT EXISTS (SELECT 1 FROM s2 WHERE s2.cohort_id = m.cohort_id AND s2.user_id = m.user_id))""",
)
def cohort_derived_dropoff(spark, sf):
    """Those who left a path after its first step, and a split of them, under a filter."""
    rows = events(spark, sf)
    left = lineage.Derived(31, "left", 1, lineage.PathWalk(tuple(_STEPS), _GAP), ("dropped", 2))
    parts = [lineage.Derived(32 + i, f"left {i}", 31, _GROUPS, i) for i in range(3)]
    return lineage.build_all(rows, COHORTS, [*parts, left], F.expr(_IN_SCOPE)).where("cohort_id >= 31")


@query(
    "path_spec_values_present",
    "column_name:s value:s rows:i present:b",
    """SELECT *, rows > 0 AS present FROM (
       SELECT 'event_name' AS column_name, n AS value, (SELECT COUNT(*) FROM ev WHERE event_name = n) AS rows
         FROM (VALUES ('view'), ('click'), ('signup'), ('purchase'), ('refund')) v(n)
       UNION ALL SELECT 'k', '10', COUNT(*) FROM ev WHERE k = 10
       UNION ALL SELECT 'k', '1000', COUNT(*) FROM ev WHERE k = 1000)""",
    MEMBERS[0],
)
def path_spec_values_present(spark, sf):
    steps = [*_STEPS, PathStep((EventMatch("refund", {"k": 1000}),))]
    return paths.path_references(events(spark, sf), steps)
