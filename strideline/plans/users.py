"""Registered queries: user search and timelines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from strideline.operators import text_index, timeline
from strideline.operators.staging import staging_path
from strideline.plans.base import COHORTS, EV, MEMBERS, OD, events, members, orders, query, study

_NOON = datetime(2024, 1, 12, 12)
_SPOT = "user_id:s event_time:t event_name:s row_id:i"


@query(
    "user_search",
    "user_id:s",
    "SELECT DISTINCT user_id FROM ev WHERE user_id ILIKE '%1%' AND user_id IN (SELECT user_id FROM m WHERE cohort_id = 3) ORDER BY 1 LIMIT 20",
    *MEMBERS,
)
def user_search(spark, sf):
    rows = events(spark, sf)
    return timeline.search_users(rows, "1", 20, members(rows), 3)


@query(
    "user_search_indexed",
    "user_id:s",
    "SELECT DISTINCT user_id FROM ev WHERE user_id ILIKE '%1%' AND user_id IN (SELECT user_id FROM m WHERE cohort_id = 3) ORDER BY 1 LIMIT 20",
    *MEMBERS,
)
def user_search_indexed(spark, sf):
    rows = events(spark, sf)
    index = text_index.build(rows, "user_id", staging_path(spark))
    return text_index.search_users(index, "1", 20, members(rows), 3)


@query(
    "user_summary",
    "user_id:s first_event_time:t last_event_time:t total_events:i priority:s",
    """SELECT user_id, MIN(event_time) AS first_event_time, MAX(event_time) AS last_event_time, SUM(event_count) AS total_events,
       MIN(priority) FILTER (rn = 1) AS priority FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_time DESC, event_name DESC, row_id DESC) AS rn FROM od) GROUP BY user_id""",
    OD,
)
def user_summary(spark, sf):
    return timeline.user_summary(orders(spark, sf))


@query(
    "user_timeline_page",
    "user_id:s position:i event_time:t event_name:s row_id:i",
    """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_time, event_name, row_id) AS position FROM od)
       WHERE position BETWEEN 6 AND 10""",
    OD,
)
def user_timeline_page(spark, sf):
    return timeline.timeline_page(orders(spark, sf), 2, 5).select("user_id", "position", "event_time", "event_name", "row_id")


#: Three "users" that own all rows: the status of an order.
_FEW = "few AS (SELECT event_name AS user_id, event_time, priority AS event_name, row_id FROM od)"


def _few(spark, sf):
    return orders(spark, sf).select(F.col("event_name").alias("user_id"), "event_time", F.col("priority").alias("event_name"), "row_id")


@query(
    "user_timeline_deep_page",
    "user_id:s position:i event_time:t event_name:s row_id:i",
    """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_time, event_name, row_id) AS position FROM few)
       WHERE position BETWEEN 3001 AND 3050""",
    OD,
    _FEW,
)
def user_timeline_deep_page(spark, sf):
    """Page 61 of users with thousands of events each."""
    return timeline.timeline_page(_few(spark, sf), 61, 50).select("user_id", "position", "event_time", "event_name", "row_id")


@query(
    "user_timeline_page_over_1000",
    "user_id:s position:i event_time:t event_name:s row_id:i",
    """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_time, event_name, row_id) AS position FROM few)
       WHERE position BETWEEN 3601 AND 3603""",
    OD,
    _FEW,
)
def user_timeline_page_over_1000(spark, sf):
    """Page 1,201, of three events."""
    return timeline.timeline_page(_few(spark, sf), 1_201, 3).select("user_id", "position", "event_time", "event_name", "row_id")


_NEAREST = """SELECT user_id, event_time, event_name, row_id FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY {order}) AS rn FROM ev WHERE {where}) WHERE rn = 1"""
_UP = "event_time, event_name, row_id"
_DOWN = "event_time DESC, event_name DESC, row_id DESC"


@query("user_jump", _SPOT, _NEAREST.format(order=_UP, where="event_time >= TIMESTAMP '2024-01-12 12:00:00'"), EV)
def user_jump(spark, sf):
    return timeline.jump_to(events(spark, sf), _NOON)


@query("user_next_event", _SPOT, _NEAREST.format(order=_UP, where="event_name = 'click' AND event_time > TIMESTAMP '2024-01-12 12:00:00'"), EV)
def user_next_event(spark, sf):
    return timeline.next_event(events(spark, sf), "click", _NOON)


@query("user_previous_event", _SPOT, _NEAREST.format(order=_DOWN, where="event_name = 'click' AND event_time < TIMESTAMP '2024-01-12 12:00:00'"), EV)
def user_previous_event(spark, sf):
    return timeline.previous_event(events(spark, sf), "click", _NOON)


@query(
    "user_page_of",
    "user_id:s event_time:t event_name:s page:i",
    """SELECT s.user_id, s.event_time, s.event_name, floor((SELECT COUNT(*) FROM ev WHERE ev.user_id = s.user_id AND
         (ev.event_time < s.event_time OR (ev.event_time = s.event_time AND ev.event_name < s.event_name))) / 10) + 1 AS page
       FROM (""" + _NEAREST.format(order=_UP, where="event_time >= TIMESTAMP '2024-01-12 12:00:00'") + ") s",
    EV,
)
def user_page_of(spark, sf):
    rows = events(spark, sf)
    return timeline.page_of(rows, timeline.jump_to(rows, _NOON), 10)


@query(
    "user_cohort_join_tags",
    "user_id:s event_time:t event_name:s row_id:i cohort_joins:s",
    """SELECT user_id, event_time, event_name, row_id, string_agg(name, '|' ORDER BY join_time, name) AS cohort_joins FROM (
       SELECT ev.*, m.join_time, c.name, ROW_NUMBER() OVER (PARTITION BY m.cohort_id, m.user_id ORDER BY ev.event_time, ev.event_name, ev.row_id) AS rn
       FROM m JOIN (VALUES (2, 'Heavy buyers'), (3, 'Engaged'), (4, 'Smooth buyers')) c(id, name) ON c.id = m.cohort_id
       JOIN ev ON ev.user_id = m.user_id AND ev.event_time >= m.join_time) WHERE rn = 1 GROUP BY 1, 2, 3, 4""",
    *MEMBERS,
)
def user_cohort_join_tags(spark, sf):
    base = study(events(spark, sf))
    return timeline.cohort_join_tags(base.rows, base.members, COHORTS, base.hot)
