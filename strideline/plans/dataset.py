"""Registered queries: ingestion, scope, revenue rules, cohorts and splits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from strideline.functions.predicates import scope_predicate
from strideline.operators import cohorts as co
from strideline.operators import events as evs
from strideline.operators import prefix, revenue, revenue_store, scope, sketches, splits, text_index
from strideline.operators.staging import stage, staging_path
from strideline.operators.vectors import OBSERVED_FRACTION, observation_end
from strideline.plans.base import (
    COHORTS,
    EV,
    FIRST_SEEN,
    HEAVY_BUYER,
    HIGH_CLICKS,
    LOW_SIGNUP,
    MEMBERS,
    NO_BIG_ERROR,
    OBS,
    OD,
    RULES,
    TEN_PURCHASES,
    act,
    events,
    members,
    nth,
    orders,
    query,
    study,
)
from strideline.sources.csv import read_csv_events, with_row_id
from strideline.sources.export import ResultTable, export_results
from strideline.specs import Cohort, Condition, Filter, RevenueRule

# --- ingestion ------------------------------------------------------------------

_TEXT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props", "is_large", "blank")


def _raw_text(spark, sf):
    raw = spark.read.parquet(f"{sf}/events.parquet")
    return raw.withColumns({"is_large": F.col("value") > 50, "blank": F.lit("  ")}).select(
        *[F.col(name).cast("string").alias(name) for name in _TEXT_COLUMNS]
    )


def _detect_sql() -> str:
    stamp = r"^\d{4}-\d{1,2}-\d{1,2}( \d{1,2}(:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?)?)?$"
    parts = []
    for name in _TEXT_COLUMNS:
        parts.append(f"""SELECT '{name}' AS column_name, COUNT(*) AS filled,
          CASE WHEN COUNT(*) = 0 THEN 'TEXT'
               WHEN COUNT(*) = COUNT(*) FILTER (lower(v) IN ('true', 'false')) THEN 'BOOLEAN'
               WHEN COUNT(*) = COUNT(*) FILTER (regexp_matches(v, '{stamp}') AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL) THEN 'TIMESTAMP'
               WHEN COUNT(*) = COUNT(*) FILTER (TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'NUMERIC'
               ELSE 'TEXT' END AS kind
        FROM (SELECT trim(CAST({name} AS VARCHAR)) AS v FROM raw) WHERE v <> ''""")
    return "\nUNION ALL ".join(parts)


@query(
    "detect_types",
    "column_name:s filled:i kind:s",
    _detect_sql(),
    "raw AS (SELECT *, CASE WHEN value > 50 THEN 'true' ELSE 'false' END AS is_large, '  ' AS blank FROM events)",
)
def detect_types(spark, sf):
    return evs.detect_types(_raw_text(spark, sf))


@query(
    "normalize_timestamps",
    "event_id:i iso_utc:t shifted:t quoted:t hourly:t broken:t",
    """SELECT event_id, date_trunc('second', ts) AS iso_utc, date_trunc('second', ts) AS shifted, ts AS quoted,
       date_trunc('hour', ts) AS hourly, CAST(NULL AS TIMESTAMP) AS broken FROM events""",
)
def normalize_timestamps(spark, sf):
    raw = spark.read.parquet(f"{sf}/events.parquet")
    texts = {
        "iso_utc": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "shifted": F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+05:30")),
        "quoted": F.concat(F.lit(' "'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(' UTC" ')),
        "hourly": F.date_format("ts", "yyyy-MM-dd HH"),
        "broken": F.concat(F.lit("at "), F.date_format("ts", "HH:mm")),
    }
    return raw.select("event_id", *[evs.normalize_timestamp(text).alias(name) for name, text in texts.items()])


@query(
    "normalize_events",
    "user_id:s event_name:s event_time:t priority:s event_count:d original_revenue:d modified_revenue:d row_id:i",
    """SELECT user_id, event_name, event_time, priority, SUM(event_count) AS event_count, SUM(original_revenue) AS original_revenue,
       SUM(modified_revenue) AS modified_revenue, MIN(row_id) AS row_id FROM od GROUP BY 1, 2, 3, 4""",
    OD,
)
def normalize_events(spark, sf):
    return evs.normalize_events(orders(spark, sf))


@query(
    "map_events",
    "user_id:s event_name:s event_time:t priority:s event_count:d original_revenue:d modified_revenue:d row_id:i",
    """SELECT CAST(o_custkey AS VARCHAR) AS user_id, o_orderstatus AS event_name, o_orderdate AS event_time, o_orderpriority AS priority,
       1.0 AS event_count, o_totalprice AS original_revenue, o_totalprice AS modified_revenue, o_orderkey AS row_id
       FROM orders WHERE o_orderdate <= TIMESTAMP '2000-07-02 00:00:00'""",
)
def map_events(spark, sf):
    raw = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_custkey").cast("string").alias("customer"),
        F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" ")).alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderkey").alias("row_id"),
    )
    mapping = evs.ColumnMapping("customer", "status", "at", revenue="price", kinds={"priority": "TEXT"})
    mapped = evs.map_events(raw, mapping, now=datetime(2000, 7, 1))
    return mapped.select("user_id", "event_name", "event_time", "priority", *evs.METRICS, "row_id")


@query(
    "time_report",
    "rows:i empty_times:i unreadable_times:i future_times:i",
    """SELECT COUNT(*) AS rows, COUNT(*) FILTER (event_id % 7 = 0) AS empty_times, COUNT(*) FILTER (event_id % 7 = 1) AS unreadable_times,
       COUNT(*) FILTER (event_id % 7 > 1 AND ts > TIMESTAMP '2024-01-21 00:00:00') AS future_times FROM events""",
)
def time_report(spark, sf):
    text = F.when(F.col("event_id") % 7 == 0, F.lit("  ")).when(F.col("event_id") % 7 == 1, F.lit("soon")).otherwise(F.col("ts").cast("string"))
    raw = spark.read.parquet(f"{sf}/events.parquet").withColumn("at", text)
    return evs.time_report(raw, evs.ColumnMapping("user_id", "event_type", "at"), datetime(2024, 1, 20))


@query(
    "column_values_search_indexed",
    "value:s frequency:d",
    "SELECT user_id || '-' || event_name AS value, SUM(event_count) AS frequency FROM ev WHERE user_id || '-' || event_name ILIKE '%1-CLI%' GROUP BY 1",
    EV,
)
def column_values_search_indexed(spark, sf):
    """A substring search that reads the index of a column's values, not the events."""
    rows = events(spark, sf).withColumn("pair", F.concat_ws("-", "user_id", "event_name"))
    return text_index.build(rows, "pair", staging_path(spark), "event_count").column_search("1-cli")


@query(
    "column_values_all",
    "value:s frequency:d",
    "SELECT CAST(user_id AS VARCHAR) || '-' || event_name AS value, SUM(event_count) AS frequency FROM ev GROUP BY 1",
    EV,
)
def column_values_all(spark, sf):
    """All values of a column with hundreds."""
    rows = events(spark, sf).withColumn("pair", F.concat_ws("-", "user_id", "event_name"))
    return scope.column_values(rows, "pair", limit=None)


@query(
    "check_rows",
    "rows:i empty_times:i bad_counts:i",
    "SELECT COUNT(*) AS rows, 0 AS empty_times, COUNT(*) FILTER (value < 1 OR value <> floor(value)) AS bad_counts FROM events",
)
def check_rows(spark, sf):
    mapping = evs.ColumnMapping("user_id", "event_type", "ts", event_count="value", row_id="event_id")
    return evs.check_rows(spark.read.parquet(f"{sf}/events.parquet"), mapping)


@query(
    "csv_ingest",
    "user_id:s event_name:s event_time:t priority:s event_count:d original_revenue:d modified_revenue:d row_id:i",
    """SELECT CAST(o_custkey AS VARCHAR) AS user_id, o_orderstatus AS event_name, o_orderdate AS event_time, 'level "' || o_orderpriority || '", new' AS priority,
       1.0 AS event_count, o_totalprice AS original_revenue, o_totalprice AS modified_revenue, o_orderkey AS row_id FROM orders""",
)
def csv_ingest(spark, sf):
    raw = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_custkey").alias("customer"),
        F.col("o_orderstatus").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
        F.col("o_totalprice").alias("price"),
        F.concat(F.lit('level "'), F.col("o_orderpriority"), F.lit('", new')).alias("priority"),
        F.col("o_orderkey").alias("order_id"),
    )
    path = staging_path(spark)
    raw.write.option("header", True).option("escape", '"').csv(path)
    loaded = with_row_id(read_csv_events(spark, path).rows, "order_id").drop("order_id")
    mapping = evs.ColumnMapping("customer", "status", "at", revenue="price", kinds={"priority": "TEXT"})
    mapped = evs.map_events(loaded, mapping)
    return mapped.select("user_id", "event_name", "event_time", "priority", *evs.METRICS, "row_id")


#: Small splits, so that records cross their borders at test sizes too.
_SPLIT_BYTES = 256 << 10


@query(
    "csv_multi_line_ingest",
    "user_id:s event_name:s event_time:t note:s event_count:d original_revenue:d modified_revenue:d row_id:i",
    """SELECT CAST(o_custkey AS VARCHAR) AS user_id, o_orderstatus || chr(10) || 'of "' || o_orderpriority || '"' AS event_name, o_orderdate AS event_time,
       CASE WHEN o_orderkey % 3 = 0 THEN 'first, "line"' || chr(10) || chr(10) || 'third ' || o_orderkey ELSE 'one line' END AS note,
       1.0 AS event_count, o_totalprice AS original_revenue, o_totalprice AS modified_revenue, o_orderkey AS row_id FROM orders""",
)
def csv_multi_line_ingest(spark, sf):
    raw = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_custkey").alias("customer"),
        F.concat("o_orderstatus", F.lit('\nof "'), "o_orderpriority", F.lit('"')).alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
        F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('first, "line"\n\nthird '), F.col("o_orderkey"))).otherwise(F.lit("one line")).alias("note"),
        F.col("o_orderkey").alias("order_id"),
    )
    path = staging_path(spark)
    raw.write.option("header", True).option("escape", '"').csv(path)
    loaded = with_row_id(read_csv_events(spark, path, multi_line=True, split_bytes=_SPLIT_BYTES).rows, "order_id").drop("order_id")
    mapping = evs.ColumnMapping("customer", "status", "at", revenue="price", kinds={"note": "TEXT"})
    mapped = evs.map_events(loaded, mapping)
    return mapped.select("user_id", "event_name", "event_time", "note", *evs.METRICS, "row_id")


@query(
    "csv_load_report",
    "imported_rows:i skipped_rows:i",
    "SELECT COUNT(*) FILTER (value <= 200) AS imported_rows, COUNT(*) FILTER (value > 200) AS skipped_rows FROM events",
)
def csv_load_report(spark, sf):
    raw = spark.read.parquet(f"{sf}/events.parquet")
    extra = F.when(F.col("value") > 200, F.lit(",one field too many")).otherwise(F.lit(""))
    lines = raw.select(F.concat(F.concat_ws(",", "user_id", "event_type", "event_id"), extra).alias("uid,event,id"))
    path = staging_path(spark)
    # One semicolon-separated column, so the commas are written as they are.
    lines.write.option("header", True).option("sep", ";").csv(path)
    return read_csv_events(spark, path, multi_line=False).load_report()


@query("export_round_trip", "event_name:s", "SELECT DISTINCT event_name FROM ev", EV)
def export_round_trip(spark, sf):
    path = staging_path(spark)
    names = scope.list_events(events(spark, sf))
    export_results(spark, {"events": ResultTable("Events", names, {"limit": None})}, path, "json")
    return spark.read.schema("event_name string").json(f"{path}/events")


@query("dataset_totals", "total_events:d total_users:i", "SELECT SUM(event_count) AS total_events, COUNT(DISTINCT user_id) AS total_users FROM ev", EV)
def dataset_totals(spark, sf):
    return evs.dataset_totals(events(spark, sf))


# --- revenue rules --------------------------------------------------------------


@query(
    "revenue_rules_default",
    "event_name:s is_included:b override_revenue:d",
    "SELECT DISTINCT event_name, TRUE AS is_included, CAST(NULL AS DOUBLE) AS override_revenue FROM ev WHERE original_revenue <> 0",
    EV,
)
def revenue_rules_default(spark, sf):
    return revenue.default_rules(events(spark, sf))


@query(
    "revenue_addable_events",
    "event_name:s",
    "SELECT DISTINCT event_name FROM ev WHERE event_name NOT IN ('purchase', 'signup', 'click')",
    EV,
)
def revenue_addable_events(spark, sf):
    return revenue.addable_events(events(spark, sf), revenue.rules_frame(spark, RULES))


_MODIFIED = """SELECT user_id, row_id, event_name, CASE event_name WHEN 'purchase' THEN original_revenue
       WHEN 'signup' THEN 2.5 * event_count ELSE 0.0 END AS modified_revenue FROM ev"""


@query("modified_revenue", "user_id:s row_id:i event_name:s modified_revenue:d", _MODIFIED, EV)
def modified_revenue(spark, sf):
    return revenue.modified_revenue(events(spark, sf), RULES).select("user_id", "row_id", "event_name", "modified_revenue")


@query("modified_revenue_from_table", "user_id:s row_id:i event_name:s modified_revenue:d", _MODIFIED, EV)
def modified_revenue_from_table(spark, sf):
    priced = revenue.modified_revenue_from(events(spark, sf), revenue.rules_frame(spark, RULES))
    return priced.select("user_id", "row_id", "event_name", "modified_revenue")


@query(
    "revenue_rules_upsert",
    "event_name:s is_included:b override_revenue:d",
    """SELECT DISTINCT event_name, event_name <> 'view' AS is_included,
       CASE event_name WHEN 'view' THEN 3.0 WHEN 'click' THEN 1.5 END AS override_revenue FROM ev WHERE original_revenue <> 0""",
    EV,
)
def revenue_rules_upsert(spark, sf):
    updates = spark.createDataFrame([("view", False, 3.0), ("click", True, 1.5)], revenue.RULE_SCHEMA)
    return revenue.upsert_rules(revenue.default_rules(events(spark, sf)), updates)


@query(
    "revenue_partial_recompute",
    "user_id:s row_id:i event_name:s modified_revenue:d",
    """SELECT user_id, row_id, event_name, CASE event_name WHEN 'purchase' THEN original_revenue WHEN 'signup' THEN 0.0 WHEN 'click' THEN 1.5 * event_count
         WHEN 'view' THEN original_revenue ELSE 0.0 END AS modified_revenue FROM ev""",
    EV,
)
def revenue_partial_recompute(spark, sf):
    """Rows priced and stored by event; then some rules change, and only their events are priced again."""
    store = revenue_store.save(events(spark, sf), RULES, staging_path(spark))
    store.upsert([RevenueRule("signup", included=False, override=2.5), RevenueRule("click", override=1.5), RevenueRule("view"), RevenueRule("purchase")])
    return store.events().select("user_id", "row_id", "event_name", "modified_revenue")


# --- scope ----------------------------------------------------------------------


@query(
    "scope_date_range",
    "rows:i users:i first_time:t last_time:t",
    """SELECT COUNT(*) AS rows, COUNT(DISTINCT user_id) AS users, MIN(event_time) AS first_time, MAX(event_time) AS last_time
       FROM ev WHERE event_time >= TIMESTAMP '2024-01-05' AND event_time < TIMESTAMP '2024-01-13'""",
    EV,
)
def scope_date_range(spark, sf):
    scoped = scope.apply_scope(events(spark, sf), date_from="2024-01-05", date_to="2024-01-12")
    return scoped.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("user_id").alias("users"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
    )


_GROUPED = "event_name:s rows:i revenue:d"
_GROUP_SQL = "SELECT event_name, COUNT(*) AS rows, SUM(original_revenue) AS revenue FROM {0} WHERE {1} GROUP BY event_name"


def _by_event(rows):
    return rows.groupBy("event_name").agg(F.count(F.lit(1)).alias("rows"), F.sum("original_revenue").alias("revenue"))


@query(
    "scope_filters_text",
    _GROUPED,
    _GROUP_SQL.format("od", "priority IN ('1-URGENT', '2-HIGH') AND event_name <> 'P'"),
    OD,
)
def scope_filters_text(spark, sf):
    filters = [Filter("priority", "IN", ["1-URGENT", "2-HIGH"]), Filter("event_name", "!=", "P")]
    return _by_event(scope.apply_scope(orders(spark, sf), filters))


@query(
    "scope_filters_numeric",
    _GROUPED,
    _GROUP_SQL.format("ev", "k >= 20 AND k <> 50 AND original_revenue < 90.5 AND k NOT IN (33, 34)"),
    EV,
)
def scope_filters_numeric(spark, sf):
    filters = [Filter("k", ">=", 20), Filter("k", "!=", 50), Filter("original_revenue", "<", 90.5), Filter("k", "NOT IN", [33, 34])]
    return _by_event(scope.apply_scope(events(spark, sf), filters))


@query(
    "scope_filters_timestamp",
    "case_name:s rows:i",
    """SELECT 'before' AS case_name, COUNT(*) FILTER (event_time < TIMESTAMP '2024-01-10 06:00:00') AS rows FROM ev
       UNION ALL SELECT 'after', COUNT(*) FILTER (event_time >= TIMESTAMP '2024-01-20') FROM ev
       UNION ALL SELECT 'on', COUNT(*) FILTER (CAST(event_time AS DATE) = DATE '2024-01-15') FROM ev
       UNION ALL SELECT 'between_open', COUNT(*) FILTER (event_time >= TIMESTAMP '2024-01-10 12:00:00' AND event_time < TIMESTAMP '2024-01-13') FROM ev
       UNION ALL SELECT 'between_timed', COUNT(*) FILTER (event_time >= TIMESTAMP '2024-01-10' AND event_time < TIMESTAMP '2024-01-12 08:30:00') FROM ev
       UNION ALL SELECT 'not_in', COUNT(*) FILTER (event_time NOT IN (TIMESTAMP '2024-01-10 00:00:00')) FROM ev
       UNION ALL SELECT 'legacy_equals', COUNT(*) FILTER (CAST(event_time AS DATE) = DATE '2024-01-07') FROM ev""",
    EV,
)
def scope_filters_timestamp(spark, sf):
    rows = events(spark, sf)
    cases = {
        "before": Filter("event_time", "BEFORE", {"date": "2024-01-10", "time": "06:00"}),
        "after": Filter("event_time", "AFTER", {"date": "2024-01-20"}),
        "on": Filter("event_time", "ON", {"date": "2024-01-15"}),
        "between_open": Filter("event_time", "BETWEEN", {"startDate": "2024-01-10", "startTime": "12", "endDate": "2024-01-12", "endTime": " "}),
        "between_timed": Filter("event_time", "BETWEEN", {"startDate": "2024-01-10", "endDate": "2024-01-12", "endTime": "08:30"}),
        "not_in": Filter("event_time", "NOT IN", ["2024-01-10T00:00:00Z"]),
        "legacy_equals": Filter("event_time", "=", "2024-01-07 10:00:00"),
    }
    counted = rows.agg(*[F.count_if(scope_predicate(rows.schema, [spec])).alias(name) for name, spec in cases.items()])
    return counted.unpivot([], list(cases), "case_name", "rows")


@query(
    "scope_summary",
    "total_rows:i filtered_rows:i total_events:d total_users:i percentage:d",
    """SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (p) AS filtered_rows, SUM(event_count) FILTER (p) AS total_events,
       COUNT(DISTINCT user_id) FILTER (p) AS total_users, COUNT(*) FILTER (p) * 100.0 / COUNT(*) AS percentage
       FROM (SELECT *, (k > 95 AND event_name = 'view' AND event_time < TIMESTAMP '2024-01-21') AS p FROM ev)""",
    EV,
)
def scope_summary(spark, sf):
    filters = [Filter("k", ">", 95), Filter("event_name", "=", ["view"])]
    return scope.scope_summary(events(spark, sf), filters, date_to="2024-01-20")


@query(
    "column_values_top",
    "value:i frequency:d",
    """SELECT k AS value, SUM(event_count) AS frequency FROM ev WHERE k IS NOT NULL AND event_name = 'click'
       AND CAST(k AS VARCHAR) ILIKE '1%' GROUP BY k ORDER BY frequency DESC, value ASC LIMIT 10""",
    EV,
)
def column_values_top(spark, sf):
    return scope.column_values(events(spark, sf), "k", event_name="click", search="1", limit=10)


@query(
    "column_values_distinct",
    "value:s",
    "SELECT DISTINCT user_id AS value FROM ev WHERE user_id <> '' ORDER BY value LIMIT 50",
    EV,
)
def column_values_distinct(spark, sf):
    return scope.column_values(events(spark, sf), "user_id", limit=50)


@query("column_values_count", "total_distinct:i", "SELECT COUNT(DISTINCT k) AS total_distinct FROM ev WHERE event_name = 'view'", EV)
def column_values_count(spark, sf):
    return scope.count_values(events(spark, sf), "k", event_name="view")


@query("date_range", "min_date:e max_date:e", "SELECT CAST(MIN(event_time) AS DATE) AS min_date, CAST(MAX(event_time) AS DATE) AS max_date FROM ev", EV)
def date_range(spark, sf):
    return scope.date_range(events(spark, sf))


@query("list_events", "event_name:s", "SELECT DISTINCT event_name FROM ev ORDER BY 1", EV)
def list_events(spark, sf):
    return scope.list_events(events(spark, sf))


@query(
    "event_property_values",
    "value:s rows:i",
    """SELECT CAST(k AS VARCHAR) AS value, COUNT(*) AS rows FROM ev WHERE event_name = 'purchase' AND k IS NOT NULL
       GROUP BY 1 ORDER BY rows DESC, value ASC LIMIT 25""",
    EV,
)
def event_property_values(spark, sf):
    return scope.event_property_values(events(spark, sf), "purchase", "k")


@query("observation_end", "observation_end:t", "SELECT t AS observation_end FROM obs", EV, OBS)
def observation_end_query(spark, sf):
    return observation_end(events(spark, sf))


@query(
    "observation_end_sketch",
    "n:i day:e within:b",
    """SELECT COUNT(*) AS n, (SELECT CAST(quantile_disc(event_time, 0.999) AS DATE) FROM ev) AS day, TRUE AS within FROM ev""",
    EV,
)
def observation_end_sketch(spark, sf):
    """Day sketches of the event time, stored and read back; the exact rank of the instant found is held against them."""
    rows = events(spark, sf)
    path = staging_path(spark)
    sketches.save(sketches.time_sketches(rows), path)
    found = sketches.observed_end(sketches.load(spark, path), OBSERVED_FRACTION)
    end = rows.crossJoin(F.broadcast(found.select("instant")))  # one row
    rank = end.agg(F.avg((F.col("event_time") < F.col("instant")).cast("int")).alias("low"), F.avg((F.col("event_time") <= F.col("instant")).cast("int")).alias("high"))
    within = sketches.within(OBSERVED_FRACTION, F.col("low"), F.col("high"), 2 * sketches.rank_error())
    return found.select("n", "day").crossJoin(F.broadcast(rank.select(within.alias("within"))))  # one row each


@query(
    "value_sketches_hot_key",
    "event_name:s n:i median_within:b p99_within:b",
    """SELECT event_name, COUNT(*) AS n, TRUE AS median_within, TRUE AS p99_within
       FROM (SELECT event_name, original_revenue FROM ev UNION ALL SELECT '*', original_revenue FROM ev) WHERE original_revenue IS NOT NULL GROUP BY 1""",
    EV,
)
def value_sketches_hot_key(spark, sf):
    """Sketches of the value in cents by event and day; the key ``*`` holds half of all rows."""
    rows = events(spark, sf).select(F.explode(F.array("event_name", F.lit("*"))).alias("event_name"), "event_time", F.round(F.col("original_revenue") * 100).cast("long").alias("cents"))
    named = {"median": 0.5, "p99": 0.99}
    path = staging_path(spark)
    sketches.save(sketches.sketch_by_day(rows, ["event_name"], "event_time", "cents"), path)
    found = stage(sketches.quantiles(sketches.merged(sketches.load(spark, path), ["event_name"]), ["event_name"], named))
    shares = sketches.rank_bounds(rows, ["event_name"], "cents", found, list(named))
    marks = [sketches.within(f, F.col(f"{n}_low"), F.col(f"{n}_high"), 2 * sketches.rank_error()).alias(f"{n}_within") for n, f in named.items()]
    return found.join(shares, "event_name").select("event_name", "n", *marks)


# --- cohorts --------------------------------------------------------------------

_MEMBER = "cohort_id:i user_id:s join_time:t"


def _single(spark, sf, *conditions, **options):
    return co.build_membership(events(spark, sf), [Cohort(9, "subject", conditions, **options)])


@query(
    "cohort_condition_once",
    _MEMBER,
    "SELECT 9 AS cohort_id, user_id, MIN(event_time) AS join_time FROM ev WHERE event_name = 'purchase' AND k IN (1, 2, 3) GROUP BY user_id",
    EV,
)
def cohort_condition_once(spark, sf):
    return _single(spark, sf, Condition("purchase", 1, Filter("k", "IN", [1, 2, 3])))


@query("cohort_condition_nth", _MEMBER, "SELECT 9 AS cohort_id, user_id, t AS join_time FROM " + nth("ev", "event_name = 'purchase'", 14), EV)
def cohort_condition_nth(spark, sf):
    return _single(spark, sf, HEAVY_BUYER)


@query(
    "cohort_condition_deep",
    _MEMBER,
    """SELECT 9 AS cohort_id, 'all' AS user_id, MIN(event_time) AS join_time FROM (
         SELECT event_time, ROW_NUMBER() OVER (ORDER BY event_time, row_id) AS n FROM ev WHERE event_name = 'view') WHERE n >= 1100 HAVING COUNT(*) > 0""",
    EV,
)
def cohort_condition_deep(spark, sf):
    """The 1,100th occurrence, of one user who owns all rows."""
    rows = events(spark, sf).withColumn("user_id", F.lit("all"))
    return co.build_membership(rows, [Cohort(9, "subject", [Condition("view", 1_100)])])


@query(
    "row_ids_dense",
    "row_id:i number:i event_time:t",
    "SELECT row_id, ROW_NUMBER() OVER (ORDER BY event_time, row_id) AS number, event_time FROM ev",
    EV,
)
def row_ids_dense(spark, sf):
    return prefix.dense_row_ids(events(spark, sf).select("row_id", "event_time"), ["event_time", "row_id"], "number")


@query(
    "cohort_negated",
    _MEMBER,
    """SELECT 9 AS cohort_id, user_id, t AS join_time FROM first_seen
       WHERE user_id NOT IN (SELECT user_id FROM ev WHERE event_name = 'error' AND k > 90)""",
    EV,
    FIRST_SEEN,
)
def cohort_negated(spark, sf):
    return _single(spark, sf, NO_BIG_ERROR)


_AND = ("a AS " + nth("ev", "event_name = 'click' AND k >= 90", 2), "b AS " + nth("ev", "event_name = 'purchase'", 10))


@query(
    "cohort_and",
    _MEMBER,
    "SELECT 9 AS cohort_id, a.user_id, LEAST(a.t, b.t) AS join_time FROM a JOIN b ON a.user_id = b.user_id",
    EV,
    *_AND,
)
def cohort_and(spark, sf):
    return _single(spark, sf, HIGH_CLICKS, TEN_PURCHASES, logic="AND")


@query(
    "cohort_and_all_met",
    _MEMBER,
    "SELECT 9 AS cohort_id, a.user_id, GREATEST(a.t, b.t) AS join_time FROM a JOIN b ON a.user_id = b.user_id",
    EV,
    *_AND,
)
def cohort_and_all_met(spark, sf):
    return _single(spark, sf, HIGH_CLICKS, TEN_PURCHASES, logic="AND", all_met=True)


@query("cohort_or", _MEMBER, "SELECT * FROM m WHERE cohort_id = 3", *MEMBERS)
def cohort_or(spark, sf):
    return co.build_membership(events(spark, sf), [Cohort(3, "subject", [HIGH_CLICKS, LOW_SIGNUP], "OR")])


@query(
    "cohort_first_event_join",
    _MEMBER,
    "SELECT 9 AS cohort_id, f.user_id, f.t AS join_time FROM first_seen f WHERE f.user_id IN (SELECT user_id FROM c2)",
    EV,
    FIRST_SEEN,
    "c2 AS " + nth("ev", "event_name = 'purchase'", 14),
)
def cohort_first_event_join(spark, sf):
    return _single(spark, sf, HEAVY_BUYER, join_type="first_event")


@query("cohort_all_users", _MEMBER, "SELECT 1 AS cohort_id, user_id, t AS join_time FROM first_seen", EV, FIRST_SEEN)
def cohort_all_users(spark, sf):
    return co.all_users(events(spark, sf))


@query("cohort_membership_batch", _MEMBER, "SELECT * FROM m", *MEMBERS)
def cohort_membership_batch(spark, sf):
    return co.build_membership(events(spark, sf), COHORTS)


@query(
    "cohort_activity",
    "cohort_id:i user_id:s row_id:i event_time:t join_time:t",
    "SELECT cohort_id, user_id, row_id, event_time, join_time FROM act",
    *MEMBERS,
    act(),
)
def cohort_activity(spark, sf):
    base = study(events(spark, sf))
    return co.activity(base.rows, base.members, base.hot).select("cohort_id", "user_id", "row_id", "event_time", "join_time")


_SPECS = "specs AS (SELECT * FROM (VALUES (1, 'All Users'), (2, 'Heavy buyers'), (3, 'Engaged'), (4, 'Smooth buyers'), (6, 'Nobody')) v(cohort_id, name))"
_LISTED = [c for c in COHORTS if not c.hidden] + [Cohort(6, "Nobody", [Condition("refund")])]


@query(
    "cohort_active_flags",
    "cohort_id:i name:s linked_events:i is_active:b",
    """SELECT s.cohort_id, s.name, COUNT(act.row_id) AS linked_events, COUNT(act.row_id) > 0 AS is_active
       FROM specs s LEFT JOIN act ON s.cohort_id = act.cohort_id GROUP BY 1, 2""",
    *MEMBERS,
    act(),
    _SPECS,
)
def cohort_active_flags(spark, sf):
    rows = events(spark, sf)
    joined = co.build_membership(rows, _LISTED)
    return co.active_flags(co.cohort_frame(spark, _LISTED), co.activity(rows, joined))


@query(
    "cohort_sizes",
    "cohort_id:i name:s size:i",
    "SELECT s.cohort_id, s.name, COUNT(DISTINCT m.user_id) AS size FROM specs s LEFT JOIN m ON s.cohort_id = m.cohort_id GROUP BY 1, 2",
    *MEMBERS,
    _SPECS,
)
def cohort_sizes(spark, sf):
    listed = co.list_cohorts(co.cohort_frame(spark, _LISTED), co.build_membership(events(spark, sf), _LISTED))
    return listed.select("cohort_id", "name", "size")


@query(
    "cohort_estimate",
    "estimated_users:i total_users:i percentage:d",
    """SELECT e AS estimated_users, u AS total_users, e * 100.0 / u AS percentage FROM (
       SELECT (SELECT COUNT(*) FROM m WHERE cohort_id = 4) AS e, (SELECT COUNT(DISTINCT user_id) FROM ev) AS u)""",
    *MEMBERS,
)
def cohort_estimate(spark, sf):
    return co.estimate_size(events(spark, sf), COHORTS[3])


@query(
    "definition_missing_events",
    "kind:s name:s",
    """SELECT 'event' AS kind, name FROM (VALUES ('purchase'), ('refund')) v(name) WHERE name NOT IN (SELECT event_name FROM ev)
       UNION ALL SELECT 'property', 'channel'""",
    EV,
)
def definition_missing_events(spark, sf):
    definition = Cohort(9, "saved", [Condition("purchase", 2), Condition("refund", 1, Filter("channel", "=", "web"))])
    return co.missing_names(events(spark, sf), definition)


# --- splits ---------------------------------------------------------------------

_SEED = "-spring"


@query(
    "cohort_split_random",
    "cohort_id:i user_id:s join_time:t group_index:i",
    f"""SELECT cohort_id, user_id, join_time, floor(rn * 4 / total) AS group_index FROM (
       SELECT *, ROW_NUMBER() OVER (PARTITION BY cohort_id ORDER BY md5(user_id || '{_SEED}'), user_id) - 1 AS rn,
              COUNT(*) OVER (PARTITION BY cohort_id) AS total FROM m) WHERE total >= 8""",
    *MEMBERS,
)
def cohort_split_random(spark, sf):
    return splits.random_split(members(events(spark, sf)), 4, _SEED)


@query(
    "cohort_split_random_preview",
    "cohort_id:i group_index:i size:i",
    f"""SELECT cohort_id, floor(rn * 3 / total) AS group_index, COUNT(*) AS size FROM (
       SELECT *, ROW_NUMBER() OVER (PARTITION BY cohort_id ORDER BY md5(user_id || '{_SEED}'), user_id) - 1 AS rn,
              COUNT(*) OVER (PARTITION BY cohort_id) AS total FROM m) WHERE total >= 8 GROUP BY 1, 2""",
    *MEMBERS,
)
def cohort_split_random_preview(spark, sf):
    return splits.split_preview(splits.random_split(members(events(spark, sf)), 3, _SEED), "group_index")


@query(
    "cohort_split_hash",
    "cohort_id:i user_id:s join_time:t group_index:i",
    f"SELECT *, CAST('0x' || substr(md5(user_id || '{_SEED}'), 1, 8) AS BIGINT) % 4 AS group_index FROM m",
    *MEMBERS,
)
def cohort_split_hash(spark, sf):
    return splits.hash_split(members(events(spark, sf)), 4, _SEED)


_PROPERTY_SPLIT = (
    OD,
    "parents AS (SELECT 1 AS cohort_id, user_id, MIN(event_time) AS join_time FROM od GROUP BY user_id)",
    """children AS (
       SELECT p.*, v.split_value FROM parents p CROSS JOIN (VALUES ('1-URGENT'), ('5-LOW')) v(split_value)
       WHERE EXISTS (SELECT 1 FROM od WHERE od.user_id = p.user_id AND od.priority = v.split_value)
       UNION ALL SELECT p.*, '_other' FROM parents p
       WHERE NOT EXISTS (SELECT 1 FROM od WHERE od.user_id = p.user_id AND od.priority IN ('1-URGENT', '5-LOW')))""",
)


def _property_children(spark, sf):
    rows = orders(spark, sf)
    return splits.property_split(co.all_users(rows), rows, "priority", ["1-URGENT", "5-LOW"])


@query("cohort_split_property", "cohort_id:i user_id:s join_time:t split_value:s", "SELECT * FROM children", *_PROPERTY_SPLIT)
def cohort_split_property(spark, sf):
    return _property_children(spark, sf)


@query(
    "cohort_split_preview",
    "cohort_id:i split_value:s size:i",
    "SELECT cohort_id, split_value, COUNT(*) AS size FROM children GROUP BY 1, 2",
    *_PROPERTY_SPLIT,
)
def cohort_split_preview(spark, sf):
    return splits.split_preview(_property_children(spark, sf), "split_value")
