"""Registered queries: retention, usage and monetisation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strideline.functions.predicates import text_predicate
from strideline.operators import canonical, ltv, monetization, retention, usage, vectors
from strideline.operators.cohorts import build_membership
from strideline.operators.revenue import modified_revenue
from strideline.operators.staging import staging_path
from strideline.operators.vectors import observed_until
from strideline.plans.base import COHORTS, EV, MAX_DAY, MEMBERS, OBS, RULES, SIZES, act, events, grid, query, study
from strideline.specs import Filter


def _base(spark, sf):
    base = study(events(spark, sf))
    return base.rows, base.members, base.until, base.hot


# Per-user and bucket facts, all rows at or after joining.
_FACTS = """facts AS (
  SELECT cohort_id, user_id, bucket, COUNT(*) AS any_events,
         SUM(CASE WHEN event_name = 'purchase' THEN 1 ELSE 0 END) AS purchases,
         SUM(CASE WHEN event_name = 'click' THEN event_count ELSE 0 END) AS clicks,
         SUM(CASE WHEN event_name = 'click' AND k IN (10, 20, 30, 40, 50) THEN event_count ELSE 0 END) AS some_clicks,
         SUM(CASE event_name WHEN 'purchase' THEN original_revenue WHEN 'signup' THEN 2.5 * event_count ELSE 0 END) AS revenue,
         SUM(event_count) AS events
  FROM act GROUP BY 1, 2, 3)"""
_CELLS = """cells AS (
  SELECT g.*, COALESCE(f.any_events, 0) * ok AS any_events, COALESCE(f.purchases, 0) * ok AS purchases, COALESCE(f.clicks, 0) * ok AS clicks,
         COALESCE(f.some_clicks, 0) * ok AS some_clicks, COALESCE(f.revenue, 0) * ok AS revenue, COALESCE(f.events, 0) * ok AS events
  FROM g LEFT JOIN facts f ON f.cohort_id = g.cohort_id AND f.user_id = g.user_id AND f.bucket = g.bucket)"""
DENSE = (*MEMBERS, OBS, act(), grid(), _FACTS, _CELLS)
HOURLY = (*MEMBERS, OBS, act(3_600), grid(2 * 24, "HOUR"), _FACTS, _CELLS)

_VECTOR = "cohort_id:i user_id:s bucket:i value:d is_eligible:i"


# --- vectors --------------------------------------------------------------------


@query(
    "retention_vector_classic",
    _VECTOR,
    "SELECT cohort_id, user_id, bucket, CASE WHEN any_events > 0 THEN 1 ELSE 0 END AS value, ok AS is_eligible FROM cells",
    *DENSE,
)
def retention_vector_classic(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return _as_double(vectors.retention_vector(rows, joined, until, MAX_DAY, hot=hot))


@query(
    "retention_vector_ever_after",
    _VECTOR,
    """SELECT cohort_id, user_id, bucket, MAX(CASE WHEN purchases > 0 THEN 1 ELSE 0 END) OVER (
       PARTITION BY cohort_id, user_id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value, ok AS is_eligible FROM cells""",
    *DENSE,
)
def retention_vector_ever_after(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return _as_double(vectors.retention_vector(rows, joined, until, MAX_DAY, event="purchase", kind="ever_after", hot=hot))


def _as_double(frame):
    return frame.withColumn("value", F.col("value").cast("double"))


@query("usage_vector_volume", _VECTOR, "SELECT cohort_id, user_id, bucket, clicks AS value, ok AS is_eligible FROM cells", *DENSE)
def usage_vector_volume(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return vectors.usage_vector(rows, joined, until, MAX_DAY, "click", hot=hot)


@query(
    "usage_vector_unique",
    _VECTOR,
    "SELECT cohort_id, user_id, bucket, CASE WHEN clicks > 0 THEN 1 ELSE 0 END AS value, ok AS is_eligible FROM cells",
    *DENSE,
)
def usage_vector_unique(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return vectors.usage_vector(rows, joined, until, MAX_DAY, "click", "unique", hot=hot)


_SOME_K = Filter("k", "in", ["10", "20", "30", "40", "50"])


@query("usage_property_filter", _VECTOR, "SELECT cohort_id, user_id, bucket, some_clicks AS value, ok AS is_eligible FROM cells", *DENSE)
def usage_property_filter(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return vectors.usage_vector(rows, joined, until, MAX_DAY, "click", where=text_predicate(_SOME_K), hot=hot)


@query(
    "revenue_vector",
    "cohort_id:i user_id:s bucket:i value:d event_count:d is_eligible:i",
    "SELECT cohort_id, user_id, bucket, revenue AS value, events AS event_count, ok AS is_eligible FROM cells",
    *DENSE,
)
def revenue_vector(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return vectors.revenue_vector(modified_revenue(rows, RULES), joined, until, MAX_DAY, hot=hot)


# --- retention ------------------------------------------------------------------

_TABLE = "cohort_id:i bucket:i size:i eligible:i active:i retention:d"


def _table_sql(active: str) -> str:
    return f"""SELECT cohort_id, bucket, COUNT(*) AS size, SUM(ok) AS eligible, SUM({active}) AS active,
       CASE WHEN SUM(ok) > 0 THEN SUM({active}) * 100.0 / SUM(ok) END AS retention FROM cells GROUP BY 1, 2"""


_ACTIVE = "CASE WHEN any_events > 0 THEN 1 ELSE 0 END"


@query("retention_table", _TABLE, _table_sql(_ACTIVE), *DENSE)
def retention_table(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return retention.retention_table(rows, joined, until, MAX_DAY, hot=hot)


def _stored(spark, rows):
    """The canonical table in buckets, under a name of its own."""
    name = f"canonical_{uuid.uuid4().hex}"
    return canonical.load(spark, canonical.save(rows, name, staging_path(spark), buckets=8).table)


@query(
    "canonical_round_trip",
    "user_id:s event_name:s event_time:t k:i event_count:d original_revenue:d modified_revenue:d row_id:i",
    "SELECT * FROM ev",
    EV,
)
def canonical_round_trip(spark, sf):
    return _stored(spark, events(spark, sf)).events()


@query("canonical_retention", _TABLE, _table_sql(_ACTIVE), *DENSE)
def canonical_retention(spark, sf):
    """Membership and retention over buckets: no event is moved."""
    store = _stored(spark, events(spark, sf))
    rows, hot = store.events(), store.hot()
    joined = store.save_members(build_membership(rows, COHORTS, hot=hot), f"members_{uuid.uuid4().hex}", staging_path(spark))
    return retention.retention_table(rows, joined, observed_until(rows), MAX_DAY, hot=hot)


@query("retention_event", _TABLE, _table_sql("CASE WHEN purchases > 0 THEN 1 ELSE 0 END"), *DENSE)
def retention_event(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return retention.retention_table(rows, joined, until, MAX_DAY, event="purchase", hot=hot)


@query(
    "retention_ever_after",
    _TABLE,
    """SELECT cohort_id, bucket, COUNT(*) AS size, SUM(ok) AS eligible, SUM(later) AS active,
       CASE WHEN SUM(ok) > 0 THEN SUM(later) * 100.0 / SUM(ok) END AS retention FROM (
         SELECT *, MAX(CASE WHEN any_events > 0 THEN 1 ELSE 0 END) OVER (
           PARTITION BY cohort_id, user_id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM cells)
       GROUP BY 1, 2""",
    *DENSE,
)
def retention_ever_after(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return retention.retention_table(rows, joined, until, MAX_DAY, kind="ever_after", hot=hot)


@query("retention_hourly", _TABLE, _table_sql(_ACTIVE), *HOURLY)
def retention_hourly(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return retention.retention_table(rows, joined, until, 2, unit="hour", hot=hot)


_WILSON = f"""SELECT *, CASE WHEN n > 0 THEN GREATEST(0.0, (p + z * z / (2 * n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)) * 100 END AS ci_lower,
       CASE WHEN n > 0 THEN LEAST(1.0, (p + z * z / (2 * n) + z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)) * 100 END AS ci_upper
       FROM (SELECT *, CAST(NULLIF(eligible, 0) AS DOUBLE) AS n, CAST(active AS DOUBLE) / NULLIF(eligible, 0) AS p, CAST(1.96 AS DOUBLE) AS z FROM ({_table_sql(_ACTIVE)}))"""


@query("retention_wilson_ci", _TABLE + " ci_lower:d ci_upper:d", _WILSON, *DENSE)
def retention_wilson_ci(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return retention.with_interval(retention.retention_table(rows, joined, until, MAX_DAY, hot=hot), 0.95)


@query(
    "retention_horizon",
    "horizon:i",
    f"""SELECT GREATEST(1, COALESCE(MIN(CASE WHEN best < 1.0 THEN bucket END) - 1, MAX(bucket))) AS horizon FROM (
       SELECT bucket, MAX(COALESCE(retention, 0)) AS best FROM ({_table_sql("CASE WHEN some_clicks > 0 THEN 1 ELSE 0 END")}) GROUP BY bucket)""",
    *DENSE,
)
def retention_horizon(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    chosen = rows.where((F.col("event_name") == "click") & text_predicate(_SOME_K))
    return retention.useful_horizon(retention.retention_table(chosen, joined, until, MAX_DAY, hot=hot))


@query(
    "retention_sparse_ever_after",
    "cohort_id:i bucket:i active_users:i",
    f"""SELECT l.cohort_id, b.i AS bucket, COUNT(DISTINCT l.user_id) AS active_users
       FROM (SELECT cohort_id, user_id, MAX(bucket) AS last FROM act WHERE event_name = 'purchase' GROUP BY 1, 2) l
       JOIN generate_series(0, {MAX_DAY}) b(i) ON l.last >= b.i GROUP BY 1, 2""",
    *MEMBERS,
    act(),
)
def retention_sparse_ever_after(spark, sf):
    base = study(events(spark, sf))
    return retention.ever_after_counts(base.rows, base.members, MAX_DAY, event="purchase", hot=base.hot)


@query(
    "eligibility_counts",
    "cohort_id:i bucket:i eligible_users:i",
    """SELECT m.cohort_id, b.i AS bucket, COUNT(DISTINCT m.user_id) AS eligible_users FROM m CROSS JOIN obs CROSS JOIN generate_series(0, 25) b(i)
       WHERE date_diff('second', m.join_time, obs.t) / 86400.0 >= b.i GROUP BY 1, 2""",
    *MEMBERS,
    OBS,
)
def eligibility_counts(spark, sf):
    _, joined, until, _ = _base(spark, sf)
    return retention.eligibility_counts(joined, until, 25)


# --- usage ----------------------------------------------------------------------


@query(
    "usage_volume",
    "cohort_id:i bucket:i size:i eligible:i volume:d",
    "SELECT cohort_id, bucket, COUNT(*) AS size, SUM(ok) AS eligible, SUM(clicks) AS volume FROM cells GROUP BY 1, 2",
    *DENSE,
)
def usage_volume(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return usage.usage_by_day(rows, joined, until, MAX_DAY, "click", hot=hot).select("cohort_id", "bucket", "size", "eligible", "volume")


@query(
    "usage_users",
    "cohort_id:i bucket:i users:i",
    "SELECT cohort_id, bucket, SUM(CASE WHEN some_clicks > 0 THEN 1 ELSE 0 END) AS users FROM cells GROUP BY 1, 2",
    *DENSE,
)
def usage_users(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    table = usage.usage_by_day(rows, joined, until, MAX_DAY, "click", text_predicate(_SOME_K), hot=hot)
    return table.select("cohort_id", "bucket", "users")


_ADOPTED = """adopted AS (
  SELECT c.cohort_id, c.bucket, COUNT(*) AS size, SUM(CASE WHEN f.day <= c.bucket THEN 1 ELSE 0 END) AS adopted
  FROM cells c LEFT JOIN (SELECT cohort_id, user_id, MIN(bucket) AS day FROM cells WHERE clicks > 0 GROUP BY 1, 2) f
    ON f.cohort_id = c.cohort_id AND f.user_id = c.user_id GROUP BY 1, 2)"""


@query("usage_adoption", "cohort_id:i bucket:i size:i adopted:i", "SELECT * FROM adopted", *DENSE, _ADOPTED)
def usage_adoption(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return usage.adoption_by_day(rows, joined, until, MAX_DAY, "click", hot=hot)


@query(
    "usage_retained",
    "cohort_id:i bucket:i size:i eligible:i retained:i",
    """SELECT cohort_id, bucket, COUNT(*) AS size, SUM(ok) AS eligible,
       SUM(CASE WHEN purchases > 0 THEN 1 ELSE 0 END) AS retained FROM cells GROUP BY 1, 2""",
    *DENSE,
)
def usage_retained(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return usage.retained_by_day(rows, joined, until, MAX_DAY, "purchase", hot=hot)


_BY_DAY = """by_day AS (
  SELECT c.cohort_id, c.bucket, COUNT(*) AS size, SUM(ok) AS eligible, SUM(clicks) AS volume,
         SUM(CASE WHEN clicks > 0 THEN 1 ELSE 0 END) AS users, MIN(a.adopted) AS adopted,
         SUM(CASE WHEN any_events > 0 THEN 1 ELSE 0 END) AS retained
  FROM cells c JOIN adopted a ON a.cohort_id = c.cohort_id AND a.bucket = c.bucket GROUP BY 1, 2)"""


@query(
    "usage_table",
    "cohort_id:i bucket:i size:i eligible:i volume:d users:i adopted:i retained:i",
    "SELECT * FROM by_day",
    *DENSE,
    _ADOPTED,
    _BY_DAY,
)
def usage_table(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return usage.usage_table(rows, joined, until, MAX_DAY, "click", hot=hot)


@query(
    "usage_frequency",
    "cohort_id:i frequency:s users:i share:d",
    """SELECT s.cohort_id, f.frequency, COUNT(t.user_id) AS users, COUNT(t.user_id) * 1.0 / MIN(s.size) AS share
       FROM sizes s CROSS JOIN (VALUES ('0'), ('1'), ('2-5'), ('6-10'), ('11-20'), ('20+')) f(frequency)
       LEFT JOIN (SELECT m.cohort_id, m.user_id, CASE WHEN COALESCE(c.n, 0) = 0 THEN '0' WHEN c.n = 1 THEN '1' WHEN c.n <= 5 THEN '2-5'
                  WHEN c.n <= 10 THEN '6-10' WHEN c.n <= 20 THEN '11-20' ELSE '20+' END AS frequency
                  FROM m LEFT JOIN (SELECT cohort_id, user_id, SUM(event_count) AS n FROM act WHERE event_name = 'click' GROUP BY 1, 2) c
                    ON c.cohort_id = m.cohort_id AND c.user_id = m.user_id) t
         ON t.cohort_id = s.cohort_id AND t.frequency = f.frequency
       GROUP BY 1, 2""",
    *MEMBERS,
    act(),
    SIZES,
)
def usage_frequency(spark, sf):
    base = study(events(spark, sf))
    return usage.usage_frequency(base.rows, base.members, "click", hot=base.hot)


@query(
    "usage_derived_volume",
    "cohort_id:i bucket:i count:d cumulative_count:d per_installed_user:d cumulative_per_installed_user:d per_event_firer:d per_active_user:d",
    """SELECT cohort_id, bucket, volume AS count, run AS cumulative_count, volume / size AS per_installed_user,
       run / size AS cumulative_per_installed_user, CASE WHEN users > 0 THEN volume / users ELSE 0 END AS per_event_firer,
       CASE WHEN retained > 0 THEN volume / retained ELSE 0 END AS per_active_user
       FROM (SELECT *, SUM(volume) OVER (PARTITION BY cohort_id ORDER BY bucket) AS run FROM by_day)""",
    *DENSE,
    _ADOPTED,
    _BY_DAY,
)
def usage_derived_volume(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return usage.derived_volume(usage.usage_table(rows, joined, until, MAX_DAY, "click", hot=hot))


@query(
    "usage_derived_users",
    "cohort_id:i bucket:i count:i percent:d adoption_count:i adoption_percent:d",
    """SELECT cohort_id, bucket, users AS count, users * 100.0 / size AS percent, adopted AS adoption_count,
       adopted * 100.0 / size AS adoption_percent FROM by_day""",
    *DENSE,
    _ADOPTED,
    _BY_DAY,
)
def usage_derived_users(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return usage.derived_users(usage.usage_table(rows, joined, until, MAX_DAY, "click", hot=hot))


# --- monetisation ---------------------------------------------------------------


def _priced(spark, sf):
    rows, joined, until, hot = _base(spark, sf)
    return modified_revenue(rows, RULES), joined, until, hot


@query(
    "monetization_revenue",
    "cohort_id:i bucket:i size:i eligible:i revenue:d event_count:d",
    """SELECT cohort_id, bucket, COUNT(*) AS size, SUM(ok) AS eligible, SUM(revenue) AS revenue, SUM(events) AS event_count
       FROM cells GROUP BY 1, 2""",
    *DENSE,
)
def monetization_revenue(spark, sf):
    rows, joined, until, hot = _priced(spark, sf)
    return monetization.revenue_table(rows, joined, until, MAX_DAY, hot=hot)


@query(
    "monetization_retained",
    "cohort_id:i bucket:i active:i",
    "SELECT cohort_id, bucket, COUNT(*) AS active FROM cells WHERE any_events > 0 GROUP BY 1, 2",
    *DENSE,
)
def monetization_retained(spark, sf):
    rows, joined, until, hot = _priced(spark, sf)
    return monetization.retained_users(rows, joined, until, MAX_DAY, hot)


def _derived_sql() -> str:
    return """SELECT cohort_id, bucket, revenue AS total_revenue, run AS cumulative_revenue, revenue / size AS revenue_per_acquired_user,
       run / size AS cumulative_revenue_per_acquired_user, CASE WHEN retained > 0 THEN revenue / retained ELSE 0 END AS revenue_per_retained_user
       FROM (SELECT *, SUM(revenue) OVER (PARTITION BY cohort_id ORDER BY bucket) AS run FROM (
         SELECT cohort_id, bucket, COUNT(*) AS size, SUM(revenue) AS revenue, SUM(CASE WHEN any_events > 0 THEN 1 ELSE 0 END) AS retained
         FROM cells GROUP BY 1, 2))"""


@query(
    "monetization_derived",
    "cohort_id:i bucket:i total_revenue:d cumulative_revenue:d revenue_per_acquired_user:d cumulative_revenue_per_acquired_user:d revenue_per_retained_user:d",
    _derived_sql(),
    *DENSE,
)
def monetization_derived(spark, sf):
    rows, joined, until, hot = _priced(spark, sf)
    return monetization.derived_revenue(monetization.monetization_table(rows, joined, until, MAX_DAY, hot))


@query(
    "monetization_calendar_day",
    "cohort_id:i day_number:i revenue:d event_volume:d",
    """SELECT m.cohort_id, date_diff('day', CAST(m.join_time AS DATE), CAST(ev.event_time AS DATE)) AS day_number,
       SUM(CASE ev.event_name WHEN 'purchase' THEN original_revenue ELSE 2.5 * event_count END) AS revenue, SUM(event_count) AS event_volume
       FROM m JOIN ev ON m.user_id = ev.user_id WHERE ev.event_name IN ('purchase', 'signup') GROUP BY 1, 2 HAVING day_number BETWEEN 0 AND 7""",
    *MEMBERS,
)
def monetization_calendar_day(spark, sf):
    base = study(events(spark, sf))
    priced = modified_revenue(base.rows, RULES)
    return monetization.calendar_day_revenue(priced, base.members, RULES, MAX_DAY, base.hot)


# --- lifetime value -------------------------------------------------------------

LTV_DAYS = 14
LTV_HORIZON = 30


def _fit_ctes() -> list[str]:
    ctes = [f"derived AS ({_derived_sql()})"]
    ctes.append("pts AS (SELECT cohort_id, CAST(bucket AS DOUBLE) AS x, cumulative_revenue_per_acquired_user AS y FROM derived)")
    ctes.append(
        """r0 AS (SELECT DISTINCT cohort_id, CAST(0.01 AS DOUBLE) AS lo, CAST(1.5 AS DOUBLE) AS hi, CAST(NULL AS DOUBLE) AS a,
        CAST(NULL AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS sse FROM pts)"""
    )
    for n in range(1, 8):
        p = n - 1
        ctes.append(f"k{n} AS (SELECT cohort_id, s.i AS ord, lo + (hi - lo) * (s.i / 63.0) AS b FROM r{p} CROSS JOIN generate_series(0, 63) s(i))")
        ctes.append(
            f"""a{n} AS (SELECT k.cohort_id, k.ord, k.b, GREATEST(0.0, SUM(y * pow(x, k.b)) / SUM(pow(x, k.b) * pow(x, k.b))) AS a
            FROM k{n} k JOIN pts USING (cohort_id) WHERE x > 0 GROUP BY 1, 2, 3)"""
        )
        ctes.append(
            f"""e{n} AS (SELECT q.cohort_id, q.ord, q.b, q.a, SUM(pow(y - q.a * CASE WHEN x > 0 THEN pow(x, q.b) ELSE 0 END, 2)) AS sse
            FROM a{n} q JOIN pts USING (cohort_id) GROUP BY 1, 2, 3, 4)"""
        )
        ctes.append(
            f"""w{n} AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cohort_id ORDER BY sse, ord) AS rn FROM (
            SELECT cohort_id, ord, b, a, sse FROM e{n} UNION ALL SELECT cohort_id, -1, b, a, sse FROM r{p} WHERE sse IS NOT NULL)) WHERE rn = 1)"""
        )
        ctes.append(
            f"""r{n} AS (SELECT w.cohort_id, LEAST(1.5, GREATEST(0.01, w.b - (r.hi - r.lo) / 4)) AS lo,
            LEAST(1.5, GREATEST(0.01, w.b + (r.hi - r.lo) / 4)) AS hi, w.a, w.b, w.sse FROM w{n} w JOIN r{p} r USING (cohort_id))"""
        )
    ctes.append(
        """fit AS (SELECT r.cohort_id, r.a, r.b, r.sse / (COUNT(*) - 2) AS residual_variance, COUNT(*) AS points, CAST(MAX(x) AS INTEGER) AS last_day
        FROM r7 r JOIN pts USING (cohort_id) GROUP BY r.cohort_id, r.a, r.b, r.sse)"""
    )
    return ctes


_LTV = (*MEMBERS, OBS, act(), grid(LTV_DAYS), _FACTS, _CELLS, *_fit_ctes())


def _fit(spark, sf):
    rows, joined, until, hot = _priced(spark, sf)
    curve = monetization.derived_revenue(monetization.monetization_table(rows, joined, until, LTV_DAYS, hot))
    return ltv.fit_power_law(curve, "cumulative_revenue_per_acquired_user")


@query("ltv_fit", "cohort_id:i a:d b:d residual_variance:d points:i last_day:i", "SELECT * FROM fit", *_LTV)
def ltv_fit(spark, sf):
    return _fit(spark, sf)


def _projection_sql(a: str, b: str) -> str:
    return f"""SELECT cohort_id, day, p AS projected, GREATEST(0.0, p - w) AS lower, p + w AS upper FROM (
       SELECT cohort_id, d.i AS day, {a} * pow(d.i, {b}) AS p,
              1.96 * sqrt(GREATEST(0.0, residual_variance)) * sqrt(1 + (d.i - last_day) / 10.0) AS w
       FROM fit JOIN generate_series(0, {LTV_HORIZON}) d(i) ON d.i > last_day)"""


_PROJECTED = "cohort_id:i day:i projected:d lower:d upper:d"
_KEEP = ("cohort_id", "day", "projected", "lower", "upper")


@query("ltv_projection", _PROJECTED, _projection_sql("a", "b"), *_LTV)
def ltv_projection(spark, sf):
    return ltv.project(_fit(spark, sf), LTV_HORIZON).select(*_KEEP)


@query("ltv_reprojection", _PROJECTED, _projection_sql("40.0", "0.9"), *_LTV)
def ltv_reprojection(spark, sf):
    return ltv.reproject(_fit(spark, sf), 40.0, 0.9, LTV_HORIZON).select(*_KEEP)
