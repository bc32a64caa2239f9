"""Registered queries: cohort comparison and experiment impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideline.operators import compare, impact
from strideline.operators.revenue import modified_revenue
from strideline.operators.staging import stage
from strideline.plans.base import MEMBERS, OBS, RULES, act, events, grid, quantile_seconds_sql, query, study, two_sided_sql
from strideline.plans.metrics import _CELLS, _FACTS
from strideline.specs import EventMatch

A, B, DAY = 3, 2, 3
WIDE = 30
DENSE = (*MEMBERS, OBS, act(), grid(WIDE), _FACTS, _CELLS)


def _values(spark, sf, metric, event=None, **options):
    base = study(modified_revenue(events(spark, sf), RULES))
    pair = base.members.where(F.col("cohort_id").isin(A, B))
    return compare.metric_values(base.rows, pair, base.until, metric, DAY, event, hot=base.hot, **options)


# --- per-user values ------------------------------------------------------------

_VALUES = "cohort_id:i user_id:s value:d"
_PAIR = f"cohort_id IN ({A}, {B})"


def _at_day(value: str, extra: str = "") -> str:
    return f"SELECT cohort_id, user_id, {value} AS value FROM cells WHERE {_PAIR} AND bucket = {DAY} AND ok = 1 {extra}"


def _up_to(value: str) -> str:
    return f"SELECT cohort_id, user_id, {value} AS value FROM cells WHERE {_PAIR} AND bucket <= {DAY} AND ok = 1 GROUP BY 1, 2"


@query("compare_retention", _VALUES, _at_day("CASE WHEN any_events > 0 THEN 1 ELSE 0 END"), *DENSE)
def compare_retention(spark, sf):
    return _values(spark, sf, "retention_rate")


@query(
    "compare_retention_ever_after",
    _VALUES,
    f"""SELECT cohort_id, user_id, MAX(CASE WHEN purchases > 0 THEN 1 ELSE 0 END) AS value FROM cells
       WHERE {_PAIR} AND bucket BETWEEN {DAY} AND {WIDE} GROUP BY 1, 2 HAVING MAX(CASE WHEN bucket = {DAY} THEN ok END) = 1""",
    *DENSE,
)
def compare_retention_ever_after(spark, sf):
    return _values(spark, sf, "retention_rate", "purchase", kind="ever_after")


@query("compare_usage_mean", _VALUES, _at_day("clicks"), *DENSE)
def compare_usage_mean(spark, sf):
    return _values(spark, sf, "per_installed_user", "click")


@query("compare_usage_unique", _VALUES, _at_day("CASE WHEN clicks > 0 THEN 1 ELSE 0 END"), *DENSE)
def compare_usage_unique(spark, sf):
    return _values(spark, sf, "unique_users_percent", "click")


@query("compare_usage_cumulative", _VALUES, _up_to("SUM(clicks)"), *DENSE)
def compare_usage_cumulative(spark, sf):
    return _values(spark, sf, "cumulative_per_installed_user", "click")


@query("compare_usage_cumulative_unique", _VALUES, _up_to("MAX(CASE WHEN clicks > 0 THEN 1 ELSE 0 END)"), *DENSE)
def compare_usage_cumulative_unique(spark, sf):
    return _values(spark, sf, "unique_users_cumulative_percent", "click")


@query("compare_per_retained", _VALUES, _at_day("clicks", "AND any_events > 0"), *DENSE)
def compare_per_retained(spark, sf):
    return _values(spark, sf, "per_retained_user", "click")


@query("compare_per_firer", _VALUES, _at_day("clicks", "AND clicks > 0"), *DENSE)
def compare_per_firer(spark, sf):
    return _values(spark, sf, "per_event_firer", "click")


@query("compare_revenue", _VALUES, _at_day("revenue"), *DENSE)
def compare_revenue(spark, sf):
    return _values(spark, sf, "revenue_per_acquired_user")


@query("compare_revenue_cumulative", _VALUES, _up_to("SUM(revenue)"), *DENSE)
def compare_revenue_cumulative(spark, sf):
    return _values(spark, sf, "cumulative_revenue_per_acquired_user")


@query("compare_revenue_retained", _VALUES, _at_day("revenue", "AND any_events > 0"), *DENSE)
def compare_revenue_retained(spark, sf):
    return _values(spark, sf, "revenue_per_retained_user")


# --- tests ------------------------------------------------------------------------


def _pair_ctes(values: str) -> list[str]:
    picks = ", ".join(
        f"""CAST(COUNT(*) FILTER (cohort_id = {c}) AS DOUBLE) AS n_{n}, CAST(COALESCE(SUM(value) FILTER (cohort_id = {c}), 0) AS DOUBLE) AS sum_{n},
        CAST(COALESCE(AVG(value) FILTER (cohort_id = {c}), 0) AS DOUBLE) AS mean_{n}, var_samp(value) FILTER (cohort_id = {c}) AS var_{n}"""
        for n, c in (("a", A), ("b", B))
    )
    return [f"vals AS ({values})", f"pair AS (SELECT {picks} FROM vals)"]


_Z = """zt AS (SELECT *, CASE WHEN v > 0 THEN """ + two_sided_sql("ABS((sum_a / n_a - sum_b / n_b) / sqrt(v))") + """ ELSE 1.0 END AS p_z FROM (
  SELECT *, ((sum_a + sum_b) / (n_a + n_b)) * (1 - (sum_a + sum_b) / (n_a + n_b)) * (1 / n_a + 1 / n_b) AS v FROM pair))"""

# Log factorials by a running sum; every table of the support; the tail.
_FISHER = """lf AS (SELECT i, SUM(CASE WHEN i > 0 THEN ln(i) ELSE 0 END) OVER (ORDER BY i) AS v FROM (
  SELECT unnest(generate_series(0, CAST(n_a + n_b AS BIGINT))) AS i FROM pair)),
tabs AS (SELECT x.i AS x, p.sum_a,
    exp((SELECT v FROM lf WHERE i = p.n_a) - (SELECT v FROM lf WHERE i = x.i) - la.v
      + (SELECT v FROM lf WHERE i = p.n_b) - lb.v - lc.v
      - (SELECT v FROM lf WHERE i = p.n_a + p.n_b) + (SELECT v FROM lf WHERE i = p.sum_a + p.sum_b) + (SELECT v FROM lf WHERE i = p.n_a + p.n_b - p.sum_a - p.sum_b)) AS prob
  FROM pair p JOIN lf x ON x.i BETWEEN GREATEST(0, p.sum_a + p.sum_b - p.n_b) AND LEAST(p.sum_a + p.sum_b, p.n_a)
  JOIN lf la ON la.i = p.n_a - x.i JOIN lf lb ON lb.i = p.sum_a + p.sum_b - x.i JOIN lf lc ON lc.i = p.n_b - (p.sum_a + p.sum_b - x.i)),
ft AS (SELECT LEAST(1.0, SUM(prob) FILTER (prob <= (SELECT prob FROM tabs WHERE x = sum_a) + 1e-10)) AS p_fisher FROM tabs)"""

# One minus the t density integrated over [-t, t] by Simpson's rule, with the gamma function.
_WELCH = """ws AS (SELECT *, ABS((mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b)) AS t,
  pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)) AS df FROM pair),
wi AS (SELECT SUM(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + pow(t * i / 2000.0, 2) / df, -(df + 1) / 2)) * MIN(t) / 6000.0 AS half
  FROM ws CROSS JOIN generate_series(0, 2000) s(i)),
wt AS (SELECT *, 1 - 2 * half AS p_welch FROM ws, wi)"""


def _rank_cte() -> str:
    variance = "n_a * n_b / 12.0 * (n_a + n_b + 1 - tie_term / ((n_a + n_b) * (n_a + n_b - 1)))"
    z = f"GREATEST(0.0, n_a * n_b / 2.0 - LEAST(u_a, n_a * n_b - u_a) - 0.5) / sqrt({variance})"
    return f"""rt AS (SELECT *, {two_sided_sql('(' + z + ')')} AS p_mwu FROM (SELECT *, rank_sum_a - n_a * (n_a + 1) / 2.0 AS u_a FROM (
      SELECT CAST(COUNT(*) FILTER (cohort_id = {A}) AS DOUBLE) AS n_a, CAST(COUNT(*) FILTER (cohort_id = {B}) AS DOUBLE) AS n_b,
             SUM(r) FILTER (cohort_id = {A}) AS rank_sum_a, SUM((same * same - 1.0)) AS tie_term FROM (
        SELECT cohort_id, rank() OVER (ORDER BY value) + (COUNT(*) OVER (PARTITION BY value) - 1) / 2.0 AS r,
               CAST(COUNT(*) OVER (PARTITION BY value) AS DOUBLE) AS same FROM (SELECT cohort_id, ROUND(value, 6) AS value FROM vals)))))"""


_RETAINED = _at_day("CASE WHEN any_events > 0 THEN 1 ELSE 0 END")
_COUNTS = "n_a:i sum_a:d mean_a:d n_b:i sum_b:d mean_b:d"


def _side(spark, sf, metric, event=None):
    return compare.side_by_side(_values(spark, sf, metric, event), A, B)


@query("test_two_proportion_z", _COUNTS + " p_z:d", "SELECT * FROM zt", *DENSE, *_pair_ctes(_RETAINED), _Z)
def test_two_proportion_z(spark, sf):
    return compare.proportion_test(_side(spark, sf, "retention_rate")).drop("var_a", "var_b")


@query(
    "test_fisher_exact",
    _COUNTS + " p_fisher:d",
    "SELECT pair.*, ft.p_fisher FROM pair, ft",
    *DENSE,
    *_pair_ctes(_at_day("CASE WHEN purchases > 0 THEN 1 ELSE 0 END")),
    _FISHER,
)
def test_fisher_exact(spark, sf):
    return compare.fisher_test(_side(spark, sf, "retention_rate", "purchase")).drop("var_a", "var_b")


@query(
    "test_welch_t",
    "n_a:i mean_a:d var_a:d n_b:i mean_b:d var_b:d p_welch:d",
    "SELECT * FROM wt",
    *DENSE,
    *_pair_ctes(_up_to("SUM(clicks)")),
    _WELCH,
)
def test_welch_t(spark, sf):
    return compare.welch_test(_side(spark, sf, "cumulative_per_installed_user", "click")).drop("sum_a", "sum_b")


@query(
    "test_mann_whitney_u",
    "n_a:i n_b:i rank_sum_a:d tie_term:d u_a:d p_mwu:d",
    "SELECT * FROM rt",
    *DENSE,
    *_pair_ctes(_up_to("SUM(revenue)")),
    _rank_cte(),
)
def test_mann_whitney_u(spark, sf):
    values = stage(_values(spark, sf, "cumulative_revenue_per_acquired_user"))
    return compare.rank_test(values, A, B)


_SUMMARY = "metric:s n_a:i n_b:i value_a:d value_b:d difference:d relative_lift:d p_z:d p_fisher:d p_welch:d p_mwu:d p_value:d significant:b"


@query(
    "compare_summary",
    _SUMMARY,
    """SELECT 'cumulative_per_installed_user' AS metric, w.n_a, w.n_b, mean_a AS value_a, mean_b AS value_b, mean_a - mean_b AS difference,
       (mean_a - mean_b) / mean_b AS relative_lift, NULL AS p_z, NULL AS p_fisher, p_welch, p_mwu, p_mwu AS p_value, p_mwu < 0.05 AS significant FROM wt w, rt""",
    *DENSE,
    *_pair_ctes(_up_to("SUM(clicks)")),
    _WELCH,
    _rank_cte(),
)
def compare_summary(spark, sf):
    metric = "cumulative_per_installed_user"
    return compare.compare_cohorts(stage(_values(spark, sf, metric, "click")), metric, A, B)


@query(
    "compare_summary_proportion",
    _SUMMARY,
    """SELECT 'retention_rate' AS metric, n_a, n_b, mean_a AS value_a, mean_b AS value_b, mean_a - mean_b AS difference,
       (mean_a - mean_b) / mean_b AS relative_lift, p_z, p_fisher, NULL AS p_welch, NULL AS p_mwu, LEAST(p_z, p_fisher) AS p_value,
       LEAST(p_z, p_fisher) < 0.05 AS significant FROM zt, ft""",
    *DENSE,
    *_pair_ctes(_RETAINED),
    _Z,
    _FISHER,
)
def compare_summary_proportion(spark, sf):
    return compare.compare_cohorts(stage(_values(spark, sf, "retention_rate")), "retention_rate", A, B)


# --- impact -----------------------------------------------------------------------

SPEC = impact.Experiment(
    baseline=1,
    variants=[2, 3, 4],
    start_day=1,
    end_day=6,
    exposure=["view", EventMatch("error", {"k": 7})],
    interaction=["click"],
    impact=["purchase", EventMatch("signup", {"k": 11})],
    monetization=["purchase", "signup"],
    retention_event="view",
)

_EXPOSED = "(event_name = 'view' OR (event_name = 'error' AND k = 7))"
_CLICK = "event_name = 'click'"
_PAID = "event_name IN ('purchase', 'signup')"
_SIGNUP = "(event_name = 'signup' AND k = 11)"
_KEPT = "event_name = 'view'"
_WINDOW = """win AS (
  SELECT m.cohort_id, m.join_time, ev.user_id, ev.event_name, ev.event_time, ev.k, ev.row_id, ev.event_count,
         CAST(CASE ev.event_name WHEN 'purchase' THEN original_revenue WHEN 'signup' THEN 2.5 * event_count ELSE 0.0 END AS DECIMAL(28, 10)) AS revenue,
         CAST(floor((epoch_us(ev.event_time) - epoch_us(m.join_time)) / 86400000000.0) AS INTEGER) AS rel_day
  FROM m JOIN ev ON m.user_id = ev.user_id
  WHERE ev.event_time >= m.join_time + INTERVAL 1 DAY AND ev.event_time < m.join_time + INTERVAL 7 DAY)"""


def _amount(condition: str, column: str = "event_count") -> str:
    return f"COALESCE((SELECT SUM({column}) FROM win w WHERE w.cohort_id = s.cohort_id AND {condition}), 0)"


def _people(condition: str) -> str:
    return f"(SELECT COUNT(DISTINCT user_id) FROM win w WHERE w.cohort_id = s.cohort_id AND {condition})"


_COUNTED = f"""counted AS (
  SELECT s.cohort_id, s.n AS total_users, {_people(_EXPOSED)} AS exposure_users, {_amount(_EXPOSED)} AS exposure_count,
         {_people(_CLICK)} AS interaction_users, {_amount(_CLICK)} AS interaction_count,
         (SELECT COUNT(*) FROM (SELECT user_id FROM win w WHERE w.cohort_id = s.cohort_id AND {_CLICK} GROUP BY user_id HAVING SUM(event_count) >= 2)) AS reuse_users,
         {_amount(_PAID, 'revenue')} AS total_revenue,
         (SELECT COUNT(*) FROM (SELECT user_id FROM win w WHERE w.cohort_id = s.cohort_id AND {_PAID} GROUP BY user_id HAVING SUM(revenue) > 0.0001)) AS paying_users,
         {_people("event_name = 'purchase'")} AS reached_0, {_amount("event_name = 'purchase'")} AS impact_0,
         {_people(_SIGNUP)} AS reached_1, {_amount(_SIGNUP)} AS impact_1
  FROM (SELECT cohort_id, COUNT(*) AS n FROM m GROUP BY 1) s)"""
_RATES = """rated AS (
  SELECT *, exposure_users / total_users AS exposure_rate, CASE WHEN exposure_users > 0 THEN interaction_users / exposure_users ELSE 0 END AS usage_rate,
         CASE WHEN exposure_count > 0 THEN interaction_count / exposure_count END AS ctr,
         CASE WHEN interaction_users > 0 THEN reuse_users / interaction_users ELSE 0 END AS reuse_rate, interaction_count / total_users AS engagement
  FROM counted)"""
_DELAYS = f"""delays AS (
  SELECT f.cohort_id, f.user_id, (epoch_us(MIN(w.event_time)) - epoch_us(MIN(f.t))) / 1000000.0 AS seconds
  FROM (SELECT cohort_id, user_id, MIN(event_time) AS t FROM win WHERE {_EXPOSED} GROUP BY 1, 2) f
  JOIN win w ON w.cohort_id = f.cohort_id AND w.user_id = f.user_id WHERE {_CLICK} AND w.event_time > f.t GROUP BY 1, 2)"""
_SERIES = f"""series AS (
  SELECT cohort_id, rel_day, active_users, CASE WHEN active_users > 0 THEN i / active_users ELSE 0 END AS engagement,
         CASE WHEN active_users > 0 THEN r / active_users ELSE 0 END AS revenue FROM (
    SELECT s.cohort_id, CAST(d.i AS INTEGER) AS rel_day, COUNT(DISTINCT CASE WHEN {_KEPT} THEN w.user_id END) AS active_users,
           SUM(CASE WHEN {_CLICK} THEN event_count ELSE 0 END) AS i, SUM(CASE WHEN {_PAID} THEN revenue ELSE 0 END) AS r
    FROM (SELECT DISTINCT cohort_id FROM m) s CROSS JOIN generate_series(1, 6) d(i)
    LEFT JOIN win w ON w.cohort_id = s.cohort_id AND w.rel_day = d.i GROUP BY 1, 2))"""
_AVERAGES = """averages AS (
  SELECT cohort_id, CASE WHEN SUM(ABS(engagement)) > 0 THEN AVG(engagement) END AS engagement_daily_avg,
         CASE WHEN SUM(ABS(revenue)) > 0 THEN AVG(revenue) END AS revenue_daily_avg FROM series GROUP BY 1)"""
_LONG = """long_form AS (
  SELECT r.cohort_id, k.metric_key, CASE k.metric_key
      WHEN 'exposure_rate' THEN exposure_rate WHEN 'usage_rate' THEN usage_rate WHEN 'ctr' THEN ctr WHEN 'reuse_rate' THEN reuse_rate
      WHEN 'time_to_first_interaction' THEN (SELECT """ + quantile_seconds_sql(0.5) + """ FROM delays d WHERE d.cohort_id = r.cohort_id)
      WHEN 'engagement' THEN engagement WHEN 'engagement_daily_avg' THEN engagement_daily_avg
      WHEN 'revenue_per_user' THEN total_revenue / total_users WHEN 'revenue_conversion' THEN paying_users / total_users
      WHEN 'revenue_intensity' THEN CASE WHEN paying_users > 0 THEN total_revenue / paying_users END WHEN 'revenue_daily_avg' THEN revenue_daily_avg
      WHEN 'purchase_reach' THEN reached_0 / total_users WHEN 'purchase_intensity' THEN impact_0 / total_users
      WHEN 'signup_reach' THEN reached_1 / total_users WHEN 'signup_intensity' THEN impact_1 / total_users END AS value
  FROM rated r JOIN averages a USING (cohort_id) CROSS JOIN (VALUES ('exposure_rate'), ('usage_rate'), ('ctr'), ('reuse_rate'), ('time_to_first_interaction'),
    ('engagement'), ('engagement_daily_avg'), ('revenue_per_user'), ('revenue_conversion'), ('revenue_intensity'), ('revenue_daily_avg'),
    ('purchase_reach'), ('purchase_intensity'), ('signup_reach'), ('signup_intensity')) k(metric_key)),
deltas AS (SELECT v.*, CASE WHEN v.cohort_id <> 1 AND b.value <> 0 THEN (v.value - b.value) / b.value END AS delta
  FROM long_form v JOIN long_form b ON b.metric_key = v.metric_key AND b.cohort_id = 1)"""
_PER_USER = f"""per_user AS (
  SELECT m.cohort_id, m.user_id, COALESCE(SUM(w.event_count) FILTER ({_EXPOSED}), 0) AS exposures, COALESCE(SUM(w.event_count) FILTER ({_CLICK}), 0) AS interactions,
         COALESCE(SUM(w.revenue) FILTER ({_PAID}), 0) AS revenue, COALESCE(SUM(w.event_count) FILTER (w.event_name = 'purchase'), 0) AS impact_0,
         COALESCE(SUM(w.event_count) FILTER ({_SIGNUP.replace('k =', 'w.k =')}), 0) AS impact_1
  FROM m LEFT JOIN win w ON w.cohort_id = m.cohort_id AND w.user_id = m.user_id GROUP BY 1, 2),
kept AS (
  SELECT cohort_id, user_id, COUNT(*) AS days, SUM(i) AS i, SUM(r) AS r FROM (
    SELECT cohort_id, user_id, rel_day, SUM(CASE WHEN {_CLICK} THEN event_count ELSE 0 END) AS i, SUM(CASE WHEN {_PAID} THEN revenue ELSE 0 END) AS r,
           MAX(CASE WHEN {_KEPT} THEN 1 ELSE 0 END) AS here FROM win GROUP BY 1, 2, 3) WHERE here = 1 GROUP BY 1, 2),
vectors AS (
  SELECT p.*, CASE WHEN exposures > 0 THEN interactions / exposures ELSE 0 END AS user_ctr,
         COALESCE(kept.i / kept.days, 0) AS user_daily_interactions, COALESCE(kept.r / kept.days, 0) AS user_daily_revenue
  FROM per_user p LEFT JOIN kept ON kept.cohort_id = p.cohort_id AND kept.user_id = p.user_id)"""

IMPACT = (*MEMBERS, _WINDOW)


def _study(spark, sf):
    return study(modified_revenue(events(spark, sf), RULES))


def _days(base):
    return impact.user_days(base.rows, base.members, SPEC, base.hot)


def _totals(spark, sf):
    base = _study(spark, sf)
    return impact.user_totals(_days(base), base.members, SPEC)


@query(
    "impact_window",
    "cohort_id:i user_id:s row_id:i rel_day:i modified_revenue:d",
    "SELECT cohort_id, user_id, row_id, rel_day, revenue AS modified_revenue FROM win",
    *IMPACT,
)
def impact_window(spark, sf):
    base = _study(spark, sf)
    return impact.impact_window(base.rows, base.members, SPEC, base.hot).select("cohort_id", "user_id", "row_id", "rel_day", "modified_revenue")


@query(
    "impact_exposure",
    "cohort_id:i total_users:i exposure_users:i exposure_count:d interaction_users:i interaction_count:d reuse_users:i exposure_rate:d",
    "SELECT * FROM rated",
    *IMPACT,
    _COUNTED,
    _RATES,
)
def impact_exposure(spark, sf):
    rated = impact.rates(impact.cohort_totals(_totals(spark, sf), SPEC))
    return rated.select(
        "cohort_id", "total_users", "exposure_users", "exposure_count", "interaction_users", "interaction_count", "reuse_users", "exposure_rate"
    )


@query("impact_rates", "cohort_id:i exposure_rate:d usage_rate:d ctr:d reuse_rate:d engagement:d", "SELECT * FROM rated", *IMPACT, _COUNTED, _RATES)
def impact_rates(spark, sf):
    rated = impact.rates(impact.cohort_totals(_totals(spark, sf), SPEC))
    return rated.select("cohort_id", "exposure_rate", "usage_rate", "ctr", "reuse_rate", "engagement")


@query("impact_time_to_interaction", "cohort_id:i user_id:s seconds:d", "SELECT * FROM delays", *IMPACT, _DELAYS)
def impact_time_to_interaction(spark, sf):
    base = _study(spark, sf)
    totals = stage(impact.user_totals(_days(base), base.members, SPEC))
    return impact.interaction_times(base.rows, totals, SPEC, base.hot)


def _daily(spark, sf):
    base = _study(spark, sf)
    return impact.daily_series(_days(base), base.members, SPEC)


@query("impact_daily_series", "cohort_id:i rel_day:i active_users:i engagement:d revenue:d", "SELECT * FROM series", *IMPACT, _SERIES)
def impact_daily_series(spark, sf):
    return _daily(spark, sf)


@query("impact_daily_avg", "cohort_id:i engagement_daily_avg:d revenue_daily_avg:d", "SELECT * FROM averages", *IMPACT, _SERIES, _AVERAGES)
def impact_daily_avg(spark, sf):
    return impact.daily_averages(_daily(spark, sf))


@query(
    "impact_reach_intensity",
    "cohort_id:i event:s event_users:i total_users:i reach:d intensity:d",
    """SELECT cohort_id, 'purchase' AS event, reached_0 AS event_users, total_users, reached_0 / total_users AS reach, impact_0 / total_users AS intensity FROM counted
       UNION ALL SELECT cohort_id, 'signup', reached_1, total_users, reached_1 / total_users, impact_1 / total_users FROM counted""",
    *IMPACT,
    _COUNTED,
)
def impact_reach_intensity(spark, sf):
    return impact.reach_intensity(impact.cohort_totals(_totals(spark, sf), SPEC), SPEC)


@query(
    "impact_monetization",
    "cohort_id:i total_users:i total_revenue:d paying_users:i revenue_per_user:d revenue_conversion:d revenue_intensity:d",
    """SELECT *, total_revenue / total_users AS revenue_per_user, paying_users / total_users AS revenue_conversion,
       CASE WHEN paying_users > 0 THEN total_revenue / paying_users END AS revenue_intensity FROM counted""",
    *IMPACT,
    _COUNTED,
)
def impact_monetization(spark, sf):
    return impact.monetization(impact.cohort_totals(_totals(spark, sf), SPEC))


_ALL_METRICS = (*IMPACT, _COUNTED, _RATES, _DELAYS, _SERIES, _AVERAGES, _LONG)


def _prepared(spark, sf):
    base = _study(spark, sf)
    return impact.prepare(base.rows, base.members, SPEC, base.hot)


@query("impact_deltas", "cohort_id:i metric_key:s delta:d", "SELECT * FROM deltas WHERE cohort_id <> 1", *_ALL_METRICS)
def impact_deltas(spark, sf):
    return impact.metrics_long(_prepared(spark, sf)).where(F.col("cohort_id") != 1).select("cohort_id", "metric_key", "delta")


@query("impact_metrics_long", "cohort_id:i metric_key:s value:d delta:d", "SELECT * FROM deltas", *_ALL_METRICS)
def impact_metrics_long(spark, sf):
    return impact.metrics_long(_prepared(spark, sf))


@query(
    "impact_variant_order",
    "cohort_id:i metric_key:s value:d delta:d",
    "SELECT * FROM deltas WHERE metric_key = 'engagement' AND cohort_id <> 1 ORDER BY delta DESC NULLS LAST, cohort_id",
    *_ALL_METRICS,
)
def impact_variant_order(spark, sf):
    return impact.rank_variants(impact.metrics_long(_prepared(spark, sf)), "engagement", SPEC.baseline)


_BASE_P, _VAR_P = "b.x / b.n", "v.x / v.n"
_SIGNIFICANCE = (
    *IMPACT,
    _COUNTED,
    _DELAYS,
    _PER_USER,
    """pairs AS (
      SELECT cohort_id, 'exposure_rate' AS metric_key, CAST(exposure_users AS DOUBLE) AS x, CAST(total_users AS DOUBLE) AS n FROM counted
      UNION ALL SELECT cohort_id, 'usage_rate', interaction_users, exposure_users FROM counted
      UNION ALL SELECT cohort_id, 'reuse_rate', reuse_users, interaction_users FROM counted
      UNION ALL SELECT cohort_id, 'revenue_conversion', paying_users, total_users FROM counted
      UNION ALL SELECT cohort_id, 'purchase_reach', reached_0, total_users FROM counted
      UNION ALL SELECT cohort_id, 'signup_reach', reached_1, total_users FROM counted)""",
    f"""ztests AS (
      SELECT cohort_id, metric_key, 'z_test' AS test, CASE WHEN n_b = 0 OR n = 0 THEN 'insufficient_data' WHEN n_b < 30 OR n < 30 THEN 'low_sample'
               WHEN p_b = p THEN 'no_difference' END AS skip_reason,
             CASE WHEN v > 0 THEN {two_sided_sql('ABS((p_b - p) / sqrt(v))')} ELSE 1.0 END AS p
      FROM (SELECT *, pool * (1 - pool) * (1 / n_b + 1 / n) AS v FROM (
        SELECT v.cohort_id, v.metric_key, v.n, b.n AS n_b, v.x / NULLIF(v.n, 0) AS p, b.x / NULLIF(b.n, 0) AS p_b, (v.x + b.x) / NULLIF(v.n + b.n, 0) AS pool
        FROM pairs v JOIN pairs b ON b.metric_key = v.metric_key AND b.cohort_id = 1 WHERE v.cohort_id <> 1)))""",
    """uv AS (
      SELECT cohort_id, 'ctr' AS metric_key, CAST(user_ctr AS DOUBLE) AS value FROM vectors
      UNION ALL SELECT cohort_id, 'engagement', interactions FROM vectors
      UNION ALL SELECT cohort_id, 'engagement_daily_avg', user_daily_interactions FROM vectors
      UNION ALL SELECT cohort_id, 'time_to_first_interaction', seconds FROM delays
      UNION ALL SELECT cohort_id, 'revenue_per_user', revenue FROM vectors
      UNION ALL SELECT cohort_id, 'revenue_intensity', revenue FROM vectors WHERE revenue > 0
      UNION ALL SELECT cohort_id, 'revenue_daily_avg', user_daily_revenue FROM vectors
      UNION ALL SELECT cohort_id, 'purchase_intensity', impact_0 FROM vectors
      UNION ALL SELECT cohort_id, 'signup_intensity', impact_1 FROM vectors)""",
    """faced AS (SELECT c.v AS variant, u.metric_key, u.cohort_id = 1 AS is_base, ROUND(u.value, 6) AS value
      FROM uv u JOIN (VALUES (2), (3), (4)) c(v) ON u.cohort_id = 1 OR u.cohort_id = c.v)""",
    """ranks AS (SELECT variant, metric_key, COUNT(*) FILTER (is_base) AS n_b, COUNT(*) FILTER (NOT is_base) AS n_v, SUM(r) FILTER (is_base) AS rank_sum,
        AVG(value) FILTER (is_base) AS mean_b, AVG(value) FILTER (NOT is_base) AS mean_v
      FROM (SELECT *, rank() OVER (PARTITION BY variant, metric_key ORDER BY value) + (COUNT(*) OVER (PARTITION BY variant, metric_key, value) - 1) / 2.0 AS r FROM faced)
      GROUP BY 1, 2)""",
    f"""rtests AS (
      SELECT variant AS cohort_id, metric_key, 'mwu' AS test,
        CASE WHEN metric_key = 'ctr' AND ((SELECT exposure_count FROM counted WHERE cohort_id = 1) < 30
               OR (SELECT exposure_count FROM counted c WHERE c.cohort_id = variant) < 30) THEN 'low_sample'
             WHEN n_b = 0 OR n_v = 0 THEN 'insufficient_data' WHEN n_b < 30 OR n_v < 30 THEN 'low_sample' WHEN mean_b = mean_v THEN 'no_difference' END AS skip_reason,
        {two_sided_sql('((n_b * n_v / 2.0 - LEAST(u, n_b * n_v - u)) / sqrt(n_b * n_v * (n_b + n_v + 1) / 12.0))')} AS p
      FROM (SELECT *, rank_sum - n_b * (n_b + 1) / 2.0 AS u FROM ranks))""",
)


@query(
    "impact_significance",
    "cohort_id:i metric_key:s test:s p_value:d significant:b skip_reason:s",
    """SELECT cohort_id, metric_key, test, CASE WHEN skip_reason IS NULL THEN p END AS p_value, skip_reason IS NULL AND p < 0.05 AS significant, skip_reason
       FROM (SELECT * FROM ztests UNION ALL SELECT cohort_id, metric_key, test, skip_reason, p FROM rtests)""",
    *_SIGNIFICANCE,
)
def impact_significance(spark, sf):
    return impact.significance(_prepared(spark, sf))


@query(
    "impact_vector_counts",
    "cohort_id:i user_id:s exposures:d interactions:d impact_0:d impact_1:d",
    "SELECT * FROM vectors",
    *IMPACT,
    _PER_USER,
)
def impact_vector_counts(spark, sf):
    return _totals(spark, sf).select("cohort_id", "user_id", "exposures", "interactions", "impact_0", "impact_1")


@query("impact_vector_ctr", "cohort_id:i user_id:s user_ctr:d", "SELECT * FROM vectors", *IMPACT, _PER_USER)
def impact_vector_ctr(spark, sf):
    return _totals(spark, sf).select("cohort_id", "user_id", "user_ctr")


@query(
    "impact_vector_daily_avg",
    "cohort_id:i user_id:s user_daily_interactions:d user_daily_revenue:d revenue:d",
    "SELECT * FROM vectors",
    *IMPACT,
    _PER_USER,
)
def impact_vector_daily_avg(spark, sf):
    return _totals(spark, sf).select("cohort_id", "user_id", "user_daily_interactions", "user_daily_revenue", "revenue")


@query(
    "impact_sample",
    "cohort_id:i user_id:s interactions:d",
    """SELECT cohort_id, user_id, interactions FROM (
       SELECT *, ROW_NUMBER() OVER (PARTITION BY cohort_id ORDER BY md5(user_id || '42'), user_id) AS rn FROM vectors) WHERE rn <= 40""",
    *IMPACT,
    _PER_USER,
)
def impact_sample(spark, sf):
    values = _totals(spark, sf).select("cohort_id", "user_id", "interactions")
    return impact.sample_users(values, 40)
