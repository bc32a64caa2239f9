"""Power-law fit of a metric curve and its projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The exponent range, the search rounds and their grid, and the
# width of the projected band.
MIN_B, MAX_B = 0.01, 1.5
ROUNDS, STEPS = 7, 64
Z_BAND = 1.96
BAND_GROWTH = 10
MIN_POINTS = 2


def _power(day: Column, exponent: Column) -> Column:
    return F.when(day > 0, F.pow(day, exponent)).otherwise(0.0)


# One search round as SQL text, so a round is a single expression to build. Each
# candidate exponent gets its best non-negative scale in closed form and its
# squared error; only a strictly smaller error replaces the best so far, in grid
# order.
_ROUND = """
aggregate(
  transform(
    transform(sequence(0, {last}), i -> _low + (_high - _low) * (i / {last}.0D)),
    b -> transform(
      array(aggregate(
        _points,
        named_struct('vp', 0.0D, 'pp', 0.0D),
        (s, p) -> named_struct(
          'vp', s.vp + p.value * if(p.day > 0, pow(p.day, b), 0.0D),
          'pp', s.pp + if(p.day > 0, pow(p.day, b) * pow(p.day, b), 0.0D)
        ),
        s -> if(s.pp > 0, greatest(0.0D, s.vp / s.pp), 0.0D)
      )),
      a -> named_struct(
        'sse', aggregate(_points, 0.0D, (t, p) -> t + pow(p.value - a * if(p.day > 0, pow(p.day, b), 0.0D), 2)),
        'b', b,
        'a', a
      )
    )[0]
  ),
  _best,
  (best, new) -> if(best IS NULL OR new.sse < best.sse, new, best)
)
"""


def fit_report(curves: DataFrame, value: str, day: str = "bucket", key: str = "cohort_id") -> DataFrame:
    """:func:`fit_power_law` with a row for every key of ``curves``: those with fewer than two usable points have
    NULLs, the number of ``points`` they do have, and ``fitted`` false."""
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(day) >= 0)
    held = curves.groupBy(key).agg(F.count_if(usable).alias("_points"))
    fitted = fit_power_law(curves, value, day, key).withColumn("_fitted", F.lit(True))
    joined = held.join(fitted, key, "left")
    return joined.withColumn("points", F.col("_points")).withColumn("fitted", F.coalesce("_fitted", F.lit(False))).drop("_points", "_fitted")


def fit_power_law(curves: DataFrame, value: str, day: str = "bucket", key: str = "cohort_id") -> DataFrame:
    """``(key, a, b, residual_variance, points, last_day)`` minimising squared error.

    A curve has one point per bucket, so its points fit in an array and the whole
    search is a projection over one row per cohort: seven rounds, each narrowing
    the exponent range around the best of 64 candidates.
    """
    packed = (
        curves.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(day) >= 0))
        .groupBy(key)
        .agg(
            F.array_sort(
                F.collect_list(F.struct(F.col(day).cast("double").alias("day"), F.col(value).cast("double").alias("value")))
            ).alias("_points")
        )
        .where(F.size("_points") >= MIN_POINTS)
        .withColumn("_low", F.lit(MIN_B))
        .withColumn("_high", F.lit(MAX_B))
        .withColumn("_best", F.lit(None).cast("struct<sse:double,b:double,a:double>"))
    )
    for _ in range(ROUNDS):
        packed = packed.withColumn("_best", F.expr(_ROUND.format(last=STEPS - 1)))
        margin = (F.col("_high") - F.col("_low")) / 4

        def clamped(bound: Column) -> Column:
            return F.least(F.lit(MAX_B), F.greatest(F.lit(MIN_B), bound))

        packed = packed.withColumns(
            {"_low": clamped(F.col("_best.b") - margin), "_high": clamped(F.col("_best.b") + margin)}
        )
    count = F.size("_points")
    return packed.select(
        key,
        F.col("_best.a").alias("a"),
        F.col("_best.b").alias("b"),
        F.when(count > 2, F.col("_best.sse") / (count - 2)).otherwise(0.0).alias("residual_variance"),
        count.alias("points"),
        F.element_at("_points", -1)["day"].cast("int").alias("last_day"),
    )


def project(fit: DataFrame, horizon: int, last_day: int | None = None) -> DataFrame:
    """``(…, day, projected, lower, upper)`` for the days after the last observed one.

    That is each curve's own, or ``last_day`` for all of them, such as the last day of a table of several curves.
    """
    if last_day is not None:
        fit = fit.withColumn("last_day", F.lit(last_day))
    day = F.col("day").cast("double")
    exponent = F.least(F.lit(MAX_B), F.greatest(F.lit(MIN_B), F.col("b")))
    curve = F.col("a") * _power(day, exponent)
    band = F.lit(Z_BAND) * F.sqrt(F.greatest(F.lit(0.0), F.col("residual_variance")))
    band = band * F.sqrt(F.lit(1.0) + (day - F.col("last_day")) / F.lit(float(BAND_GROWTH)))
    days = F.sequence(F.col("last_day") + 1, F.lit(horizon))
    return (
        fit.where(F.col("last_day") < horizon)
        .withColumn("day", F.explode(days))
        .withColumn("projected", curve)
        .withColumn("lower", F.greatest(F.lit(0.0), F.col("projected") - band))
        .withColumn("upper", F.col("projected") + band)
    )


def reproject(fit: DataFrame, a: float, b: float, horizon: int) -> DataFrame:
    """The projection with a hand-chosen scale and exponent."""
    return project(fit.withColumn("a", F.lit(float(a))).withColumn("b", F.lit(float(b))), horizon)
