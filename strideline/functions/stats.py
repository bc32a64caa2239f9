"""Statistics as Column arithmetic on aggregated rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Z by confidence level.
Z_BY_CONFIDENCE = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}

# The five-term polynomial for the normal tail (Abramowitz and Stegun 26.2.17).
_POLY_T = 0.2316419
_POLY = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def _num(column: Column) -> Column:
    return column.cast("double")


def exact_sum(amount: Column) -> Column:
    """Sum of doubles as decimals of ten places, so that the order of addition doesn't matter.

    Amounts that no such decimal holds (NaN, infinities, 1e18 and more) are added as doubles.
    """
    exact = amount.try_cast("decimal(28,10)")
    rest = F.sum(F.when(exact.isNull(), amount))
    return F.coalesce(F.sum(exact).cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))


def upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_POLY_T) * z)
    series = F.lit(0.0)
    for coefficient in reversed(_POLY):
        series = t * (F.lit(coefficient) + series)
    return F.exp(F.lit(-0.5) * z * z) * F.lit(1.0 / math.sqrt(2 * math.pi)) * series


def normal_cdf(z: Column) -> Column:
    tail = upper_tail(F.abs(z))
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)


def two_sided(z: Column) -> Column:
    return F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z)))


def wilson_bounds(successes: Column, trials: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval, clamped to [0, 1]; NULL without trials."""
    z = Z_BY_CONFIDENCE[confidence]
    n = _num(trials)
    p = _num(successes) / n
    z2 = z * z
    denominator = F.lit(1.0) + F.lit(z2) / n
    centre = p + F.lit(z2) / (F.lit(2.0) * n)
    spread = F.lit(z) * F.sqrt((p * (F.lit(1.0) - p) + F.lit(z2) / (F.lit(4.0) * n)) / n)
    some = n > 0
    low = F.when(some, F.greatest(F.lit(0.0), (centre - spread) / denominator))
    high = F.when(some, F.least(F.lit(1.0), (centre + spread) / denominator))
    return low, high


def two_proportion_p(x_a: Column, n_a: Column, x_b: Column, n_b: Column) -> Column:
    """Two-sided z-test with pooled variance; 1 when it is degenerate."""
    xa, na, xb, nb = _num(x_a), _num(n_a), _num(x_b), _num(n_b)
    possible = (na > 0) & (nb > 0)
    pooled = F.when(possible, (xa + xb) / (na + nb))
    variance = pooled * (F.lit(1.0) - pooled) * F.when(possible, F.lit(1.0) / na + F.lit(1.0) / nb)
    z = F.when(variance > 0, (xa / na - xb / nb) / F.sqrt(F.when(variance > 0, variance)))
    return F.coalesce(two_sided(z), F.lit(1.0))


def mann_whitney_p(
    n_a: Column, n_b: Column, rank_sum_a: Column, tie_term: Column, tie_correction: bool = False, continuity: bool = False
) -> Column:
    """Two-sided normal approximation from a rank sum; 1 when degenerate."""
    na, nb = _num(n_a), _num(n_b)
    n = na + nb
    u_a = rank_sum_a - na * (na + 1) / 2
    u = F.least(u_a, na * nb - u_a)
    variance = na * nb * (n + 1) / 12
    if tie_correction:
        variance = na * nb / 12 * (n + 1 - F.when(n > 1, tie_term / (n * F.greatest(n - 1, F.lit(1.0)))).otherwise(0.0))
    distance = na * nb / 2 - u
    if continuity:
        distance = F.greatest(F.lit(0.0), distance - 0.5)
    z = F.when(variance > 0, distance / F.sqrt(F.when(variance > 0, variance)))
    return F.coalesce(two_sided(z), F.lit(1.0))


def welch_statistic(n_a: Column, mean_a: Column, var_a: Column, n_b: Column, mean_b: Column, var_b: Column) -> tuple[Column, Column]:
    """t and the Welch-Satterthwaite degrees of freedom; NULL when undefined."""
    na, nb = _num(n_a), _num(n_b)
    ok = (na > 1) & (nb > 1)
    part_a = F.when(ok, var_a / na)
    part_b = F.when(ok, var_b / nb)
    error = part_a + part_b
    t = F.when(error > 0, (mean_a - mean_b) / F.sqrt(F.when(error > 0, error)))
    below = part_a * part_a / F.when(ok, na - 1) + part_b * part_b / F.when(ok, nb - 1)
    df = F.when(below > 0, error * error / F.when(below > 0, below))
    return t, df


_SIMPSON_STEPS = 2_000
#: In units of 1 / sqrt(df); what the density holds beyond is below the smallest double.
_REACH = 40.0


def _cosine_power_integral(start: Column, end: Column, power: Column) -> Column:
    """Integral of cos(x) ** power from ``start`` to ``end`` by Simpson's rule."""
    step = (end - start) / F.lit(float(_SIMPSON_STEPS))

    def term(total: Column, i: Column) -> Column:
        weight = F.when((i == 0) | (i == _SIMPSON_STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        height = F.pow(F.greatest(F.lit(0.0), F.cos(start + i * step)), power)
        return total + weight * height

    points = F.sequence(F.lit(0), F.lit(_SIMPSON_STEPS))
    return F.aggregate(points, F.lit(0.0), term) * step / F.lit(3.0)


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) at any degrees of freedom, by integration.

    With ``t = sqrt(df) * tan(x)`` the density becomes cos(x) ** (df - 1), so the
    tail is a ratio of two smooth integrals and needs no gamma function. Meant for
    the single aggregated row of a comparison.
    """
    power = F.greatest(F.lit(0.0), df - 1)
    end = F.least(F.lit(math.pi / 2), F.lit(_REACH) / F.sqrt(df))
    angle = F.least(F.atan(F.abs(t) / F.sqrt(df)), end)
    return _cosine_power_integral(angle, end, power) / _cosine_power_integral(F.lit(0.0), end, power)


def welch_p(n_a: Column, mean_a: Column, var_a: Column, n_b: Column, mean_b: Column, var_b: Column) -> Column:
    t, df = welch_statistic(n_a, mean_a, var_a, n_b, mean_b, var_b)
    return F.coalesce(F.when(t.isNotNull(), student_two_sided(t, F.coalesce(df, F.lit(1.0)))), F.lit(1.0))
