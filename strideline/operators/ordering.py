"""Order statistics that never put an unbounded sorted group into one task.

Values are cut into two coarser levels by monotone functions (day and second for
times, binary exponent and leading mantissa bits for doubles). Counts are combined
map-side, and every running sum works inside one coarse cell:

* over the coarse cells of a key (calendar days, or a few thousand exponents),
* over the finer cells of one coarse cell (86,400 seconds, or 65,536 mantissas),
* over the distinct values of one fine cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.times import DAY_MICROS, MICROS, micros
from strideline.operators.prefix import crossing, slice_of
from strideline.operators.skew import row_salt

# Fixed values. The first is the largest rank Spark limits before the shuffle.
GROUP_LIMIT = 1_000
TOP_SALTS = 16
RANK_DECIMALS = 6
HASH_DIGITS = 3
MANTISSA_CELLS = 65_536


def _time_levels(value: Column) -> tuple[Column, Column]:
    """For long microseconds."""
    return F.floor(value / F.lit(DAY_MICROS)).cast("long"), F.floor(value / F.lit(MICROS)).cast("long")


def _double_levels(value: Column) -> tuple[Column, Column]:
    """For doubles; both levels grow with the value."""
    exponent = F.floor(F.log2(F.abs(value)))
    sign = F.signum(value)
    coarse = F.when(value == 0, F.lit(0)).otherwise(sign * (exponent + 1_100)).cast("long")
    scaled = value * F.pow(F.lit(2.0), -exponent) * F.lit(MANTISSA_CELLS)
    fine = F.when(value == 0, F.lit(0)).otherwise(F.floor(scaled)).cast("long")
    return coarse, fine


_LEVELS = {"micros": _time_levels, "double": _double_levels}


def _running(partition: Sequence[str], order: str, value: str) -> Column:
    window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(value).over(window)


def exact_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Sequence[float],
    kind: str = "double",
    collapse: bool = True,
) -> DataFrame:
    """``(keys, fraction, quantile)`` with linear interpolation, exactly.

    ``collapse`` first counts equal values, which pays when ``rows`` is costly;
    without it only the coarse counts are shuffled and ``rows`` is read twice.
    NULL values are ignored; a key with no values gives no row.
    """
    group = list(keys) or ["_all"]
    source = rows if keys else rows.withColumn("_all", F.lit(0))
    coarse, fine = _LEVELS[kind](F.col("_v"))
    values = (
        source.where(F.col(value).isNotNull())
        .select(*group, F.col(value).alias("_v"))
        .withColumn("_n", F.lit(1).cast("long"))
    )
    if collapse:
        values = values.groupBy(*group, "_v").agg(F.sum("_n").alias("_n"))
    values = values.withColumn("_c", coarse).withColumn("_f", fine)

    fine_counts = values.groupBy(*group, "_c", "_f").agg(F.sum("_n").alias("_n"))
    coarse_counts = fine_counts.groupBy(*group, "_c").agg(F.sum("_n").alias("_n"))
    located = coarse_counts.withColumn("_upto", _running(group, "_c", "_n")).withColumn(
        "_total", F.sum("_n").over(Window.partitionBy(*group))
    )

    # Each fraction needs the order statistics on both sides of its position.
    targets = []
    for index, fraction in enumerate(fractions):
        position = F.lit(float(fraction)) * (F.col("_total") - 1)
        low = F.floor(position).cast("long")
        high = F.ceil(position).cast("long")
        weight = position - low
        targets.append(F.struct(F.lit(index).alias("q"), F.lit(0).alias("side"), low.alias("rank"), weight.alias("w")))
        targets.append(F.struct(F.lit(index).alias("q"), F.lit(1).alias("side"), high.alias("rank"), weight.alias("w")))
    before = F.col("_upto") - F.col("_n")
    level_one = (
        located.withColumn("_t", F.explode(F.array(*targets)))
        .where((F.col("_t.rank") >= before) & (F.col("_t.rank") < F.col("_upto")))
        .select(*group, "_c", "_t.q", "_t.side", "_t.w", (F.col("_t.rank") - before).alias("_rank"))
    )
    target = [*group, "q", "side"]
    level_two = (
        fine_counts.join(level_one, [*group, "_c"])
        .withColumn("_upto", _running(target, "_f", "_n"))
        .where((F.col("_rank") >= before) & (F.col("_rank") < F.col("_upto")))
        .select(*group, "_c", "_f", "q", "side", "w", (F.col("_rank") - before).alias("_rank"))
    )
    level_three = (
        values.join(level_two, [*group, "_c", "_f"])
        .groupBy(*target, "_v")
        .agg(F.sum("_n").alias("_n"), F.first("_rank").alias("_rank"), F.first("w").alias("w"))
        .withColumn("_upto", _running(target, "_v", "_n"))
        .where((F.col("_rank") >= before) & (F.col("_rank") < F.col("_upto")))
    )
    low_value = F.min(F.when(F.col("side") == 0, F.col("_v")))
    high_value = F.min(F.when(F.col("side") == 1, F.col("_v")))
    fraction_of = F.element_at(F.array(*[F.lit(float(f)) for f in fractions]), F.col("q") + 1)
    return (
        level_three.groupBy(*group, "q")
        .agg(low_value.alias("_low"), high_value.alias("_high"), F.first("w").alias("w"))
        .select(
            *keys,
            fraction_of.alias("fraction"),
            (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("w")).alias("quantile"),
        )
    )


def quantile_instant(rows: DataFrame, time: str, fraction: float) -> datetime | None:
    """The interpolated quantile of a timestamp column, computed now.

    Three counts over ever narrower literal time ranges: days of everything, seconds
    of the day found, instants of the second found. Only the first reads the whole
    column; the ranges of the others are pushed into the scan. Each count returns at
    most two rows.
    """
    found: dict[int, tuple[int, int]] | None = None  # side -> (cell start, rank in cell)
    weight = 0.0
    width_above = None
    for width in (DAY_MICROS, MICROS, 1):
        cell = (F.floor(micros(F.col(time)) / F.lit(width)) * F.lit(width)).cast("long")
        part = rows.where(F.col(time).isNotNull())
        if found is not None:
            ranges = [
                (F.col(time) >= _instant(start)) & (F.col(time) < _instant(start + width_above))
                for start in {start for start, _ in found.values()}
            ]
            part = part.where(ranges[0] if len(ranges) == 1 else ranges[0] | ranges[1])
        counts = part.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
        if found is None:
            # One row per calendar day, so a single ordered window is small.
            ordered = counts.withColumn("_all", F.lit(0)).withColumn("_upto", _running(["_all"], "_cell", "_n"))
            ordered = ordered.withColumn("_total", F.sum("_n").over(Window.partitionBy("_all")))
            position = F.lit(fraction) * (F.col("_total") - 1)
            sides = F.array(
                F.struct(F.lit(0).alias("side"), F.floor(position).cast("long").alias("rank")),
                F.struct(F.lit(1).alias("side"), F.ceil(position).cast("long").alias("rank")),
            )
            hits = ordered.select("_cell", "_n", "_upto", (position - F.floor(position)).alias("_w"), F.explode(sides).alias("_t"))
        else:
            above = (F.floor(F.col("_cell") / F.lit(width_above)) * F.lit(width_above)).cast("long")
            ordered = counts.withColumn("_above", above).withColumn("_upto", _running(["_above"], "_cell", "_n"))
            sides = F.array(
                *[
                    F.struct(F.lit(side).alias("side"), F.lit(rank).alias("rank"), F.lit(start).alias("start"))
                    for side, (start, rank) in found.items()
                ]
            )
            hits = ordered.select("*", F.lit(weight).alias("_w"), F.explode(sides).alias("_t")).where(
                F.col("_above") == F.col("_t.start")
            )
        before = F.col("_upto") - F.col("_n")
        picked = (
            hits.where((F.col("_t.rank") >= before) & (F.col("_t.rank") < F.col("_upto")))
            .select("_t.side", "_cell", (F.col("_t.rank") - before).alias("_rank"), "_w")
            .collect()
        )
        if not picked:
            return None
        found = {row["side"]: (row["_cell"], row["_rank"]) for row in picked}
        weight, width_above = float(picked[0]["_w"]), width
    low, high = found[0][0], found[1][0]
    return datetime(1970, 1, 1) + timedelta(microseconds=int(low + (high - low) * weight))


def _instant(value: int) -> Column:
    moment = datetime(1970, 1, 1) + timedelta(microseconds=value)
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def quantile_columns(
    rows: DataFrame, keys: Sequence[str], value: str, named: dict[str, float], kind: str = "double"
) -> DataFrame:
    """One row per key with a column for each named fraction, exactly, located level by level."""
    long_form = exact_quantiles(rows, keys, value, list(named.values()), kind)
    picks = [F.max(F.when(F.col("fraction") == F.lit(float(f)), F.col("quantile"))).alias(name) for name, f in named.items()]
    return long_form.groupBy(*keys).agg(*picks)


def quantile_seconds(rows: DataFrame, keys: Sequence[str], seconds: str, named: dict[str, float]) -> DataFrame:
    """The same of elapsed seconds, in whole microseconds, halves up: interpolated doubles of seconds
    could land on either side of their last digit."""
    whole = rows.withColumn("_us", F.round(F.col(seconds) * F.lit(float(MICROS))).cast("long"))
    found = quantile_columns(whole, keys, "_us", named, "micros")
    return found.select(*keys, *[(F.floor(F.col(name) + F.lit(0.5)) / F.lit(float(MICROS))).alias(name) for name in named])


def rank_sums(rows: DataFrame, keys: Sequence[str], side: str, value: str) -> DataFrame:
    """Per key: sizes of both sides, sum of average ranks of side A, tie term.

    ``side`` is a boolean column, true for A. Only the distinct values are ordered;
    the number of values below each one is added up level by level, so no window
    spans a whole key. Values are ranked at six decimals: floating sums depend on the
    order of addition, and equal amounts must tie on every run.
    """
    group = list(keys)
    coarse, fine = _double_levels(F.col("_v"))
    weight = F.lit(1).cast("double")
    level = (
        rows.where(F.col(value).isNotNull())
        .select(*group, F.col(side).alias("_side"), F.round(F.col(value).cast("double"), RANK_DECIMALS).alias("_v"))
        .groupBy(*group, "_v")
        .agg(F.sum(F.when(F.col("_side"), weight).otherwise(0.0)).alias("_a"), F.sum(weight).alias("_c"))
        .withColumn("_l1", coarse)
        .withColumn("_l2", fine)
        .withColumn("_s", F.col("_a") * (F.col("_c") + 1) / 2)
        .withColumn("_ties", F.pow("_c", F.lit(3)) - F.col("_c"))
    )
    steps = [([*group, "_l1", "_l2"], "_v"), ([*group, "_l1"], "_l2"), (group, "_l1")]
    for cells, order in steps:
        below = _running(cells, order, "_c") - F.col("_c")
        level = (
            level.withColumn("_s", F.col("_s") + F.col("_a") * below)
            .groupBy(*cells)
            .agg(*[F.sum(name).alias(name) for name in ("_a", "_c", "_s", "_ties")])
        )
    return level.select(
        *group,
        F.col("_a").alias("n_a"),
        (F.col("_c") - F.col("_a")).alias("n_b"),
        F.col("_s").alias("rank_sum_a"),
        F.col("_ties").alias("tie_term"),
    )


def first_per_key(rows: DataFrame, keys: Sequence[str], time: str, then: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key by ``time, *then``, with position ``_pos`` from 1.

    Two ranked passes: the salted one lets every task drop all but ``limit`` rows
    per key and salt before the shuffle, so the second sees at most
    ``limit * TOP_SALTS`` rows of a key. Beyond the rank Spark can limit early, positions
    come from running sums over ranges.
    """
    order = [time, *then]
    if limit > GROUP_LIMIT:
        return slice_of(rows, keys, order, 1, limit)
    salted = rows.withColumn("_salt", row_salt(TOP_SALTS, *order))
    near = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_pos", F.row_number().over(near))
        .where(F.col("_pos") <= limit)
        .drop("_salt", "_pos")
        .withColumn("_pos", F.row_number().over(whole))
        .where(F.col("_pos") <= limit)
    )


def crossing_time(rows: DataFrame, keys: Sequence[str], time: str, weight: str, need: str) -> DataFrame:
    """Per key, the first time at which the running sum of ``weight`` reaches ``need``, at any depth
    and however many rows fall on one day. Weights must not be negative."""
    return crossing(rows, keys, time, weight, need)


def hash_ranked(rows: DataFrame, keys: Sequence[str], identity: str, seed: str, limit: int | None = None) -> DataFrame:
    """Add ``_rank`` from 0 in the order of a seeded hash, and the key's ``_total``.

    The rank is the number of rows in lower hash cells plus the place inside the own
    cell. Cells are the first hex digits of the hash, so they are uniform and no
    window holds more than about 1/4096 of a key. With ``limit`` only the cells that
    can hold lower ranks are ordered.
    """
    hashed = rows.withColumn("_hash", F.md5(F.concat(F.col(identity), F.lit(seed))))
    keyed = hashed.withColumn("_cell", F.substring("_hash", 1, HASH_DIGITS))
    cells = keyed.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    offsets = cells.select(
        *keys,
        "_cell",
        (_running(keys, "_cell", "_n") - F.col("_n")).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    if limit is not None:
        offsets = offsets.where(F.col("_offset") < limit)
    joined = keyed.join(offsets, [*keys, "_cell"])
    place = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("_hash", identity)) - 1
    ranked = joined.withColumn("_rank", F.col("_offset") + place).drop("_hash", "_cell", "_offset")
    return ranked if limit is None else ranked.where(F.col("_rank") < limit)
