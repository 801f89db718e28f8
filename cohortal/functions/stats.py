"""Statistics inside cohorts, as columns over windows or as aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortal.functions.scalars import _col


def half_up(c: Column | str, digits: int) -> Column:
    """Rounded half up after the noise of summing in another order is taken off, so that results do not depend on the plan."""
    return F.round(F.round(_col(c), digits + 4), digits)


def interpolated(c: Column | str, q: float) -> Column:
    """The linearly interpolated percentile, q in 0..100, as an aggregate."""
    return F.percentile(_col(c), q / 100)


def winsorized(c: Column | str, by: list[str], lo: float = 5, hi: float = 95) -> Column:
    """Clip to the cohort's percentiles; cohorts of fewer than 3 values stay as they are."""
    c, w = _col(c), Window.partitionBy(*by)
    clipped = F.least(F.greatest(c, F.percentile(c, lo / 100).over(w)), F.percentile(c, hi / 100).over(w))
    return F.when(c.isNull(), None).when(F.count(c).over(w) < 3, c).otherwise(clipped)


def tie_percentile(c: Column | str, by: list[str], higher_better: Column | bool = True, digits: int = 1) -> Column:
    """100 for the best of a cohort, 0 for the worst; equal values share their mean position; one value alone is 50."""
    c, better = _col(c), F.lit(higher_better) if isinstance(higher_better, bool) else higher_better
    n = F.count(c).over(Window.partitionBy(*by))
    below = F.rank().over(Window.partitionBy(*by).orderBy(c.asc_nulls_last())) - 1
    equal = F.count(c).over(Window.partitionBy(*by, c))
    share = (below + (equal - 1) / F.lit(2.0)) / F.greatest(n - 1, F.lit(1))
    placed = F.lit(100.0) * F.when(better, share).otherwise(1 - share)
    return half_up(F.when(c.isNull(), None).when(n == 1, F.lit(50.0)).otherwise(placed), digits)


def decile(position: Column, size: Column) -> Column:
    """1..10 from a position counted from 0; bucket sizes differ where 10 does not divide the size."""
    return F.least(F.lit(10), (F.floor(position * 10 / size) + 1)).cast("long")


def weighted_composite(values: dict[str, Column | str], weights: dict[str, float | Column], digits: int = 2) -> Column:
    """sum(v w) / sum(w) over the values that are there and have a positive weight; NULL if none."""
    w = {k: x if isinstance(x, Column) else F.lit(float(x)) for k, x in weights.items()}
    used = {k: _col(v).isNotNull() & (w[k] > 0) for k, v in values.items()}
    add = lambda f: sum((F.when(used[k], f(k)).otherwise(F.lit(0.0)) for k in values), F.lit(0.0))
    return half_up(F.try_divide(add(lambda k: _col(values[k]) * w[k]), add(lambda k: w[k])), digits)


def slope(y: Column | str, x: Column | str) -> Column:
    """The least-squares slope, as an aggregate."""
    return F.regr_slope(_col(y), _col(x))


def trend_dispersion(y: Column | str, x: Column | str) -> Column:
    """Scatter about a rising trend line, else the sample deviation; NULL under 3 points on a trend."""
    y, x = _col(y), _col(x)
    b, n = F.regr_slope(y, x), F.regr_count(y, x)
    left = F.greatest(F.regr_syy(y, x) - b * F.regr_sxy(y, x), F.lit(0.0))
    return F.when(b > 0, F.when(n > 2, F.sqrt(left / (n - 2)))).otherwise(F.stddev_samp(y))


def min_max_scaled(c: Column | str, by: list[str]) -> Column:
    """(v - min) / (max - min or 1) inside a series; NULL for series of one point."""
    c, w = _col(c), Window.partitionBy(*by)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(F.count(c).over(w) >= 2, (c - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0)))


def most_common(df, by: list[str], value: str, order: str):
    """Per group the most common non-null value; of equally common ones the first seen in ``order``."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = F.min_by(F.col(value), F.struct(-F.col("n"), F.col("seen")))
    return counted.groupBy(*by).agg(best.alias(value), F.max("n").alias("n"))
