"""Exact percentiles and ranks of cohorts that are too large for one task.

A window puts a cohort's rows into one task. Here the distinct values of all cohorts
are range-partitioned instead, counted within each partition, and shifted by the
totals of the partitions before: no task holds more than its range, whatever the
size of a cohort, and nothing is approximate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortal.functions import stats
from cohortal.plans.stage import materialised


def ranked(rows: DataFrame, by: list[str], slice_of: Column, order: list[Column], name: str, size: str | None = None) -> DataFrame:
    """``rows`` with ``name``, consecutive ranks from 1 inside ``by``, and optionally each group's ``size``.

    ``slice_of`` falls, or stays, as ``order`` goes on. Only slices are sorted, each in a task of its own; what stands before a
    slice is a sum over the sizes of the others, a table as small as there are slices. A plain window would sort whole groups.
    """
    sliced = rows.withColumn("_slice", slice_of)
    sizes = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    totals = {"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_size": F.sum("_n").over(Window.partitionBy(*by))}
    shifts = sizes.withColumns(totals).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_slice").alias("_s"), "_before", "_size")
    on = F.col("_slice") == F.col("_s")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*order))
    out = sliced.withColumn("_place", place).join(shifts, on).withColumn(name, (F.col("_before") + F.col("_place")).cast("long"))
    return out.select(*(c for c in rows.columns if c not in (name, size)), name, *([F.col("_size").alias(size)] if size else []))


def by_cuts(rows: DataFrame, by: list[str], value: str, cuts: int = 64) -> tuple[DataFrame, Column]:
    """``rows`` with the approximate quantiles of each group, and the slice of each row: higher values in higher slices, nulls lowest."""
    at = F.percentile_approx(value, [k / cuts for k in range(1, cuts)], 20 * cuts).alias("_cuts")
    # Written once: an approximate quantile depends on the order of the merges, and sizes and places must be told by the same slices.
    known = materialised(rows.groupBy(*by).agg(at))
    return rows.join(known, by), F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(value))), F.lit(-1))


def value_positions(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, equal, below, n): of each distinct value, how many rows have it, how many less, and the cohort's size."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("equal"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once, so that a value's partition is the same wherever it is read.
    placed = materialised(counts.repartitionByRange(n, *by, value).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part", *by).agg(F.sum("equal").alias("_total"))  # at most one row a partition and cohort
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_part", *by, F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_shift"), F.sum("_total").over(Window.partitionBy(*by)).alias("n"))
    local = placed.withColumn("_local", F.coalesce(F.sum("equal").over(inside), F.lit(0)))
    return local.join(shifts, ["_part", *by]).select(*by, value, "equal", (F.col("_local") + F.col("_shift")).alias("below"), "n")


def interpolated_bounds(positions: DataFrame, by: list[str], value: str, lo: float, hi: float) -> DataFrame:
    """(by, n, lo, hi): linearly interpolated percentiles, exact, from the positions."""

    def at(q: float) -> Column:
        place = (F.col("n") - 1) * (q / 100)
        holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("equal"))
        low, high = F.max(F.when(holds(F.floor(place)), F.col(value))), F.max(F.when(holds(F.ceil(place)), F.col(value)))
        return low + (high - low) * F.max(place - F.floor(place))

    return positions.groupBy(*by).agg(F.max("n").alias("n"), at(lo).alias("lo"), at(hi).alias("hi"))


def percentiles_at_scale(grid: DataFrame, winsor: tuple[float, float] = (5.0, 95.0)) -> DataFrame:
    """What ``score.percentiles`` gives, without a window over a cohort."""
    by = ["segment", "cohort", "metric"]
    bounds = interpolated_bounds(value_positions(grid, by, "raw"), by, "raw", *winsor)
    clipped = F.least(F.greatest("raw", "lo"), F.col("hi"))
    wide = grid.join(bounds, by, "left")
    wide = wide.withColumn("win", F.when(F.col("raw").isNull(), None).when(F.col("n") < 3, F.col("raw")).otherwise(clipped)).drop("n", "lo", "hi")
    met = wide.join(value_positions(wide, by, "win"), [*by, "win"], "left")
    share = (F.col("below") + (F.col("equal") - 1) / F.lit(2.0)) / F.greatest(F.col("n") - 1, F.lit(1))
    placed = F.lit(100.0) * F.when(F.col("higher_better"), share).otherwise(1 - share)
    pct = F.when(F.col("win").isNull(), None).when(F.col("n") == 1, F.lit(50.0)).otherwise(placed)
    return met.withColumn("pct", stats.half_up(pct, 1)).drop("equal", "below", "n")
