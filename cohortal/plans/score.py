"""Scoring a month: from long measures to composites, ranks, deciles and stability.

``rows``: entity, segment, peer, market_cap (one row an entity). ``measures``:
entity, metric, raw. Everything is one plan; its shuffles are by (segment, cohort,
metric) for the percentiles and by entity for the scores. A missing value is never
filled in: weights are renormalised over what is there.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortal.functions import stats
from cohortal.functions.spec import FACTORS, OFFICIAL_WEIGHTS, RETURN_METRIC, Settings, weight_tuples
from cohortal.plans.large import percentiles_at_scale, ranked
from cohortal.plans.stage import materialised, written
from cohortal.plans.sweep import rank_ranges

POOLED = "pooled_thin"
FINANCIAL = ["banks", "insurers", "capital_markets"]
UNCLASSIFIED = "(unclassified)"


def measure_grid(rows: DataFrame, measures: DataFrame, spec: DataFrame) -> DataFrame:
    """One row for each entity and metric of its segment; raw is null where it is missing."""
    wanted = rows.join(F.broadcast(spec), (F.size("segments") == 0) | F.array_contains("segments", F.col("segment")))
    return wanted.join(measures.select("entity", "metric", "raw"), ["entity", "metric"], "left").drop("segments")


def metric_resolution(grid: DataFrame) -> DataFrame:
    """(segment, metric, n, resolved, share): how often a metric is there."""
    return grid.groupBy("segment", "metric").agg(
        F.count("*").alias("n"), F.count("raw").alias("resolved"), (F.count("raw") / F.count("*")).alias("share")
    )


def applicable(grid: DataFrame, least: float = Settings.applicability) -> DataFrame:
    """The grid without metrics that too few entities of a segment have."""
    keep = metric_resolution(grid).where(F.col("share") >= least).select("segment", "metric")
    return grid.join(keep, ["segment", "metric"], "left_semi")


def with_cohort(rows: DataFrame, min_cohort: int = Settings.min_cohort) -> DataFrame:
    """cohort and basis of each row: its peer group; those of thin groups are pooled with each other."""
    peer = F.coalesce("peer", F.lit(UNCLASSIFIED))
    sizes = rows.groupBy("segment", peer.alias("_p")).agg(F.count("*").alias("_n"))
    both = rows.withColumn("_p", peer).join(sizes, ["segment", "_p"])
    thin = F.col("_n") < min_cohort
    return both.withColumns({"cohort": F.when(thin, POOLED).otherwise(F.col("_p")), "basis": F.when(thin, "universe").when(F.col("segment").isin(FINANCIAL), "peer group").otherwise("sector")}).drop("_p", "_n")


def percentiles(grid: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The grid with winsorized values and tie-averaged percentiles (win, pct) inside (segment, cohort, metric).

    A window where every cohort has at most ``settings.window_rows`` rows, else by ranges
    of values: both exact and equal. With ``thin_fallback="segment"`` the rows of thin groups
    are placed among all of their segment, and not among each other alone.
    """
    if settings.thin_fallback == "segment":
        inner, thin = replace(settings, thin_fallback="pool"), F.col("basis") == "universe"
        among_all = percentiles(grid.withColumn("cohort", F.lit(POOLED)), inner).where(thin)
        return percentiles(grid.where(~thin), inner).unionByName(among_all)
    by = ["segment", "cohort", "metric"]
    largest = grid.groupBy(*by).agg(F.count("raw").alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) > settings.window_rows:
        return percentiles_at_scale(grid, settings.winsor)
    lo, hi = settings.winsor
    out = grid.withColumn("win", stats.winsorized("raw", by, lo, hi))
    return out.withColumn("pct", stats.tie_percentile("win", by, F.col("higher_better")))


def hurdle_gate(scored: DataFrame, hurdle: float = Settings.hurdle, returns: dict[str, str] | None = None) -> DataFrame:
    """Growth percentiles are null without a measure of return, and at most 50 where it is under the hurdle."""
    by_segment = returns or RETURN_METRIC
    name = F.coalesce(*(F.when(F.col("segment") == s, m) for s, m in by_segment.items()))
    own = F.max(F.when(F.col("metric") == name, F.col("raw"))).over(Window.partitionBy("entity"))
    gated = scored.withColumn("_return", own)
    low, cond = F.col("_return") <= hurdle, F.col("conditioned")
    pct = F.when(~cond, F.col("pct")).when(F.col("_return").isNull(), None).when(low, F.least("pct", F.lit(50.0))).otherwise(F.col("pct"))
    basis = F.when(cond & low & F.col("pct").isNotNull(), F.concat("basis", F.lit("|below-hurdle"))).otherwise(F.col("basis"))
    return gated.withColumns({"pct": pct, "basis": basis}).drop("_return")


def factor_scores(scored: DataFrame) -> DataFrame:
    """One row an entity: factor means (1 digit), resolved, applicable and coverage.

    An optional metric counts as applicable only where it is there.
    """
    there = F.col("pct").isNotNull()
    means = {f: stats.half_up(F.avg(F.when(F.col("factor") == f, F.col("pct"))), 1).alias(f) for f in FACTORS}
    total = F.count(F.when(there | ~F.col("optional"), 1))
    return scored.groupBy("entity", "segment", "peer", "market_cap").agg(
        *means.values(), F.count("pct").alias("resolved"), total.alias("applicable"), F.try_divide(F.count("pct"), total).alias("coverage")
    )


def coverage_gate(scores: DataFrame, least: float = Settings.coverage) -> tuple[DataFrame, DataFrame]:
    """(enough, insufficient): the latter with a reason."""
    enough = F.coalesce(F.col("coverage") >= least, F.lit(False))
    share = F.coalesce(F.bround(F.col("coverage") * 100).cast("int"), F.lit(0))
    reason = F.format_string(f"resolved %d of %d applicable metrics (%d%%, threshold {least * 100:.0f}%%)", F.col("resolved"), F.col("applicable"), share)
    return scores.where(enough), scores.where(~enough).withColumn("reason", reason)


def composite(weights: dict[str, float] | None = None) -> Column:
    return stats.weighted_composite({f: f for f in FACTORS}, weights or OFFICIAL_WEIGHTS)


def _placed() -> tuple[Column, list[Column]]:
    """Slices of a tenth of a point of composite, and the order inside them: composite, market cap, id; nulls last."""
    order = [F.col("composite").desc_nulls_last(), F.col("market_cap").desc_nulls_last(), F.col("entity").asc()]
    return F.coalesce(F.floor(F.col("composite") * 10), F.lit(-1)), order


def with_rank(scores: DataFrame, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Consecutive ranks by composite, nulls last; ties by market cap, then id."""
    return ranked(scores, by or ["segment"], *_placed(), name)


def with_peer_decile(scores: DataFrame) -> DataFrame:
    """peer_rank, peer_size and decile inside (segment, peer); null without a peer group."""
    both = ranked(scores, ["segment", "peer"], *_placed(), "peer_rank", "peer_size")
    known = F.col("peer").isNotNull()
    out = both.withColumns({"peer_rank": F.when(known, F.col("peer_rank")), "peer_size": F.when(known, F.col("peer_size"))})
    return out.withColumn("decile", stats.decile(F.col("peer_rank") - 1, F.col("peer_size")))


def percentile_grid(rows: DataFrame, measures: DataFrame, spec: DataFrame, settings: Settings = Settings(), returns: dict[str, str] | None = None) -> DataFrame:  # noqa: B008
    """Every entity's percentile of every applicable metric, gated.

    The grid is read twice, for the resolution of metrics and for their percentiles, so it is
    written once: the facts behind the measures are far larger than it.
    """
    grid = written(measure_grid(with_cohort(rows, settings.min_cohort), measures, spec))
    return hurdle_gate(percentiles(applicable(grid, settings.applicability), settings), settings.hurdle, returns)


def ranked_scores(enough: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Scores of those with enough measures, with composite, ranks and deciles.

    They are read several times, for the sizes of slices and for the ranks inside them, so they are written once: one row an entity.
    """
    return with_peer_decile(with_rank(materialised(enough.withColumn("composite", composite(weights)))))


def score_segments(rows: DataFrame, measures: DataFrame, spec: DataFrame, weights: dict[str, float] | None = None, settings: Settings = Settings(), returns: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(scored, insufficient), of all segments at once."""
    enough, short = coverage_gate(factor_scores(percentile_grid(rows, measures, spec, settings, returns)), settings.coverage)
    return ranked_scores(enough, weights), short


def rank_stability(scored: DataFrame, sweep: tuple[int, ...] = Settings.sweep) -> DataFrame:
    """(entity, segment, rank_min, rank_max, rank_median, stability) over every weighting of the sweep.

    A composite of 0 ranks like a missing one; ties keep the official order. The vectors are a fixed small table.
    """
    vectors = weight_tuples(sweep)
    ranges = rank_ranges(written(scored.select("entity", "segment", "rank", *FACTORS)), FACTORS, vectors)
    spread = (F.col("rank_max") - F.col("rank_min")) / F.greatest(F.col("size") - 1, F.lit(1))
    return ranges.select("entity", "segment", "rank_min", "rank_max", "rank_median", stats.half_up(1 - spread, 3).alias("stability"))


def what_if(scored: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Re-ranked under other weights, with the place in both orders; at the official ones the stored composite counts."""
    official = all(weights.get(f) == w for f, w in OFFICIAL_WEIGHTS.items())
    live = scored if official else scored.withColumn("composite", composite(weights))
    return with_rank(live, name="new_rank")


def displacement(reranked: DataFrame) -> DataFrame:
    """(segment, displaced): places whose occupant differs between the two orders."""
    return reranked.groupBy("segment").agg(F.count_if(F.col("rank") != F.col("new_rank")).alias("displaced"))


def regression_gap(rows: DataFrame, by: list[str], x: str, y: str, lo: float = -0.2, hi: float = 0.4, least: int = 8) -> DataFrame:
    """``gap``: fitted less actual log multiple, the multiple being 1 / y, regressed on clipped returns inside a cohort.

    Null where the cohort has fewer than ``least`` usable rows or no spread in x.
    """
    usable = F.col(x).isNotNull() & (F.col(y) > 0)
    rx = F.when(usable, F.least(F.greatest(F.col(x), F.lit(lo)), F.lit(hi)))
    ry = F.when(usable, -F.log(F.when(F.col(y) > 0, F.col(y))))
    fit = rows.withColumns({"_x": rx, "_y": ry})
    # Moments of a cohort are sums, so tasks combine theirs before the shuffle; one row a cohort comes back.
    lines = fit.where("_x is not null").groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(
        F.regr_slope("_y", "_x").alias("_b"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.count("*").alias("_n"), (F.max("_x") > F.min("_x")).alias("_wide")
    )
    on = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    gap = F.col("_my") + F.col("_b") * (F.col("_x") - F.col("_mx")) - F.col("_y")
    met = fit.join(lines.where((F.col("_n") >= least) & F.col("_wide")), on, "left")
    return met.select(*rows.columns, gap.alias("gap"))


def drivers_text(grid: DataFrame) -> DataFrame:
    """(entity, factor, metrics): each factor's metrics, best percentile first, missing ones last."""
    rows = F.collect_list(F.struct((-F.coalesce("pct", F.lit(-1.0))).alias("o"), F.col("metric").alias("m")))
    return grid.groupBy("entity", "factor").agg(F.array_join(F.transform(F.array_sort(rows), lambda x: x["m"]), ", ").alias("metrics"))
