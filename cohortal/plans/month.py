"""The monthly run: from filings and listings to ranks, what changed since last month, and whether to trust it.

Facts become measures, listings become segments and peer groups, banks get their gap between price and return, and every
segment is scored at once. Against last month's record come changes, exits with their reasons, lost measures and the drift
report. Each result is a table; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.functions.spec import OFFICIAL_WEIGHTS, Registry, Settings
from cohortal.operators import classify, eligibility
from cohortal.plans import intake, panel, score
from cohortal.plans import measures as m
from cohortal.plans.stage import materialised, written


def classified(wide: DataFrame, listings: DataFrame) -> DataFrame:
    """``wide`` measures with name, sector, industry, segment and peer of each listing."""
    both = listings.select("entity", "name", "sector", "industry").join(wide, "entity")
    lends = (F.col("nii_assets"), F.when(F.col("nii_assets").isNotNull(), F.lit(1.0)), F.col("is_fund"))
    told = both.withColumn("segment", classify.segment(F.col("sector"), F.col("industry"), F.col("revenue_ttm"), *lends))
    return told.withColumn("peer", classify.peer_group(F.col("segment"), F.col("sector"), F.col("industry"), F.col("market_cap")))


def with_gap(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ptbv_gap`` of banks: how much cheaper than their return on tangible equity justifies, among their peers."""
    banks = score.regression_gap(rows.where("segment = 'banks'"), ["peer"], "rotce", "tbv_yield")
    rest = rows.where("segment <> 'banks'").withColumn("gap", F.lit(None).cast("double"))
    return banks.unionByName(rest).withColumnRenamed("gap", "ptbv_gap")


def graded(facts: DataFrame, listings: DataFrame, as_of: str, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(wide, grid): the measures of ``listings`` as of a day, and their percentiles inside segment and cohort."""
    # Read by the gap, the measures, their reasons and the rows that are scored.
    wide = with_gap(materialised(classified(m.measures(facts, listings, as_of, settings), listings)))
    long = m.long_measures(wide)
    rows = wide.select("entity", "segment", "peer", "market_cap")
    grid = written(score.percentile_grid(rows, long, Registry().table(facts.sparkSession), settings))
    return wide, grid


def run_month(
    facts: DataFrame,
    listings: DataFrame,
    as_of: str,
    prior: DataFrame | None = None,
    prior_grid: DataFrame | None = None,
    left: list[tuple[str, DataFrame]] = (),
    abandoned: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    settings: Settings = Settings(),  # noqa: B008
) -> dict[str, DataFrame]:
    """Tables by name: scored (with ranks, deciles and, given ``prior``, changes), insufficient, grid, stability, exits, lost, abandoned, notes, inputs and drift.

    ``listings``: entity, name, sector, industry, market_cap. ``prior``: last month's entity, name, sector, segment,
    composite, rank; ``prior_grid`` its entity, metric, pct. ``left``: (kind, (entity, reason)) of those that a rule before
    the scoring took out, in order of precedence; who has too few measures follows ``excluded``. ``abandoned``: (entity,
    concept, last_reported); by default the tags that the freshness rule rejects and that were in use lately.
    """
    wide, grid = graded(facts, listings, as_of, settings)
    long = m.long_measures(wide)
    enough, short = score.coverage_gate(score.factor_scores(grid), settings.coverage)
    scored = materialised(score.ranked_scores(enough, weights or OFFICIAL_WEIGHTS).join(wide.select("entity", "name", "sector"), "entity"))
    named = short.join(wide.select("entity", "name", "sector"), "entity")
    out = {"grid": grid.join(long.select("entity", "metric", "reason"), ["entity", "metric"], "left"), "insufficient": named, "stability": score.rank_stability(scored, settings.sweep)}
    out["notes"], out["inputs"] = m.note_rows(wide), wide.select("entity", "raw_inputs.*")
    none = scored.limit(0)
    before = none if prior is None else prior
    out["scored"] = panel.with_deltas(scored, before)
    ruled = dict(left)
    ruled["insufficient_data"] = named.select("entity", "reason")
    sources = [(kind, ruled[kind]) for kind in panel.EXIT_KINDS if kind in ruled]
    out["exits"] = panel.exits(before, scored, sources)
    lost = none.select("entity", F.lit("").alias("metric"), F.lit("").alias("reason"), F.lit(False).alias("economic"))
    out["lost"] = lost if prior_grid is None else panel.lost_since(scored, out["grid"], before, prior_grid)
    tags = eligibility.recently_abandoned(m.ignored_tags(wide), as_of, settings.drift_horizon)
    out["abandoned"] = tags if abandoned is None else abandoned
    out["drift"] = panel.drift_report(scored, prior, out["lost"], out["exits"], out["abandoned"], settings)
    return out


def run_from_listings(
    facts: DataFrame,
    listings: DataFrame,
    ids: DataFrame,
    prices: DataFrame,
    as_of: str,
    prior: DataFrame,
    newer: DataFrame | None = None,
    prior_grid: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    settings: Settings = Settings(),  # noqa: B008
) -> dict[str, DataFrame]:
    """A month from listings on: the tables of ``run_month``, and staged, funnel, excluded and carried.

    Inputs as for ``intake.staged`` and ``intake.filers``; ``prior`` is last month's record with its listings. The notes tell of
    carried reports as well.
    """
    rows = materialised(intake.staged(listings, ids, intake.filers(facts, as_of, newer), prices, prior, as_of, settings))
    chosen = rows.where("stage is null")
    # Facts of filers that are not scored go before anything is shuffled by what they say.
    own = facts.join(chosen.select("entity"), "entity", "left_semi")
    out = run_month(own, chosen, as_of, prior, prior_grid, intake.exits_of(rows, prior), weights=weights, settings=settings)
    carried = chosen.where("carried")
    late = F.struct(F.lit("report").alias("metric"), F.lit("carried").alias("kind"), F.col("newer.form").alias("tag"), F.col("latest").alias("end"), F.lit(None).cast("double").alias("amount"))
    out["notes"] = out["notes"].unionByName(carried.select("entity", late.alias("n")).select("entity", "n.*"))
    excluded = rows.where("stage is not null").select("listing", "entity", "stage", "reason")
    return out | {"staged": rows, "funnel": intake.funnel(rows), "excluded": excluded, "carried": carried.select("listing", "entity", "latest", "newer")}
