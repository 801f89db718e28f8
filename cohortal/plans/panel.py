"""Month over month: deltas, exits, drift, chained prices, forward returns and summaries.

A panel is (month, entity, ...), partitioned by month. Months are compared by
their place in the record (a dense index), not by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortal.functions import stats
from cohortal.functions.spec import Settings
from cohortal.plans.large import by_cuts, ranked, value_positions
from cohortal.plans.stage import materialised

ECONOMIC = r"(?i)negative|non-?positive|zero"
#: Why an entity left, in order of precedence.
EXIT_KINDS = ["excluded", "insufficient_data", "share_class", "market_cap_floor", "no_sec_match", "unlisted"]
NO_DECILE = 30


def month_index(panel: DataFrame) -> DataFrame:
    """(month, idx), counted from 0; as long as the record has months."""
    return panel.select("month").distinct().withColumn("idx", F.row_number().over(Window.orderBy("month")).cast("long") - 1)


def with_deltas(current: DataFrame, prior: DataFrame) -> DataFrame:
    """``current`` with composite_change, rank_change (up is positive) and is_new."""
    before = prior.select("entity", F.col("composite").alias("_c"), F.col("rank").alias("_r"))
    both = current.join(before.withColumn("_was", F.lit(True)), "entity", "left")
    return both.withColumns(
        {
            "composite_change": stats.half_up(F.col("composite") - F.col("_c"), 2),
            "rank_change": F.col("_r") - F.col("rank"),
            "is_new": F.col("_was").isNull(),
        }
    ).drop("_c", "_r", "_was")


def exits(prior: DataFrame, scored_now: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(entity, name, sector, segment, rank, kind, reason): scored before and not now.

    ``sources`` are (kind, (entity, reason)) in order of precedence; who is in
    none is unlisted.
    """
    gone = prior.join(scored_now.select("entity"), "entity", "left_anti").select("entity", "name", "sector", "segment", "rank")
    names = []
    for k, (_, source) in enumerate(sources):
        one = source.groupBy("entity").agg(F.min(F.coalesce("reason", F.lit(""))).alias(f"_r{k}"))
        gone, names = gone.join(one, "entity", "left"), [*names, f"_r{k}"]
    kind = F.coalesce(*(F.when(F.col(n).isNotNull(), kind) for n, (kind, _) in zip(names, sources, strict=True)), F.lit("unlisted"))
    reason = F.coalesce(*(F.col(n) for n in names), F.lit("no longer listed"))
    return gone.withColumns({"kind": kind, "reason": reason}).drop(*names)


def exit_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("kind", F.asc_nulls_last("rank"), "entity")


def exit_places(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place`` in the order of ``exit_order``, counted by ranges of that order instead of in one task."""
    keyed = rows.withColumn("_o", F.struct("kind", F.col("rank").isNull().alias("late"), "rank", "entity"))
    return keyed.join(value_positions(keyed, [], "_o").select("_o", "below"), "_o").withColumn("place", (F.col("below") + 1).cast("long")).select(*rows.columns, "place")


def metrics_lost(now: DataFrame, before: DataFrame) -> DataFrame:
    """(entity, metric, reason, economic): measured before, in both months known, and missing now."""
    then = before.where("pct is not null").select("entity", "metric")
    gone = now.where("pct is null").join(then, ["entity", "metric"])
    return gone.select("entity", "metric", "reason", F.coalesce(F.col("reason").rlike(ECONOMIC), F.lit(False)).alias("economic"))


def lost_since(scored: DataFrame, grid: DataFrame, prior: DataFrame, prior_grid: DataFrame) -> DataFrame:
    """(entity, metric, reason, economic): of those scored in both months, what was measured then and is not now.

    A measure that is not looked at any more counts as lost.
    """
    both = scored.select("entity").join(prior.select("entity"), "entity", "left_semi")
    then = prior_grid.where("pct is not null").select("entity", "metric").join(both, "entity", "left_semi")
    met = then.join(grid.select("entity", "metric", "pct", "reason"), ["entity", "metric"], "left").where("pct is null")
    reason = F.coalesce("reason", F.lit("not looked at in this segment"))
    return met.select("entity", "metric", reason.alias("reason"), reason.rlike(ECONOMIC).alias("economic"))


def drift_report(scored: DataFrame, prior: DataFrame | None, lost: DataFrame, dropped: DataFrame, abandoned: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row: counts now and before, the change in percent, what was lost, and the status."""
    one = scored.agg(F.count("*").alias("n_now"))
    then = (prior if prior is not None else scored.limit(0)).agg(F.count("*").alias("n_before"))
    parts = [one, then]
    parts.append(lost.agg(F.count_if(~F.col("economic")).alias("n_lost"), F.count_if("economic").alias("n_economic")))
    parts.append(dropped.agg(F.count("*").alias("n_dropped")))
    parts.append(abandoned.agg(F.count("*").alias("n_abandoned")))
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(p)  # one row each
    change = F.try_divide((F.col("n_now") - F.col("n_before")) * 100.0, F.col("n_before"))
    row = row.withColumn("change_pct", F.round(change, 2))
    status = (
        F.when(F.col("n_before") == 0, "baseline")
        .when(F.col("change_pct") <= -settings.drift_block, "block")
        .when((F.col("change_pct") <= -settings.drift_warn) | (F.col("n_lost") + F.col("n_dropped") + F.col("n_abandoned") > 0), "warn")
        .otherwise("ok")
    )
    return row.withColumn("status", status)


def chain_linked(panel: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """(month, entity, price_adj): prices restated to the newest month, 4 digits.

    Going back, each price is multiplied by what the next month says this month's
    price was over what it was then. A missing month, or a link that is missing or
    not positive, leaves everything older missing. ``latest`` (entity, price,
    prior_price) replaces the newest month's rows.
    """
    idx = month_index(panel)
    rows = panel.join(F.broadcast(idx), "month").select("month", "idx", "entity", "price", "prior_price")
    last = F.max("idx").over(Window.partitionBy("entity"))
    if latest is not None:
        fresh = latest.select("entity", F.lit(True).alias("_new"), F.col("price").alias("_p"), F.col("prior_price").alias("_q"))
        newest = idx.agg(F.max("idx").alias("_last"))
        rows = rows.join(fresh, "entity", "left").crossJoin(F.broadcast(newest))  # one row
        given = F.col("_new") & (F.col("idx") == F.col("_last"))
        rows = rows.withColumns({c: F.when(given, F.col(x)).otherwise(F.col(c)) for c, x in (("price", "_p"), ("prior_price", "_q"))}).drop("_new", "_p", "_q", "_last")
    w = Window.partitionBy("entity").orderBy(F.desc("idx"))
    ahead_idx, ahead_prior = F.lag("idx").over(w), F.lag("prior_price").over(w)
    ok = (ahead_idx == F.col("idx") + 1) & (ahead_prior > 0) & (F.col("price") > 0)
    rows = rows.withColumns({"_first": F.col("idx") == last, "_ok": F.coalesce(ok, F.lit(False)), "_link": F.when(F.coalesce(ok, F.lit(False)), ahead_prior / F.col("price"))})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    link = F.when(F.col("_first"), F.lit(1.0)).otherwise(F.coalesce("_link", F.lit(1.0)))
    broken = F.max(F.when(~F.col("_first") & ~F.col("_ok"), 1).otherwise(0)).over(run)
    return rows.select("month", "entity", F.when(broken == 0, stats.half_up(F.col("price") * F.product(link).over(run), 4)).alias("price_adj"))


def forward_returns(panel: DataFrame, horizon: int, price: str = "price_adj") -> DataFrame:
    """The panel with ``fwd``: the return to the month ``horizon`` places on; rows without both prices go."""
    rows = panel.join(F.broadcast(month_index(panel)), "month")
    later = rows.select("entity", (F.col("idx") - horizon).alias("idx"), F.col(price).alias("_later"))
    met = rows.join(later, ["entity", "idx"]).where((F.col(price) > 0) & F.col("_later").isNotNull())
    return met.withColumn("fwd", F.col("_later") / F.col(price) - 1).drop("_later")


def outcome_pairs(panel: DataFrame, horizon: int, price: str = "price_adj") -> DataFrame:
    """Like ``forward_returns``, but counted along each entity's own months, so that a gap in its record counts as none."""
    later = F.lead(price, horizon).over(Window.partitionBy("entity").orderBy("month"))
    out = panel.withColumn("_later", later).where((F.col(price) > 0) & F.col("_later").isNotNull())
    return out.withColumn("fwd", F.col("_later") / F.col(price) - 1).drop("_later")


def score_deciles(pairs: DataFrame, key: str = "composite", least: int = NO_DECILE) -> DataFrame:
    """Months of at least ``least`` pairs with ``bucket`` 1..10, the best first."""
    rows = pairs.where(F.col(key).isNotNull() & F.col("fwd").isNotNull())
    cut, slice_of = by_cuts(rows, ["month"], key)
    placed = ranked(cut, ["month"], slice_of, [F.desc(key), F.asc("entity")], "_p", "_n").where(F.col("_n") >= least)
    return placed.withColumn("bucket", F.least(F.lit(9), F.floor((F.col("_p") - 1) / (F.col("_n") / 10))).cast("long") + 1).drop("_n", "_p", "_cuts")


def decile_grid(panel: DataFrame, keys: list[str], horizons: list[int], price: str = "price_adj", least: int = NO_DECILE) -> DataFrame:
    """(key, horizon, month, entity, fwd, bucket): ``score_deciles`` of every key over every horizon, from one reading of the panel.

    Each row looks ahead along its entity's months once, as far as the longest horizon; keys and horizons are rows from then on,
    and are ranked side by side.
    """
    rows = panel.join(F.broadcast(month_index(panel)), "month")  # as long as the record has months
    ahead = F.collect_list(F.struct("idx", F.col(price).alias("p"))).over(Window.partitionBy("entity").orderBy("idx").rangeBetween(1, max(horizons)))
    at = lambda h: F.filter("_ahead", lambda x: x["idx"] == F.col("idx") + h)
    seen = rows.select("month", "entity", *keys, "idx", price, ahead.alias("_ahead"))
    fwd = F.array(*(F.struct(F.lit(h).alias("horizon"), (F.try_element_at(at(h), F.lit(1))["p"] / F.col(price) - 1).alias("fwd")) for h in horizons))
    # Written once, as quantiles, sizes and ranks read it: a row for each of the panel's.
    seen = materialised(seen.where(F.col(price) > 0).select("month", "entity", *keys, fwd.alias("_fwd")))
    long = seen.select("month", "entity", *keys, F.inline("_fwd")).where("fwd is not null")
    long = long.unpivot(["month", "entity", "horizon", "fwd"], keys, "key", "value").where("value is not null")
    by = ["key", "horizon", "month"]
    cut, slice_of = by_cuts(long, by, "value")
    placed = ranked(cut, by, slice_of, [F.desc("value"), F.asc("entity")], "_p", "_n").where(F.col("_n") >= least)
    bucket = F.least(F.lit(9), F.floor((F.col("_p") - 1) / (F.col("_n") / 10))).cast("long") + 1
    return placed.select(*by, "entity", "fwd", bucket.alias("bucket"))


def decile_means(bucketed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, bucket, mean_fwd, n), ten rows each."""
    return bucketed.groupBy(*(by or []), "bucket").agg(F.avg("fwd").alias("mean_fwd"), F.count("*").alias("n"))


def decile_verdict(bucketed: DataFrame, observations_needed: int = 12) -> DataFrame:
    """One row: top less universe, whether the means fall from decile to decile, months seen, and whether that is enough."""
    means = decile_means(bucketed)
    before = F.lag("mean_fwd").over(Window.orderBy("bucket"))  # ten rows
    falls = means.withColumn("_ok", before.isNull() | (F.col("mean_fwd") <= before + 1e-9))
    one = falls.agg(F.bool_and("_ok").alias("monotonic"), F.max(F.when(F.col("bucket") == 1, F.col("mean_fwd"))).alias("top_mean"))
    rest = bucketed.agg(F.avg("fwd").alias("universe_mean"), F.count_distinct("month").alias("observations"))
    out = one.crossJoin(rest)  # one row each
    return out.withColumns({"top_spread": F.col("top_mean") - F.col("universe_mean"), "interpretable": F.col("observations") >= observations_needed})


def month_summary(now: DataFrame, before: DataFrame) -> DataFrame:
    """One row: entered, left and the median absolute move of those in both months."""
    a, b = now.select("entity", "rank"), before.select("entity", F.col("rank").alias("was"))
    both = a.join(b, "entity", "full_outer")
    return both.agg(
        F.count_if(F.col("was").isNull()).alias("entered"),
        F.count_if(F.col("rank").isNull()).alias("left_out"),
        F.median(F.abs(F.col("was") - F.col("rank"))).alias("median_move"),
    )


def top_movers(deltas: DataFrame, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """(risers, fallers): of rows that are not new and have moved, the first n, then only those of the right sign."""
    moved = deltas.where("not is_new and rank_change <> 0")
    up = moved.orderBy(F.desc("rank_change"), "entity").limit(n).where("rank_change > 0")
    down = moved.orderBy(F.asc("rank_change"), "entity").limit(n).where("rank_change < 0")
    return up, down


def most_stable(rows: DataFrame, n: int = 60, volatile: bool = False) -> DataFrame:
    return rows.orderBy(F.asc_nulls_last("stability") if volatile else F.desc_nulls_last("stability"), "entity").limit(n)


def history_index(panel: DataFrame) -> DataFrame:
    """(entity, points): each entity's months in order, as structs."""
    cols = [c for c in panel.columns if c not in ("entity", "month")]
    return panel.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("month", *cols))).alias("points"))


def spark_line(panel: DataFrame, value: str) -> DataFrame:
    """The panel with ``level``, scaled inside each entity, and ``rising``."""
    w = Window.partitionBy("entity").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return panel.withColumns({"level": stats.min_max_scaled(value, ["entity"]), "rising": F.last(value).over(w) >= F.first(value).over(w)})


def unranked_record(insufficient: DataFrame, gone: DataFrame) -> DataFrame:
    """Insufficient rows and exits as one table (entity, name, kind, reason); the first wins."""
    a = insufficient.select("entity", "name", F.lit("insufficient").alias("kind"), "reason")
    b = gone.select("entity", "name", "kind", "reason").join(a.select("entity"), "entity", "left_anti")
    return a.unionByName(b)


def coverage_totals(grid: DataFrame) -> DataFrame:
    """One row: cells, those resolved, and the share, undefined when empty."""
    out = grid.agg(F.count("*").alias("cells"), F.count("pct").alias("resolved"))
    return out.withColumn("share", F.try_divide("resolved", "cells"))


def data_pack(scored: DataFrame, grid: DataFrame, stability: DataFrame, panel: DataFrame, gone: DataFrame, spec: DataFrame) -> dict[str, DataFrame]:
    """The six long tables of a data pack, by name; specs are joined to the measures."""
    labels = F.broadcast(spec.select("metric", F.col("factor").alias("_factor")))  # as long as the registry
    return {
        "scores": scored,
        "measures": grid.join(labels, "metric").select("entity", "segment", "metric", F.col("_factor").alias("factor"), "raw", "pct", "basis"),
        "stability": stability,
        "history": panel,
        "exits": gone,
        "metrics": spec.select("metric", "factor", "higher_better"),
    }
