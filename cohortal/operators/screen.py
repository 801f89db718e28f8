"""The interactive side: screens, searches, sorts, tops, portfolios and holdings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortal.functions.scalars import contains_text
from cohortal.plans.large import value_positions

NO_SECTOR = "Unclassified"
#: Named sorts: column, descending.
SORTS = {"score": ("composite", True), "gainers": ("change", True), "decliners": ("change", False), "risers": ("rank_change", True)}


def text_match(query: str, *cols: str) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | contains_text(c, query)
    return out


def screen(rows: DataFrame, query: str | None = None, sectors: list[str] | None = None, min_change: float | None = None, min_composite: float | None = None, min_factor: dict[str, float] | None = None) -> DataFrame:
    """Rows that meet every active bound; a missing value fails one."""
    at_least = {"change": min_change, "composite": min_composite} | (min_factor or {})
    out = rows.where(text_match(query, "entity", "name")) if query else rows
    out = out.where(F.coalesce("sector", F.lit(NO_SECTOR)).isin(sectors)) if sectors else out
    for c, least in at_least.items():
        out = out.where(F.col(c) >= least) if least is not None else out
    return out


def top_decile(rows: DataFrame, query: str | None = None) -> DataFrame:
    """The first decile; an active search lifts the limit."""
    return rows if query else rows.where(F.coalesce("decile", F.lit(99)) <= 1)


def sort_order(column: str, descending: bool, text: bool = False) -> Column:
    """Numbers with nulls last in both directions; texts with nulls as empty."""
    if text:
        c = F.lower(F.coalesce(F.col(column), F.lit("")))
        return c.desc() if descending else c.asc()
    return F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)


def sorted_by(rows: DataFrame, preset: str) -> DataFrame:
    return rows.orderBy(sort_order(*SORTS[preset]), F.asc("entity"))


def placed(rows: DataFrame, by: list[str], column: str, descending: bool, text: bool = False) -> DataFrame:
    """``rows`` with ``place``, from 1 inside ``by``, in the order of ``sort_order`` and then of entity.

    Distinct values are counted by ranges, so no task holds a whole table; rows of one value are ordered in one.
    """
    value = F.lower(F.coalesce(F.col(column), F.lit(""))) if text else F.col(column)
    keyed = rows.withColumn("_v", value)
    known, none = keyed.where("_v is not null"), keyed.where("_v is null")
    ends = value_positions(known, by, "_v")
    tied = known.withColumn("_t", F.row_number().over(Window.partitionBy(*by, "_v").orderBy("entity"))).join(ends, [*by, "_v"])
    first = tied.withColumn("place", (F.when(F.lit(descending), F.col("n") - F.col("below") - F.col("equal")).otherwise(F.col("below")) + F.col("_t")).cast("long"))
    sizes = known.groupBy(*by).agg(F.count("*").alias("_known"))
    rest = none.join(value_positions(none, by, "entity").select(*by, "entity", "below"), [*by, "entity"]).join(sizes, by, "left")
    last = rest.withColumn("place", (F.coalesce("_known", F.lit(0)) + F.col("below") + 1).cast("long"))
    return first.select(*rows.columns, "place").unionByName(last.select(*rows.columns, "place"))


def cross_search(tables: DataFrame, unranked: DataFrame, query: str, current: str, limit: int = 8) -> DataFrame:
    """Matches in other tables and among the unranked: the exact id first, then ids with the prefix, then the rest."""
    q = query.strip().upper()
    every = tables.where(F.col("segment") != current).select("entity", "name", "segment").unionByName(
        unranked.select("entity", "name", F.lit(None).cast("string").alias("segment"))
    )
    place = F.when(F.col("entity") == q, 0).when(F.startswith("entity", F.lit(q)), 1).otherwise(2)
    return every.where(text_match(query, "entity", "name")).withColumn("place", place).orderBy("place", "entity").limit(limit)


def point_lookup(tables: DataFrame, unranked: DataFrame, entity: str) -> DataFrame:
    """The row of one id in any table, else of the unranked list."""
    key = F.col("entity") == entity.strip().upper()
    ranked = tables.where(key).select("entity", "name", F.lit("ranked").alias("found"))
    rest = unranked.where(key).select("entity", "name", F.lit("unranked").alias("found"))
    return ranked.unionByName(rest.join(ranked.select("entity"), "entity", "left_anti"))


def exclusion_search(excluded: DataFrame, query: str) -> DataFrame:
    return excluded.where(text_match(query, "entity", "reason"))


def top_per_segment(rows: DataFrame, n: int | None, by: str = "segment") -> DataFrame:
    """The first n of each table by rank; all with None."""
    if n is None:
        return rows
    w = Window.partitionBy(by).orderBy(F.asc_nulls_last("rank"), F.asc("entity"))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def facet_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("sector", F.lit(NO_SECTOR)).alias("sector")).count().withColumnRenamed("count", "n").orderBy("sector")


def counter(rows: DataFrame, column: str) -> DataFrame:
    """Counts by value, most common first."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column))


def group_change(rows: DataFrame, value: str = "change") -> DataFrame:
    """(sector, mean, n): the equally weighted mean change of each sector."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.coalesce("sector", F.lit(NO_SECTOR)).alias("sector")).agg(
        F.avg(value).alias("mean_change"), F.count("*").alias("n")
    )


def price_review(snapshot: DataFrame, above: float = 0.50) -> DataFrame:
    """Moves of more than ``above``, the largest first."""
    return snapshot.where(F.abs("change") > above).orderBy(F.abs("change").desc(), "entity")


def held_at(watch: DataFrame, instants: DataFrame) -> DataFrame:
    """Watch intervals [added, removed) that hold at each instant; an open end never closes.

    ``instants`` (instant, entity): an equi-join by entity with the bounds as its condition.
    """
    on = (F.col("w.entity") == F.col("i.entity")) & (F.col("w.added_at") <= F.col("i.instant"))
    open_end = F.col("w.removed_at").isNull() | (F.col("i.instant") < F.col("w.removed_at"))
    return instants.alias("i").join(watch.alias("w"), on & open_end, "left_semi")


def open_holdings(watch: DataFrame) -> DataFrame:
    """(entity, day): ids with an open interval, and the first day of one."""
    return watch.where("removed_at is null").groupBy("entity").agg(F.min("added_at").cast("date").alias("day"))


def portfolio_summary(held: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: mean change of what is held, its spread over the universe and over each row's sector, and counts."""
    sector = F.coalesce("sector", F.lit(NO_SECTOR)).alias("sector")
    u = universe.select("entity", sector, "change")
    means = u.groupBy("sector").agg(F.avg("change").alias("sector_mean"))
    marked = u.join(held.select("entity").distinct().withColumn("held", F.lit(True)), "entity", "left").join(F.broadcast(means), "sector")  # one row a sector
    mine = F.col("held") & F.col("change").isNotNull()
    out = marked.agg(
        F.avg(F.when(mine, F.col("change"))).alias("mean_change"),
        F.avg("change").alias("universe_mean"),
        F.avg(F.when(mine, F.col("change") - F.col("sector_mean"))).alias("sector_spread"),
        F.count_if(F.coalesce(F.col("held"), F.lit(False))).alias("n_held"),
        F.count_if(F.coalesce(mine, F.lit(False))).alias("n_priced"),
    )
    return out.withColumn("spread", F.col("mean_change") - F.col("universe_mean"))


def unscored_holdings(held: DataFrame, scored: DataFrame) -> DataFrame:
    return held.join(scored.select("entity"), "entity", "left_anti")


def import_holdings(shared: DataFrame, watch: DataFrame) -> DataFrame:
    """The watch log with shared ids (entity, added_at) that are not held yet."""
    fresh = shared.join(open_holdings(watch).select("entity"), "entity", "left_anti")
    return watch.unionByName(fresh.select("entity", "added_at", F.lit(None).cast("timestamp").alias("removed_at")))


def first_event(watch: DataFrame) -> DataFrame:
    return watch.agg(F.min("added_at").alias("first_at"))


def pack_subset(table: DataFrame, keep: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key survives elsewhere."""
    return table.join(keep.select(*on).distinct(), on, "left_semi")
