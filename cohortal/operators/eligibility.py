"""Who is scored: floors with hysteresis, the cascade of exclusions, share classes and the funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortal.functions.spec import Settings


def clears(value: Column | str, floor: float, was_scored: Column | str, ratio: float = Settings.retention) -> Column:
    """At the floor, or, for those scored before, at ``ratio`` of it; a missing value never clears."""
    v = F.col(value) if isinstance(value, str) else value
    before = F.col(was_scored) if isinstance(was_scored, str) else was_scored
    return F.coalesce((v >= floor) | (F.coalesce(before, F.lit(False)) & (v >= floor * ratio)), F.lit(False))


def cascade(rows: DataFrame, as_of: str, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``stage`` and ``reason`` of the first rule that fails, null where none does; ``carried`` for stale rows that stay.

    Columns: has_facts, domestic, n_filings, latest (date), newer (struct form,
    filed, report_date, or null), adv, was_scored.
    """
    day = F.to_date(F.lit(as_of))
    age = F.datediff(day, "latest")
    stale = F.col("latest").isNull() | (age > settings.report_age)
    carried = stale & F.coalesce("was_scored", F.lit(False)) & F.col("newer").isNotNull() & F.coalesce(age <= settings.carry_age, F.lit(False))
    liquid = clears("adv", settings.adv_floor, "was_scored", settings.retention)
    rules = [
        ("no_facts", ~F.coalesce("has_facts", F.lit(False)), F.lit("no facts on file")),
        ("no_price", F.col("adv").isNull(), F.lit("no price")),
        ("foreign_filer", ~F.coalesce("domestic", F.lit(False)), F.lit("files no domestic forms")),
        ("short_history", F.coalesce("n_filings", F.lit(0)) < settings.min_filings, F.format_string("%d periodic filings", F.coalesce("n_filings", F.lit(0)))),
        ("stale", stale & ~carried, F.format_string("latest report is %s", F.coalesce(F.col("latest").cast("string"), F.lit("missing")))),
        ("illiquid", ~liquid, F.lit("average dollar volume under the floor")),
    ]
    stage, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, fails, why in reversed(rules):
        stage, reason = F.when(fails, name).otherwise(stage), F.when(fails, why).otherwise(reason)
    return rows.withColumns({"stage": stage, "reason": reason, "carried": carried & stage.isNull()})


STAGES = ["no_facts", "no_price", "foreign_filer", "short_history", "stale", "illiquid"]


def funnel(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, step, stage, survivors, dropped): how many are left after each rule, in one pass over the rows."""
    by = by or []
    place = F.coalesce(*(F.when(F.col("stage") == s, k + 1) for k, s in enumerate(STAGES)), F.lit(len(STAGES) + 1))
    counts = [F.count_if(place > k).alias(f"n{k}") for k in range(len(STAGES) + 1)]
    parts = ", ".join(f"{k}, '{'listed' if k == 0 else STAGES[k - 1]}', n{k}" for k in range(len(STAGES) + 1))
    long = rows.groupBy(*by).agg(*counts).selectExpr(*by, f"stack({len(STAGES) + 1}, {parts}) as (step, stage, survivors)")
    before = F.lag("survivors").over(Window.partitionBy(*by).orderBy("step"))
    return long.withColumn("dropped", F.coalesce(before - F.col("survivors"), F.lit(0)))


def dedupe_share_classes(listings: DataFrame, company: str, entity: str, score: Column) -> DataFrame:
    """One listing a company, that of the highest score (then id), with the sorted classes and those dropped."""
    keyed = listings.withColumn("_s", score)
    top = F.max_by(F.col(entity), F.struct("_s", F.col(entity)))
    out = keyed.groupBy(company).agg(top.alias(entity), F.array_sort(F.collect_set(entity)).alias("share_classes"))
    return out.withColumn("dropped", F.array_remove("share_classes", F.col(entity)))


def structural_signals(facts: DataFrame, domestic_forms: list[str], probes: list[str]) -> DataFrame:
    """(entity, domestic, n_filings, latest): from the first probe concept that an entity has."""
    place = F.coalesce(*(F.when(F.col("concept") == c, k) for k, c in enumerate(probes)))
    used = facts.where(F.col("concept").isin(probes)).withColumn("_p", place)
    first = F.min("_p").over(Window.partitionBy("entity"))
    return (
        used.withColumn("_f", first)
        .where("_p = _f")
        .groupBy("entity")
        .agg(
            F.max(F.col("form").isin(domestic_forms)).alias("domestic"),
            F.count_distinct("form", "accn").alias("n_filings"),
            F.max("end").alias("latest"),
        )
    )


def recently_abandoned(rows: DataFrame, scoring_day: str, horizon: int = Settings.drift_horizon) -> DataFrame:
    return rows.where(F.col("last_reported") >= F.date_sub(F.to_date(F.lit(scoring_day)), horizon))


def unmapped_candidates(facts: DataFrame, family: str, noise: str, known: DataFrame, anchors: DataFrame, within: int = 10, top: int = 5) -> DataFrame:
    """(entity, concept, val): concepts of a family that no line item maps, near the anchor date, by their largest amount, the first five an entity."""
    named = facts.where(F.col("concept").rlike(family) & ~F.col("concept").rlike(noise) & (F.col("val") != 0)).join(known.select("concept"), "concept", "left_anti")
    near = named.join(anchors, "entity").where(F.abs(F.datediff("end", "anchor")) <= within)
    sizes = near.groupBy("entity", "concept").agg(F.max(F.abs("val")).alias("val"))
    w = Window.partitionBy("entity").orderBy(F.desc("val"), "concept")
    return sizes.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")


def ever_reported(facts: DataFrame, pattern: str, noise: str, as_of: str | None = None) -> DataFrame:
    """Entities that ever reported a concept of a pattern; with ``as_of`` only by what was filed until then."""
    seen = facts if as_of is None else facts.where(F.col("filed") <= F.to_date(F.lit(as_of)))
    return seen.where(F.col("concept").rlike(pattern) & ~F.col("concept").rlike(noise)).select("entity").distinct()
