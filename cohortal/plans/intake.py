"""The front half of a monthly run: which listings are scored, and what became of the others.

A row of the staged table is a listing. It carries the first rule that it fails through one plan: common stock, size, a
known filer, one class a company, and the rules on filings, reports and trading. Funnel, exclusions, carried reports and
the scored set are read off that table, without another look at the inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.functions.spec import Settings
from cohortal.operators import classify, eligibility
from cohortal.operators import temporal as t
from cohortal.plans import measures as m

#: Forms of domestic filers, forms that count as periodic, and the concepts by which they are counted, the first that a filer has.
DOMESTIC, PERIODIC = ["10-K", "10-Q"], ["10-K", "10-Q", "20-F", "40-F"]
PROBES = ["Assets", "Liabilities", "StockholdersEquity"]
STAGES = ["not_common", "market_cap_floor", "no_sec_match", "share_class", *eligibility.STAGES]
#: What an exit is called whose listing failed a rule before the scoring.
EXIT_OF = {"not_common": "unlisted", "market_cap_floor": "market_cap_floor", "no_sec_match": "no_sec_match", "share_class": "share_class"}


def filers(facts: DataFrame, as_of: str, newer: DataFrame | None = None) -> DataFrame:
    """(entity, domestic, n_filings, latest, newer): what is known of each filer by ``as_of``.

    ``latest`` is the last balance sheet. ``newer`` is (entity, form, filed, report_date): filings that the index shows and
    the facts lack; of several the last filed counts.
    """
    place = F.when(F.col("taxonomy") == "us-gaap", F.array_position(F.array(*map(F.lit, PROBES)), F.col("concept")))
    filings = F.count_distinct(F.when(F.col("form").isin(PERIODIC), F.struct("form", "accn"))).cast("int").alias("n_filings")
    each = t.visible(facts, as_of).groupBy("entity", F.nullif(place, F.lit(0)).alias("_place")).agg(F.max(F.col("form").isin(DOMESTIC)).alias("domestic"), filings)
    signals = each.groupBy("entity").agg(F.min_by(F.struct("domestic", "n_filings"), "_place").alias("_s")).select("entity", "_s.*")
    known = signals.join(m.anchors(facts, as_of).withColumnRenamed("anchor", "latest"), "entity", "left")
    if newer is None:
        return known.withColumn("newer", F.lit(None).cast("struct<form: string, filed: date, report_date: date>"))
    seen = newer.where(F.col("filed") <= F.to_date(F.lit(as_of))).groupBy("entity")
    last = seen.agg(F.max(F.struct("filed", "report_date", "form")).alias("_n"))
    return known.join(last, "entity", "left").withColumn("newer", F.when(F.col("_n").isNotNull(), F.struct("_n.form", "_n.filed", "_n.report_date"))).drop("_n")


def staged(listings: DataFrame, ids: DataFrame, known: DataFrame, prices: DataFrame, prior: DataFrame, as_of: str, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row a listing, with ``stage`` and ``reason`` of the first rule that it fails, null where none does.

    ``listings``: listing, name, sector, industry, market_cap, volume, last_sale. ``ids``: listing, entity. ``known``: as from
    ``filers``. ``prices``: listing, adv. ``prior``: the listings scored last month, which the floors give some room.

    Beside these: entity, share_classes, latest, newer, carried (kept on an old report, as a newer one is on the index), and
    kept_small and kept_thin (under a floor, but scored before). A listing occurs once in each input; a company's class is the
    one with the most volume in money, and of equal ones the last in name.
    """
    was = prior.select("listing").distinct().withColumn("was_scored", F.lit(True))
    rows = listings.join(ids, "listing", "left").join(prices.select("listing", "adv"), "listing", "left").join(was, "listing", "left")
    cap_ok, thin_ok = (eligibility.clears(c, floor, "was_scored", settings.retention) for c, floor in (("market_cap", settings.cap_floor), ("adv", settings.adv_floor)))
    first = [
        ("not_common", ~classify.is_common_stock("name"), F.lit("not an operating company's common stock")),
        ("market_cap_floor", ~cap_ok, F.when(F.col("market_cap").isNull(), "market value unknown").otherwise("market value under the floor")),
        ("no_sec_match", F.col("entity").isNull(), F.lit("no filer under this listing")),
    ]
    stage, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, fails, why in reversed(first):
        stage, reason = F.when(fails, name).otherwise(stage), F.when(fails, why).otherwise(reason)
    rows = rows.withColumns({"_stage": stage, "_reason": reason})
    money = F.coalesce("volume", F.lit(0.0)) * F.coalesce("last_sale", F.lit(0.0))
    classes = eligibility.dedupe_share_classes(rows.where("_stage is null"), "entity", "listing", money).select("entity", F.col("listing").alias("_kept"), "share_classes")
    rows = rows.join(classes, "entity", "left").join(known.withColumn("has_facts", F.lit(True)), "entity", "left")
    other = F.col("_stage").isNull() & (F.col("listing") != F.col("_kept"))
    rows = rows.withColumns({
        "_reason": F.when(other, F.concat(F.col("_kept"), F.lit(" stands for the company"))).otherwise(F.col("_reason")),
        "_stage": F.when(other, "share_class").otherwise(F.col("_stage")),
    })
    rows = eligibility.cascade(rows, as_of, settings)
    alive = F.col("_stage").isNull()
    last = {"stage": F.coalesce("_stage", "stage"), "reason": F.when(alive, F.col("reason")).otherwise(F.col("_reason")), "carried": alive & F.col("carried")}
    before = F.coalesce("was_scored", F.lit(False))
    kept = lambda value, floor, ok: F.coalesce(before & ok & (F.col(value) < floor), F.lit(False))
    rows = rows.withColumns(last).withColumns({"kept_small": kept("market_cap", settings.cap_floor, cap_ok), "kept_thin": kept("adv", settings.adv_floor, thin_ok)})
    return rows.select(
        "listing", "entity", "name", "sector", "industry", "market_cap", "adv", "share_classes", "latest", "newer", "stage", "reason", "carried", "kept_small", "kept_thin"
    )


def funnel(rows: DataFrame) -> DataFrame:
    """(step, stage, survivors, dropped, kept_below): listings left after each rule, and of these those that a floor kept for being scored before; one pass."""
    place = F.coalesce(*(F.when(F.col("stage") == s, k + 1) for k, s in enumerate(STAGES)), F.lit(len(STAGES) + 1))
    names = ["listed", *STAGES]
    below = {"market_cap_floor": F.col("kept_small"), "illiquid": F.col("kept_thin")}
    counts = [F.count_if(place > k).alias(f"n{k}") for k in range(len(names))]
    kept = [F.count_if((place > k) & below.get(s, F.lit(False))).alias(f"b{k}") for k, s in enumerate(names)]
    cells = [F.struct(F.lit(k).alias("step"), F.lit(s).alias("stage"), F.col(f"n{k}").alias("survivors"), (F.col(f"n{max(0, k - 1)}") - F.col(f"n{k}")).alias("dropped"), F.col(f"b{k}").alias("kept_below")) for k, s in enumerate(names)]
    return rows.agg(*counts, *kept).select(F.inline(F.array(*cells)))


def exits_of(rows: DataFrame, prior: DataFrame) -> list[tuple[str, DataFrame]]:
    """(kind, (entity, reason)) of last month's ``prior`` (entity, listing) whose listing a rule took out, in order of precedence."""
    gone = prior.select("entity", "listing").join(rows.where("stage is not null").select("listing", "stage", "reason"), "listing")
    kind = F.coalesce(*(F.when(F.col("stage") == s, k) for s, k in EXIT_OF.items()), F.lit("excluded"))
    told = gone.select("entity", kind.alias("kind"), "reason")
    return [(k, told.where(F.col("kind") == k).select("entity", "reason")) for k in ("excluded", "share_class", "market_cap_floor", "no_sec_match", "unlisted")]
