"""From point-in-time facts to the measures that are scored.

Facts are resolved to line items once; instants, trailing years, fiscal years and
quarters of every item are then three aggregations by entity, and the measures are
expressions over one row an entity. Trends over quarters are aggregates joined to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortal.functions import stats
from cohortal.functions.scalars import clamp, or_zero, positive_ratio, safe_div, sum_of_present
from cohortal.functions.spec import BY_CONCEPT, DEBT_ITEMS, DEBT_LIKE, DEBT_NOISE, DEBT_PARTS, DEBT_SLICES, LINE_ITEMS, METRICS, Settings, line_items
from cohortal.operators import temporal as t
from cohortal.operators.eligibility import ever_reported
from cohortal.plans.stage import by_entity, dealt, materialised, written

TAXONOMIES = ["us-gaap", "ifrs-full", "dei"]
PARTIAL_DEBT = 0.75
TREND_YEARS, TREND_POINTS, TREND_BASE = 3, 9, 50e6
CURRENT_DAYS = 120
MATERIAL, CONFIRM, WINDOW = 0.25, 0.5, 370
MARGIN_SWING = 0.5
AGREE = 0.05
BY_ITEM = ["entity", "item"]
SOURCE = ("concept", "accn", "form")
#: Items whose fiscal years are looked at by themselves, beside the one-offs.
ANNUAL_ITEMS = ["revenue", "cost", "gross_profit", "operating_income", "net_income", "da", "nii", "premiums"]
#: Items of which single quarters are looked at, beside the one-offs.
QUARTERLY_ITEMS = ["revenue", "cost", "gross_profit", "operating_income", "net_income"]
#: What a note tells beside a measure.
NOTE = "struct<metric: string, kind: string, tag: string, end: date, amount: double>"


def tagged_facts(facts: DataFrame, as_of: str) -> DataFrame:
    """(entity, item, concept, start, end, val, filed, accn, form, seq, priority, largest_wins): the latest version of each concept and period.

    Concepts of no item go before anything is shuffled. Items that are looked at concept by concept are named ``item:concept``.
    """
    items = line_items(facts.sparkSession)  # as long as the registry
    wanted = facts.join(F.broadcast(items.select("concept").distinct()), "concept", "left_semi")
    # One sort serves both windows: the taxonomy of a concept and the latest version of its periods, which does not depend on the items that a concept serves.
    period = ["entity", "concept", "start", "end"]
    placed = by_entity(wanted).sortWithinPartitions(*period, F.desc("filed"), "seq")
    one = t.latest_version(t.visible(t.first_taxonomy(placed, TAXONOMIES), as_of, t.FORMS, t.UNITS), period)
    named = F.when(F.col("item").isin(*BY_CONCEPT), F.concat_ws(":", "item", "concept")).otherwise(F.col("item"))
    one = one.join(F.broadcast(items), "concept").withColumn("item", named)
    return one.select("entity", "item", "concept", "start", "end", "val", "filed", "accn", "form", "seq", "priority", "largest_wins").where("end is not null")


def resolve_items(tagged: DataFrame) -> DataFrame:
    """(entity, item, concept, start, end, val, filed, accn, form): one value for each item and period."""
    nested = F.col("largest_wins") & F.col("start").isNotNull()
    # What ``t.priority_merge`` and, for nested items, ``t.largest_in_newest`` keep, in one pass: whether an item nests is the same for all rows of a key.
    order = [F.when(~nested, F.col("priority")).asc(), F.desc("filed"), F.when(nested, F.col("val")).desc_nulls_last(), F.col("priority").asc(), F.col("seq").asc()]
    w = Window.partitionBy(*BY_ITEM, "start", "end").orderBy(*order)
    one = tagged.where(~nested | F.col("val").isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return one.select("entity", "item", "concept", "start", "end", "val", "filed", "accn", "form")


def gathered_items(items: DataFrame, anchor: DataFrame | None = None) -> DataFrame:
    """Items gathered: one row for each entity and item, some fifty an entity. They have an ``anchor`` or, better, get it from ``anchor`` (entity, anchor) when they are fewer."""
    own = items.where("val is not null")
    if anchor is None:
        return t.gathered(own, BY_ITEM, F.col("anchor"), SOURCE)
    return t.gathered(own, BY_ITEM, None, SOURCE).drop("_anchor").join(anchor.withColumnRenamed("anchor", "_anchor"), "entity", "left")


def spread_items(groups: DataFrame) -> DataFrame:
    """(entity, item, anchor, start, end, val, filed, concept, accn, form): the items of gathered rows. Who filters by item reads no other's."""
    starts = groups.select(*BY_ITEM, F.col("_anchor").alias("anchor"), F.inline("_f"))
    rows = starts.select(*BY_ITEM, "anchor", "start", F.inline("_s"))
    return rows.select(*BY_ITEM, "anchor", "start", "end", "val", "filed", "src.*")


def anchors(facts: DataFrame, as_of: str) -> DataFrame:
    """(entity, anchor): the latest balance sheet on file."""
    return t.reference_date(t.visible(facts.where("taxonomy = 'us-gaap'"), as_of, t.FORMS), ["entity"], as_of)


def _newest_instants(items: DataFrame, as_of: str) -> DataFrame:
    """(entity, item, end, concept, val, filed, accn, form, anchor): each item's newest instant up to ``as_of``."""
    cols = ["end", "concept", "val", "filed", "accn", "form"]
    rows = items.where(F.col("start").isNull() & F.col("val").isNotNull() & (F.col("end") <= F.to_date(F.lit(as_of))))
    return rows.groupBy(*BY_ITEM).agg(F.max_by(F.struct(*cols), "end").alias("x"), F.max("anchor").alias("anchor")).select(*BY_ITEM, "x.*", "anchor")


def instants(items: DataFrame, as_of: str) -> DataFrame:
    """(entity, item, concept, end, val, filed, accn, form): each item's newest instant up to ``as_of``, unless stale against ``anchor``."""
    return _newest_instants(items, as_of).where(t.fresh(F.col("end"), F.col("anchor"))).drop("anchor")


def instants_at(items: DataFrame, days: DataFrame) -> DataFrame:
    """(entity, item, day, end, concept, val): each item's newest instant as of each entity's ``day``, stale against that day or not."""
    both = items.where("start is null and val is not null").drop("day").join(days, "entity").where(F.col("end") <= F.col("day"))
    got = both.groupBy(*BY_ITEM, "day").agg(F.max_by(F.struct("end", "concept", "val"), "end").alias("x"))
    return got.select(*BY_ITEM, "day", "x.*")


def instants_near(items: DataFrame, days: DataFrame, names: list[str], within: int = 45) -> DataFrame:
    """(entity, item, val): the instants of items nearest to each entity's one ``day``, of equally near ones the earlier."""
    own = items.where(F.col("item").isin(names) & F.col("start").isNull() & F.col("val").isNotNull()).select(*BY_ITEM, "end", "val")
    gap = F.abs(F.datediff("end", "day"))
    return own.join(days, "entity").where(gap <= within).groupBy(*BY_ITEM).agg(F.min_by("val", F.struct(gap, F.col("end"))).alias("val"))


#: How debt, EBIT and gross profit are said to have been found (the names in ``total_debt`` and ``measure_columns``).
#:   combined-tag, noncurrent+current+short, longtermdebt+short, current+short-only, last-reported-zero, no debt tag ever filed, unresolved


def total_debt(inst: str) -> tuple[Column, Column]:
    """(value, path) from a map of instants: the newest complete path; a part of debt far below an older total does not count.

    Falls back to the current and short-term parts alone, whose value is then partial.
    """
    get = lambda k: F.col(inst)[k]
    val = lambda k: get(k)["val"]

    def path(key: str, place: int, value: Column, how: str) -> Column:
        part = get(key)["concept"].isin(DEBT_PARTS)
        made = F.struct(get(key)["end"].alias("end"), F.lit(-place).alias("place"), value.alias("value"), F.lit(how).alias("how"), part.alias("part"))
        return F.when(val(key).isNotNull(), made)

    paths = F.array(
        path("debt_combined", 0, val("debt_combined"), "combined-tag"),
        path("debt_noncurrent", 1, sum_of_present(val("debt_noncurrent"), val("debt_lt_current"), val("debt_short")), "noncurrent+current+short"),
        path("debt_lt_total", 2, sum_of_present(val("debt_lt_total"), val("debt_short")), "longtermdebt+short"),
    )
    ordered = F.sort_array(F.filter(paths, lambda x: x.isNotNull()), asc=False)
    whole = F.filter(ordered, lambda c, i: ~(c["part"] & F.exists(F.slice(ordered, i + 2, 3), lambda o: c["value"] < PARTIAL_DEBT * o["value"])))
    best = F.try_element_at(whole, F.lit(1))
    partial = sum_of_present(val("debt_lt_current"), val("debt_short"))
    return F.coalesce(best["value"], partial), F.coalesce(best["how"], F.when(partial.isNotNull(), "current+short-only"))


def debt_history(facts: DataFrame, as_of: str, back: DataFrame, strict_pit: bool = False) -> DataFrame:
    """(entity, last_zero, prior_zero, any_debt): whether the last debt reported by ``as_of``, or by each entity's earlier ``day``, was zero, and whether any ever was.

    The last of each concept counts. The third looks at the whole record, filed later or not; with ``strict_pit`` only at
    what was filed by ``as_of``.
    """
    named = [c for item in DEBT_ITEMS for c in LINE_ITEMS[item]]
    tagged = tagged_facts(facts.where(F.col("concept").isin(named)), as_of)
    own = tagged.where(F.col("item").isin(DEBT_ITEMS) & F.col("start").isNull() & F.col("val").isNotNull())
    own = own.where(F.col("end") <= F.to_date(F.lit(as_of))).join(back, "entity", "left")
    zero_on = lambda ok: F.max_by("zero", F.when(ok, F.col("end")))
    days = own.groupBy("entity", "day", "end").agg(F.bool_and(F.col("val") == 0).alias("zero"))
    zero = days.groupBy("entity").agg(zero_on(F.lit(True)).alias("last_zero"), zero_on(F.col("end") <= F.col("day")).alias("prior_zero"))
    gaap = facts.where("taxonomy = 'us-gaap'")
    ever = ever_reported(gaap, DEBT_LIKE, DEBT_NOISE, as_of if strict_pit else None)
    sliced = t.visible(facts.where(F.col("concept").isin(DEBT_SLICES) & F.col("start").isNull()), as_of, t.FORMS, t.UNITS).select("entity")
    any_debt = ever.unionByName(sliced).distinct().withColumn("any_debt", F.lit(True))
    return zero.join(any_debt, "entity", "full_outer")


def _yearly_move(q: DataFrame, lo: int = 350, hi: int = 380) -> DataFrame:
    return t.year_ago(q, BY_ITEM, "end", "val", lo, hi)


def _last(q: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy(*BY_ITEM).orderBy(F.desc("end"))
    return q.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)


def _family(item: Column | str = "item") -> Column:
    return F.split_part(F.col(item) if isinstance(item, str) else item, F.lit(":"), F.lit(1))


def one_offs(items: DataFrame) -> DataFrame:
    """(entity, kind, end, concept, val): the largest one-off of each kind that one concept has in the trailing year; of equal ones the first concept's, then the earlier."""
    tagged = items.where(_family().isin(*BY_CONCEPT) & F.col("start").isNotNull() & (F.col("val") > 0))
    inside = tagged.where(F.datediff("anchor", "end").between(0, WINDOW))
    place = F.array_position(F.array(*(F.lit(c) for kind in BY_CONCEPT for c in LINE_ITEMS[kind])), F.col("concept"))
    most = F.max_by(F.struct("end", "concept", "val"), F.struct("val", -place, -F.unix_date("end")))
    return inside.groupBy("entity", _family().alias("kind")).agg(most.alias("x")).select("entity", "kind", "x.*")


def _net_one_offs(rows: DataFrame) -> DataFrame:
    """(entity, end, off): charges less gains of each period (entity, item, end, val); of a kind the largest counts, as concepts nest."""
    most = rows.where(_family().isin(*BY_CONCEPT) & (F.col("val") > 0)).groupBy("entity", "end", _family().alias("kind")).agg(F.max("val").alias("val"))
    return most.groupBy("entity", "end").agg(F.sum(F.when(F.col("kind") == "one_off_charge", F.col("val")).otherwise(-F.col("val"))).alias("off"))


def shown_moves(q: DataFrame, items: dict[str, str]) -> DataFrame:
    """(entity, a column for each item): year-on-year moves (move, val) of the last four quarters, where there are eight quarters."""
    w = Window.partitionBy(*BY_ITEM)
    own = q.where(F.col("item").isin(*items)).withColumn("_n", F.count("*").over(w))
    last = _last(_yearly_move(own), 4).where("_n >= 8 and val_year_ago is not null")
    pair = F.struct((F.col("val") - F.col("val_year_ago")).alias("move"), F.col("val").alias("val"))
    of = lambda item: F.collect_list(F.when(F.col("item") == item, pair))
    return last.groupBy("entity").agg(*(F.when(F.size(of(item)) > 0, of(item)).alias(name) for item, name in items.items()))


def without_one_offs(value: Column, gain: Column, charge: Column, moves: Column, base: Column, tax: Column, gain_in_line: bool) -> Column:
    """A figure without the one-offs that its own line shows, if together they are material: (value, gain, charge).

    ``gain`` and ``charge`` are what was taken out, before tax, and null where nothing was.
    """
    shows = lambda x, sign, also: F.coalesce(F.exists(moves, lambda m: (m["move"] * sign >= CONFIRM * x) & also(m)), F.lit(False))
    g, c = gain * (1 - tax), charge * (1 - tax)
    has_gain = (g > 0) & shows(g, 1, (lambda m: m["val"] >= g) if gain_in_line else (lambda m: F.lit(True)))
    has_charge = (c > 0) & shows(c, -1, lambda m: F.lit(True))
    net = F.when(has_charge, c).otherwise(0.0) - F.when(has_gain, g).otherwise(0.0)
    counts = F.coalesce((net != 0) & (base > 0) & (F.abs(net) >= MATERIAL * base), F.lit(False))
    return F.struct(
        F.when(counts, value + net).otherwise(value).alias("value"),
        F.when(counts & has_gain & value.isNotNull(), gain).alias("gain"),
        F.when(counts & has_charge & value.isNotNull(), charge).alias("charge"),
    )


def normalised(value: Column, gain: Column, charge: Column, moves: Column, base: Column, tax: Column, gain_in_line: bool) -> Column:
    """The figure alone."""
    return without_one_offs(value, gain, charge, moves, base, tax, gain_in_line)["value"]


def qualifying(periods: DataFrame, tax: DataFrame) -> DataFrame:
    """Periods (entity, item, end, val, off) with one-offs taken out where they distort, after tax.

    An item counts if it is worth a quarter of its period and a typical period, and
    the line moves with it. If more than a third of the periods have one, none counts.
    """
    w = Window.partitionBy(*BY_ITEM)
    p = t.year_ago(periods, BY_ITEM, "end", "val", pick="first").join(tax, "entity", "left")
    p = p.withColumns({"_a": F.coalesce(F.col("off") * (1 - or_zero("tax")), F.lit(0.0)), "_typ": F.median(F.abs("val")).over(w), "_n": F.count("*").over(w)})
    big = (F.col("_a") != 0) & (F.abs("_a") >= F.greatest(MATERIAL * F.abs("val"), F.col("_typ")))
    seen = (F.col("val_year_ago") - F.col("val")) * F.signum("_a") >= 0.5 * F.abs("_a")
    p = p.withColumn("_q", F.coalesce(big & seen, F.lit(False)))
    p = p.withColumn("_many", F.sum(F.col("_q").cast("int")).over(w) > F.greatest(F.lit(1.0), F.col("_n") / 3))
    return p.select(*BY_ITEM, "end", F.when(F.col("_q") & ~F.col("_many"), F.col("val") + F.col("_a")).otherwise(F.col("val")).alias("val"))


def _nearest(among: Column, day: Column, within: int) -> Column:
    """Of structs (day, val) the one nearest to a day, of equally near ones the earlier; as (gap, day, val)."""
    near = F.filter(among, lambda x: F.abs(F.datediff(x["day"], day)) <= within)
    return F.array_min(F.transform(near, lambda x: F.struct(F.abs(F.datediff(x["day"], day)).alias("gap"), x["day"].alias("day"), x["val"].alias("val"))))


def asset_days(items: DataFrame) -> DataFrame:
    """(entity, _days): total assets as (day, val). An entity has some eighty balance sheets, which are gathered."""
    own = items.where("item = 'assets' and start is null and val is not null")
    return own.groupBy("entity").agg(F.collect_list(F.struct(F.col("end").alias("day"), "val")).alias("_days"))


def _assets_near(points: DataFrame, days: DataFrame, within: int) -> DataFrame:
    """Points (entity, end, ...) with the total assets nearest to their end."""
    return points.join(days, "entity", "left").withColumn("assets", _nearest(F.col("_days"), F.col("end"), within)["val"]).drop("_days")


def _current(points: DataFrame, anchor: DataFrame) -> DataFrame:
    """Series with their last end, where that is current."""
    last = F.max("end").over(Window.partitionBy("entity"))
    return points.withColumn("last", last).join(anchor, "entity").where(F.datediff("anchor", "last") <= CURRENT_DAYS).drop("anchor")


def _ttm_points(q: DataFrame, item: str) -> DataFrame:
    return t.rolling_sum4(q.where(F.col("item") == item), BY_ITEM, "end", "val").where("val_ttm is not null").select("entity", "end", F.col("val_ttm").alias("ttm"))


def _years(years: DataFrame, item: str, count: int) -> DataFrame:
    """(entity, k, end, val): an item's fiscal years (entity, item, years), the newest first."""
    rows = years.where(F.col("item") == item).select("entity", F.posexplode(F.slice("years", 1, count)).alias("k", "y"))
    return rows.select("entity", "k", "y.end", "y.val")


def _disagree(q: DataFrame, years: DataFrame, item: str, since: DataFrame) -> DataFrame:
    """Entities whose quarters disagree with a fiscal year that ends at or after ``since``."""
    ends = _years(years, item, 5).join(since, "entity").where("end >= since and val <> 0")
    return t.quarters_match_years(q.where(F.col("item") == item).select("entity", "end", "val"), ends, ["entity"], AGREE).where("not matches").select("entity")


def _slope(points: DataFrame, y: Column) -> DataFrame:
    x = F.datediff("end", F.lit("1970-01-01").cast("date")) / F.lit(365.25)
    return points.groupBy("entity").agg(stats.slope(y, x).alias("slope"), F.count("*").alias("n"), F.min("end").alias("from"), F.min_by("ttm", "end").alias("base"), F.min("ttm").alias("least"))


def revenue_growth(q: DataFrame, years: DataFrame, anchor: DataFrame) -> DataFrame:
    """(entity, trend, latest): yearly growth along the line of log trailing revenue, and the latest year's change."""
    points = _current(_ttm_points(q, "revenue"), anchor)
    near = points.where(F.datediff("last", "end") <= 365 * TREND_YEARS + 30)
    fit = _slope(near, F.log(F.when(F.col("ttm") > 0, F.col("ttm"))))
    fit = fit.where((F.col("n") >= TREND_POINTS) & (F.col("least") > 0) & (F.col("base") >= TREND_BASE))
    bad = _disagree(q, years, "revenue", fit.select("entity", F.date_sub("from", 280).alias("since")))
    trend = fit.join(bad, "entity", "left_anti").select("entity", (F.exp("slope") - 1).alias("trend"))
    moved = t.year_ago(points, ["entity"], "end", "ttm").where("end = last")
    enough = points.groupBy("entity").agg(F.count("*").alias("_c")).where("_c >= 5").select("entity")
    latest = moved.join(enough, "entity", "left_semi").select("entity", F.when(F.col("ttm_year_ago") > 0, F.col("ttm") / F.col("ttm_year_ago") - 1).alias("latest"))
    return trend.join(latest, "entity", "full_outer")


def operating_income_change(q: DataFrame, years: DataFrame, days: DataFrame, anchor: DataFrame) -> DataFrame:
    """(entity, op_inc_change): four times the median yearly change of the last four quarters, over mean assets."""
    own = _current(q.where("item = 'operating_income'"), anchor)
    last = _last(_yearly_move(own, 355, 375), 8)
    four = F.col("_k") <= 4
    got = last.groupBy("entity").agg(
        F.count(F.when(four, F.col("val_year_ago"))).alias("n"), F.median(F.when(four, F.col("val") - F.col("val_year_ago"))).alias("m"), F.max("end").alias("end"), F.min("end").alias("since")
    ).where("n = 4")
    got = got.join(_disagree(q, years, "operating_income", got.select("entity", "since")), "entity", "left_anti")
    now = _assets_near(got, days, 10).withColumnRenamed("assets", "a1")
    then = _assets_near(now.withColumn("end", F.date_sub("end", 365)), days, 10).where("a1 <> 0 and assets <> 0 and a1 + assets > 0")
    return then.select("entity", safe_div(4 * F.col("m"), (F.col("a1") + F.col("assets")) / 2).alias("op_inc_change"))


def gross_profit_trend(q: DataFrame, years: DataFrame, days: DataFrame, anchor: DataFrame) -> DataFrame:
    """(entity, gp_trend): the three-year change along the line of trailing gross profit over assets of the same date.

    Gross profit is revenue less cost where there are enough quarters of both, else as reported. The quarters must agree with
    the fiscal years of revenue and cost, and the trailing gross profit at a year's end with that year's.
    """
    r = q.where("item = 'revenue'").select("entity", "end", F.col("val").alias("_r"))
    made = r.join(q.where("item = 'cost'").select("entity", "end", F.col("val").alias("_c")), ["entity", "end"]).select("entity", "end", (F.col("_r") - F.col("_c")).alias("val"))
    enough = made.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= TREND_POINTS + 3).select("entity")
    tagged = q.where("item = 'gross_profit'").select("entity", "end", "val").join(enough, "entity", "left_anti")
    gross = made.join(enough, "entity", "left_semi").unionByName(tagged)
    points = _current(t.rolling_sum4(gross, ["entity"], "end", "val").where("val_ttm is not null").select("entity", "end", F.col("val_ttm").alias("ttm")), anchor)
    near = _assets_near(points.where(F.datediff("last", "end") <= 365 * TREND_YEARS + 30), days, 10).where("assets > 0")
    fit = _slope(near.withColumn("ttm", F.col("ttm") / F.col("assets")), F.col("ttm"))
    most = near.groupBy("entity").agg(F.max(F.abs(F.col("ttm") / F.col("assets"))).alias("_m"))
    fit = fit.join(most, "entity").where((F.col("n") >= TREND_POINTS) & (F.col("_m") <= 3))
    since = fit.select("entity", F.date_sub("from", 280).alias("since"))
    bad = _disagree(q, years, "revenue", since).unionByName(_disagree(q, years, "cost", since.join(enough, "entity", "left_semi")))

    year = lambda item, name: _years(years, item, 5).select("entity", "end", F.col("val").alias(name))
    ends = year("revenue", "revenue").join(since, "entity").where("end >= since and revenue <> 0")
    ends = ends.join(year("cost", "cost"), ["entity", "end"], "left").join(year("gross_profit", "gross"), ["entity", "end"], "left")
    ends = ends.join(enough.withColumn("_made", F.lit(True)), "entity", "left")
    expected = F.when(F.col("_made") & F.col("cost").isNotNull(), F.col("revenue") - F.col("cost")).otherwise(F.col("gross"))
    at = ends.select("entity", F.col("end").alias("year_end"), "revenue", expected.alias("expected")).where("expected is not null").join(points.select("entity", "end", "ttm"), "entity")
    at = at.where(F.abs(F.datediff("end", "year_end")) <= 10).groupBy("entity", "year_end", "revenue", "expected").agg(F.min_by("ttm", "end").alias("ttm"))
    off = at.where(F.abs(F.col("ttm") - F.col("expected")) > AGREE * F.abs("revenue")).select("entity")
    return fit.join(bad.unionByName(off), "entity", "left_anti").select("entity", (F.col("slope") * TREND_YEARS).alias("gp_trend"))


def earnings_variability(q: DataFrame, years: DataFrame, days: DataFrame, anchor: DataFrame, tax: DataFrame) -> DataFrame:
    """(entity, earn_var): scatter of five twelve-month returns on assets, else of five fiscal years'."""
    ni = q.where("item = 'net_income'")
    adjusted = qualifying(_last(ni, 21).drop("_k").join(_net_one_offs(q), ["entity", "end"], "left"), tax)
    older = ni.join(adjusted.select(*BY_ITEM, "end"), [*BY_ITEM, "end"], "left_anti").select(*BY_ITEM, "end", "val")
    points = _current(_ttm_points(adjusted.unionByName(older), "net_income"), anchor)
    series = points.groupBy("entity").agg(F.max("last").alias("at"), F.collect_list(F.struct(F.col("end").alias("day"), F.col("ttm").alias("val"))).alias("_days"))
    near = t.anniversaries(series, ["entity", "_days"], "at").withColumn("_x", _nearest(F.col("_days"), F.col("target"), 20))
    near = near.where("_x is not null").select("entity", "k", F.col("_x.day").alias("end"), F.col("_x.val").alias("ttm"))
    roa = _assets_near(near, days, 10).where("assets > 0")
    five = roa.groupBy("entity").agg(stats.trend_dispersion(F.col("ttm") / F.col("assets"), -F.col("k")).alias("v"), F.count("*").alias("n")).where("n = 5").select("entity", "v")
    five_years = _years(years, "net_income", 5).withColumn("item", F.lit("net_income"))
    offs = _net_one_offs(years.where(_family().isin(*BY_CONCEPT)).select(*BY_ITEM, F.inline("years")))
    yearly = qualifying(five_years.select(*BY_ITEM, "end", "val").join(offs, ["entity", "end"], "left"), tax).join(five_years.select("entity", "end", "k"), ["entity", "end"])
    fy = _assets_near(yearly.select("entity", "end", "k", "val"), days, 45).where("assets <> 0").groupBy("entity")
    fy = fy.agg(stats.trend_dispersion(F.col("val") / F.col("assets"), -F.col("k")).alias("fy"), F.count("*").alias("n")).where("n >= 5").select("entity", "fy")
    return five.join(fy, "entity", "full_outer").select("entity", F.coalesce("v", "fy").alias("earn_var"))


def annual_gpoa(years: DataFrame, days: DataFrame) -> DataFrame:
    """(entity, k, gpoa, margin, revenue) of fiscal years 0 and 3: gross profit over assets near the year's end.

    The cost of the same end counts, else the newest year's within 20 days.
    """
    r = _years(years, "revenue", 6).where("k in (0, 3)").select("entity", "k", "end", F.col("val").alias("revenue"))
    c = _years(years, "cost", 6).select("entity", F.col("end").alias("day"), F.col("val").alias("cost"))
    close = r.join(c, "entity").where(F.abs(F.datediff("day", "end")) <= 20)
    met = close.groupBy("entity", "k", "end", "revenue").agg(
        F.coalesce(F.max_by("cost", F.when(F.col("day") == F.col("end"), F.col("day"))), F.max_by("cost", "day")).alias("cost"), F.max_by("cost", "day").alias("near_cost")
    )
    both = _assets_near(met, days, 45)
    gpoa = safe_div(F.col("revenue") - F.col("cost"), "assets")
    return both.select("entity", "k", gpoa.alias("gpoa"), safe_div(F.col("revenue") - F.col("near_cost"), "revenue").alias("margin"), "revenue")


def entity_rows(facts: DataFrame, listings: DataFrame, as_of: str, strict_pit: bool = False) -> tuple[DataFrame, DataFrame]:
    """One row an entity with all that the measures need, maps of instants, earlier instants, trailing and fiscal years, and trends; and (entity, earn_var).

    ``facts``: entity, taxonomy, concept, unit, start, end, val, filed, accn, form, seq. ``listings``: entity, market_cap.
    ``strict_pit`` keeps later filings out of the never-borrowed rule as well.

    Every part is a long table by entity; those of one shape are united and gathered by one aggregation, so that the row is
    made by a few joins on one key.
    """
    anchor = dealt(anchors(facts, as_of))
    groups = dealt(gathered_items(resolve_items(tagged_facts(facts, as_of)), anchor))  # read by every branch below
    items = spread_items(groups)
    now = _newest_instants(items, as_of)
    fresh = t.fresh(F.col("end"), F.col("anchor"))
    back = dealt(now.where(fresh & (F.col("item") == "assets")).select("entity", F.date_sub("end", 365).alias("day")))
    in_quarters = F.col("item").isin(QUARTERLY_ITEMS) | _family().isin(*BY_CONCEPT)
    q = written(t.quarters_of(groups.where(in_quarters), BY_ITEM)).select(*BY_ITEM, F.inline("quarters"))
    trailing = t.trailing_of(groups, BY_ITEM, SOURCE, stale=True)
    years = dealt(t.years_of(groups, BY_ITEM, carry=("concept",)))
    days = dealt(asset_days(items))
    # One shape for all: where a figure is too old, its tag and date go to the audit instead.
    shape = {"end": "date", "concept": "string", "val": "double", "basis": "string", "filed": "date", "accn": "string", "form": "string"}

    def part(rows: DataFrame, kind: Column | str, **given: Column) -> DataFrame:
        x = F.struct(*((given[c] if c in given else F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in shape.items()))
        return rows.select(*BY_ITEM, (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), x.alias("x"))

    of_debt, looked_at = F.col("item").isin(DEBT_ITEMS), F.col("item").isin(ANNUAL_ITEMS) | _family().isin(*BY_CONCEPT)
    prior = instants_at(items, back)
    parts = [
        part(now, F.when(fresh, "inst").otherwise("stale")),
        part(prior, F.when(t.fresh(F.col("end"), F.col("day")), "prior").when(of_debt, "stale")),
        part(instants_near(items, back, ["equity", "cash", "assets"]), "near"),
        part(trailing, F.when(F.col("stale"), "stale").otherwise("last")),
        part(years.where(looked_at & (F.size("years") == 0)).select(*BY_ITEM, "newest.*"), "stale"),
        part(one_offs(items).withColumnRenamed("kind", "item"), "off"),
    ]
    long = reduce(DataFrame.unionByName, parts).withColumn("years", F.lit(None).cast(years.schema["years"].dataType))
    long = long.unionByName(years.select(*BY_ITEM, F.lit("years").alias("kind"), F.lit(None).cast(long.schema["x"].dataType).alias("x"), "years"))
    of = lambda kind, value: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("item", F.col(value).alias("v")))))
    maps = long.groupBy("entity").agg(
        *(of(kind, "x").alias(kind) for kind in ("inst", "prior", "near", "last", "off")),
        of("years", "years").alias("years"),
        F.collect_list(F.when(F.col("kind") == "stale", F.struct("x.concept", F.col("x.end").alias("end")))).alias("stale"),
    )
    maps = maps.withColumn("ttm", F.transform_values("last", lambda _, x: x["val"]))

    ends = annual_gpoa(years, days).groupBy("entity").agg(*(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{k}_{c}") for k in (0, 3) for c in ("gpoa", "margin", "revenue")))
    scalars = [revenue_growth(q, years, anchor), operating_income_change(q, years, days, anchor), gross_profit_trend(q, years, days, anchor), ends, unexpected_earnings(items.where("start is not null"))]
    named = [c for part in scalars for c in part.columns if c != "entity"]
    lines = None
    for part in scalars:
        line = part.unpivot("entity", [c for c in part.columns if c != "entity"], "name", "value")
        lines = line if lines is None else lines.unionByName(line)
    calc = lines.groupBy("entity").agg(*(F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in named))

    wide = listings.select("entity", "market_cap")
    for part in (
        anchor,
        maps,
        calc,
        shown_moves(q, {"operating_income": "op_moves", "net_income": "ni_moves"}),
        debt_history(facts, as_of, back, strict_pit),
    ):
        wide = wide.join(part, "entity", "left")
    wide = materialised(by_entity(wide))
    tax = wide.select("entity", effective_tax().alias("tax"))
    return wide, earnings_variability(q, years, days, anchor, tax)


def _i(k: str) -> Column:
    return F.col("inst")[k]["val"]


def _t(k: str) -> Column:
    return F.col("ttm")[k]


def _y(item: str, k: int) -> Column:
    return F.try_element_at(F.col("years")[item], F.lit(k + 1))["val"]


def effective_tax(settings: Settings = Settings()) -> Column:  # noqa: B008
    rate = F.when(_t("pretax") > 0, safe_div(_t("tax"), _t("pretax")))
    return F.coalesce(clamp(rate, *settings.tax_clamp), F.lit(settings.default_tax))


def notes() -> Column:
    """Notes on a wide row: one-offs taken out of a figure, a return on closing capital alone, and tags left for being too old.

    An array of NOTE. An ignored tag comes with its newest date, each once.
    """
    c = F.col

    def note(metric: str, kind: str, when: Column, tag: Column, end: Column, amount: Column) -> Column:
        none = F.lit(None)
        x = F.struct(F.lit(metric).alias("metric"), F.lit(kind).alias("kind"), *(none if v is None else v for v in (tag, end, amount)))
        return F.when(when, x.cast(NOTE))

    made = []
    for metric, off in (("ebit", "_ebit_off"), ("net_income", "_ni_off")):
        for kind in ("gain", "charge"):
            x = c("off")[f"one_off_{kind}"]
            made.append(note(metric, f"one_off_{kind}", c(off)[kind].isNotNull(), x["concept"], x["end"], c(off)[kind]))
    closing = c("ebit").isNotNull() & c("_close_ic").isNotNull() & c("_open_ic").isNull()
    made.append(note("roic", "closing_capital", closing, F.lit(None), F.lit(None), F.lit(None)))
    newest = F.transform(F.array_distinct(c("stale.concept")), lambda k: F.struct(k.alias("tag"), F.array_max(F.filter(c("stale"), lambda x: x["concept"] == k)["end"]).alias("end")))
    ignored = F.transform(newest, lambda x: F.struct(F.lit("inputs").alias("metric"), F.lit("ignored_tag").alias("kind"), x["tag"], x["end"], F.lit(None)).cast(NOTE))
    return F.concat(F.filter(F.array(*made), lambda x: x.isNotNull()), F.coalesce(ignored, F.array().cast(f"array<{NOTE}>")))


def measure_columns(settings: Settings = Settings(), symmetric: bool = False) -> list[tuple[str, Column]]:  # noqa: B008
    """Names and expressions, in order; later ones use earlier ones by name.

    ``symmetric`` averages trend and latest year wherever they differ, instead of only where revenue fell.
    """
    c, cap = F.col, F.nullif(F.col("market_cap"), F.lit(0.0))
    debt, how = total_debt("inst")
    prior_debt, _ = total_debt("prior")
    zero, prior_zero = (F.coalesce(c(x), F.lit(False)) for x in ("last_zero", "prior_zero"))
    p, near = (lambda k: c("prior")[k]["val"]), (lambda k: c("near")[k]["val"])
    clear = ~F.coalesce(c("any_debt"), F.lit(False)) & c("anchor").isNotNull()
    never = c("last_zero").isNull() & clear & _i("equity").isNotNull() & _i("assets").isNotNull()
    prior_never = c("prior_zero").isNull() & clear & p("equity").isNotNull() & p("assets").isNotNull()
    step = lambda item: (_y(item, 0) - _y(item, 3)) / c("assets") / 3
    cagr = lambda item: F.when((_y(item, 3) > 0) & (_y(item, 0) > 0), F.pow(_y(item, 0) / _y(item, 3), F.lit(1 / 3)) - 1)
    fallen = c("latest").isNotNull() if symmetric else (c("latest") < c("_growth")) & (c("latest") < 0)
    swing = (F.abs(c("0_margin") - c("3_margin")) > MARGIN_SWING) & (c("0_revenue") >= TREND_BASE) & (c("3_revenue") >= TREND_BASE)
    tangible = c("equity") - or_zero(_i("preferred")) - _i("goodwill") - or_zero(_i("intangibles"))
    ev_ok = lambda x: F.when(c("ev") > 0, x / c("ev"))
    ebit_base = F.greatest(F.abs(c("_ebit")), 0.02 * or_zero(_t("revenue")))
    ni_base = F.greatest(F.abs(_t("net_income")), 0.02 * or_zero(_t("revenue")), 0.005 * or_zero(_i("assets")))
    made = {
        "OperatingIncomeLoss": _t("operating_income"),
        "derived: Rev - COGS - OpEx": _t("revenue") - _t("cost") - _t("operating_expense"),
        "derived: Rev - CostsAndExpenses": _t("revenue") - _t("costs_and_expenses"),
        "derived: pretax income + interest expense": _t("pretax") + _t("interest"),
    }
    source = F.coalesce(*(F.when(v.isNotNull(), F.lit(k)) for k, v in made.items()), F.lit("unresolved"))
    lead = F.when(_t("operating_income").isNotNull(), c("last")["operating_income"]).when(F.coalesce(*list(made.values())[1:3]).isNotNull(), c("last")["revenue"])
    lead = F.coalesce(lead.when(made["derived: pretax income + interest expense"].isNotNull(), c("last")["pretax"]), c("last")["revenue"], c("inst")["assets"])
    gross = F.when((_t("revenue") - _t("cost")).isNotNull(), F.concat(F.lit("Rev - "), c("last")["cost"]["concept"])).when(_t("gross_profit").isNotNull(), "GrossProfit").otherwise("unresolved")
    same_year = c("last")["net_income"]["end"] == c("last")["ocf"]["end"]
    off = lambda kind: or_zero(c("off")[f"one_off_{kind}"]["val"])
    as_it_is = lambda v: F.struct(v.alias("value"), F.lit(None).cast("double").alias("gain"), F.lit(None).cast("double").alias("charge"))
    mean_assets = F.coalesce((_i("assets") + F.nullif(near("assets"), F.lit(0.0))) / 2, _i("assets"))
    return [
        ("assets", F.nullif(_i("assets"), F.lit(0.0))), ("equity", _i("equity")), ("cash", or_zero(_i("cash"))),
        ("liabilities", F.coalesce(_i("liabilities"), _i("balance_total") - _i("equity"))),
        ("debt", F.coalesce(debt, F.when(zero | never, 0.0))),
        ("debt_path", F.coalesce(how, F.when(zero, "last-reported-zero").when(never, "no debt tag ever filed").otherwise("unresolved"))),
        ("tax_rate", effective_tax(settings)),
        ("gross_profit", F.coalesce(_t("revenue") - _t("cost"), _t("gross_profit"))), ("gross_profit_path", gross),
        ("_ebit", F.coalesce(*made.values())), ("ebit_path", source),
        ("_ebit_off", F.when(c("anchor").isNull(), as_it_is(c("_ebit"))).otherwise(without_one_offs(c("_ebit"), off("gain"), off("charge"), c("op_moves"), ebit_base, F.lit(0.0), True))),
        ("_ni_off", F.when(c("anchor").isNull(), as_it_is(_t("net_income"))).otherwise(without_one_offs(_t("net_income"), off("gain"), off("charge"), c("ni_moves"), ni_base, c("tax_rate"), False))),
        ("ebit", c("_ebit_off")["value"]), ("ni", c("_ni_off")["value"]),
        ("ebitda", c("ebit") + _t("da")), ("ffo", c("ni") + _t("da")), ("ev", cap + c("debt") - c("cash")),
        ("_prior_debt", F.coalesce(prior_debt, F.when(prior_zero | prior_never, 0.0))),
        ("_close_ic", c("debt") + c("equity") - c("cash")), ("_open_ic", c("_prior_debt") + near("equity") - or_zero(near("cash"))),
        ("roic", positive_ratio(c("ebit") * (1 - c("tax_rate")), F.coalesce((c("_close_ic") + c("_open_ic")) / 2, c("_close_ic")))),
        ("gpoa", safe_div("gross_profit", "assets")),
        ("delta_gpoa", F.coalesce(c("gp_trend"), F.when(~F.coalesce(swing, F.lit(False)), c("0_gpoa") - c("3_gpoa")))),
        ("ebit_ev", ev_ok(c("ebit"))), ("ebitda_ev", ev_ok(c("ebitda"))), ("fcf_ev", ev_ok(_t("ocf") - _t("capex"))),
        ("_growth", F.coalesce(c("trend"), cagr("revenue"))),
        ("rev_growth", F.when(fallen, (c("_growth") + c("latest")) / 2).otherwise(c("_growth"))),
        ("debt_equity", positive_ratio("debt", "equity")), ("net_debt_ebitda", positive_ratio(c("debt") - c("cash"), "ebitda")),
        ("altman_z", 6.56 * safe_div(_i("current_assets") - _i("current_liabilities"), "assets") + 3.26 * safe_div(_i("retained"), "assets") + 6.72 * safe_div("ebit", "assets") + 1.05 * safe_div("equity", "liabilities")),
        ("roe", positive_ratio("ni", "equity")), ("roa", safe_div("ni", "assets")), ("earn_yield", safe_div("ni", cap)),
        ("book_yield", F.when(c("equity") > 0, safe_div("equity", cap))), ("equity_assets", safe_div("equity", "assets")),
        ("ffo_assets", safe_div("ffo", "assets")), ("ffo_yield", safe_div("ffo", cap)), ("debt_assets", safe_div("debt", "assets")),
        ("net_debt_ffo", positive_ratio(c("debt") - c("cash"), "ffo")),
        ("profit_growth", step("net_income")), ("ffo_growth", step("net_income") + or_zero(step("da"))),
        ("_bank_revenue", _t("nii") + _t("noninterest_income")), ("efficiency", positive_ratio(_t("noninterest_expense"), "_bank_revenue")),
        ("credit_cost", positive_ratio(_t("provision"), "_bank_revenue")), ("nii_growth", step("nii")), ("nii_assets", safe_div(_t("nii"), "assets")),
        ("tbv_yield", F.when(tangible > 0, safe_div(tangible, cap))), ("rotce", F.when(cap.isNotNull(), positive_ratio("ni", tangible))),
        ("loss_ratio", positive_ratio(_t("claims"), _t("premiums"))), ("cost_ratio", positive_ratio(_t("benefits"), _t("revenue"))),
        ("invest_yield", safe_div(_t("investment_income"), "assets")), ("premium_growth", cagr("premiums")),
        ("reserves_equity", positive_ratio(_i("reserves"), "equity")),
        ("op_margin", positive_ratio(_t("operating_income"), _t("revenue"))), ("net_margin", positive_ratio("ni", _t("revenue"))),
        ("comp_ratio", positive_ratio(_t("compensation"), _t("revenue"))), ("is_fund", _i("fund_holdings").isNotNull()),
        ("net_payout_yield", F.when(_t("ocf").isNotNull(), safe_div(or_zero(_t("bought")) - or_zero(_t("issued")), cap))),
        ("accruals", F.when(same_year, positive_ratio(_t("net_income") - _t("ocf"), mean_assets))),
        ("raw_inputs", F.struct("assets", "equity", "cash", "debt", "ebit", _t("da").alias("da"), _t("ocf").alias("ocf"), _t("capex").alias("capex"), "gross_profit", "market_cap", "ev")),
        ("notes", notes()),
        ("asof", lead["end"]), ("filed", lead["filed"]), ("accn", lead["accn"]), ("form", lead["form"]), ("basis", lead["basis"]),
    ]


#: Columns beside the measures: what segments, screens and provenance need.
HELPERS = [
    "nii_assets", "tbv_yield", "rotce", "is_fund", "net_payout_yield", "accruals", "sue", "debt", "debt_path", "ebit", "ebit_path", "ni", "equity", "assets",
    "cash", "liabilities", "ebitda", "ffo", "ev", "revenue_ttm", "gross_profit", "gross_profit_path", "tax_rate", "anchor", "asof", "filed", "accn", "form", "basis",
    "raw_inputs", "notes",
]


def measures(facts: DataFrame, listings: DataFrame, as_of: str, settings: Settings = Settings(), symmetric: bool = False, strict_pit: bool = False) -> DataFrame:  # noqa: B008
    """One wide row an entity: every measure but ``ptbv_gap``, which a peer group gives, helpers and where the figures came from."""
    wide, scatter = entity_rows(facts, listings, as_of, strict_pit)
    rows = wide.withColumn("revenue_ttm", _t("revenue"))  # over a table as it is, so that each step is analysed in no time
    for name, value in measure_columns(settings, symmetric):
        rows = rows.withColumn(name, value)
    rows = rows.join(scatter, "entity", "left")
    return rows.select("entity", "market_cap", *(m.key for m in METRICS if m.key in rows.columns), *HELPERS)


def note_rows(wide: DataFrame) -> DataFrame:
    """(entity, metric, kind, tag, end, amount): the notes of wide rows, one a row."""
    return wide.select("entity", F.inline("notes"))


def ignored_tags(wide: DataFrame) -> DataFrame:
    """(entity, concept, last_reported): the audit of the freshness rule, the newest rejected date of each tag."""
    return note_rows(wide).where("kind = 'ignored_tag'").select("entity", F.col("tag").alias("concept"), F.col("end").alias("last_reported"))


#: What a measure is made of, where nothing more is known of why it is missing.
MADE_OF = {
    "ebit_ev": "EBIT", "ebitda_ev": "EBIT and depreciation", "fcf_ev": "operating cash flow and capital expenditure", "gpoa": "gross profit and assets", "roe": "earnings and equity above nil",
    "roa": "earnings and assets", "earn_yield": "earnings and market value", "book_yield": "equity above nil and market value", "equity_assets": "equity and assets",
    "ffo_assets": "earnings, depreciation and assets", "ffo_yield": "funds from operations and market value", "debt_assets": "debt and assets", "net_debt_ffo": "debt and funds from operations above nil",
    "profit_growth": "four years of earnings, and assets", "ffo_growth": "four years of earnings, and assets", "ptbv_gap": "a peer group of banks with tangible book and returns",
}


def missing_reason(metric: Column) -> Column:
    """Why a measure is missing, from a wide row. An economic reason says ``negative`` or ``zero`` of its base, and no other does."""
    c, of, needs = F.col, lambda *keys: metric.isin(*keys), lambda what: F.lit(f"needs {what}")
    no_cap, no_debt = F.nullif("market_cap", F.lit(0.0)).isNull(), c("debt").isNull()
    cause = F.when(no_cap & no_debt, "market value and debt").when(no_debt, "debt").otherwise("market value")
    priced = of("ebit_ev", "ebitda_ev", "fcf_ev")
    reasons = [
        (of("debt_equity", "net_debt_ebitda") & no_debt, needs("debt")),
        (of("debt_equity") & c("equity").isNull(), needs("equity")),
        (of("debt_equity"), F.lit("equity is negative or zero")),
        (of("net_debt_ebitda") & c("ebitda").isNull(), needs("EBITDA")),
        (of("net_debt_ebitda"), F.lit("EBITDA is negative or zero")),
        (priced & c("ev").isNull(), F.concat(F.lit("needs an enterprise value, and there is no "), cause)),
        (priced & (c("ev") <= 0), F.lit("enterprise value is negative or zero")),
        (of("roic") & (c("ebit").isNull() | no_debt | c("equity").isNull()), needs("EBIT, debt and equity")),
        (of("roic"), F.lit("capital employed is negative or zero")),
        (of("altman_z") & (c("liabilities") == 0), F.lit("liabilities are zero")),
        *((of(k), needs(what)) for k, what in MADE_OF.items()),
    ]
    out = F.when(*reasons[0])
    for when, why in reasons[1:]:
        out = out.when(when, why)
    return out.otherwise("needs a figure that no filing tags")


def long_measures(wide: DataFrame) -> DataFrame:
    """(entity, metric, raw, reason): the wide rows unpivoted for scoring."""
    keys = [m.key for m in METRICS if m.key in wide.columns]
    keep = ["entity", "market_cap", "equity", "ebitda", "debt", "ebit", "ev", "liabilities"]
    long = wide.select(*keep, *(F.col(k).cast("double").alias(k) for k in keys)).unpivot(keep, keys, "metric", "raw")
    return long.select("entity", "metric", "raw", F.when(F.col("raw").isNull(), missing_reason(F.col("metric"))).alias("reason"))


def unexpected_earnings(flows: DataFrame) -> DataFrame:
    """(entity, sue): the last yearly change in quarterly earnings a share less its drift, over its scatter; 13 reported quarters at least."""
    w = Window.partitionBy("entity").orderBy("end", "start")
    own = flows.where((F.col("item") == "eps") & t.duration().between(80, 100)).select("entity", "start", "end", "val", (F.col("val") - F.lag("val", 4).over(w)).alias("yoy"))
    back = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("end"), F.desc("start")))
    own = own.withColumns({"_b": back, "_n": F.count("*").over(Window.partitionBy("entity"))}).where("_n >= 13 and _b <= 9")
    drift = F.avg(F.when(F.col("_b") >= 2, F.col("yoy")))
    scatter = F.stddev_samp(F.when(F.col("_b") <= 8, F.col("yoy")))
    last, eps = F.max(F.when(F.col("_b") == 1, F.col("yoy"))), F.max(F.when(F.col("_b") == 1, F.abs("val")))
    return own.groupBy("entity").agg(((last - drift) / F.greatest(scatter, 0.01 * eps, F.lit(0.01))).alias("sue"))
