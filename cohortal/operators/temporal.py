"""Point-in-time and sequence operators over long fact tables.

Facts are rows (entity, concept, start, end, val, filed, seq): ``start`` is null
for a balance-sheet instant and set for a flow. Everything groups by entity, so
one shuffle by entity serves a chain of these operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortal.functions.stats import half_up

#: The forms that may supply a figure, and the units.
FORMS = [
    "10-K", "10-K/A", "10-KT", "10-KT/A",
    "10-Q", "10-Q/A", "10-QT", "10-QT/A",
    "20-F", "20-F/A", "40-F", "40-F/A",
]
UNITS = ["USD", "pure", "shares"]
MAX_AGE, STITCHED_AGE = 300, 120


def visible(facts: DataFrame, as_of: str, forms: list[str] | None = None, units: list[str] | None = None) -> DataFrame:
    """Facts filed by ``as_of``, of allowed forms and units."""
    out = facts.where(F.col("filed") <= F.to_date(F.lit(as_of)))
    out = out.where(F.col("form").isin(forms)) if forms else out
    return out.where(F.col("unit").isin(units)) if units else out


def first_taxonomy(facts: DataFrame, order: list[str]) -> DataFrame:
    """Of each concept only the facts of the first taxonomy that has it, before any other filter."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("taxonomy")), F.lit(0))
    place = F.when(place > 0, place).otherwise(len(order) + 1)
    best = F.min(place).over(Window.partitionBy("entity", "concept"))
    return facts.withColumns({"_place": place, "_best": best}).where("_place = _best").drop("_place", "_best")


def latest_version(facts: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: the latest filed, of equally late ones the first seen."""
    w = Window.partitionBy(*key).orderBy(F.col("filed").desc(), F.col("seq").asc())
    return facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def priority_merge(facts: DataFrame, key: list[str], priority: str = "priority") -> DataFrame:
    """One row for each key: that of the concept of highest priority; others only fill gaps."""
    w = Window.partitionBy(*key).orderBy(F.col(priority).asc(), F.col("filed").desc(), F.col("seq").asc())
    return facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def largest_in_newest(facts: DataFrame, key: list[str], priority: str = "priority") -> DataFrame:
    """One row for each key: in the newest filing, the largest value; then priority."""
    w = Window.partitionBy(*key).orderBy(F.col("filed").desc(), F.col("val").desc_nulls_last(), F.col(priority).asc())
    return facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def asof(probes: DataFrame, facts: DataFrame, by: list[str], at: str, day: str, values: list[str]) -> DataFrame:
    """Each probe with the values of the latest fact on or before it.

    One union, one shuffle and one window: no range join. Facts and probes of one
    day meet, because facts sort first.
    """
    none = {c: F.lit(None) for c in values}
    rest = [c for c in probes.columns if c not in by]
    kind = F.struct(*(F.col(c) for c in values))
    left = probes.select(*by, F.col(at).alias("_day"), F.lit(1).alias("_probe"), F.struct(*rest).alias("_row"), F.lit(None).cast(facts.select(kind.alias("k")).schema["k"].dataType).alias("_fact"))
    right = facts.select(*by, F.col(day).alias("_day"), F.lit(0).alias("_probe"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), kind.alias("_fact"))
    w = Window.partitionBy(*by).orderBy("_day", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    seen = left.unionByName(right).withColumn("_fact", F.last("_fact", ignorenulls=True).over(w)).where("_probe = 1")
    return seen.select(*by, "_row.*", *(F.col(f"_fact.{c}").alias(c) for c in none))


def nearest(probes: DataFrame, facts: DataFrame, by: list[str], at: str, day: str, within: int, values: list[str]) -> DataFrame:
    """Each probe with the fact nearest in time, at most ``within`` days away; the earlier one on ties.

    Facts are replicated to the two day buckets they can serve, so that the join is
    on equal keys and its output is bounded by the window.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / (within + 1))
    key = [c for c in probes.columns]
    left = probes.withColumn("_b", bucket(F.col(at)))
    own = bucket(F.col(day))
    right = facts.select(*by, F.col(day).alias("_day"), *values, F.explode(F.array(own - 1, own, own + 1)).alias("_b"))
    gap = F.abs(F.datediff(F.col("_day"), F.col(at)))
    met = left.join(right, [*by, "_b"]).where(gap <= within)
    best = met.groupBy(*key).agg(F.min_by(F.struct(F.col("_day"), *values), F.struct(gap, F.col("_day"))).alias("_f"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return probes.alias("l").join(best.alias("r"), on, "left").select("l.*", F.col("_f._day").alias(f"nearest_{day}"), *(F.col(f"_f.{c}").alias(c) for c in values))


def fresh(day: Column, anchor: Column, max_age: int = MAX_AGE) -> Column:
    """Not older than the anchor by more than ``max_age`` days; without an anchor everything is fresh."""
    return anchor.isNull() | (day >= F.date_sub(anchor, max_age))


def stale_inputs(facts: DataFrame, anchor: DataFrame, by: list[str], max_age: int = MAX_AGE) -> DataFrame:
    """(by, last_reported): the newest date of each concept whose every value is too old."""
    last = facts.groupBy(*by).agg(F.max("end").alias("last_reported")).join(anchor, "entity")
    return last.where(~fresh(F.col("last_reported"), F.col("anchor"), max_age)).drop("anchor")


def year_ago(series: DataFrame, by: list[str], day: str, value: str, lo: int = 350, hi: int = 380, pick: str = "latest") -> DataFrame:
    """Each point with the value ``lo``..``hi`` days earlier: the latest such, or the first."""
    order = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*by).orderBy(order).rangeBetween(-hi, -lo)
    take = F.last(value).over(w) if pick == "latest" else F.first(value).over(w)
    return series.withColumn(f"{value}_year_ago", take)


def stub_synthesis(flows: DataFrame, by: list[str], lo: int = 80, hi: int = 400, carry: tuple[str, ...] = ()) -> DataFrame:
    """Flows of one start: the longer less the shorter gives the tail, where that lasts lo..hi days.

    ``since`` is the start of both; ``carry`` names columns taken from the longer one.
    """
    a, b = flows.alias("a"), flows.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*by, "start"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    tail = F.datediff("a.end", "b.end")
    return (
        a.join(b, on)
        .where(tail.between(lo, hi))
        .select(
            *(F.col(f"a.{c}").alias(c) for c in by),
            F.date_add("b.end", 1).alias("start"),
            F.col("a.end").alias("end"),
            (F.col("a.val") - F.col("b.val")).alias("val"),
            F.greatest("a.filed", "b.filed").alias("filed"),
            F.lit(True).alias("synthetic"),
            F.col("a.start").alias("since"),
            *(F.col(f"a.{c}").alias(c) for c in carry),
        )
    )


def duration(start: Column | str = "start", end: Column | str = "end") -> Column:
    """Days between both."""
    return F.datediff(end, start)


def gathered(rows: DataFrame, by: list[str], anchor: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(by, _f, _anchor): all of a group in one row, ``_f`` an array of (start, _s) and ``_s`` one of (end, val, filed, src); instants stand under a null start.

    ``src`` are the columns that are carried. Quarters, years and trailing years are read off such rows without another grouping.
    """
    day, src = F.lit(None).cast("date") if anchor is None else anchor, F.struct(*(carry or ["filed"]))
    starts = rows.groupBy(*by, "start").agg(F.collect_list(F.struct("end", "val", "filed", src.alias("src"))).alias("_s"), F.max(day).alias("_anchor"))
    return starts.groupBy(*by).agg(F.collect_list(F.struct("start", "_s")).alias("_f"), F.max("_anchor").alias("_anchor"))


def _first_of_each_end(rows: Column) -> Column:
    """Of structs whose first field is ``end`` the least of each end, sorted."""
    firsts = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["end"] != x["end"]))
    # A lambda's variable, so that the rows are sorted once and not for each of them.
    return F.get(F.transform(F.array(F.array_sort(rows)), firsts), F.lit(0))


def _of_flows(of: Callable[[Column], Column]) -> Column:
    """The array that ``of`` makes of each start, put together."""
    return F.flatten(F.transform(F.filter("_f", lambda g: g["start"].isNotNull()), of))


def _newest_first(filed: Column) -> Column:
    return F.coalesce(-F.unix_date(filed), F.lit(2**31 - 1))


def quarters_of(groups: DataFrame, by: list[str]) -> DataFrame:
    """(by, quarters): what ``quarterly_series`` gives, an array of (end, val) a group."""

    def quarter(a: Column, val: Column, filed: Column, tail: bool, since: Column, start: Column) -> Column:
        made = {"end": a["end"], "synthetic": F.lit(tail), "o": _newest_first(filed), "since": since, "start": start, "val": val}
        return F.struct(*(v.alias(k) for k, v in made.items()))

    def told(g: Column) -> Column:
        whole = F.filter(g["_s"], lambda a: duration(g["start"], a["end"]).between(80, 100))
        # A tail begins a day after the shorter flow ends, so that it lasts a day less than lies between both ends.
        shorter = lambda a: F.filter(g["_s"], lambda b: F.datediff(a["end"], b["end"]).between(81, 101))
        tails = F.transform(g["_s"], lambda a: F.transform(shorter(a), lambda b: quarter(a, a["val"] - b["val"], F.greatest(a["filed"], b["filed"]), True, g["start"], F.date_add(b["end"], 1))))
        return F.concat(F.transform(whole, lambda a: quarter(a, a["val"], a["filed"], False, g["start"], g["start"])), F.flatten(tails))

    years = _of_flows(lambda g: F.filter(g["_s"], lambda a: duration(g["start"], a["end"]).between(330, 400)))
    rows = groups.select(*by, _of_flows(told).alias("_q"), years.alias("_y"))
    # The years are a lambda's variable: named once, inside a lambda, the column would be replaced by what makes it, and all years looked for anew at each quarter.
    repeats = lambda q, among: F.exists(among, lambda y: (y["end"] == q["end"]) & y["val"].isNotNull() & (F.abs(q["val"] - y["val"]) <= 0.01 * F.abs(y["val"])))
    both = F.array(F.struct(F.col("_q").alias("q"), F.col("_y").alias("y")))
    kept = _first_of_each_end(F.get(F.transform(both, lambda x: F.filter(x["q"], lambda q: q["synthetic"] | ~repeats(q, x["y"]))), F.lit(0)))
    return rows.select(*by, F.transform(kept, lambda q: F.struct(q["end"].alias("end"), q["val"].alias("val"))).alias("quarters"))


def quarterly_series(flows: DataFrame, by: list[str]) -> DataFrame:
    """(by, end, val) of single quarters: reported ones and tails, without quarters that repeat the year's value.

    ``flows`` are the latest versions. A reported quarter beats a tail, then the newest filing counts, then the first start.
    """
    return quarters_of(gathered(flows, by), by).select(*by, F.inline("quarters"))


def far_from_last_kept(rows: Column, gap: int = 200) -> Column:
    """Of structs sorted newest first (field ``end``), those at least ``gap`` days from the last one kept."""
    return F.aggregate(
        rows,
        F.slice(rows, 1, 0),
        lambda kept, x: F.when(
            (F.size(kept) == 0) | (F.datediff(F.element_at(kept, -1)["end"], x["end"]) >= gap), F.concat(kept, F.array(x))
        ).otherwise(kept),
    )


def annual_series(flows: DataFrame, by: list[str], anchor: Column | None = None, count: int = 6, carry: tuple[str, ...] = ()) -> DataFrame:
    """(by, years, newest): up to ``count`` years newest first, as structs (end, val, filed, carry); a stale newest year empties them.

    ``newest`` is the newest year, stale or not. ``anchor`` is a column of ``flows``, one date for each group. Of years of one end the latest filed counts, then the first start.
    """
    return years_of(gathered(flows, by, anchor, carry), by, count, carry)


def years_of(groups: DataFrame, by: list[str], count: int = 6, carry: tuple[str, ...] = ()) -> DataFrame:
    """What ``annual_series`` gives, of gathered rows."""

    whole = lambda g: lambda a: duration(g["start"], a["end"]).between(330, 400)

    def told(g: Column) -> Column:
        made = lambda a: {"end": a["end"], "o": _newest_first(a["filed"]), "start": g["start"], "val": a["val"], "filed": a["filed"], **{c: a["src"][c] for c in carry}}
        return F.transform(F.filter(g["_s"], whole(g)), lambda a: F.struct(*(v.alias(k) for k, v in made(a).items())))

    one = F.transform(_first_of_each_end(_of_flows(told)), lambda y: F.struct(*(y[c].alias(c) for c in ("end", "val", "filed", *carry))))
    rows = groups.where(F.exists("_f", lambda g: F.exists(g["_s"], whole(g)))).select(*by, "_anchor", F.reverse(one).alias("_y"))
    out = rows.select(*by, "_anchor", far_from_last_kept(F.col("_y")).alias("_all"))
    newest = F.get("_all", F.lit(0))
    years = F.when(fresh(newest["end"], F.col("_anchor")), F.slice("_all", 1, count)).otherwise(F.slice("_all", 1, 0))
    return out.select(*by, years.alias("years"), newest.alias("newest"))


def tiled(facts: Column, picks: int = 6) -> Column:
    """The trailing year as tiles: from the latest end backwards, at each cursor the longest flow that ends within 4 days of it and fits.

    ``facts`` are structs (end, start, val, filed, tail, src); equally long ones count in the order of their ends, reported before
    derived. Gives (covered, val, n, newest, first), or NULL unless 350..380 days are covered: ``newest`` is (filed, src) of the tile
    filed last, ``first`` the src of the first.
    """
    days = lambda x: F.datediff(x["end"], x["start"])
    latest = F.array_max(F.transform(facts, lambda x: x["end"]))
    told = lambda x: F.struct(x["filed"].alias("filed"), x["src"].alias("src"))
    none = F.get(F.transform(facts, told), F.lit(-1))
    state = F.struct(
        latest.alias("cursor"), F.lit(0).alias("covered"), F.lit(0.0).alias("val"), F.lit(0).alias("n"), F.lit(False).alias("over"), none.alias("newest"), none["src"].alias("first")
    )

    def step(s: Column, _: Column) -> Column:
        fits = F.filter(facts, lambda x: (F.abs(F.datediff(x["end"], s["cursor"])) <= 4) & (days(x) <= 366 - s["covered"] + 12))
        ordered = F.transform(
            fits, lambda x: F.struct(days(x).alias("days"), (-F.unix_date(x["end"])).alias("o"), (-x["tail"]).alias("p"), x["start"].alias("start"), x["val"].alias("val"), x["filed"].alias("filed"), x["src"].alias("src"))
        )
        best = F.array_max(ordered)
        stop = s["over"] | (s["covered"] >= 350)
        # A lambda's variable, so that the tiles are looked through once a step and not once a field.
        return F.get(F.transform(F.array(F.when(~stop, best)), lambda b: laid(s, b)), F.lit(0))

    def laid(s: Column, best: Column) -> Column:
        stop = best.isNull()
        later = F.coalesce(best["filed"] > s["newest"]["filed"], F.lit(True))
        return F.struct(
            F.when(stop, s["cursor"]).otherwise(F.date_sub(best["start"], 1)).alias("cursor"),
            F.when(stop, s["covered"]).otherwise(s["covered"] + best["days"]).alias("covered"),
            F.when(stop, s["val"]).otherwise(s["val"] + best["val"]).alias("val"),
            F.when(stop, s["n"]).otherwise(s["n"] + 1).alias("n"),
            stop.alias("over"),
            F.when(stop | ~later, s["newest"]).otherwise(told(best)).alias("newest"),
            F.when(stop | (s["n"] > 0), s["first"]).otherwise(best["src"]).alias("first"),
        )

    done = F.aggregate(F.sequence(F.lit(1), F.lit(picks)), state, step)
    return F.get(F.transform(F.array(done), lambda x: F.when(x["covered"].between(350, 380), x)), F.lit(0))


def ttm(flows: DataFrame, by: list[str], anchor: Column | None = None, carry: tuple[str, ...] = (), stale: bool = False) -> DataFrame:
    """(by, end, val, basis, filed, carry): the trailing twelve months, by tiling, else the latest year.

    basis is ``ttm`` or, for a year reported as one, ``fy``. A total of several tiles must end within 120 days of the
    anchor, a single year within 300; a stale total is not replaced by a year. ``anchor`` is a column of ``flows``. The
    filing is that of the newest tile; a ``concept`` that is carried is that of the first. With ``stale`` what was too old
    stays as well, told by a column of that name.
    """
    return trailing_of(gathered(flows, by, anchor, carry), by, carry, stale)


def trailing_of(groups: DataFrame, by: list[str], carry: tuple[str, ...] = (), stale: bool = False) -> DataFrame:
    """What ``ttm`` gives, of gathered rows."""
    own = F.filter("_f", lambda g: g["start"].isNotNull())
    out = groups.select(*by, own.alias("_f"), "_anchor", F.array_max(F.flatten(F.transform(own, lambda g: g["_s"]["end"]))).alias("end")).where("end is not null")
    # Flows of one start give each other's tails; tiles and years are taken from the one array.
    tile = lambda a, start, val, filed, tail: F.struct(a["end"].alias("end"), start.alias("start"), val.alias("val"), filed.alias("filed"), F.lit(tail).alias("tail"), a["src"].alias("src"))

    def tiles_of(g: Column) -> Column:
        # No tile ends further back: before the last one under 350 days are covered, with gaps of 4 days at most between six.
        late = F.filter(g["_s"], lambda a: a["end"] >= F.date_sub("end", 420))
        shorter = lambda a: F.filter(g["_s"], lambda b: F.datediff(a["end"], b["end"]).between(80, 400))
        tails = F.transform(late, lambda a: F.transform(shorter(a), lambda b: tile(a, F.date_add(b["end"], 1), a["val"] - b["val"], F.greatest(a["filed"], b["filed"]), 1)))
        return F.concat(F.transform(late, lambda a: tile(a, g["start"], a["val"], a["filed"], 0)), F.flatten(tails))

    def years_of(g: Column) -> Column:
        whole = F.filter(g["_s"], lambda a: duration(g["start"], a["end"]).between(330, 400))
        return F.transform(whole, lambda a: F.struct(a["end"].alias("end"), a["filed"].alias("filed"), (-F.unix_date(g["start"])).alias("o"), a["val"].alias("val"), a["src"].alias("src")))

    recent, years = F.flatten(F.transform("_f", tiles_of)), F.flatten(F.transform("_f", years_of))
    out = out.select(*by, "_anchor", "end", recent.alias("_g"), F.array_max(years).alias("_y"))
    # Made by a generator, so that no filter behind it walks the tiles once more.
    out = out.select(*by, "_anchor", "end", "_y", F.inline(F.array(F.struct(tiled(F.col("_g")).alias("_t")))))
    out = out.withColumn("_fresh", F.when(fresh(F.col("_y.end"), F.col("_anchor")), F.col("_y")))
    whole, alone = F.col("_t").isNotNull(), F.col("_t.n") == 1
    good = F.when(alone, fresh(F.col("end"), F.col("_anchor"))).otherwise(fresh(F.col("end"), F.col("_anchor"), STITCHED_AGE))
    told = lambda c: F.when(whole, F.col("_t.first.concept" if c == "concept" else f"_t.newest.src.{c}")).otherwise(F.col(f"_y.src.{c}")).alias(c)
    good = F.when(whole, good).otherwise(F.col("_fresh").isNotNull())
    return out.where(whole | F.col("_y").isNotNull() if stale else good).select(
        *by,
        *([(~good).alias("stale")] if stale else []),
        F.when(whole, F.col("end")).otherwise(F.col("_y.end")).alias("end"),
        F.when(whole, F.col("_t.val")).otherwise(F.col("_y.val")).alias("val"),
        F.when(whole & ~alone, "ttm").otherwise("fy").alias("basis"),
        F.when(whole, F.col("_t.newest.filed")).otherwise(F.col("_y.filed")).alias("filed"),
        *map(told, carry),
    )


def rolling_sum4(series: DataFrame, by: list[str], day: str, value: str, span: int = 300) -> DataFrame:
    """The sum of each quarter and the three before, where these four span at most ``span`` days."""
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(-3, 0)
    whole = (F.count(value).over(w) == 4) & (F.datediff(F.col(day), F.first(day).over(w)) <= span)
    return series.withColumn(f"{value}_ttm", F.when(whole, F.sum(value).over(w)))


def anniversaries(ends: DataFrame, by: list[str], end: str, count: int = 5) -> DataFrame:
    """(by, k, target): the same day ``k`` years of 365.25 days back, for k under ``count``; half a day is rounded to an even number."""
    out = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return out.withColumn("target", F.date_sub(end, F.bround(F.col("k") * 365.25).cast("int")))


def quarters_match_years(quarters: DataFrame, years: DataFrame, by: list[str], tolerance: float = 0.05) -> DataFrame:
    """(by, matches): every year that holds exactly four quarters equals their sum within the tolerance."""
    y = years.select(*by, F.col("end").alias("_ye"), F.col("val").alias("_yv"))
    inside = quarters.join(y, by).where((F.col("end") > F.date_sub("_ye", 355)) & (F.col("end") <= F.date_add("_ye", 10)))
    summed = inside.groupBy(*by, "_ye", "_yv").agg(F.count("*").alias("n"), F.sum("val").alias("s")).where("n = 4")
    return summed.groupBy(*by).agg(F.bool_and(F.abs(F.col("s") - F.col("_yv")) <= tolerance * F.abs("_yv")).alias("matches"))


def reference_date(facts: DataFrame, by: list[str], as_of: str, at_least: int = 5) -> DataFrame:
    """(by, anchor): the latest instant that at least so many distinct concepts share."""
    known = facts.where(F.col("start").isNull() & F.col("val").isNotNull() & (F.col("end") <= F.col("filed")) & (F.col("filed") <= F.to_date(F.lit(as_of))))
    shared = known.groupBy(*by, "end").agg(F.count_distinct("concept").alias("n")).where(F.col("n") >= at_least)
    return shared.groupBy(*by).agg(F.max("end").alias("anchor"))


def merge_predecessors(facts: DataFrame, successors: DataFrame) -> DataFrame:
    """Facts with predecessors' ids replaced by their successors'; exact repeats count once."""
    named = facts.join(successors.select(F.col("predecessor").alias("entity"), "successor"), "entity", "left")
    cols = [c for c in facts.columns if c != "entity"]
    return named.select(F.coalesce("successor", "entity").alias("entity"), *cols).dropDuplicates(["entity", *[c for c in cols if c != "seq"]])


def momentum(prices: DataFrame, scoring_day: str, months: int, slack: int = 7) -> DataFrame:
    """(entity, momentum): close at the month's end before last over that of ``months`` back, less 1; 4 digits.

    The start must lie within ``slack`` days before its month's end.
    """
    day = F.to_date(F.lit(scoring_day))
    ends = {"_late": F.last_day(F.add_months(day, -1)), "_early": F.last_day(F.add_months(day, -months))}
    pick = lambda end: F.max_by(F.struct("d", "close"), F.when(F.col("d") <= end, F.col("d")))
    held = prices.where("close is not null").groupBy("entity")
    got = held.agg(*(pick(e).alias(n) for n, e in ends.items()), *(F.max(e).alias(f"{n}_day") for n, e in ends.items()))
    ok = (F.col("_late.d") <= F.col("_late_day")) & (F.col("_early.d") <= F.col("_early_day")) & (F.datediff("_early_day", "_early.d") <= slack)
    return got.select("entity", F.when(ok, half_up(F.try_divide("_late.close", "_early.close") - 1, 4)).alias("momentum"))


def average_dollar_volume(prices: DataFrame, day: str, sessions: int = 63) -> DataFrame:
    """(entity, adv): the mean of close x volume over the last sessions up to a day; missing ones inside are skipped."""
    w = Window.partitionBy("entity").orderBy(F.col("d").desc())
    last = prices.where(F.col("d") <= F.to_date(F.lit(day))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= sessions)
    return last.groupBy("entity").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"))
