"""Query name -> builder, and the oracle SQL of each, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortal.functions import scalars, stats
from cohortal.functions.spec import FACTORS
from cohortal.operators import classify, eligibility, screen, temporal
from cohortal.plans import panel, score
from cohortal.plans import standin as s
from cohortal.registry import ORACLE_SQL, QUERIES, query
from cohortal.registry import half_up_sql as _hu
from cohortal.sources import sinks

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Exact sums of whole numbers.
_NET = "round(l_extendedprice * (1 - l_discount) * 10000)::BIGINT"
_CENTS = "round(l_extendedprice * 100)::BIGINT"


# The inputs once more, for the oracle.
_LINES = """lines AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag,
         l_shipdate::DATE AS ship, o_custkey, o_orderdate::DATE AS day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_MEASURES = (
    _LINES
    + f""",
wide AS (
  SELECT o_custkey AS entity, (sum({_NET}) / 10000.0::DOUBLE)::DOUBLE AS spend,
    count(DISTINCT l_orderkey)::DOUBLE AS orders,
    {_hu(f"sum({_NET}) / (sum({_CENTS}) * 100.0::DOUBLE)", 6)} AS margin,
    (sum({_NET}) FILTER (day BETWEEN DATE '2000-01-01' AND DATE '2000-06-30') / 10000.0::DOUBLE)::DOUBLE AS recent_spend,
    nullif(count(DISTINCT l_orderkey) FILTER (day BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'), 0)::DOUBLE AS recent_orders,
    {_hu(f"sum({_NET}) / 10000.0::DOUBLE / count(DISTINCT l_orderkey)", 2)} AS aov,
    {_hu("sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity)", 6)} AS return_share,
    (sum({_NET}) FILTER (day BETWEEN DATE '2000-01-01' AND DATE '2000-01-15') / 10000.0::DOUBLE)::DOUBLE AS rare_spend
  FROM lines GROUP BY 1),
measures AS (
  SELECT entity, metric, raw FROM wide UNPIVOT INCLUDE NULLS (raw FOR metric IN (spend, orders, margin, recent_spend, recent_orders, aov, return_share, rare_spend))
  UNION ALL SELECT c_custkey, 'balance', c_acctbal FROM customer)"""
)
_SPEC = """spec(metric, factor, higher_better, optional, conditioned) AS (VALUES
  ('spend', 'quality', true, false, false), ('orders', 'quality', true, false, false), ('margin', 'quality', true, false, false),
  ('recent_spend', 'growth', true, false, true), ('recent_orders', 'growth', true, true, false), ('aov', 'valuation', true, false, false),
  ('return_share', 'health', false, false, false), ('balance', 'health', true, false, false), ('rare_spend', 'valuation', true, false, false))"""
_ROWS = """rows0 AS (
  SELECT c_custkey AS entity, c_name AS name, c_mktsegment AS segment, c_nationkey::VARCHAR AS peer, c_acctbal AS market_cap FROM customer),
rows1 AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY segment, peer) < 12 THEN 'pooled_thin' ELSE peer END AS cohort,
            CASE WHEN count(*) OVER (PARTITION BY segment, peer) < 12 THEN 'universe' ELSE 'sector' END AS basis FROM rows0)"""
_SCORED = f"""{_MEASURES},
{_SPEC},
{_ROWS},
grid0 AS (SELECT r.*, s.*, m.raw FROM rows1 r CROSS JOIN spec s LEFT JOIN measures m ON m.entity = r.entity AND m.metric = s.metric),
resolution AS (SELECT segment, metric, count(*) AS n, count(raw) AS resolved, count(raw) / count(*) AS share FROM grid0 GROUP BY 1, 2),
grid AS (SELECT g.* FROM grid0 g SEMI JOIN (SELECT * FROM resolution WHERE share >= 0.4) k ON g.segment = k.segment AND g.metric = k.metric),
bounds AS (SELECT segment, cohort, metric, count(raw) AS n, quantile_cont(raw, 0.05) AS lo, quantile_cont(raw, 0.95) AS hi FROM grid GROUP BY 1, 2, 3),
clipped AS (SELECT g.*, CASE WHEN raw IS NULL THEN NULL WHEN b.n < 3 THEN raw ELSE least(greatest(raw, lo), hi) END AS win
  FROM grid g JOIN bounds b USING (segment, cohort, metric)),
placed AS (SELECT *, count(win) OVER (PARTITION BY segment, cohort, metric) AS n,
    (rank() OVER (PARTITION BY segment, cohort, metric ORDER BY win NULLS LAST) - 1
     + (count(win) OVER (PARTITION BY segment, cohort, metric, win) - 1) / 2.0::DOUBLE) AS below FROM clipped),
pcts AS (SELECT *, {_hu("CASE WHEN win IS NULL THEN NULL WHEN n = 1 THEN 50.0::DOUBLE WHEN higher_better THEN 100.0::DOUBLE * (below / greatest(n - 1, 1)) ELSE 100.0::DOUBLE * (1 - below / greatest(n - 1, 1)) END", 1)} AS pct0 FROM placed),
returned AS (SELECT *, max(CASE WHEN metric = 'margin' THEN raw END) OVER (PARTITION BY entity) AS ret FROM pcts),
gated AS (SELECT *, CASE WHEN NOT conditioned THEN pct0 WHEN ret IS NULL THEN NULL WHEN ret <= 0.95 THEN least(pct0, 50.0::DOUBLE) ELSE pct0 END AS pct,
    CASE WHEN conditioned AND ret <= 0.95 AND pct0 IS NOT NULL THEN basis || '|below-hurdle' ELSE basis END AS basis2 FROM returned),
factors AS (SELECT entity, segment, peer, market_cap,
    {_hu("avg(pct) FILTER (factor = 'quality')", 1)} AS quality, {_hu("avg(pct) FILTER (factor = 'growth')", 1)} AS growth,
    {_hu("avg(pct) FILTER (factor = 'valuation')", 1)} AS valuation, {_hu("avg(pct) FILTER (factor = 'health')", 1)} AS health,
    count(pct) AS resolved, count(*) FILTER (pct IS NOT NULL OR NOT optional) AS applicable FROM gated GROUP BY 1, 2, 3, 4),
enough AS (SELECT *, {_hu("((coalesce(quality, 0) + coalesce(growth, 0) + coalesce(valuation, 0) + coalesce(health, 0)) * 25.0::DOUBLE) / nullif(25.0::DOUBLE * ((quality IS NOT NULL)::INT + (growth IS NOT NULL)::INT + (valuation IS NOT NULL)::INT + (health IS NOT NULL)::INT), 0)", 2)} AS composite
  FROM factors WHERE resolved / nullif(applicable, 0) >= 0.7),
ranked AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY composite DESC NULLS LAST, market_cap DESC NULLS LAST, entity) AS rank FROM enough),
deciled AS (SELECT *, row_number() OVER (PARTITION BY segment, peer ORDER BY composite DESC NULLS LAST, market_cap DESC NULLS LAST, entity) AS peer_rank,
    count(*) OVER (PARTITION BY segment, peer) AS peer_size FROM ranked),
scored AS (SELECT *, least(10, ((peer_rank - 1) * 10) // peer_size + 1) AS decile FROM deciled)"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return score.percentile_grid(s.customers(spark, d).select("entity", "segment", "peer", "market_cap"), s.measures(spark, d), s.registry(spark), SETTINGS, s.RETURNS)


SETTINGS = score.Settings(hurdle=s.HURDLE)


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = s.customers(spark, d).select("entity", "segment", "peer", "market_cap")
    return score.score_segments(rows, s.measures(spark, d), s.registry(spark), None, SETTINGS, s.RETURNS)


@query(f"""WITH bounds AS (SELECT c_nationkey, count(c_acctbal) AS n, quantile_cont(c_acctbal, 0.05) AS lo, quantile_cont(c_acctbal, 0.95) AS hi FROM customer GROUP BY 1),
clipped AS (SELECT c_custkey, c.c_nationkey, CASE WHEN n < 3 THEN c_acctbal ELSE least(greatest(c_acctbal, lo), hi) END AS win FROM customer c JOIN bounds b ON c.c_nationkey = b.c_nationkey)
SELECT c_custkey AS entity, {_hu("win", 6)} AS win, {_hu("100.0::DOUBLE * ((rank() OVER (PARTITION BY c_nationkey ORDER BY win) - 1 + (count(win) OVER (PARTITION BY c_nationkey, win) - 1) / 2.0::DOUBLE) / greatest(count(win) OVER (PARTITION BY c_nationkey) - 1, 1))", 1)} AS pct FROM clipped""")
def winsorized_percentile(spark, d):
    c = s.table(spark, d, "customer").withColumn("win", stats.winsorized("c_acctbal", ["c_nationkey"]))
    return c.select(F.col("c_custkey").alias("entity"), stats.half_up("win", 6).alias("win"), stats.tie_percentile("win", ["c_nationkey"]).alias("pct"))


@query(f"WITH {_SCORED} SELECT entity, segment, quality, growth, valuation, health, composite, rank FROM scored")
def peer_composite_rank(spark, d):
    return _scored(spark, d)[0].select("entity", "segment", *FACTORS, "composite", "rank")


@query(f"WITH {_SCORED} SELECT entity, peer_rank, peer_size, decile FROM scored")
def peer_decile(spark, d):
    return _scored(spark, d)[0].select("entity", "peer_rank", "peer_size", "decile")


@query(f"WITH {_SCORED} SELECT entity, cohort, basis FROM rows1")
def thin_cohort_pooling(spark, d):
    return score.with_cohort(s.customers(spark, d)).select("entity", "cohort", "basis")


@query(f"WITH {_SCORED} SELECT segment, metric, resolved, round(share, 3) AS share, share >= 0.4 AS applicable FROM resolution")
def metric_applicability(spark, d):
    rows = s.customers(spark, d).select("entity", "segment", "peer", "market_cap")
    found = score.metric_resolution(score.measure_grid(rows, s.measures(spark, d), s.registry(spark)))
    return found.select("segment", "metric", "resolved", stats.half_up("share", 3).alias("share"), (F.col("share") >= SETTINGS.applicability).alias("applicable"))


@query(f"""WITH {_SCORED} SELECT entity, resolved, applicable, round(resolved / nullif(applicable, 0), 4) AS coverage,
  coalesce(resolved / nullif(applicable, 0) >= 0.7, false) AS enough FROM factors""")
def coverage_gate(spark, d):
    enough, short = score.coverage_gate(score.factor_scores(_grid(spark, d)))
    both = enough.withColumn("enough", F.lit(True)).unionByName(short.drop("reason").withColumn("enough", F.lit(False)))
    return both.select("entity", "resolved", "applicable", stats.half_up("coverage", 4).alias("coverage"), "enough")


@query(f"WITH {_SCORED} SELECT entity, metric, pct, basis2 AS basis FROM gated WHERE conditioned")
def hurdle_cap(spark, d):
    return _grid(spark, d).where("conditioned").select("entity", "metric", "pct", "basis")


@query(f"WITH {_SCORED} SELECT entity, metric, cohort, {_hu("win", 6)} AS win, pct FROM gated")
def cohort_percentiles(spark, d):
    return _grid(spark, d).select("entity", "metric", "cohort", stats.half_up("win", 6).alias("win"), "pct")


_SWEEP = """steps(w) AS (VALUES (10), (15), (20), (25), (30), (35), (40)),
vectors AS (SELECT row_number() OVER () AS vector, a.w::DOUBLE AS wq, b.w::DOUBLE AS wg, c.w::DOUBLE AS wv, e.w::DOUBLE AS wh
  FROM steps a, steps b, steps c, steps e WHERE a.w + b.w + c.w + e.w = 100)"""


def _composite_sql(wq: str, wg: str, wv: str, wh: str) -> str:
    parts = [("quality", wq), ("growth", wg), ("valuation", wv), ("health", wh)]
    top = " + ".join(f"(CASE WHEN {f} IS NOT NULL AND {w} > 0 THEN {f} * {w} ELSE 0.0::DOUBLE END)" for f, w in parts)
    low = " + ".join(f"(CASE WHEN {f} IS NOT NULL AND {w} > 0 THEN {w} ELSE 0.0::DOUBLE END)" for f, w in parts)
    return _hu(f"({top}) / nullif({low}, 0)", 2)


@query(f"""WITH {_SCORED}, {_SWEEP},
tried AS (SELECT entity, segment, rank, vector, coalesce(nullif({_composite_sql('wq', 'wg', 'wv', 'wh')}, 0), -1) AS c FROM scored CROSS JOIN vectors),
placed2 AS (SELECT *, row_number() OVER (PARTITION BY segment, vector ORDER BY c DESC, rank) AS r, count(*) OVER (PARTITION BY segment, vector) AS size FROM tried)
SELECT entity, segment, min(r) AS rank_min, max(r) AS rank_max, floor(median(r))::BIGINT AS rank_median,
  {_hu("1 - (max(r) - min(r)) / greatest(any_value(size) - 1, 1)", 3)} AS stability FROM placed2 GROUP BY 1, 2""")
def rank_stability(spark, d):
    return score.rank_stability(_scored(spark, d)[0])


_WHAT_IF = f"""WITH {_SCORED},
again AS (SELECT *, {_composite_sql('40.0::DOUBLE', '10.0::DOUBLE', '30.0::DOUBLE', '20.0::DOUBLE')} AS c2 FROM scored),
new AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY c2 DESC NULLS LAST, market_cap DESC NULLS LAST, entity) AS new_rank FROM again)"""


@query(f"{_WHAT_IF} SELECT entity, segment, c2 AS composite, rank, new_rank FROM new")
def what_if_ranking(spark, d):
    again = score.what_if(_scored(spark, d)[0], dict(zip(FACTORS, (40.0, 10.0, 30.0, 20.0), strict=True)))
    return again.select("entity", "segment", "composite", "rank", "new_rank")


@query(f"{_WHAT_IF} SELECT segment, count(*) FILTER (rank <> new_rank) AS displaced FROM new GROUP BY 1")
def what_if_displacement(spark, d):
    return score.displacement(what_if_ranking(spark, d))


_FACTS = f"""{_LINES},
facts AS (SELECT l_partkey AS entity, l_returnflag AS concept, date_trunc('month', day)::DATE AS "start", last_day(day) AS "end",
  l_extendedprice AS val, ship AS filed, l_orderkey * 10 + l_linenumber AS seq FROM lines)"""


@query(f"""WITH {_FACTS}, seen AS (SELECT *, row_number() OVER (PARTITION BY entity, "end" ORDER BY filed DESC, seq) AS n FROM facts WHERE filed <= DATE '2000-06-30')
SELECT entity, "end", val, filed FROM seen WHERE n = 1""")
def point_in_time_latest(spark, d):
    known = temporal.visible(s.facts(spark, d), "2000-06-30")
    return temporal.latest_version(known, ["entity", "end"]).select("entity", "end", "val", "filed")


def _prioritised(spark, d):
    place = F.when(F.col("concept") == "R", 0).when(F.col("concept") == "A", 1).otherwise(2)
    return s.facts(spark, d).withColumn("priority", place)


_PRIORITY = """CASE concept WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END"""


@query(f"""WITH {_FACTS}, seen AS (SELECT *, row_number() OVER (PARTITION BY entity, "end" ORDER BY {_PRIORITY}, filed DESC, seq) AS n FROM facts)
SELECT entity, "end", concept, val FROM seen WHERE n = 1""")
def priority_merge(spark, d):
    return temporal.priority_merge(_prioritised(spark, d), ["entity", "end"]).select("entity", "end", "concept", "val")


@query(f"""WITH {_FACTS}, seen AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY filed DESC, val DESC NULLS LAST, {_PRIORITY}) AS n FROM facts)
SELECT entity, val, filed FROM seen WHERE n = 1""")
def largest_in_newest(spark, d):
    return temporal.largest_in_newest(_prioritised(spark, d), ["entity"]).select("entity", "val", "filed")


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, o_totalprice FROM orders),
balances AS (SELECT o_custkey, day, round(sum(o_totalprice), 2) AS spent FROM o GROUP BY 1, 2),
probes AS (SELECT c_custkey, DATE '1999-12-31' AS probed FROM customer)
SELECT c_custkey AS entity, b.day, b.spent FROM probes ASOF LEFT JOIN balances b ON c_custkey = o_custkey AND probed >= b.day""")
def asof_balance(spark, d):
    o = s.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day")).agg(stats.half_up(F.sum("o_totalprice"), 2).alias("spent"))
    probes = s.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.lit("1999-12-31").cast("date").alias("at"))
    return temporal.asof(probes, o, ["entity"], "at", "day", ["day", "spent"]).select("entity", "day", "spent")


@query(f"""WITH o AS (SELECT o_custkey, o_orderdate::DATE AS day, round(max(o_totalprice), 2) AS spent FROM orders GROUP BY 1, 2),
met AS (SELECT c_custkey, day, spent, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(day - DATE '1999-06-30'), day) AS n
  FROM customer JOIN o ON o_custkey = c_custkey AND abs(day - DATE '1999-06-30') <= 45)
SELECT c_custkey AS entity, day AS nearest_day, spent FROM customer LEFT JOIN (SELECT * FROM met WHERE n = 1) USING (c_custkey)""")
def nearest_snapshot(spark, d):
    o = s.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day")).agg(stats.half_up(F.max("o_totalprice"), 2).alias("spent"))
    probes = s.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.lit("1999-06-30").cast("date").alias("at"))
    return temporal.nearest(probes, o, ["entity"], "at", "day", 45, ["spent"]).select("entity", "nearest_day", "spent")


_QUARTERS = f"""{_LINES},
quarters AS (SELECT l_suppkey AS entity, last_day((date_trunc('quarter', day) + INTERVAL 2 MONTH)::DATE) AS "end",
  (sum({_NET}) / 10000.0::DOUBLE)::DOUBLE AS val FROM lines GROUP BY 1, 2),
rolled AS (SELECT *, CASE WHEN count(val) OVER w = 4 AND "end" - first_value("end") OVER w <= 300 THEN sum(val) OVER w END AS ttm
  FROM quarters WINDOW w AS (PARTITION BY entity ORDER BY "end" ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


@query(f'WITH {_QUARTERS} SELECT entity, "end", {_hu("ttm", 2)} AS ttm FROM rolled')
def ttm_rolling(spark, d):
    rolled = temporal.rolling_sum4(s.quarterly(spark, d), ["entity"], "end", "val")
    return rolled.select("entity", "end", stats.half_up("val_ttm", 2).alias("ttm"))


@query(f"""WITH {_QUARTERS} SELECT a.entity, a."end", {_hu("a.val - b.val", 2)} AS change FROM quarters a
LEFT JOIN quarters b ON a.entity = b.entity AND a."end" - b."end" BETWEEN 350 AND 380""")
def year_ago_change(spark, d):
    both = temporal.year_ago(s.quarterly(spark, d), ["entity"], "end", "val")
    return both.select("entity", "end", stats.half_up(F.col("val") - F.col("val_year_ago"), 2).alias("change"))


@query(f"""WITH {_QUARTERS}, last4 AS (SELECT a.entity, a."end", a.val - b.val AS change, row_number() OVER (PARTITION BY a.entity ORDER BY a."end" DESC) AS n
  FROM quarters a JOIN quarters b ON a.entity = b.entity AND a."end" - b."end" BETWEEN 355 AND 375 WHERE a."end" <= DATE '2001-06-30')
SELECT entity, {_hu("4 * median(change)", 2)} AS change FROM last4 WHERE n <= 4 GROUP BY 1 HAVING count(*) = 4""")
def median_of_four(spark, d):
    both = temporal.year_ago(s.quarterly(spark, d).where(F.col("end") <= "2001-06-30"), ["entity"], "end", "val", 355, 375).where("val_year_ago is not null")
    last = both.withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("end")))).where("n <= 4")
    out = last.groupBy("entity").agg(F.median(F.col("val") - F.col("val_year_ago")).alias("m"), F.count("*").alias("k")).where("k = 4")
    return out.select("entity", stats.half_up(4 * F.col("m"), 2).alias("change"))


_YTD = f"""{_QUARTERS},
ytd AS (SELECT entity, make_date(year("end"), 1, 1) AS "start", "end", sum(val) OVER (PARTITION BY entity, year("end") ORDER BY "end") AS val FROM quarters)"""


def _ytd(spark, d):
    q = s.quarterly(spark, d)
    w = Window.partitionBy("entity", F.year("end")).orderBy("end")
    return q.select("entity", F.trunc("end", "year").alias("start"), "end", F.sum("val").over(w).alias("val"), F.col("end").alias("filed"))


@query(f"""WITH {_YTD} SELECT a.entity, (b."end" + 1)::DATE AS "start", a."end", {_hu("a.val - b.val", 2)} AS val FROM ytd a JOIN ytd b
ON a.entity = b.entity AND a."start" = b."start" AND a."end" - b."end" BETWEEN 80 AND 400""")
def stub_synthesis(spark, d):
    return temporal.stub_synthesis(_ytd(spark, d), ["entity"]).select("entity", "start", "end", stats.half_up("val", 2).alias("val"))


@query(f"""WITH {_YTD}, years AS (SELECT entity, "end", val FROM ytd WHERE month("end") = 12),
sums AS (SELECT y.entity, y."end", y.val, count(*) AS n, sum(q.val * (1 + (q.entity % 5) / 50.0::DOUBLE)) AS s FROM years y
  JOIN quarters q ON q.entity = y.entity AND q."end" > y."end" - 355 AND q."end" <= y."end" + 10 GROUP BY 1, 2, 3)
SELECT entity, bool_and(abs(s - val) <= 0.05 * abs(val)) AS matches FROM sums WHERE n = 4 GROUP BY 1""")
def restatement_guard(spark, d):
    years = _ytd(spark, d).where(F.month("end") == 12)
    drifted = s.quarterly(spark, d).withColumn("val", F.col("val") * (1 + (F.col("entity") % 5) / F.lit(50.0)))
    return temporal.quarters_match_years(drifted, years, ["entity"])


@query(f"""WITH {_QUARTERS}, points AS (SELECT entity, ("end" - DATE '1990-01-01') / 365.25::DOUBLE AS x, ttm FROM rolled
  WHERE ttm > 0 AND "end" BETWEEN DATE '1998-03-01' AND DATE '2001-03-31')
SELECT entity, count(*) AS n, round(exp(regr_slope(ln(ttm), x)) - 1, 6) AS growth FROM points GROUP BY 1 HAVING count(*) >= 9""")
def trend_growth(spark, d):
    rolled = temporal.rolling_sum4(s.quarterly(spark, d), ["entity"], "end", "val").where("val_ttm > 0")
    near = rolled.where(F.col("end").between("1998-03-01", "2001-03-31"))
    x = scalars.years_between("end", F.lit("1990-01-01").cast("date"))
    out = near.groupBy("entity").agg(F.count("*").alias("n"), (F.exp(stats.slope(F.log("val_ttm"), x)) - 1).alias("growth")).where("n >= 9")
    return out.select("entity", "n", stats.half_up("growth", 6).alias("growth"))


@query(f"""WITH {_QUARTERS}, years AS (SELECT entity, year("end") AS y, sum(val) AS v FROM quarters WHERE year("end") BETWEEN 1996 AND 2000 GROUP BY 1, 2),
fit AS (SELECT entity, regr_slope(v, y) AS b, regr_syy(v, y) AS syy, regr_sxy(v, y) AS sxy, count(*) AS n, stddev_samp(v) AS sd FROM years GROUP BY 1)
SELECT entity, round(CASE WHEN b > 0 THEN CASE WHEN n > 2 THEN sqrt(greatest(syy - b * sxy, 0) / (n - 2)) END ELSE sd END, 2) AS dispersion FROM fit""")
def trend_dispersion(spark, d):
    years = s.quarterly(spark, d).where(F.year("end").between(1996, 2000)).groupBy("entity", F.year("end").alias("y")).agg(F.sum("val").alias("v"))
    return years.groupBy("entity").agg(stats.half_up(stats.trend_dispersion("v", "y"), 2).alias("dispersion"))


@query("""WITH x AS (SELECT s_suppkey AS entity, s_nationkey, s_acctbal / 20000.0::DOUBLE AS ret, 0.2::DOUBLE + (s_suppkey % 17) / 10.0::DOUBLE AS yld FROM supplier),
f AS (SELECT *, least(greatest(ret, -0.2::DOUBLE), 0.4::DOUBLE) AS rx, ln(1 / yld) AS ry FROM x),
g AS (SELECT *, regr_slope(ry, rx) OVER w AS b, avg(rx) OVER w AS mx, avg(ry) OVER w AS my, count(*) OVER w AS n, max(rx) OVER w > min(rx) OVER w AS spread FROM f WINDOW w AS (PARTITION BY entity % 5))
SELECT entity, CASE WHEN n >= 8 AND spread THEN round(my + b * (rx - mx) - ry, 6) END AS gap FROM g""")
def regression_gap(spark, d):
    x = s.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("entity"), (F.col("s_acctbal") / 20000.0).alias("ret"), (F.lit(0.2) + (F.col("s_suppkey") % 17) / F.lit(10.0)).alias("yld"), (F.col("s_suppkey") % 5).alias("peer")
    )
    return score.regression_gap(x, ["peer"], "ret", "yld").select("entity", stats.half_up("gap", 6).alias("gap"))


@query(f"""WITH {_FACTS}, shared AS (SELECT "end", count(DISTINCT entity % 40) AS n FROM facts WHERE filed <= DATE '1999-03-31' AND "end" <= filed GROUP BY 1)
SELECT max("end") AS anchor FROM shared WHERE n >= 5""")
def reference_date_having(spark, d):
    f = s.facts(spark, d).select(F.lit(1).alias("all"), (F.col("entity") % 40).alias("concept"), F.lit(None).cast("date").alias("start"), "end", "filed", "val")
    return temporal.reference_date(f, ["all"], "1999-03-31").select("anchor")


_PRIOR = """prior AS (SELECT DISTINCT o_custkey AS entity FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '2001-05')"""


@query(f"""WITH {_PRIOR} SELECT c_custkey AS entity, c_acctbal >= 5000 OR (p.entity IS NOT NULL AND c_acctbal >= 4000) AS clears
FROM customer LEFT JOIN prior p ON p.entity = c_custkey""")
def hysteresis_floor(spark, d):
    prior = s.customer_month(spark, d, "2001-05").select("entity").withColumn("was", F.lit(True))
    both = s.customers(spark, d).join(prior, "entity", "left")
    return both.select("entity", eligibility.clears("market_cap", 5000.0, "was").alias("clears"))


def _candidates(spark, d):
    x = s.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.to_date(F.max("o_orderdate")).alias("latest"), F.count("*").cast("int").alias("n_filings"), F.sum("o_totalprice").alias("adv"))
    prior = s.customer_month(spark, d, "2001-05").select("entity").withColumn("was_scored", F.lit(True))
    c = s.customers(spark, d).join(x, "entity", "left").join(prior, "entity", "left")
    newer = F.when(F.col("entity") % 3 == 0, F.struct(F.lit("10-Q").alias("form")))
    return c.withColumns({"has_facts": F.col("n_filings").isNotNull(), "domestic": F.col("peer") != "7", "newer": newer})


_CASCADE = f"""WITH {_PRIOR},
x AS (SELECT o_custkey AS entity, max(o_orderdate)::DATE AS latest, count(*) AS n, sum(o_totalprice) AS adv FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS entity, c_mktsegment AS segment, c_nationkey, latest, n, adv, p.entity IS NOT NULL AS was, DATE '2001-07-31' - latest AS age,
  c_custkey % 3 = 0 AS newer FROM customer LEFT JOIN x ON x.entity = c_custkey LEFT JOIN prior p ON p.entity = c_custkey),
f AS (SELECT *, latest IS NULL OR age > 200 AS stale FROM c),
g AS (SELECT *, stale AND was AND newer AND coalesce(age <= 300, false) AS carry FROM f),
staged AS (SELECT *, CASE WHEN n IS NULL THEN 'no_facts' WHEN adv IS NULL THEN 'no_price' WHEN c_nationkey = 7 THEN 'foreign_filer' WHEN n < 5 THEN 'short_history'
  WHEN stale AND NOT carry THEN 'stale' WHEN NOT (adv >= 1500000 OR (was AND adv >= 1200000)) THEN 'illiquid' END AS stage FROM g)"""


def _staged(spark, d):
    return eligibility.cascade(_candidates(spark, d), "2001-07-31", score.Settings(adv_floor=1.5e6))


@query(f"{_CASCADE} SELECT entity, stage, carry AND stage IS NULL AS carried FROM staged")
def eligibility_cascade(spark, d):
    return _staged(spark, d).select("entity", "stage", "carried")


@query(f"""{_CASCADE}, k AS (SELECT segment, count(*) AS n0, {", ".join(f"count(*) FILTER (place > {k}) AS n{k}" for k in range(1, 7))} FROM (
  SELECT segment, coalesce(list_position(['no_facts', 'no_price', 'foreign_filer', 'short_history', 'stale', 'illiquid'], stage), 7) AS place FROM staged) GROUP BY 1)
SELECT segment, step::INTEGER AS step, survivors, CASE WHEN step = 0 THEN 0 ELSE lag(survivors) OVER (PARTITION BY segment ORDER BY step) - survivors END AS dropped
FROM (SELECT segment, unnest(range(7)) AS step, unnest([n0, n1, n2, n3, n4, n5, n6]) AS survivors FROM k)""")
def eligibility_funnel(spark, d):
    return eligibility.funnel(_staged(spark, d), ["segment"]).select("segment", "step", "survivors", "dropped")


@query("""WITH x AS (SELECT p_brand AS company, p_partkey AS entity, p_retailprice * p_size AS s FROM part)
SELECT company, max_by(entity, (s, entity)) AS entity, count(*)::INTEGER AS n_classes FROM x GROUP BY 1""")
def share_class_dedupe(spark, d):
    x = s.table(spark, d, "part").select(F.col("p_brand").alias("company"), F.col("p_partkey").alias("entity"), "p_retailprice", "p_size")
    out = eligibility.dedupe_share_classes(x, "company", "entity", F.col("p_retailprice") * F.col("p_size"))
    return out.select("company", "entity", F.size("share_classes").alias("n_classes"))


_MONTHS = """m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey AS entity, (sum(round(o_totalprice * 100)::BIGINT) / 100.0::DOUBLE)::DOUBLE AS composite FROM orders GROUP BY 1, 2),
r AS (SELECT month, entity, c_name AS name, c_mktsegment AS segment, composite, row_number() OVER (PARTITION BY month, c_mktsegment ORDER BY composite DESC, c_acctbal DESC, entity) AS rank
  FROM m JOIN customer ON c_custkey = entity),
now AS (SELECT * FROM r WHERE month = '2001-06'), prev AS (SELECT * FROM r WHERE month = '2001-05')"""


@query(f"""WITH {_MONTHS} SELECT n.entity, {_hu("n.composite - p.composite", 2)} AS composite_change, p.rank - n.rank AS rank_change, p.entity IS NULL AS is_new
FROM now n LEFT JOIN prev p ON n.entity = p.entity""")
def rank_change(spark, d):
    out = panel.with_deltas(s.customer_month(spark, d, "2001-06"), s.customer_month(spark, d, "2001-05"))
    return out.select("entity", "composite_change", "rank_change", "is_new")


def _exits(spark, d):
    now, prior = s.customer_month(spark, d, "2001-06"), s.customer_month(spark, d, "2001-05")
    c = s.customers(spark, d)
    excluded = c.where("market_cap < 0").select("entity", F.lit("balance under zero").alias("reason"))
    short = c.where("entity % 7 = 0").select("entity", F.lit("too few measures").alias("reason"))
    return panel.exits(prior, now, [("excluded", excluded), ("insufficient", short)])


_EXITS = f"""WITH {_MONTHS}, gone AS (SELECT p.entity, p.rank, p.segment, CASE WHEN c_acctbal < 0 THEN 'excluded' WHEN p.entity % 7 = 0 THEN 'insufficient' ELSE 'unlisted' END AS kind,
  CASE WHEN c_acctbal < 0 THEN 'balance under zero' WHEN p.entity % 7 = 0 THEN 'too few measures' ELSE 'no longer listed' END AS reason
  FROM prev p JOIN customer ON c_custkey = p.entity WHERE p.entity NOT IN (SELECT entity FROM now))"""


@query(f"{_EXITS} SELECT entity, rank, kind, reason FROM gone")
def exits_with_reason(spark, d):
    return _exits(spark, d).select("entity", "rank", "kind", "reason")


@query(f"{_EXITS} SELECT reason, count(*) AS n FROM gone GROUP BY 1")
def reason_counts(spark, d):
    return screen.counter(_exits(spark, d), "reason")


def _month_metrics(spark, d, month):
    x = s.lines(spark, d).where(F.date_format("day", "yyyy-MM") == month).groupBy(F.col("l_suppkey").alias("entity"))
    wide = x.agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned"), F.sum(F.when(F.col("l_discount") > 0.09, F.col("l_quantity"))).alias("discounted"))
    long = wide.unpivot("entity", ["returned", "discounted"], "metric", "pct")
    return long.withColumn("reason", F.when(F.col("pct").isNull(), F.when(F.col("metric") == "returned", "negative base").otherwise("no tag")))


_LOST = f"""{_LINES}, x AS (SELECT strftime(day, '%Y-%m') AS month, l_suppkey AS entity, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS returned,
  sum(CASE WHEN l_discount > 0.09 THEN l_quantity END) AS discounted FROM lines GROUP BY 1, 2),
y AS (SELECT * FROM x UNPIVOT INCLUDE NULLS (pct FOR metric IN (returned, discounted))),
lost AS (SELECT a.entity, a.metric, a.metric = 'returned' AS economic FROM y a JOIN y b ON a.entity = b.entity AND a.metric = b.metric
WHERE a.month = '2001-06' AND b.month = '2001-05' AND a.pct IS NULL AND b.pct IS NOT NULL)"""


@query(f"WITH {_LOST} SELECT * FROM lost")
def metrics_lost(spark, d):
    return panel.metrics_lost(_month_metrics(spark, d, "2001-06"), _month_metrics(spark, d, "2001-05")).select("entity", "metric", "economic")


@query(f"""{_EXITS}, {_LOST}, n AS (SELECT (SELECT count(*) FROM now) AS n_now, (SELECT count(*) FROM prev) AS n_before, (SELECT count(*) FROM gone WHERE kind = 'insufficient') AS n_dropped,
  (SELECT count(*) FROM lost WHERE NOT economic) AS n_lost, (SELECT count(*) FROM lost WHERE economic) AS n_economic,
  (SELECT count(*) FROM (SELECT l_partkey, l_returnflag, max(last_day(day)) AS last FROM lines GROUP BY 1, 2) WHERE last < DATE '2001-06-30' - 300 AND last >= DATE '2001-06-30' - 450) AS n_abandoned)
SELECT n_now, n_before, n_dropped, n_lost, n_economic, n_abandoned, round((n_now - n_before) * 100.0::DOUBLE / nullif(n_before, 0), 2) AS change_pct,
  CASE WHEN n_before = 0 THEN 'baseline' WHEN round((n_now - n_before) * 100.0::DOUBLE / n_before, 2) <= -5 THEN 'block'
       WHEN round((n_now - n_before) * 100.0::DOUBLE / n_before, 2) <= -1 OR n_dropped + n_lost + n_abandoned > 0 THEN 'warn' ELSE 'ok' END AS status FROM n""")
def drift_status(spark, d):
    now, prior = s.customer_month(spark, d, "2001-06"), s.customer_month(spark, d, "2001-05")
    lost = panel.metrics_lost(_month_metrics(spark, d, "2001-06"), _month_metrics(spark, d, "2001-05"))
    dropped = _exits(spark, d).where("kind = 'insufficient'")
    facts = s.facts(spark, d)
    anchor = facts.select("entity").distinct().withColumn("anchor", F.lit("2001-06-30").cast("date"))
    abandoned = eligibility.recently_abandoned(temporal.stale_inputs(facts, anchor, ["entity", "concept"]), "2001-06-30")
    return panel.drift_report(now, prior, lost, dropped, abandoned)


_PANEL = f"""{_LINES},
panel AS (SELECT strftime(day, '%Y-%m') AS month, l_suppkey AS entity, (sum({_NET}) / 10000.0::DOUBLE)::DOUBLE AS composite,
  {_hu(f"sum({_CENTS}) / 100.0::DOUBLE / sum(l_quantity)", 4)} AS price FROM lines WHERE day < DATE '2001-08-01' GROUP BY 1, 2),
idx AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS idx FROM (SELECT DISTINCT month FROM panel))"""


def _part_panel(spark, d):
    p = s.monthly_scores(spark, d, "l_partkey")
    return p.withColumn("prior_price", stats.half_up(F.lag("price").over(Window.partitionBy("entity").orderBy("month")) * 1.01, 4))


@query(f"""WITH {_LINES}, panel AS (SELECT strftime(day, '%Y-%m') AS month, l_partkey AS entity, {_hu(f"sum({_CENTS}) / 100.0::DOUBLE / sum(l_quantity)", 4)} AS price FROM lines WHERE day < DATE '2001-08-01' GROUP BY 1, 2),
idx AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS idx FROM (SELECT DISTINCT month FROM panel)),
p AS (SELECT panel.*, idx, {_hu("lag(price) OVER (PARTITION BY entity ORDER BY panel.month) * 1.01::DOUBLE", 4)} AS prior_price FROM panel JOIN idx USING (month)),
l AS (SELECT *, row_number() OVER w = 1 AS newest, lag(idx) OVER w = idx + 1 AND lag(prior_price) OVER w > 0 AND price > 0 AS ok, lag(prior_price) OVER w / price AS link
  FROM p WINDOW w AS (PARTITION BY entity ORDER BY idx DESC)),
c AS (SELECT *, max(CASE WHEN NOT newest AND NOT coalesce(ok, false) THEN 1 ELSE 0 END) OVER w AS broken,
  exp(sum(CASE WHEN newest OR NOT coalesce(ok, false) THEN 0 ELSE ln(link) END) OVER w) AS factor FROM l WINDOW w AS (PARTITION BY entity ORDER BY idx DESC ROWS UNBOUNDED PRECEDING))
SELECT month, entity, CASE WHEN broken = 0 THEN {_hu(_hu("price * factor", 4), 3)} END AS price_adj FROM c""")
def chain_linked_price(spark, d):
    return panel.chain_linked(_part_panel(spark, d)).withColumn("price_adj", stats.half_up("price_adj", 3))


_DAILY = f"""{_LINES}, prices AS (SELECT l_suppkey AS entity, day AS d, {_hu(f"sum({_CENTS}) / 100.0::DOUBLE / sum(l_quantity)", 4)} AS close, sum(l_quantity) AS volume FROM lines GROUP BY 1, 2)"""


def _daily(spark, d):
    return s.lines(spark, d).groupBy(F.col("l_suppkey").alias("entity"), F.col("day").alias("d")).agg(
        stats.half_up(F.sum(s.cents()) / 100.0 / F.sum("l_quantity"), 4).alias("close"), F.sum("l_quantity").alias("volume")
    )


@query(f"""WITH {_DAILY}, e AS (SELECT entity, max_by(close, d) FILTER (d <= DATE '2001-05-31') AS late, max_by(close, d) FILTER (d <= DATE '2000-06-30') AS early,
  max(d) FILTER (d <= DATE '2000-06-30') AS early_d FROM prices GROUP BY 1)
SELECT entity, CASE WHEN late IS NOT NULL AND DATE '2000-06-30' - early_d <= 7 THEN {_hu("late / early - 1", 4)} END AS momentum FROM e""")
def momentum_12_1(spark, d):
    return temporal.momentum(_daily(spark, d), "2001-06-30", 12)


@query(f"""WITH {_DAILY}, l AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d DESC) AS n FROM prices WHERE d <= DATE '2001-06-30')
SELECT entity, {_hu("avg(close * volume)", 4)} AS adv FROM l WHERE n <= 63 GROUP BY 1""")
def adv_63(spark, d):
    return temporal.average_dollar_volume(_daily(spark, d), "2001-06-30").withColumn("adv", stats.half_up("adv", 4))


_FORWARD = f"""{_PANEL},
fwd AS (SELECT a.month, a.entity, a.composite, b.price / a.price - 1 AS fwd FROM panel a JOIN idx i USING (month) JOIN idx j ON j.idx = i.idx + 3 JOIN panel b ON b.month = j.month AND b.entity = a.entity
  WHERE a.price > 0 AND b.price IS NOT NULL),
bucketed AS (SELECT *, least(9, floor((row_number() OVER (PARTITION BY month ORDER BY composite DESC, entity) - 1) / (count(*) OVER (PARTITION BY month) / 10.0::DOUBLE)))::BIGINT + 1 AS bucket,
  count(*) OVER (PARTITION BY month) AS size FROM fwd),
kept AS (SELECT * FROM bucketed WHERE size >= 30)"""


def _buckets(spark, d):
    p = s.monthly_scores(spark, d).withColumnRenamed("price", "price_adj")
    return panel.score_deciles(panel.forward_returns(p, 3))


@query(f"WITH {_FORWARD} SELECT bucket, {_hu("avg(fwd)", 6)} AS mean_fwd, count(*) AS n FROM kept GROUP BY 1")
def forward_decile_returns(spark, d):
    return panel.decile_means(_buckets(spark, d)).withColumn("mean_fwd", stats.half_up("mean_fwd", 6))


@query(f"""WITH {_FORWARD}, means AS (SELECT bucket, avg(fwd) AS m FROM kept GROUP BY 1), steps AS (SELECT *, m <= lag(m) OVER (ORDER BY bucket) + 1e-9 AS ok FROM means)
SELECT (SELECT bool_and(coalesce(ok, true)) FROM steps) AS monotonic, round((SELECT m FROM means WHERE bucket = 1) - avg(fwd), 6) AS top_spread,
  count(DISTINCT month) AS observations, count(DISTINCT month) >= 12 AS interpretable FROM kept""")
def decile_monotonic(spark, d):
    return panel.decile_verdict(_buckets(spark, d)).select("monotonic", stats.half_up("top_spread", 6).alias("top_spread"), "observations", "interpretable")


def _changes(spark, d):
    now, before = s.customer_month(spark, d, "2001-06"), s.customer_month(spark, d, "2001-05")
    was = before.select("entity", F.col("composite").alias("was"))
    change = stats.half_up(F.try_divide(F.col("composite") - F.col("was"), F.col("was")), 6)
    return s.customers(spark, d).join(now.select("entity", "composite", "rank"), "entity", "left").join(was, "entity", "left").withColumn("change", change)


_CHANGES = f"""WITH {_MONTHS}, changes AS (SELECT c_custkey AS entity, c_name AS name, c_nationkey::VARCHAR AS sector, c_mktsegment AS segment, n.composite, n.rank,
  round((n.composite - p.composite) / nullif(p.composite, 0), 6) AS change FROM customer LEFT JOIN now n ON n.entity = c_custkey LEFT JOIN prev p ON p.entity = c_custkey)"""


@query(f"{_CHANGES} SELECT sector, round(avg(change), 6) AS mean_change, count(*) AS n FROM changes WHERE change IS NOT NULL GROUP BY 1")
def sector_average_change(spark, d):
    return screen.group_change(_changes(spark, d)).withColumn("mean_change", stats.half_up("mean_change", 6))


def _held(spark, d):
    w = s.watch(spark, d)
    at = w.select("entity").distinct().withColumn("instant", F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return screen.held_at(w.where("event_type <> 'view'"), at)


_HELD = """held AS (SELECT DISTINCT user_id AS entity FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ends FROM events)
  WHERE event_type <> 'view' AND ts <= TIMESTAMP '2024-01-15 12:00:00' AND (ends IS NULL OR TIMESTAMP '2024-01-15 12:00:00' < ends))"""


@query(f"WITH {_HELD} SELECT entity FROM held")
def held_at_instant(spark, d):
    return _held(spark, d).select("entity")


@query(f"""{_CHANGES}, {_HELD}, means AS (SELECT sector, avg(change) AS m FROM changes GROUP BY 1), x AS (SELECT c.*, m, h.entity IS NOT NULL AS held FROM changes c JOIN means USING (sector) LEFT JOIN held h ON h.entity = c.entity)
SELECT round(avg(change) FILTER (held), 6) AS mean_change, round(avg(change), 6) AS universe_mean, round(avg(change - m) FILTER (held), 6) AS sector_spread,
  count(*) FILTER (held) AS n_held, count(change) FILTER (held) AS n_priced FROM x""")
def portfolio_summary(spark, d):
    out = screen.portfolio_summary(_held(spark, d), _changes(spark, d))
    r = lambda c: stats.half_up(c, 6).alias(c)
    return out.select(r("mean_change"), r("universe_mean"), r("sector_spread"), "n_held", "n_priced")


@query(f"WITH {_HELD}, {_MONTHS} SELECT entity FROM held WHERE entity NOT IN (SELECT entity FROM now)")
def unscored_holdings(spark, d):
    return screen.unscored_holdings(_held(spark, d).select("entity"), s.customer_month(spark, d, "2001-06"))


@query(f"""WITH {_MONTHS} SELECT count(*) FILTER (p.entity IS NULL) AS entered, count(*) FILTER (n.entity IS NULL) AS left_out, median(abs(p.rank - n.rank)) AS median_move
FROM now n FULL OUTER JOIN prev p ON n.entity = p.entity""")
def month_summary(spark, d):
    return panel.month_summary(s.customer_month(spark, d, "2001-06"), s.customer_month(spark, d, "2001-05"))


@query(f"""WITH {_MONTHS}, deltas AS (SELECT n.entity, p.rank - n.rank AS rank_change FROM now n JOIN prev p ON n.entity = p.entity WHERE p.rank <> n.rank)
SELECT * FROM (SELECT * FROM (SELECT * FROM deltas ORDER BY rank_change DESC, entity LIMIT 3) WHERE rank_change > 0
UNION ALL SELECT * FROM (SELECT * FROM deltas ORDER BY rank_change, entity LIMIT 3) WHERE rank_change < 0)""")
def top_movers(spark, d):
    up, down = panel.top_movers(panel.with_deltas(s.customer_month(spark, d, "2001-06"), s.customer_month(spark, d, "2001-05")))
    return up.unionByName(down).select("entity", "rank_change")


@query(f"""{_CHANGES} SELECT entity, sector, composite, change FROM changes WHERE sector IN ('1', '2', '3', '4', '5', '6') AND composite >= 50000 AND change >= -0.5""")
def screen_filter_sort(spark, d):
    found = screen.screen(_changes(spark, d), sectors=["1", "2", "3", "4", "5", "6"], min_change=-0.5, min_composite=50000.0)
    return screen.sorted_by(found, "score").select("entity", "sector", "composite", "change")


@query("""SELECT entity, segment FROM (
  SELECT c_custkey::VARCHAR AS entity, c_mktsegment AS segment, c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING'
  UNION ALL SELECT 'S' || s_suppkey, NULL, s_name FROM supplier)
WHERE contains(lower(name), '00012') OR contains(lower(entity), '00012') ORDER BY entity LIMIT 8""")
def cross_search(spark, d):
    c = s.customers(spark, d).select(F.col("entity").cast("string").alias("entity"), "name", "segment")
    unranked = s.table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity"), F.col("s_name").alias("name"))
    return screen.cross_search(c, unranked, "00012", "BUILDING").select("entity", "segment")


@query(f"WITH {_SCORED} SELECT entity, segment, rank FROM scored WHERE rank <= 10")
def topn_per_segment(spark, d):
    return screen.top_per_segment(_scored(spark, d)[0], 10).select("entity", "segment", "rank")


@query(f"WITH {_SCORED} SELECT g.entity, g.metric, g.pct FROM gated g SEMI JOIN (SELECT entity FROM scored WHERE decile = 1) k ON g.entity = k.entity")
def pack_subset(spark, d):
    top = _scored(spark, d)[0].where("decile = 1")
    return screen.pack_subset(_grid(spark, d), top, ["entity"]).select("entity", "metric", "pct")


@query(f"""WITH {_FACTS}, m AS (SELECT DISTINCT CASE WHEN entity % 10 = 9 THEN entity - 1 ELSE entity END AS entity, concept, "start", "end", val, filed FROM facts)
SELECT entity, count(*) AS n, {_hu("sum(val)", 2)} AS total FROM m GROUP BY 1""")
def predecessor_merge(spark, d):
    f = s.facts(spark, d)
    pairs = f.select("entity").distinct().where("entity % 10 = 9").select(F.col("entity").alias("predecessor"), (F.col("entity") - 1).alias("successor"))
    merged = temporal.merge_predecessors(f, pairs)
    return merged.groupBy("entity").agg(F.count("*").alias("n"), stats.half_up(F.sum("val"), 2).alias("total"))


@query("""WITH n AS (SELECT o_custkey AS entity, o_orderpriority AS p, count(*) AS n, min(o_orderkey) AS seen FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, seen) AS k FROM n) SELECT entity, p AS o_orderpriority, n FROM r WHERE k = 1""")
def mode_value(spark, d):
    o = s.table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), "o_orderpriority", "o_orderkey")
    return stats.most_common(o, ["entity"], "o_orderpriority", "o_orderkey")


@query("""SELECT p_partkey AS entity, regexp_matches(lower(p_name), '\\b(red|blue|green)\\b') AND NOT regexp_matches(lower(p_name), '\\b(steel|copper)\\b') AS common FROM part""")
def name_predicate(spark, d):
    name = F.col("p_name")
    keep = scalars.whole_word(name, "red", "blue", "green") & ~scalars.whole_word(name, "steel", "copper")
    return s.table(spark, d, "part").select(F.col("p_partkey").alias("entity"), keep.alias("common"))


#: (sector, industry, segment, peer group) of labels without figures to go by; null peers have no sector.
_LABELS = [
    ("Finance", "Major Banks", "banks", None), ("Finance", "Savings Institutions", "banks", None), ("Finance", "Life Insurance", "insurers", "Life & health insurers"),
    ("Finance", "Accident &Health Insurance", "insurers", "Life & health insurers"), ("Finance", "Specialty Insurers", "insurers", "Property & casualty insurers"),
    ("Finance", "Insurance Agents, Brokers & Service", "insurers", "Property & casualty insurers"), ("Finance", "Investment Managers", "capital_markets", "Asset managers & other"),
    ("Finance", "Investment Bankers/Brokers/Service", "capital_markets", "Brokers & capital markets"), ("Finance", "Trusts Except Educational Religious and Charitable", "reits", "Finance"),
    ("Real Estate", "Real Estate Investment Trusts", "reits", "Real Estate"), ("Real Estate", "Building operators", "reits", "Real Estate"), ("Finance", "Real Estate", "reits", "Finance"),
    ("Real Estate", "Other Consumer Services", "operating", "Real Estate"), ("Real Estate", "Homebuilding", "operating", "Real Estate"), ("Technology", "Real Estate Investment Trusts", "operating", "Technology"),
    ("Finance", "Computer Software", "operating", "Finance"), ("Health Care", "Major Pharmaceuticals", "operating", "Health Care"), ("", "Major Banks", "operating", None), (None, None, "operating", None),
    ("Health Care", "Biotechnology: Biological Products", "by revenue", "Health Care"), ("Health Care", "Medicinal Chemicals and Botanical Products", "by revenue", "Health Care"),
    ("Health Care", "Pharmaceutical Preparations", "by revenue", "Health Care"), ("Finance", "Finance: Consumer Services", "by evidence", None), ("Finance", "Finance Companies", "by evidence", None),
]
_LABELS_SQL = ", ".join("(" + ", ".join([str(k), *("NULL" if x is None else f"'{x}'" for x in row)]) + ")" for k, row in enumerate(_LABELS))


@query(f"""WITH labels(k, sector, industry, seg, peer) AS (VALUES {_LABELS_SQL}),
rows AS (SELECT c_custkey AS entity, c_acctbal AS x, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal * 5000 END AS revenue, c_custkey % 5 = 0 AS fund, labels.* FROM customer JOIN labels ON k = c_custkey % {len(_LABELS)}),
told AS (SELECT *, CASE seg WHEN 'by revenue' THEN CASE WHEN revenue IS NULL OR revenue < 10000000 THEN 'pre_revenue' ELSE 'operating' END
  WHEN 'by evidence' THEN CASE WHEN fund OR x / 100000 >= 0.04 THEN 'banks' ELSE 'operating' END ELSE seg END AS segment FROM rows)
SELECT entity, segment, CASE WHEN coalesce(sector, '') = '' THEN NULL WHEN segment = 'banks' AND seg = 'by evidence' THEN 'Consumer & specialty lenders'
  WHEN segment = 'banks' THEN CASE WHEN x * 4e6 >= 2e10 THEN 'Large banks' WHEN x * 4e6 >= 3e9 THEN 'Regional banks' ELSE 'Community banks' END
  WHEN seg = 'by evidence' THEN sector ELSE peer END AS peer FROM told""")
def segment_and_peer(spark, d):
    labels = spark.createDataFrame([(k, *row[:2]) for k, row in enumerate(_LABELS)], "k int, sector string, industry string")
    x = s.table(spark, d, "customer").withColumn("k", (F.col("c_custkey") % len(_LABELS)).cast("int")).join(F.broadcast(labels), "k")
    revenue, fund = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") * 5000), F.col("c_custkey") % 5 == 0
    told = x.withColumn("segment", classify.segment(F.col("sector"), F.col("industry"), revenue, F.col("c_acctbal"), F.lit(100000.0), fund))
    peer = classify.peer_group(F.col("segment"), F.col("sector"), F.col("industry"), F.col("c_acctbal") * 4e6)
    return told.select(F.col("c_custkey").alias("entity"), "segment", peer.alias("peer"))


#: (what follows a name, whether it is an operating company's common stock).
_TAILS = [
    ("Common Stock", True), ("Class A Common Stock", True), ("Ordinary Shares", True), ("Class B Ordinary Share", True), ("Common Shares", True), ("COMMON STOCK", True), ("Class C Capital Stock", True),
    ("Acquisition Corp Common Stock", False), ("Acquisitions Corp. Class A Ordinary Share", False), ("Trust Common Stock", False), ("American Depositary Shares", False), ("Bond Index Portfolio", False),
    ("Capital Stock", False), ("Warrant", False), ("Warrants to buy Common Stock", True), ("Unit of one Common Stock", False), ("Right to one Common Stock", False), ("5% Preferred Common Stock", False),
    ("Closed End Fund Common Shares", False), ("closed-end Common Stock", False), ("Senior Note Common Stock", False), ("ETF", False), ("SPAC Common Stock", False), ("Debenture Common Stock", False), ("", False), (None, False),
]


@query("WITH tails(k, tail, common) AS (VALUES " + ", ".join(f"({k}, {'NULL' if x is None else repr(x)}, {str(y).lower()})" for k, (x, y) in enumerate(_TAILS)) + f""")
SELECT p_partkey AS entity, common FROM part JOIN tails ON k = p_partkey % {len(_TAILS)}""")
def common_stock(spark, d):
    tails = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(_TAILS)], "k int, tail string")
    p = s.table(spark, d, "part").withColumn("k", (F.col("p_partkey") % len(_TAILS)).cast("int")).join(F.broadcast(tails), "k")
    return p.select(F.col("p_partkey").alias("entity"), classify.is_common_stock(F.concat(F.lit("Brand "), F.col("p_partkey").cast("string"), F.lit(" Inc. "), F.col("tail"))).alias("common"))


@query(f"WITH {_SCORED} SELECT count(*) AS cells, count(pct) AS resolved, round(count(pct) / count(*), 6) AS share FROM gated")
def coverage_totals(spark, d):
    return panel.coverage_totals(_grid(spark, d)).withColumn("share", stats.half_up("share", 6))


@query(f"WITH {_MONTHS} SELECT month, entity, composite, rank FROM r WHERE month BETWEEN '2001-04' AND '2001-06' QUALIFY row_number() OVER (PARTITION BY entity ORDER BY month DESC) = 1")
def latest_of_months(spark, d):
    months = [s.customer_month(spark, d, m).withColumn("month", F.lit(m)) for m in ("2001-04", "2001-05", "2001-06")]
    every = months[0].unionByName(months[1]).unionByName(months[2])
    points = panel.history_index(every.select("month", "entity", "composite", "rank"))
    return points.select("entity", F.element_at("points", -1).alias("p")).select("p.month", "entity", "p.composite", "p.rank")


@query(f"""WITH {_PANEL}, x AS (SELECT *, count(composite) OVER w AS n, min(composite) OVER w AS lo, max(composite) OVER w AS hi, last_value(composite) OVER o >= first_value(composite) OVER o AS rising
  FROM panel WINDOW w AS (PARTITION BY entity), o AS (PARTITION BY entity ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT month, entity, CASE WHEN n >= 2 THEN round((composite - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) END AS level, rising FROM x""")
def spark_line(spark, d):
    return panel.spark_line(s.monthly_scores(spark, d), "composite").select("month", "entity", stats.half_up("level", 6).alias("level"), "rising")


@query(f"""WITH {_MONTHS} SELECT month, segment, string_agg(rank || '. ' || entity || ' ' || name || ': ' || composite_text, chr(10) ORDER BY rank, entity) AS text
FROM (SELECT *, format('{{:,.2f}}', composite) AS composite_text FROM now WHERE rank <= 5) GROUP BY 1, 2""")
def table_export(spark, d):
    now = screen.top_per_segment(s.customer_month(spark, d, "2001-06"), 5)
    rows = now.withColumn("entity", F.col("entity").cast("string"))
    return sinks.table_text(rows).select(F.lit("2001-06").alias("month"), "segment", "text")


@query(f"{_CHANGES} SELECT sector, count(*) AS n FROM changes GROUP BY 1")
def sector_facets(spark, d):
    return screen.facet_counts(_changes(spark, d))


@query(f"{_CHANGES} SELECT entity, change FROM changes WHERE abs(change) > 0.5")
def price_review(spark, d):
    return screen.price_review(_changes(spark, d)).select("entity", "change")


@query(f"WITH {_SCORED} SELECT entity, decile FROM scored WHERE decile = 1")
def top_decile_scope(spark, d):
    return screen.top_decile(_scored(spark, d)[0]).select("entity", "decile")


@query(f"""{_CASCADE} SELECT entity, stage FROM staged WHERE stage IS NOT NULL AND contains(entity::VARCHAR, '13')""")
def exclusion_search(spark, d):
    out = _staged(spark, d).where("stage is not null").withColumn("id", F.col("entity")).withColumn("entity", F.col("entity").cast("string"))
    return screen.exclusion_search(out.withColumn("reason", F.lit("")), "13").select(F.col("id").alias("entity"), "stage")


@query("""SELECT c_custkey::VARCHAR AS entity, c_name AS name, 'ranked' AS found FROM customer WHERE c_custkey = 77""")
def point_lookup(spark, d):
    c = s.customers(spark, d).select(F.col("entity").cast("string").alias("entity"), "name")
    return screen.point_lookup(c, c, " 77 ")


@query("""WITH w AS (SELECT user_id AS entity, ts AS added_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS removed_at FROM events)
SELECT entity, min(added_at)::DATE AS day FROM w WHERE removed_at IS NULL GROUP BY 1""")
def open_holdings(spark, d):
    return screen.open_holdings(s.watch(spark, d))


@query("""WITH w AS (SELECT user_id AS entity, ts AS added_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS removed_at FROM events)
SELECT entity, added_at FROM w UNION ALL
SELECT c_custkey, TIMESTAMP '2024-02-01' FROM customer WHERE c_custkey NOT IN (SELECT entity FROM w WHERE removed_at IS NULL)""")
def import_holdings(spark, d):
    shared = s.customers(spark, d).select("entity", F.lit("2024-02-01").cast("timestamp").alias("added_at"))
    log = s.watch(spark, d).select("entity", "added_at", "removed_at")
    return screen.import_holdings(shared, log).select("entity", F.col("added_at").cast("timestamp_ntz").alias("added_at"))


@query("SELECT min(ts) AS first_at FROM events")
def first_watch_event(spark, d):
    return screen.first_event(s.watch(spark, d))


@query(f"""{_EXITS}, a AS (SELECT entity, name, 'insufficient' AS kind, 'too few measures' AS reason FROM now WHERE entity % 5 = 0)
SELECT entity, kind, reason FROM a UNION ALL SELECT g.entity, kind, reason FROM gone g WHERE g.entity NOT IN (SELECT entity FROM a)""")
def unranked_record(spark, d):
    short = s.customer_month(spark, d, "2001-06").where("entity % 5 = 0").select("entity", "name", F.lit("too few measures").alias("reason"))
    return panel.unranked_record(short, _exits(spark, d)).select("entity", "kind", "reason")


@query(f"""WITH {_PANEL}, p AS (SELECT month, entity, price, lead(price, 3) OVER (PARTITION BY entity ORDER BY month) AS later FROM panel)
SELECT month, entity, {_hu("later / price - 1", 6)} AS fwd FROM p WHERE price > 0 AND later IS NOT NULL""")
def outcome_pairs(spark, d):
    return panel.outcome_pairs(s.monthly_scores(spark, d), 3, "price").select("month", "entity", stats.half_up("fwd", 6).alias("fwd"))


_QFLOWS = f"""{_QUARTERS}, flows AS (SELECT entity, (last_day(("end" - INTERVAL 3 MONTH)::DATE) + 1)::DATE AS "start", "end", val FROM quarters)"""


def _qflows(spark, d):
    q = s.quarterly(spark, d)
    return q.select("entity", F.date_add(F.last_day(F.add_months("end", -3)), 1).alias("start"), "end", "val", F.date_add("end", 40).alias("filed"), F.lit(0).alias("seq"))


@query(f"""WITH {_QFLOWS}, l AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY "end" DESC) AS n FROM flows)
SELECT entity, max("end") AS "end", {_hu("sum(val)", 2)} AS ttm, 'ttm' AS basis FROM l WHERE n <= 4 GROUP BY 1""")
def ttm_tiling(spark, d):
    return temporal.ttm(_qflows(spark, d), ["entity"]).select("entity", "end", stats.half_up("val", 2).alias("ttm"), "basis")


@query(f"""WITH {_YTD} SELECT entity, "end", {_hu("val", 2)} AS val FROM quarters""")
def quarterly_series(spark, d):
    f = _ytd(spark, d).withColumn("seq", F.lit(0))
    return temporal.quarterly_series(f, ["entity"]).select("entity", "end", stats.half_up("val", 2).alias("val"))


@query(f"""WITH {_YTD} SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY "end" DESC) - 1 AS k, "end", {_hu("val", 2)} AS val FROM ytd
WHERE month("end") = 12 QUALIFY k < 6""")
def annual_series(spark, d):
    f = _ytd(spark, d).withColumn("seq", F.lit(0))
    years = temporal.annual_series(f, ["entity"]).select("entity", F.posexplode("years").alias("k", "y"))
    return years.select("entity", F.col("k").cast("long").alias("k"), "y.end", stats.half_up("y.val", 2).alias("val"))


@query(f"""WITH {_QUARTERS}, l AS (SELECT entity, max("end") AS last FROM quarters GROUP BY 1)
SELECT entity, k::INTEGER AS k, (last - round_even(k * 365.25, 0)::INTEGER)::DATE AS target FROM l, unnest([0, 1, 2, 3, 4]) AS t(k)""")
def anniversaries(spark, d):
    ends = s.quarterly(spark, d).groupBy("entity").agg(F.max("end").alias("last"))
    return temporal.anniversaries(ends, ["entity"], "last").select("entity", "k", "target")


@query(f"""WITH {_FACTS}, l AS (SELECT entity, concept, max("end") AS last_reported FROM facts GROUP BY 1, 2)
SELECT entity, concept, last_reported FROM l WHERE last_reported < DATE '2001-06-30' - 300""")
def stale_inputs(spark, d):
    f = s.facts(spark, d)
    anchor = f.select("entity").distinct().withColumn("anchor", F.lit("2001-06-30").cast("date"))
    return temporal.stale_inputs(f, anchor, ["entity", "concept"])


@query(f"""WITH {_SCORED} SELECT entity, factor, string_agg(metric, ', ' ORDER BY coalesce(pct, -1) DESC, metric) AS metrics FROM gated GROUP BY 1, 2""")
def metric_order(spark, d):
    return score.drivers_text(_grid(spark, d))


@query(f"""WITH {_FACTS}
SELECT entity, bool_or(concept = 'R') AS domestic, count(DISTINCT (concept, seq)) AS n_filings, max("end") AS latest FROM facts
WHERE concept = 'A' OR (concept = 'R' AND entity NOT IN (SELECT entity FROM facts WHERE concept = 'A')) GROUP BY 1""")
def structural_signals(spark, d):
    f = s.facts(spark, d).withColumns({"form": F.col("concept"), "accn": F.col("seq")})
    return eligibility.structural_signals(f, ["R"], ["A", "R"])


@query(f"""{_EXITS} SELECT entity, kind, rank, row_number() OVER (ORDER BY kind, rank NULLS LAST, entity) AS place
FROM (SELECT entity, kind, CASE WHEN entity % 5 <> 0 THEN rank END AS rank FROM gone)""")
def exit_order(spark, d):
    gone = _exits(spark, d).withColumn("rank", F.when(F.col("entity") % 5 != 0, F.col("rank")))
    return panel.exit_places(gone).select("entity", "kind", "rank", "place")
