"""Queries over the record of months: incremental chains, the data pack and its subset, exports, sorts with places."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortal import catalog as c
from cohortal.catalog_sources import _path
from cohortal.functions import scalars as sc
from cohortal.functions import stats
from cohortal.operators import screen
from cohortal.plans import chain, pack, panel
from cohortal.plans import standin as s
from cohortal.plans.stage import written
from cohortal.registry import half_up_sql as _hu
from cohortal.registry import query
from cohortal.sources import readers, sinks

_NEWEST, _BEFORE = "2001-07", "2001-06"


def _chained(price: str = "price", prior: str = "prior_price") -> str:
    """The chain of the newest basis, stated once more as a walk from the newest month back; the newest month's rows may be given anew."""
    return f"""{c._LINES}, panel AS (SELECT strftime(day, '%Y-%m') AS month, l_partkey AS entity, {_hu(f"sum({c._CENTS}) / 100.0::DOUBLE / sum(l_quantity)", 4)} AS price FROM lines WHERE day < DATE '2001-08-01' GROUP BY 1, 2),
idx AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS idx FROM (SELECT DISTINCT month FROM panel)),
p0 AS (SELECT panel.*, idx, {_hu("lag(price) OVER (PARTITION BY entity ORDER BY panel.month) * 1.01::DOUBLE", 4)} AS prior_price FROM panel JOIN idx USING (month)),
p AS (SELECT month, entity, idx, {price} AS price, {prior} AS prior_price FROM p0),
l AS (SELECT *, row_number() OVER w = 1 AS newest, lag(idx) OVER w = idx + 1 AND lag(prior_price) OVER w > 0 AND price > 0 AS ok, lag(prior_price) OVER w / price AS link FROM p WINDOW w AS (PARTITION BY entity ORDER BY idx DESC)),
c AS (SELECT *, max(CASE WHEN NOT newest AND NOT coalesce(ok, false) THEN 1 ELSE 0 END) OVER w AS broken,
  exp(sum(CASE WHEN newest OR NOT coalesce(ok, false) THEN 0 ELSE ln(link) END) OVER w) AS factor FROM l WINDOW w AS (PARTITION BY entity ORDER BY idx DESC ROWS UNBOUNDED PRECEDING))
SELECT month, entity, CASE WHEN broken = 0 THEN {_hu(_hu("price * factor", 4), 2)} END AS price_adj FROM c"""


def _chain_record(spark, d) -> str:
    """A record begun with all months but the last two, which follow one by one."""
    # Written once: each of three appends asks for its months and then for its rows.
    rows, path = written(c._part_panel(spark, d).select("month", "entity", "price", "prior_price")), _path(spark, "chain")
    sinks.append_months(chain.linked_history(rows.where(F.col("month") < _BEFORE)), path)
    for month in (_BEFORE, _NEWEST):
        chain.chain_month(spark, path, rows.where(F.col("month") == month), month)
    return path


@query(f"WITH {_chained()}")
def chain_update(spark, d):
    """Prices on the newest basis from a record that was kept up month by month."""
    return chain.on_newest_basis(readers.read_months(spark, _chain_record(spark, d))).withColumn("price_adj", stats.half_up("price_adj", 2))


_SPLIT = f"month = '{_NEWEST}' AND entity % 10 = 0"


@query(f"WITH {_chained(f'CASE WHEN {_SPLIT} THEN price / 2 ELSE price END', f'CASE WHEN {_SPLIT} THEN prior_price / 2 ELSE prior_price END')}")
def chain_restated(spark, d):
    """The same after a split behind the newest month: its prices are restated, the record stays."""
    path = _chain_record(spark, d)
    record = readers.read_months(spark, path)
    latest = readers.read_months(spark, path, only=_NEWEST).where("entity % 10 = 0").select("entity", (F.col("price") / 2).alias("price"), (F.col("prior_price") / 2).alias("prior_price"))
    return chain.on_newest_basis(chain.restated(record, latest, _NEWEST, readers.read_months(spark, path, only=_BEFORE))).withColumn("price_adj", stats.half_up("price_adj", 2))


# -- the data pack

_RECORD = """ordered AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey AS entity, sum(round(o_totalprice * 100)::BIGINT) / 100.0::DOUBLE AS composite, count(*)::DOUBLE AS orders FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01' GROUP BY 1, 2),
scores AS (SELECT month, entity, c_name AS name, c_nationkey::VARCHAR AS sector, c_mktsegment AS segment, composite, orders, row_number() OVER (PARTITION BY month, c_mktsegment ORDER BY composite DESC, entity) AS rank FROM ordered JOIN customer ON c_custkey = entity),
idx AS (SELECT month, row_number() OVER (ORDER BY month) AS i FROM (SELECT DISTINCT month FROM scores)),
not_ranked AS (SELECT j.month, a.entity, a.name, a.segment, 'unlisted' AS kind, 'no orders' AS reason FROM scores a JOIN idx i USING (month) JOIN idx j ON j.i = i.i + 1 LEFT JOIN scores b ON b.month = j.month AND b.entity = a.entity WHERE b.entity IS NULL)"""
_PACK_SPEC = [("spend", "quality", True), ("orders", "growth", True), ("late", "health", False)]


def _pack(spark, d):
    """The record of all months as a pack: customers that ordered are ranked, those that did a month before and not now are not."""
    o = s.table(spark, d, "orders").where(F.col("o_orderdate") < "2001-08-01")
    spent = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_custkey").alias("entity")).agg(
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("composite"), F.count("*").cast("double").alias("orders")
    )
    scores = s.customers(spark, d).select("entity", "name", "sector", "segment").join(spent, "entity")
    w = Window.partitionBy("month", "segment").orderBy(F.desc("composite"), "entity")
    scores = scores.withColumn("rank", F.row_number().over(w).cast("long"))
    metrics = scores.select("month", "entity", F.col("composite").alias("spend"), "orders").unpivot(["month", "entity"], ["spend", "orders"], "metric", "raw").withColumn("pct", F.lit(None).cast("double"))
    idx = F.broadcast(panel.month_index(scores))  # as long as the record has months
    later = scores.join(idx, "month").select("entity", "name", "segment", (F.col("idx") + 1).alias("idx"))
    here = scores.join(idx, "month").select("entity", "idx")
    gone = later.join(here, ["entity", "idx"], "left_anti").join(idx, "idx").select("month", "entity", "name", "segment", F.lit("unlisted").alias("kind"), F.lit("no orders").alias("reason"))
    spec = spark.createDataFrame(_PACK_SPEC, "metric string, factor string, higher_better boolean")  # three rows
    return pack.build(scores, metrics, gone, spec)


_COUNTS = f"""kept AS (SELECT s.* FROM scores s WHERE segment = 'MACHINERY' OR (segment = 'BUILDING' AND entity IN (SELECT entity FROM scores WHERE month = '{_NEWEST}' AND segment = 'BUILDING' AND rank <= 5)))"""


@query(f"""WITH {_RECORD}, {_COUNTS}
SELECT 'scores_monthly' AS file, month AS key, count(*) AS n_rows, round(sum(composite), 2) AS total FROM kept GROUP BY month
UNION ALL SELECT 'metrics_monthly', month, 2 * count(*), round(sum(composite + orders), 2) FROM kept GROUP BY month
UNION ALL SELECT 'companies', segment, count(DISTINCT entity), 0 FROM kept GROUP BY segment
UNION ALL SELECT 'not_ranked_monthly', month, count(*), 0 FROM not_ranked WHERE segment IN ('MACHINERY', 'BUILDING') GROUP BY month
UNION ALL SELECT 'months', month, 1, count(*) FROM scores GROUP BY month
UNION ALL SELECT 'metrics_dictionary', metric, 1, 0 FROM (VALUES ('spend'), ('orders'), ('late')) t(metric)""")
def data_pack_subset(spark, d):
    """One segment whole and today's first five of another, in all six tables, as read back from the pack's files."""
    full, path = _pack(spark, d), _path(spark, "pack")
    keep = pack.top_today(full[pack.SCORES], 5).where("segment = 'BUILDING'")
    cut = pack.subset(full, ["MACHINERY", "BUILDING"], keep)
    pack.write(cut, path)
    schema = lambda n: cut[n].schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    keys = {pack.SCORES: ("month", "composite"), pack.METRICS: ("month", "raw"), pack.COMPANIES: ("segment", None), pack.NOT_RANKED: ("month", None), pack.MONTHS: ("month", "companies_ranked"), pack.DICTIONARY: ("metric", None)}
    out = None
    for name, (key, value) in keys.items():
        total = F.round(F.sum(F.col(value).cast("double")), 2) if value else F.lit(0.0)
        rows = pack.read(spark, path, name, schema(name)).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_rows"), total.alias("total"))
        rows = rows.select(F.lit(name).alias("file"), "key", "n_rows", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {_RECORD} SELECT 'months' AS file, count(DISTINCT month) AS n_rows FROM scores UNION ALL SELECT 'metrics_dictionary', 3 UNION ALL SELECT 'companies', count(DISTINCT entity) FROM scores
UNION ALL SELECT 'scores_monthly', count(*) FROM scores UNION ALL SELECT 'metrics_monthly', 2 * count(*) FROM scores UNION ALL SELECT 'not_ranked_monthly', count(*) FROM not_ranked""")
def data_pack_manifest(spark, d):
    return pack.write(_pack(spark, d), _path(spark, "pack")).select("file", "n_rows")


# -- exports


@query(f"""WITH {_RECORD}, last AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY month DESC) AS k FROM scores)
SELECT entity, string_agg(month || ' | ' || rank || ' | ' || format('{{:.2f}}', composite) || ' | -', chr(10) ORDER BY month) AS text FROM last WHERE k <= 6 GROUP BY 1""")
def company_export(spark, d):
    """Each company's last six months as text; nothing older is gathered."""
    return sinks.history_text(_pack(spark, d)[pack.SCORES].withColumn("price_adj", F.lit(None).cast("double")), 6)


@query(f"""WITH {_RECORD}, m AS (SELECT entity, month, 'spend' AS metric, composite AS raw FROM scores UNION ALL SELECT entity, month, 'orders', orders FROM scores),
last AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY month DESC) AS k FROM m)
SELECT entity, metric, string_agg(month || ' ' || format('{{:,.2f}}', raw), ' | ' ORDER BY month) AS trend FROM last WHERE k <= 4 GROUP BY 1, 2""")
def trend_export(spark, d):
    """Each company's measures along its last four months, one line each."""
    return sinks.trend_text(_pack(spark, d)[pack.METRICS], 4)


@query(f"""WITH {c._SCORED} SELECT entity, segment || '#' || rank || ': ' || format('{{:.2f}}', composite) AS head FROM scored""")
def company_heads(spark, d):
    """The first line of each company's text, by its parts; the measures follow it."""
    scored, _ = c._scored(spark, d)
    text = sinks.company_text(scored, c._grid(spark, d))
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    part = lambda pattern: F.regexp_extract(head, pattern, 1)
    return text.select("entity", F.concat(part(r" of (.*), composite"), F.lit("#"), part(r" rank (\d+) "), F.lit(": "), F.replace(part(r"composite (.*)$"), F.lit(","), F.lit(""))).alias("head"))


# -- sorts with places, the public list


_BY_NAME = {"score": "composite DESC NULLS LAST", "gainers": "change DESC NULLS LAST", "decliners": "change NULLS LAST", "risers": "rank_change DESC NULLS LAST", "name": "lower(coalesce(name, '')) DESC"}
_MOVED = f"""{c._MONTHS}, rows AS (SELECT n.entity, n.name, n.segment, n.composite, p.rank - n.rank AS rank_change, round(n.composite - p.composite, 2) AS change FROM now n LEFT JOIN prev p USING (entity))"""


@query(f"WITH {_MOVED} " + " UNION ALL ".join(f"SELECT '{k}' AS sort, segment, entity, row_number() OVER (PARTITION BY segment ORDER BY {o}, entity) AS place FROM rows" for k, o in _BY_NAME.items()))
def named_sorts(spark, d):
    """Every named sort, and one by text, with each row's place in its table."""
    now, prev = s.customer_month(spark, d, "2001-06"), s.customer_month(spark, d, "2001-05")
    both = panel.with_deltas(now, prev).withColumnRenamed("composite_change", "change").select("entity", "name", "segment", "composite", "rank_change", "change")
    out = None
    for name, (column, down, *text) in (screen.SORTS | {"name": ("name", True, True)}).items():
        rows = screen.placed(both, ["segment"], column, down, *text).select(F.lit(name).alias("sort"), "segment", "entity", "place")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {c._SCORED} SELECT entity, name, c_nationkey::VARCHAR AS sector, segment, rank, composite FROM scored JOIN (SELECT c_custkey AS entity, c_name AS name, c_nationkey FROM customer) USING (entity)""")
def public_list(spark, d):
    """The columns that everyone may see."""
    scored, _ = c._scored(spark, d)
    named = scored.join(s.customers(spark, d).select("entity", "name", "sector"), "entity")
    rows = sinks.public_rows(named.withColumns({"composite_change": F.lit(None).cast("double"), "rank_change": F.lit(None).cast("long")}))
    return rows.drop("decile", "composite_change", "rank_change")


_FOUR = ["quality", "growth", "valuation", "health"]
_SHARE = lambda i: f"CASE WHEN k = {i} THEN v ELSE (spread // 3 + CASE WHEN {i} - CASE WHEN k < {i} THEN 1 ELSE 0 END < spread % 3 THEN 1 ELSE 0 END) / 100.0::DOUBLE END AS {_FOUR[i]}"


@query(f"""WITH x AS (SELECT c_custkey AS entity, c_custkey % 4 AS k, round(least(100, greatest(0, round(c_acctbal) / 100.0::DOUBLE)), 2) AS v FROM customer), y AS (SELECT *, round((100 - v) * 100)::BIGINT AS spread FROM x)
SELECT entity, {", ".join(map(_SHARE, range(4)))} FROM y""")
def weight_rebalance(spark, d):
    """One weight set by each customer's balance, the other three sharing the rest in hundredths."""
    key = F.element_at(F.array(*map(F.lit, _FOUR)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return s.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), sc.rebalanced(_FOUR, key, F.round("c_acctbal") / 100).alias("w")).select("entity", "w.*")
