"""Queries over sources, sinks and scalar functions.

A reader is queried over files that are written from the tables first, in the form in which the source gives them, into
the shared folder; the oracle starts from the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortal.functions import scalars as sc
from cohortal.functions import stats
from cohortal.operators import classify, eligibility, temporal
from cohortal.plans import filings as f
from cohortal.plans import panel
from cohortal.plans import standin as s
from cohortal.plans.stage import shared_folder
from cohortal.registry import half_up_sql as _hu
from cohortal.registry import query
from cohortal.sources import readers, sinks


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def _documents(rows: DataFrame, name: str, by: str | None = None) -> str:
    """Rows of one text column as files; with ``by`` one document a folder."""
    path = _path(rows.sparkSession, name)
    writer = rows.repartition(by).write.partitionBy(by) if by else rows.write
    writer.text(path)
    return path


# -- scalar functions


@query("""SELECT o_orderkey AS entity, strftime(d, '%Y-%m') AS month, last_day(d - INTERVAL 1 MONTH)::DATE AS before, last_day(d - INTERVAL 6 MONTHS)::DATE AS half_year_back,
  (d + INTERVAL 1 MONTH)::DATE AS shifted, round((d - DATE '1995-01-01') / 365.25::DOUBLE, 6) AS years, CASE WHEN o_orderkey % 3 <> 0 THEN d END AS parsed
FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def date_functions(spark, d):
    x = s.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    text = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.col("d").cast("string"), F.lit("T00:00:00Z"))).otherwise("no date")
    return x.select(
        F.col("o_orderkey").alias("entity"), sc.month_key("d").alias("month"), sc.prior_month_end("d").alias("before"), sc.month_end_back("d", 6).alias("half_year_back"),
        sc.shift_months("d", 1).alias("shifted"), F.round(sc.years_between("d", F.lit("1995-01-01").cast("date")), 6).alias("years"), sc.iso_date(text).alias("parsed"),
    )


@query("""SELECT c_custkey AS entity, CASE WHEN c_custkey % 5 <> 0 THEN round(c_acctbal / (c_custkey % 5), 6) END AS ratio, CASE WHEN c_acctbal > 0 THEN round(1000 / c_acctbal, 6) END AS positive,
  least(greatest(c_acctbal, 0), 5000) AS clamped, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE 0 END AS zeroed,
  CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN round(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END, 4) END AS present,
  CASE WHEN c_custkey % 7 > 1 THEN c_acctbal END AS finite FROM customer""")
def math_functions(spark, d):
    c, k, x = s.table(spark, d, "customer"), F.col("c_custkey"), F.col("c_acctbal")
    even, third = F.when(k % 2 == 0, x), F.when(k % 3 == 0, F.lit(1.0))
    odd = F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 7 == 1, F.lit(float("inf"))).otherwise(x)
    return c.select(
        k.alias("entity"), F.round(sc.safe_div(x, k % 5), 6).alias("ratio"), F.round(sc.positive_ratio(F.lit(1000.0), x), 6).alias("positive"), sc.clamp(x, 0, 5000).alias("clamped"),
        sc.or_zero(even).alias("zeroed"), F.round(sc.sum_of_present(even, third), 4).alias("present"), sc.finite(odd).alias("finite"),
    )


@query("""SELECT p_partkey AS entity, contains(lower(p_name), 're') AS has, regexp_matches(lower(p_name), '\\b(red|blue)\\b') AS word, lpad(p_partkey::VARCHAR, 10, '0') AS padded,
  CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS money, 'Maker ' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN ' (A)' WHEN 3 THEN ' Depositary Shares' ELSE '' END AS shown FROM part""")
def text_functions(spark, d):
    p, k = s.table(spark, d, "part"), F.col("p_partkey")
    name = F.concat(F.lit("Maker "), k.cast("string"), F.element_at(F.array(*map(F.lit, [" Class A Common Stock", " common stock of it", " Ordinary Shares  ", " Depositary Shares "])), (k % 4 + 1).cast("int")))
    price = F.when(k % 4 != 0, F.concat(F.lit(" $"), F.format_number("p_retailprice", 2))).otherwise("n/a")
    return p.select(k.alias("entity"), sc.contains_text("p_name", " RE ").alias("has"), sc.whole_word("p_name", "red", "blue").alias("word"), sc.padded_id(k).alias("padded"), sc.money(price).alias("money"), sc.display_name(name).alias("shown"))


_MONTH_SQL = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][month(day)]"


@query(f"""SELECT entity, CASE WHEN x IS NULL THEN '\u2014' ELSE '$' || format('{{:,.2f}}', x) END AS money,
  CASE WHEN x IS NULL THEN '\u2014' WHEN cap >= 1e12 THEN printf('$%.2fT', round((cap / 1e12)::DECIMAL(18, 6), 2)) WHEN cap >= 1e9 THEN printf('$%.1fB', round((cap / 1e9)::DECIMAL(18, 6), 1)) WHEN cap >= 1e6 THEN printf('$%.0fM', round(cap / 1e6)) ELSE printf('$%.0f', round(cap)) END AS cap,
  CASE WHEN x IS NULL THEN '\u2014' ELSE CASE WHEN x >= 0 THEN '+' ELSE '' END || printf('%.2f', x) || '%' END AS change,
  CASE WHEN x IS NULL THEN '\u2014' WHEN entity % 4 = 0 THEN printf('%.1f', x / 7 * 100) || '%' WHEN entity % 4 = 1 THEN CASE WHEN x >= 0 THEN '+' ELSE '' END || printf('%.1f', x / 7 * 100) || 'pp'
    WHEN entity % 4 = 2 THEN printf('%.2f', x / 7) || 'x' ELSE printf('%.2f', x / 7) END AS metric,
  CASE entity % 5 WHEN 0 THEN 'Cons. Disc.' WHEN 1 THEN 'Telecom' WHEN 2 THEN 'Technology' WHEN 3 THEN 'Misc.' ELSE '\u2014' END AS sector,
  {_MONTH_SQL} || ' ' || year(day) AS month, day(day) || ' ' || {_MONTH_SQL} AS day, day(day) || ' ' || {_MONTH_SQL} || ' ' || year(day) AS full_day
FROM (SELECT o_orderkey AS entity, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice - 20000 END AS x, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice * power(100, o_orderkey % 6) END AS cap, o_orderdate::DATE AS day FROM orders)""")
def format_functions(spark, d):
    o, k = s.table(spark, d, "orders"), F.col("o_orderkey")
    x, day = F.when(k % 11 != 0, F.col("o_totalprice") - 20000), F.to_date("o_orderdate")
    cap = F.when(k % 11 != 0, F.col("o_totalprice") * F.pow(F.lit(100.0), k % 6))
    unit = F.element_at(F.array(*map(F.lit, ["pct", "pp", "x", "score"])), (k % 4 + 1).cast("int"))
    sector = F.element_at(F.array(*map(F.lit, ["Consumer Discretionary", "Telecommunications", "Technology", "Miscellaneous", ""])), (k % 5 + 1).cast("int"))
    return o.select(
        k.alias("entity"), sc.money_text(x).alias("money"), sc.cap_text(cap).alias("cap"), sc.percent_text(x).alias("change"), sc.metric_text(x / 7, unit).alias("metric"), sc.short_sector(sector).alias("sector"),
        sc.month_label(F.date_format(day, "yyyy-MM")).alias("month"), sc.day_month(day).alias("day"), sc.full_date(day).alias("full_day"),
    )


@query("""SELECT c_nationkey AS entity, string_agg('C' || c_custkey || ':' || DATE '2024-01-01' + (c_custkey % 28)::INTEGER, ',' ORDER BY c_custkey) AS link, count(*) AS n,
  string_agg('C' || c_custkey || ' ' || CASE WHEN c_custkey % 2 = 0 THEN (DATE '2024-01-01' + (c_custkey % 28)::INTEGER)::VARCHAR ELSE '2024-06-30' END, ';' ORDER BY c_custkey) AS parsed FROM customer GROUP BY 1""")
def share_links(spark, d):
    c = s.table(spark, d, "customer").select("c_nationkey", "c_custkey", F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int")).alias("day"))
    held = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "id", "day"))).alias("x"))
    made = held.select("c_nationkey", "x", sc.share_link("x.id", "x.day").alias("link"))
    # Entries come back in lower case, some without a day, some twice, and with broken ones between them.
    loose = F.transform("x", lambda e: F.concat(F.lower(e["id"]), F.when(e["c_custkey"] % 2 == 0, F.concat(F.lit(":"), e["day"].cast("string"))).otherwise(""), F.lit(",!broken,:2024-01-01,"), e["id"]))
    parsed = sc.parse_share_link(F.array_join(loose, ","), "2024-06-30")
    return made.select(F.col("c_nationkey").alias("entity"), "link", F.size(parsed).cast("long").alias("n"), F.array_join(F.transform(parsed, lambda p: F.concat_ws(" ", p["id"], p["day"])), ";").alias("parsed"))


# -- sources and sinks


@query(f"""WITH {f.SQL.format(lineitem="lineitem", orders="orders")}
SELECT lpad(entity::VARCHAR, 10, '0') AS entity, taxonomy, concept, unit, st, en, val, filed, form FROM filed_facts""")
def facts_scan(spark, d):
    one = F.struct(*(F.col(c).cast("string").alias(c) for c in ("start", "end")), "val", F.col("filed").cast("string").alias("filed"), "accn", "form")
    rows = f.filings(spark, d).groupBy("entity", "taxonomy", "concept", "unit").agg(F.collect_list(one).alias("x"))
    pack = lambda df, by, key, value, name: df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))
    units = pack(rows, ["entity", "taxonomy", "concept"], "unit", "x", "units").select("entity", "taxonomy", "concept", F.struct("units").alias("u"))
    filers = pack(pack(units, ["entity", "taxonomy"], "concept", "u", "c"), ["entity"], "taxonomy", "c", "facts")
    path = _documents(filers.select(F.to_json(F.struct(F.col("entity").alias("cik"), F.concat(F.lit("Filer "), F.col("entity").cast("string")).alias("entityName"), "facts")).alias("value")), "facts")
    got = readers.explode_facts(spark.read.schema(readers.FACT_SCHEMA).json(path))
    return got.select("entity", "taxonomy", "concept", "unit", F.col("start").alias("st"), F.col("end").alias("en"), "val", "filed", "form")


@query("""SELECT 'C' || c_custkey AS entity, c_name AS name, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS sector, round(c_acctbal, 2) AS market_cap, CASE WHEN c_custkey % 4 <> 0 THEN 1000.0::DOUBLE * c_custkey END AS volume FROM customer""")
def universe_scan(spark, d):
    c, k = s.table(spark, d, "customer"), F.col("c_custkey")
    texts = {
        "symbol": F.concat(F.lit(" c"), k.cast("string")), "name": F.col("c_name"), "lastsale": F.lit("$1.50"), "volume": F.when(k % 4 != 0, F.format_number(k * 1000, 0)).otherwise("NA"),
        "marketCap": F.concat(F.lit("$"), F.format_number("c_acctbal", 2)), "sector": F.when(k % 6 != 0, F.col("c_mktsegment")).otherwise("  "), "industry": F.lit(""), "country": F.lit("x"),
    }
    # A listing document for each block of keys; the feed gives one.
    block = (k % 16).alias("block")
    docs = c.select(block, F.struct(*(v.alias(n) for n, v in texts.items())).alias("r")).groupBy("block").agg(F.to_json(F.struct(F.struct(F.collect_list("r").alias("rows")).alias("data"))).alias("value"))
    got = readers.read_universe(spark, _documents(docs, "universe", "block"))
    return got.select("entity", "name", "sector", "market_cap", "volume")


@query("""SELECT s.s_suppkey AS entity, CASE WHEN s_suppkey % 3 <> 0 THEN lpad(s_suppkey::VARCHAR, 10, '0') END AS id FROM supplier s""")
def id_map_scan(spark, d):
    x = s.table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity"))
    docs = x.where("s_suppkey % 3 <> 0").select(F.to_json(F.struct(F.lower("entity").alias("ticker"), F.col("s_suppkey").alias("cik_str"))).alias("value"))
    matched, rest = readers.match_ids(x, readers.read_id_map(spark, _documents(docs, "ids"), least=1))
    return matched.select(F.col("s_suppkey").alias("entity"), "id").unionByName(rest.select(F.col("s_suppkey").alias("entity"), F.lit(None).cast("string").alias("id")))


_FORMS = "CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-Q' WHEN '3-MEDIUM' THEN '8-K12B' ELSE '8-K' END"


@query(f"""WITH x AS (SELECT o_custkey AS entity, {_FORMS} AS form, o_orderdate::DATE AS filed, (o_orderdate::DATE - 30)::DATE AS report, o_orderkey FROM orders),
newest AS (SELECT entity, form, filed, report FROM x WHERE form IN ('10-K', '10-Q') AND filed <= DATE '2000-06-30' QUALIFY row_number() OVER (PARTITION BY entity ORDER BY report DESC, filed DESC, form DESC) = 1)
SELECT lpad(entity::VARCHAR, 10, '0') AS entity, n.form, n.filed, n.report, notice FROM (SELECT entity, bool_or(form = '8-K12B') AS notice FROM x GROUP BY 1) LEFT JOIN newest n USING (entity)""")
def filing_index(spark, d):
    o = s.table(spark, d, "orders")
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "10-K").when(F.col("o_orderpriority") == "2-HIGH", "10-Q").when(F.col("o_orderpriority") == "3-MEDIUM", "8-K12B").otherwise("8-K")
    day = F.to_date("o_orderdate")
    rows = o.groupBy(F.col("o_custkey").cast("string").alias("cik")).agg(F.array_sort(F.collect_list(F.struct(form.alias("form"), day.cast("string").alias("filed"), F.date_sub(day, 30).cast("string").alias("report")))).alias("x"))
    recent = F.struct(F.col("x.filed").alias("accessionNumber"), F.col("x.form").alias("form"), F.col("x.filed").alias("filingDate"), F.col("x.report").alias("reportDate"))
    path = _documents(rows.select(F.to_json(F.struct("cik", F.struct(recent.alias("recent")).alias("filings"))).alias("value")), "filings")
    docs = spark.read.schema(readers.FILING_SCHEMA).json(path)
    both = readers.has_successor_notice(docs).join(readers.newest_filing(docs, "2000-06-30"), "entity", "left")
    return both.select("entity", "newer.form", "newer.filed", F.col("newer.report_date").alias("report"), F.col("successor_notice").alias("notice"))


_PRICES = """x AS (SELECT o_custkey AS k, o_orderdate::DATE AS d, max(o_totalprice) AS p, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2)"""


@query(f"""WITH {_PRICES} SELECT 'C' || k AS entity, d, CASE WHEN k % 2 = 0 THEN p / 2 ELSE p END AS close, v AS volume FROM x WHERE k % 2 = 0 OR day(d) <> 13""")
def price_scan(spark, d):
    x = s.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("p"), F.count("*").cast("double").alias("v"))
    close = F.when((F.col("k") % 2 != 0) & (F.dayofmonth("d") == 13), None).otherwise(F.col("p"))
    rows = x.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(F.unix_timestamp(F.col("d").cast("timestamp")).alias("t"), close.alias("c"), (F.col("p") / 2).alias("a"), "v"))).alias("x"))
    quote = F.struct(F.array(F.struct(F.col("x.c").alias("close"), F.col("x.v").alias("volume"))).alias("quote"), F.when(F.col("k") % 2 == 0, F.array(F.struct(F.col("x.a").alias("adjclose")))).alias("adjclose"))
    result = F.array(F.struct(F.struct(F.concat(F.lit("c"), F.col("k").cast("string")).alias("symbol")).alias("meta"), F.col("x.t").alias("timestamp"), quote.alias("indicators")))
    path = _documents(rows.select(F.to_json(F.struct(F.struct(result.alias("result")).alias("chart"))).alias("value")), "prices")
    return readers.explode_chart(spark.read.schema(readers.CHART_SCHEMA).json(path))


@query("""SELECT o_orderdate::DATE AS d, max(o_totalprice) AS close, count(*)::DOUBLE AS volume, 'ALL' AS entity FROM orders GROUP BY 1 HAVING count(*) % 5 <> 0""")
def csv_price_scan(spark, d):
    x = s.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("Date")).agg(F.max("o_totalprice").alias("c"), F.count("*").alias("Volume"))
    path = _path(spark, "csv-prices")
    x.select("Date", F.when(F.col("Volume") % 5 != 0, F.col("c").cast("string")).otherwise("null").alias("Close"), "Volume").write.option("header", True).csv(path)
    return readers.read_csv_prices(spark, path, "ALL")


@query("""SELECT c_custkey::VARCHAR AS entity, 'a "quoted", name' || chr(10) || c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS note FROM customer""")
def quoted_csv(spark, d):
    c = s.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.concat(F.lit('a "quoted", name\n'), "c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("note"))
    path = _path(spark, "quoted")
    c.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return readers.read_quoted_csv(spark, path)


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey AS entity, sum(round(o_totalprice * 100)::BIGINT) / 100.0::DOUBLE AS composite FROM orders GROUP BY 1, 2)
SELECT month, entity, composite FROM m WHERE month >= '2000-01'""")
def month_record(spark, d):
    """Months are written once; a second run with other figures leaves those on record, and the scan reads no older month."""
    m = s.table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_custkey").alias("entity")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("composite"))
    path = _path(spark, "months")
    sinks.append_months(m, path)
    sinks.append_months(m.where("month >= '2001-01'").withColumn("composite", F.lit(-1.0)), path)
    return readers.read_months(spark, path, "2000-01").select("month", "entity", "composite")


@query("""SELECT s_suppkey AS entity, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS value FROM supplier""")
def json_sink(spark, d):
    path = _path(spark, "json")
    sinks.write_json(s.table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("value")), path)
    return spark.read.schema("entity long, name string, value double").json(path)


@query("""SELECT c_custkey AS entity, c_name AS name, c_nationkey::VARCHAR AS sector, c_acctbal AS market_cap FROM customer""")
def published_columns(spark, d):
    """The slim universe, of which a visitor without an account sees all but what is hidden or reserved."""
    c = s.customers(spark, d).withColumns({"industry": F.lit("x"), "secret": F.lit(1)})
    slim = sinks.slim_universe(c)
    return sinks.visible_columns(slim, slim.columns, pro=False, hidden={"entity", "industry"}, pro_only={"market_value"})


@query("""SELECT c_custkey AS entity, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS note, CASE WHEN c_custkey % 5 = 0 THEN 7.0::DOUBLE WHEN c_custkey % 4 = 0 THEN NULL ELSE 1.0 END AS filled FROM customer""")
def guarded_updates(spark, d):
    """Rows that are stale and were looked up get a new note; a back-fill sets its own column where it is missing."""
    c = s.customers(spark, d).select("entity", F.lit("old").alias("note"), F.when(F.col("entity") % 20 == 0, None).when(F.col("entity") % 5 == 0, F.lit(7.0)).when(F.col("entity") % 4 == 0, None).otherwise(1.0).alias("filled"))
    marked = sinks.annotate(c, c.where("entity % 3 = 0"), c.where("entity % 2 = 0").select("entity", F.lit("new").alias("note")), "entity", "note")
    extra = c.where("entity % 5 = 0").select("entity", F.lit(7.0).alias("filled"))
    return sinks.back_fill(marked, extra, ["entity"], "filled")


# -- rules without a query so far


@query(f"""WITH {f.SQL.format(lineitem="lineitem", orders="orders")}, last AS (SELECT entity, concept, max(en) AS last_reported FROM filed_facts WHERE st IS NULL GROUP BY 1, 2)
SELECT entity, concept, last_reported FROM last WHERE last_reported < DATE '2000-09-30' - 300 AND last_reported >= DATE '2000-11-30' - 1200""")
def recently_abandoned(spark, d):
    facts = f.filings(spark, d).where("start is null")
    anchor = facts.select("entity").distinct().withColumn("anchor", F.lit("2000-09-30").cast("date"))
    return eligibility.recently_abandoned(temporal.stale_inputs(facts, anchor, ["entity", "concept"]), f.AS_OF, horizon=1200).select("entity", "concept", "last_reported")


@query("""SELECT o_orderkey AS entity, CASE WHEN o_orderkey % 10 = 0 THEN 'backtested' WHEN strftime(day, '%Y-%m') = '1999-03' OR (day + 40)::DATE - last_day(day) > 7 THEN 'rebuilt' ELSE 'live' END AS label
FROM (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders)""")
def build_labels(spark, d):
    o = s.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    label = classify.build_label(F.date_format("day", "yyyy-MM"), F.date_add("day", 40), F.col("o_orderkey") % 10 == 0, ["1999-03"])
    return o.select(F.col("o_orderkey").alias("entity"), label.alias("label"))


@query("""WITH x AS (SELECT c_custkey AS entity, CASE WHEN c_custkey % 9 <> 0 THEN round(abs(c_acctbal) / 10000, 3) END AS stability FROM customer)
SELECT * FROM (SELECT 'stable' AS list, entity, stability FROM x ORDER BY stability DESC NULLS LAST, entity LIMIT 60)
UNION ALL SELECT * FROM (SELECT 'volatile', entity, stability FROM x ORDER BY stability NULLS LAST, entity LIMIT 60)""")
def stable_and_volatile(spark, d):
    x = s.customers(spark, d).select("entity", F.when(F.col("entity") % 9 != 0, F.round(F.abs("market_cap") / 10000, 3)).alias("stability"))
    name = lambda label, rows: rows.select(F.lit(label).alias("list"), "entity", "stability")
    return name("stable", panel.most_stable(x)).unionByName(name("volatile", panel.most_stable(x, volatile=True)))


@query("""WITH now AS (SELECT DISTINCT o_custkey AS entity FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '2001-06'),
prev AS (SELECT DISTINCT o_custkey AS entity FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '2001-05')
SELECT entity, CASE WHEN entity % 5 = 0 THEN 'excluded' WHEN entity % 7 = 0 THEN 'insufficient_data' WHEN entity % 3 = 0 THEN 'share_class' WHEN entity % 2 = 0 THEN 'market_cap_floor'
  WHEN entity % 11 < 5 THEN 'no_sec_match' ELSE 'unlisted' END AS kind FROM prev WHERE entity NOT IN (SELECT entity FROM now)""")
def six_kinds_of_exits(spark, d):
    now, prior, c = s.customer_month(spark, d, "2001-06"), s.customer_month(spark, d, "2001-05"), s.customers(spark, d)
    rules = ["entity % 5 = 0", "entity % 7 = 0", "entity % 3 = 0", "entity % 2 = 0", "entity % 11 < 5"]
    sources = [(kind, c.where(rule).select("entity", F.lit(kind).alias("reason"))) for kind, rule in zip(panel.EXIT_KINDS, rules, strict=False)]
    return panel.exits(prior, now, sources).select("entity", "kind")


_SIX = "d <= DATE '2000-12-31'"


@query(f"""WITH {_PRICES}, p AS (SELECT k AS entity, d, p AS close FROM x),
e AS (SELECT entity, max_by(close, d) FILTER (d <= DATE '2001-05-31') AS late, max_by(close, d) FILTER ({_SIX}) AS early, max(d) FILTER ({_SIX}) AS early_d FROM p GROUP BY 1)
SELECT entity, CASE WHEN late IS NOT NULL AND DATE '2000-12-31' - early_d <= 7 THEN {_hu("late / early - 1", 4)} END AS momentum FROM e""")
def momentum_6_1(spark, d):
    p = s.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("close"))
    return temporal.momentum(p, "2001-06-30", 6)


_PANEL = """panel AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey AS entity, sum(round(o_totalprice * 100)::BIGINT) / 100.0::DOUBLE AS composite, avg(round(o_totalprice)) AS price_adj,
  count(*)::DOUBLE AS growth FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01' GROUP BY 1, 2),
idx AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS idx FROM (SELECT DISTINCT month FROM panel)), p AS (SELECT * FROM panel JOIN idx USING (month))"""


def _fwd(key: str, h: int) -> str:
    return f"""SELECT '{key}' AS key, {h} AS horizon, bucket, avg(fwd) AS mean_fwd, count(*) AS n FROM (
  SELECT *, least(9, floor((row_number() OVER (PARTITION BY month ORDER BY {key} DESC, entity) - 1) / (count(*) OVER (PARTITION BY month) / 10.0::DOUBLE)))::BIGINT + 1 AS bucket,
    count(*) OVER (PARTITION BY month) AS size FROM (SELECT a.month, a.entity, a.{key}, b.price_adj / a.price_adj - 1 AS fwd FROM p a JOIN p b ON a.entity = b.entity AND b.idx = a.idx + {h} WHERE a.price_adj > 0))
  WHERE size >= 30 GROUP BY bucket"""


@query(f"WITH {_PANEL} SELECT key, horizon, bucket, {_hu('mean_fwd', 6)} AS mean_fwd, n FROM (" + " UNION ALL ".join(_fwd(key, h) for key in ("composite", "growth") for h in (1, 3, 6, 12)) + ")")
def decile_analysis(spark, d):
    """Forward returns by decile of the composite and of a factor, one, three, six and twelve months on, from one reading of the orders."""
    o = s.table(spark, d, "orders").where(F.col("o_orderdate") < "2001-08-01")
    rows = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_custkey").alias("entity")).agg(
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("composite"), F.avg(F.round("o_totalprice")).alias("price_adj"), F.count("*").cast("double").alias("growth")
    )
    means = panel.decile_means(panel.decile_grid(rows, ["composite", "growth"], [1, 3, 6, 12]), ["key", "horizon"])
    return means.select("key", "horizon", "bucket", stats.half_up("mean_fwd", 6).alias("mean_fwd"), "n")


_FAMILY = f.CANDIDATES


@query(f"""WITH {f.SQL.format(lineitem="lineitem", orders="orders")},
known(concept) AS (VALUES {", ".join(f"('{x}')" for x in f.KNOWN)}),
near AS (SELECT entity, concept, max(abs(val)) AS val FROM filed_facts WHERE taxonomy = 'us-gaap' AND regexp_matches(concept, '{_FAMILY[0]}') AND NOT regexp_matches(concept, '{_FAMILY[1]}')
  AND concept NOT IN (SELECT concept FROM known) AND val <> 0 AND abs(en - DATE '2000-09-30') <= 10 AND filed <= DATE '{f.AS_OF}' AND form IN ('10-K', '10-Q') GROUP BY 1, 2)
SELECT entity, concept, val FROM near QUALIFY row_number() OVER (PARTITION BY entity ORDER BY val DESC, concept) <= 5""")
def unmapped_candidates(spark, d):
    facts = temporal.visible(f.filings(spark, d).where("taxonomy = 'us-gaap'"), f.AS_OF, ["10-K", "10-Q"])
    anchor = facts.select("entity").distinct().withColumn("anchor", F.lit("2000-09-30").cast("date"))
    known = spark.createDataFrame([(x,) for x in f.KNOWN], "concept string")
    return eligibility.unmapped_candidates(facts, *_FAMILY, known, anchor).select("entity", "concept", F.abs("val").alias("val"))


@query(f"""WITH {f.SQL.format(lineitem="lineitem", orders="orders")} SELECT DISTINCT entity FROM filed_facts WHERE regexp_matches(concept, 'Debt|LineOfCredit') AND NOT regexp_matches(concept, 'Noncurrent')""")
def ever_reported(spark, d):
    return eligibility.ever_reported(f.filings(spark, d), "Debt|LineOfCredit", "Noncurrent")


@query("""SELECT month, entity, growth, row_number() OVER (PARTITION BY entity ORDER BY month DESC) AS back FROM (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey AS entity, count(*) AS growth FROM orders GROUP BY 1, 2) QUALIFY back <= 3""")
def last_months_of_each(spark, d):
    rows = s.table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_custkey").alias("entity")).agg(F.count("*").alias("growth"))
    points = panel.history_index(rows).select("entity", F.posexplode(F.reverse(F.slice("points", F.greatest(F.lit(1), F.size("points") - 2), F.lit(3)))).alias("k", "x"))
    return points.select("x.month", "entity", "x.growth", (F.col("k") + 1).cast("long").alias("back"))
