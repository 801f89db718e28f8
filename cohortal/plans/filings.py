"""Stand-in filings from the driver's tables: suppliers as filers, their quarters' sales as what they report.

The text is SQL that Spark and DuckDB both read, so that the oracle starts from the same facts. It holds what real
filings do: year-to-date and annual figures, filers without single quarters, nested and abandoned concepts, restated
years, annual values tagged as a quarter, other forms, units and taxonomies, balance sheets dated ahead, one-offs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.functions.spec import CANDIDATE_FAMILIES, CANDIDATE_NOISE
from cohortal.plans.stage import dealt
from cohortal.plans.standin import table

AS_OF, PRIOR_AS_OF = "2000-11-30", "2000-08-31"
#: A family of concepts, its noise, and the one concept of it that counts as known when replacements are looked for.
CANDIDATES, KNOWN = (CANDIDATE_FAMILIES["debt"], CANDIDATE_NOISE), ["LongTermDebtNoncurrent"]
#: (concept, thousandths of r, d and h, modulus, least and greatest remainder of the filers that report it, only if positive)
FLOWS = [
    ("Revenues", 1000, 0, 0, 4, 0, 2, 0),
    ("RevenueFromContractWithCustomerExcludingAssessedTax", 900, 0, 0, 4, 1, 1, 0),
    ("SalesRevenueNet", 1000, 0, 0, 4, 2, 3, 0),
    ("CostOfRevenue", 600, 300, 0, 5, 0, 3, 0),
    ("GrossProfit", 400, -300, 0, 5, 3, 4, 0),
    ("OperatingIncomeLoss", 150, -500, -1000, 3, 0, 1, 0),
    ("OperatingExpenses", 200, 100, 0, 6, 2, 2, 0),
    ("CostsAndExpenses", 850, 500, 0, 6, 5, 5, 0),
    ("IncomeLossFromContinuingOperationsBeforeIncomeTaxesDomestic", 130, -400, -1000, 1, 0, 0, 0),
    ("InterestExpense", 20, 0, 0, 1, 0, 0, 0),
    ("IncomeTaxExpenseBenefit", 30, -90, 0, 1, 0, 0, 0),
    ("NetIncomeLoss", 100, -310, -790, 13, 0, 11, 0),
    ("ProfitLoss", 110, -310, -790, 13, 11, 12, 0),
    ("DepreciationDepletionAndAmortization", 40, 10, 0, 1, 0, 0, 0),
    ("NetCashProvidedByUsedInOperatingActivities", 160, -300, 0, 1, 0, 0, 0),
    ("PaymentsToAcquirePropertyPlantAndEquipment", 50, 0, 0, 7, 0, 5, 0),
    ("InterestIncomeExpenseNet", 300, -100, 0, 1, 0, 0, 0),
    ("NoninterestIncome", 100, 0, 0, 1, 0, 0, 0),
    ("NoninterestExpense", 200, 50, 0, 1, 0, 0, 0),
    ("ProvisionForCreditLosses", 20, 40, 0, 1, 0, 0, 0),
    ("PremiumsEarnedNet", 700, 10, 0, 1, 0, 0, 0),
    ("PolicyholderBenefitsAndClaimsIncurredNet", 400, 90, 0, 1, 0, 0, 0),
    ("BenefitsLossesAndExpenses", 800, 70, 0, 1, 0, 0, 0),
    ("NetInvestmentIncome", 60, 30, 0, 1, 0, 0, 0),
    ("LaborAndRelatedExpense", 250, 20, 0, 1, 0, 0, 0),
    ("PaymentsForRepurchaseOfCommonStock", 30, 0, 0, 3, 0, 1, 0),
    ("ProceedsFromIssuanceOfCommonStock", 10, 0, 0, 3, 1, 2, 0),
    ("EarningsPerShareDiluted", 1, -3, 0, 1, 0, 0, 0),
    ("GoodwillImpairmentLoss", 0, 0, 1000, 1, 0, 0, 1),
    ("RestructuringCharges", 0, 0, 400, 1, 0, 0, 1),
    ("GainLossOnSaleOfBusiness", 0, 0, -1000, 1, 0, 0, 1),
]
#: (concept, thousandths of s and r, modulus, least and greatest remainder, first and last day)
STOCKS = [
    ("Assets", 400, 900, 1, 0, 0, "1990-01-01", "2030-01-01"),
    ("AssetsCurrent", 150, 300, 1, 0, 0, "1990-01-01", "2030-01-01"),
    ("Liabilities", 220, 0, 3, 0, 1, "1990-01-01", "2030-01-01"),
    ("LiabilitiesAndStockholdersEquity", 400, 900, 1, 0, 0, "1990-01-01", "2030-01-01"),
    ("LiabilitiesCurrent", 90, 100, 1, 0, 0, "1990-01-01", "2030-01-01"),
    ("StockholdersEquity", 180, 200, 10, 0, 8, "1990-01-01", "2030-01-01"),
    ("StockholdersEquity", -20, 0, 10, 9, 9, "1990-01-01", "2030-01-01"),
    ("RetainedEarningsAccumulatedDeficit", 70, 0, 1, 0, 0, "1990-01-01", "2030-01-01"),
    ("CashAndCashEquivalentsAtCarryingValue", 30, 100, 1, 0, 0, "1990-01-01", "2030-01-01"),
    ("Goodwill", 20, 0, 4, 0, 2, "1990-01-01", "2030-01-01"),
    ("IntangibleAssetsNetExcludingGoodwill", 5, 0, 2, 0, 0, "1990-01-01", "2030-01-01"),
    ("PreferredStockValue", 2, 0, 5, 0, 0, "1990-01-01", "2030-01-01"),
    ("LiabilityForClaimsAndClaimsAdjustmentExpense", 60, 0, 1, 0, 0, "1990-01-01", "2030-01-01"),
    ("InvestmentOwnedAtFairValue", 90, 0, 9, 0, 0, "1990-01-01", "2030-01-01"),
    ("LongTermDebtNoncurrent", 90, 0, 6, 0, 1, "1990-01-01", "2030-01-01"),
    ("LongTermDebtCurrent", 10, 0, 6, 0, 0, "1990-01-01", "2030-01-01"),
    ("DebtLongtermAndShorttermCombinedAmount", 95, 0, 6, 1, 1, "1990-01-01", "2000-03-31"),
    ("LongTermDebt", 80, 0, 6, 2, 2, "1990-01-01", "2030-01-01"),
    ("CommercialPaper", 6, 0, 6, 2, 2, "1990-01-01", "2030-01-01"),
    ("NotesPayable", 0, 0, 6, 3, 3, "1990-01-01", "1998-12-31"),
    ("LongTermDebt", 120, 0, 6, 5, 5, "1990-01-01", "2000-06-30"),
    ("ConvertibleDebtNoncurrent", 40, 0, 12, 5, 5, "2000-04-01", "2030-01-01"),
    ("LongTermDebtNoncurrent", 60, 0, 12, 11, 11, "2000-04-01", "2030-01-01"),
    ("LineOfCredit", 10, 0, 12, 10, 10, "1997-01-01", "1997-12-31"),
]


def _values(rows: list[tuple]) -> str:
    cell = lambda x: (f"DATE '{x}'" if x[:2].isdigit() else f"'{x}'") if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


#: The sales of each supplier and quarter: the one step over the large tables. Spark writes it once, as the text behind it reads it eight times.
BASE = """base AS (
  SELECT l_suppkey AS entity, CAST(date_trunc('quarter', CAST(o_orderdate AS DATE)) AS DATE) AS qs,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS r,
    CAST(sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS BIGINT) AS d
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) < DATE '2000-10-01' GROUP BY 1, 2)"""
REST = f"""hit AS (
  SELECT *, CAST(CASE WHEN entity % 8 = 1 AND year(qs) = 2000 AND month(qs) = 4 THEN floor(r * 3e-1)
    WHEN entity % 8 = 3 AND year(qs) = 1998 AND month(qs) = 4 THEN floor(r * 4e-1)
    WHEN entity % 8 = 5 AND year(qs) = 2000 AND month(qs) = 1 THEN -floor(r * 5e-1) ELSE 0 END AS BIGINT) AS h FROM base),
quarters AS (
  SELECT entity, qs, CAST(last_day(qs + INTERVAL 2 MONTHS) AS DATE) AS qe, CAST(date_trunc('year', qs) AS DATE) AS ys, r, d, h,
    CAST(sum(r) OVER (PARTITION BY entity ORDER BY qs ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s,
    CAST(sum(r) OVER (PARTITION BY entity, date_trunc('year', qs) ORDER BY qs ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS yr,
    CAST(sum(d) OVER (PARTITION BY entity, date_trunc('year', qs) ORDER BY qs ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS yd,
    CAST(sum(h) OVER (PARTITION BY entity, date_trunc('year', qs) ORDER BY qs ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS yh
  FROM hit),
periods AS (
  SELECT entity, qs AS st, qe AS en, r, d, h, CAST(qe + INTERVAL 40 DAYS AS DATE) AS filed, '10-Q' AS form FROM quarters WHERE month(qs) < 10 AND entity % 7 <> 6
  UNION ALL SELECT entity, ys, qe, yr, yd, yh, CAST(qe + INTERVAL 40 DAYS AS DATE), '10-Q' FROM quarters WHERE month(qs) IN (4, 7)
  UNION ALL SELECT entity, qs, qe, r, d, h, CAST(qe + INTERVAL 40 DAYS AS DATE), '10-Q' FROM quarters WHERE month(qs) = 1 AND entity % 7 = 6
  UNION ALL SELECT entity, ys, qe, yr, yd, yh, CAST(qe + INTERVAL 60 DAYS AS DATE), '10-K' FROM quarters WHERE month(qs) = 10
  UNION ALL SELECT entity, ys, qe, CAST(floor(yr * 104e-2) AS BIGINT), yd, yh, CAST(qe + INTERVAL 425 DAYS AS DATE), '10-K/A' FROM quarters WHERE month(qs) = 10 AND entity % 6 = 5
  UNION ALL SELECT entity, qs, qe, yr, yd, yh, CAST(qe + INTERVAL 60 DAYS AS DATE), '10-K' FROM quarters WHERE month(qs) = 10 AND entity % 10 = 3
  UNION ALL SELECT entity, qs, qe, r * 10, d, h, CAST(qe + INTERVAL 90 DAYS AS DATE), '8-K' FROM quarters WHERE month(qs) = 7),
kinds(concept, a, b, c, m, lo, hi, pos) AS (VALUES {_values(FLOWS)}),
held(concept, a, b, m, lo, hi, since, until) AS (VALUES {_values(STOCKS)}),
flows AS (
  SELECT entity, 'us-gaap' AS taxonomy, concept, 'USD' AS unit, st, en, floor((a * r + b * d + c * h) / 1000e0) * 1e0 AS val, filed, form, pos
  FROM periods CROSS JOIN kinds WHERE entity % m BETWEEN lo AND hi),
stocks AS (
  SELECT entity, concept, qe AS en, floor((a * s + b * r) / 1000e0) * 1e0 AS val, CAST(qe + INTERVAL 40 DAYS AS DATE) AS filed
  FROM quarters CROSS JOIN held WHERE entity % m BETWEEN lo AND hi AND qe BETWEEN since AND until),
filed_facts AS (
  SELECT entity, taxonomy, concept, unit, st, en, val, filed, form FROM flows WHERE pos = 0 OR val > 0
  UNION ALL SELECT entity, 'us-gaap', concept, 'USD', CAST(NULL AS DATE), en, val, filed, '10-Q' FROM stocks
  UNION ALL SELECT entity, 'ifrs-full', concept, 'USD', CAST(NULL AS DATE), en, val * 2, filed, '20-F' FROM stocks WHERE concept = 'Assets' AND entity % 4 = 1
  UNION ALL SELECT entity, 'us-gaap', concept, 'EUR', st, en, val * 3, CAST(filed + INTERVAL 9 DAYS AS DATE), form FROM flows WHERE concept = 'Revenues'
  UNION ALL SELECT entity, 'us-gaap', concept, 'USD', CAST(NULL AS DATE), DATE '2000-12-31', val * 9, DATE '2000-11-01', '10-Q' FROM stocks WHERE en = DATE '2000-06-30')"""
#: CTEs that end in ``filed_facts`` (entity, taxonomy, concept, unit, st, en, val, filed, form).
SQL = f"""{BASE},
{REST}"""


def _base(spark: SparkSession, d: str) -> DataFrame:
    """(entity, qs, r, d), dealt by entity: some thirty rows a supplier."""
    sums = spark.sql(f"WITH {BASE} SELECT * FROM base", lineitem=table(spark, d, "lineitem"), orders=table(spark, d, "orders"))
    return dealt(sums)


def filings(spark: SparkSession, d: str) -> DataFrame:
    """entity, taxonomy, concept, unit, start, end, val, filed, accn, form, seq."""
    rows = spark.sql(f"WITH base AS (SELECT * FROM {{base}}), {REST} SELECT * FROM filed_facts", base=_base(spark, d))
    accn = F.concat_ws("-", F.col("entity").cast("string"), F.col("filed").cast("string"))
    return rows.select("entity", "taxonomy", "concept", "unit", F.col("st").alias("start"), F.col("en").alias("end"), "val", "filed", accn.alias("accn"), "form", F.lit(0).alias("seq"))


def listings(spark: SparkSession, d: str) -> DataFrame:
    """entity, market_cap, which some lack."""
    cap = F.when(F.col("s_suppkey") % 11 != 0, F.round(F.abs("s_acctbal") * 100) * 1000.0)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), cap.alias("market_cap"))


#: CTEs behind those of SQL: the facts of the monthly run (``month_facts``), of which some filers stop, start late, file abroad, drop a concept or turn
#: negative; the listings (``listed``), with second classes and warrants; ids of filers (``matched``); mean traded value over 63 sessions (``traded``),
#: and newer filings (``indexed``).
MONTH_SQL = """month_facts AS (
  SELECT entity, taxonomy, concept, unit, st, en, CASE WHEN concept = 'StockholdersEquity' AND entity % 31 = 4 AND en = DATE '2000-09-30' THEN -abs(val) ELSE val END AS val, filed,
    CASE WHEN entity % 23 = 7 AND form IN ('10-K', '10-Q') THEN '20-F' ELSE form END AS form
  FROM filed_facts WHERE NOT (entity % 37 = 6 AND concept IN ('CostOfRevenue', 'GrossProfit') AND en > DATE '2000-03-31')
    AND NOT (entity % 7 = 3 AND filed > DATE '2000-06-30') AND NOT (entity % 29 = 5 AND filed < DATE '2000-07-01') AND entity % 43 <> 11),
listed AS (
  SELECT concat('F', s_suppkey) AS listing, s_suppkey AS owner, concat('Filer ', s_suppkey, CASE WHEN s_suppkey % 13 = 1 THEN ' Warrants' ELSE ' Common Stock' END) AS name,
    CASE WHEN s_suppkey % 11 <> 0 THEN round(abs(s_acctbal) * 100) * 1000e0 END AS market_cap, (s_suppkey * 7919) % 1000 * 1e2 AS volume, 10e0 AS last_sale, s_suppkey % 5 AS k FROM {supplier}
  UNION ALL
  SELECT concat('F', s_suppkey, '.B'), s_suppkey, concat('Filer ', s_suppkey, ' Class B Common Stock'),
    CASE WHEN s_suppkey % 11 <> 0 THEN round(abs(s_acctbal) * 100) * 1000e0 END, (s_suppkey * 104729) % 1000 * 1e2, 10e0, s_suppkey % 5 FROM {supplier} WHERE s_suppkey % 9 = 0),
matched AS (SELECT listing, owner AS entity FROM listed WHERE owner % 19 <> 5),
sessions AS (
  SELECT l_suppkey AS owner, CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS traded FROM {lineitem}
  WHERE CAST(l_shipdate AS DATE) <= DATE '2000-11-30' AND l_suppkey % 41 <> 9 GROUP BY 1, 2),
traded AS (
  SELECT owner, avg(traded) / 1e2 AS adv FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY d DESC) AS n FROM sessions) x WHERE n <= 63 GROUP BY 1),
indexed AS (
  SELECT s_suppkey AS entity, '10-Q' AS form, DATE '2000-11-20' AS filed, DATE '2000-09-30' AS report_date FROM {supplier} WHERE s_suppkey % 7 = 3 AND s_suppkey % 2 = 1)"""


def month_inputs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The stand-in inputs of a monthly run: facts, listings (with k, by which they get a sector), ids, prices and newer filings."""
    args = {n: table(spark, d, n) for n in ("lineitem", "supplier")} | {"base": _base(spark, d)}
    ask = lambda sql: spark.sql(f"WITH base AS (SELECT * FROM {{base}}), {REST}, {MONTH_SQL} {sql}", **args)
    accn = F.concat_ws("-", F.col("entity").cast("string"), F.col("filed").cast("string"))
    rows = ask("SELECT * FROM month_facts")
    facts = rows.select("entity", "taxonomy", "concept", "unit", F.col("st").alias("start"), F.col("en").alias("end"), "val", "filed", accn.alias("accn"), "form", F.lit(0).alias("seq"))
    return {
        "facts": facts,
        "listings": ask("SELECT * FROM listed"),
        "ids": ask("SELECT * FROM matched"),
        "prices": ask("SELECT listing, adv FROM listed JOIN traded USING (owner)"),
        "newer": ask("SELECT * FROM indexed"),
    }
