import datetime as dt
import os

import pytest

from cohortal.plans import measures as m

D = dt.date
FLOWS = dict(
    Revenues=1000, CostOfRevenue=600, OperatingIncomeLoss=200, DepreciationDepletionAndAmortization=50, NetCashProvidedByUsedInOperatingActivities=180,
    PaymentsToAcquirePropertyPlantAndEquipment=60, IncomeTaxExpenseBenefit=40, IncomeLossFromContinuingOperationsBeforeIncomeTaxesDomestic=180, NetIncomeLoss=140,
)
STOCKS = dict(
    Assets=2000, AssetsCurrent=800, Liabilities=1200, LiabilitiesCurrent=400, StockholdersEquity=800, RetainedEarningsAccumulatedDeficit=300,
    CashAndCashEquivalentsAtCarryingValue=150, LongTermDebt=400,
)
SCHEMA = "entity string, taxonomy string, concept string, unit string, start date, end date, val double, filed date, accn string, form string, seq int"


def company(entity, drop=(), **change):
    rows = []
    for y in range(2020, 2026):
        k, filed = 1 + 0.05 * (y - 2025), D(y + 1, 2, 15)
        for c, v in (FLOWS | STOCKS | change).items():
            if c not in drop:
                start = None if c in STOCKS else D(y, 1, 1)
                rows.append((entity, "us-gaap", c, "USD", start, D(y, 12, 31), float(v) * k, filed, f"a{y}", "10-K", 0))
    return rows


def quarters(entity, growth=0.10):
    rows, y, q = [], 2022, 3
    for k in range(14):
        start = D(y, 3 * q - 2, 1)
        end = D(y + (q == 4), 3 * q % 12 + 1, 1) - dt.timedelta(1)
        rows.append((entity, "us-gaap", "Revenues", "USD", start, end, 100e6 * (1 + growth) ** (k / 4), end + dt.timedelta(40), f"q{k}", "10-Q", 0))
        y, q = (y + 1, 1) if q == 4 else (y, q + 1)
    return rows


def fact(entity, concept, start, end, val, filed, form="10-K", taxonomy="us-gaap", unit="USD"):
    return (entity, taxonomy, concept, unit, start, end, float(val), filed, f"{concept}{filed}", form, 0)


def ruled():
    """Companies that each test one rule."""
    y = lambda e, c, k, v, filed, **kw: fact(e, c, D(k, 1, 1), D(k, 12, 31), v, filed, **kw)
    rows = []
    # Of nested revenue concepts the largest in the newest filing counts: a restated 1.3 against an older 3.4.
    rows += company("NEST", drop=("Revenues",)) + [y("NEST", "Revenues", 2025, 3400, D(2026, 2, 1)), y("NEST", "RevenueFromContractWithCustomerExcludingAssessedTax", 2025, 1300, D(2026, 5, 1))]
    rows += company("BIG", drop=("Revenues",)) + [y("BIG", "Revenues", 2025, 2090, D(2026, 2, 1)), y("BIG", "RevenueFromContractWithCustomerExcludingAssessedTax", 2025, 190, D(2026, 2, 1))]
    # Other reports do not supply a figure; transition reports do.
    rows += company("PROXY") + [y("PROXY", "NetIncomeLoss", 2025, 0.1, D(2026, 6, 1), form="8-K"), y("PROXY", "NetIncomeLoss", 2025, 0.2, D(2026, 6, 1), form="DEF 14A")]
    rows += company("TRANS") + [y("TRANS", "NetIncomeLoss", 2025, 77, D(2026, 6, 1), form="10-KT/A")]
    # A balance sheet dated after the scoring day is not seen.
    rows += company("AHEAD") + [fact("AHEAD", "Assets", None, D(2026, 12, 31), 9999, D(2026, 3, 1))]
    # The opening capital is that nearest to a year before, within 45 days.
    rows += company("OPEN", drop=("StockholdersEquity",)) + [fact("OPEN", "StockholdersEquity", None, D(2025, 12, 31), 800, D(2026, 2, 15)), fact("OPEN", "StockholdersEquity", None, D(2025, 1, 20), 600, D(2026, 2, 15))]
    # A slice of debt, or a concept that speaks of borrowing, keeps the never-borrowed rule away.
    rows += company("SLICE", drop=("LongTermDebt",)) + [fact("SLICE", "LineOfCredit", None, D(2025, 12, 31), 5, D(2026, 2, 15))]
    rows += company("WORD", drop=("LongTermDebt",)) + [fact("WORD", "SubordinatedLongTermDebt", None, D(2019, 12, 31), 5, D(2020, 2, 15))]
    rows += company("ZERO", drop=("LongTermDebt",)) + [fact("ZERO", "LongTermDebt", None, D(2022, 12, 31), 0, D(2023, 2, 15))]
    # A part of debt far below an older total is passed over.
    rows += company("PART", drop=("LongTermDebt",)) + [fact("PART", "LongTermDebt", None, D(2025, 9, 30), 3100, D(2025, 11, 1)), fact("PART", "ConvertibleDebtNoncurrent", None, D(2025, 12, 31), 1100, D(2026, 2, 15))]
    # Debt that is filed later.
    rows += company("LATER", drop=("LongTermDebt",)) + [fact("LATER", "LongTermDebt", None, D(2026, 9, 30), 5, D(2026, 11, 15))]
    rows += company("R") + [y("R", "PaymentsForRepurchaseOfCommonStock", 2025, 90, D(2026, 2, 15)), y("R", "ProceedsFromIssuanceOfCommonStock", 2025, 40, D(2026, 2, 15))]
    # Quarters of a hundred days.
    end = D(2022, 12, 31)
    for k in range(12):
        start = end + dt.timedelta(1)
        end = start + dt.timedelta(100 if k % 4 == 0 else 88)
        rows.append(fact("H", "Revenues", start, end, 25e6 * (k + 1), end + dt.timedelta(40), form="10-Q"))
    return rows + [fact("H", c, None, end, 1e9, end + dt.timedelta(40), form="10-Q") for c in ("Assets", "Liabilities", "StockholdersEquity", "Goodwill", "AssetsCurrent")]


@pytest.fixture(scope="module")
def facts(spark):
    later = [("A", "us-gaap", "Assets", "USD", None, D(2025, 12, 31), 9999.0, D(2026, 10, 1), "late", "10-K", 0)]
    every = [*company("A"), *later, *company("NODEBT", drop=("LongTermDebt",)), *company("NEG", StockholdersEquity=-5), *company("Q", drop=("Revenues",)), *quarters("Q"), *ruled()]
    names = sorted({f[0] for f in every} | {"NOTHING"})
    return spark.createDataFrame(every, SCHEMA), spark.createDataFrame([(e, 5000.0) for e in names], "entity string, market_cap double")


@pytest.fixture(scope="module")
def wide(facts):
    return m.materialised(m.measures(*facts, "2026-08-31"))


@pytest.fixture(scope="module")
def rows(wide):
    return {r.entity: r for r in wide.collect()}


@pytest.fixture(scope="module")
def long(wide):
    return {(r.entity, r.metric): r.reason for r in m.long_measures(wide).collect()}


def test_complete_company(rows):
    r = rows["A"]
    assert r.gpoa == pytest.approx(0.2) and r.debt_equity == pytest.approx(0.5)  # the later filing is not seen
    assert r.rev_growth == pytest.approx((1000 / 850) ** (1 / 3) - 1)
    assert r.ebit_ev == pytest.approx(200 / 5250) and r.altman_z == pytest.approx(6.56 * 0.2 + 3.26 * 0.15 + 0.672 + 1.05 * 800 / 1200)
    assert r.debt_path == "longtermdebt+short" and r.profit_growth == pytest.approx(21 / 2000 / 3)
    assert r.earn_var == pytest.approx(0, abs=1e-9)


def test_never_borrowed_is_zero_debt(rows):
    assert rows["NODEBT"].debt == 0 and rows["NODEBT"].debt_path == "no debt tag ever filed"


def test_negative_equity(rows):
    assert rows["NEG"].debt_equity is None and rows["NEG"].roe is None and rows["NEG"].book_yield is None


def test_quarterly_trend(rows):
    assert rows["Q"].rev_growth == pytest.approx(0.10, abs=0.005)


def test_company_without_facts(rows):
    assert rows["NOTHING"].roic is None and rows["NOTHING"].debt is None


def test_long_form_has_reasons(rows, long):
    assert long["NEG", "debt_equity"] == "equity is negative or zero" and long["NEG", "gpoa"] is None and long["NOTHING", "roic"] == "needs EBIT, debt and equity"


def test_provenance(rows):
    r = rows["A"]
    assert (r.asof, r.filed, r.accn, r.form, r.basis, r.ebit_path, r.gross_profit_path) == (D(2025, 12, 31), D(2026, 2, 15), "a2025", "10-K", "fy", "OperatingIncomeLoss", "Rev - CostOfRevenue")


def test_one_offs_are_taken_out(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(100.0, 0.0, 60.0, [(-50.0, 10.0)]), (100.0, 0.0, 60.0, [(-20.0, 10.0)]), (100.0, 0.0, 10.0, [(-50.0, 10.0)])], "v double, gain double, charge double, moves array<struct<move: double, val: double>>")
    out = m.normalised(F.col("v"), F.col("gain"), F.col("charge"), F.col("moves"), F.abs("v"), F.lit(0.0), True)
    assert [r[0] for r in rows.select(out).collect()] == [160.0, 100.0, 100.0]  # shown; not shown; not material


def test_rules_of_the_fact_path(rows):
    got = rows
    assert (got["NEST"].revenue_ttm, got["BIG"].revenue_ttm) == (1300.0, 2090.0)
    assert (got["PROXY"].ni, got["TRANS"].ni, got["AHEAD"].assets) == (140.0, 77.0, 2000.0)
    assert got["OPEN"].roic == pytest.approx(200 * (1 - 40 / 180) / ((400 + 800 - 150 + 400 * 0.95 + 600 - 150 * 0.95) / 2))
    assert [(got[e].debt, got[e].debt_path) for e in ("SLICE", "WORD", "ZERO", "PART")] == [(None, "unresolved"), (None, "unresolved"), (0.0, "last-reported-zero"), (3100.0, "longtermdebt+short")]


def test_later_filings_and_the_never_borrowed_rule(spark, facts, rows):
    every, listings = facts
    only = lambda df: df.where("entity = 'LATER'")
    assert rows["LATER"].debt is None and m.measures(only(every), only(listings), "2026-08-31", strict_pit=True).first().debt == 0.0


def test_a_quarter_of_a_hundred_days_counts(rows):
    assert rows["H"].revenue_ttm == 25e6 * (9 + 10 + 11 + 12) and rows["H"].rev_growth is not None


def test_research_measures(rows):
    r = rows["R"]
    assert r.net_payout_yield == pytest.approx(50 / 5000) and r.accruals == pytest.approx((140 - 180) / ((2000 + 1900) / 2)) and r.sue is None


def test_growth_is_averaged_in_both_directions_only_if_asked(spark):
    from pyspark.sql import functions as F

    cases = spark.createDataFrame([(0.10, -0.20), (0.10, 0.05), (0.10, 0.30), (0.10, None), (None, 0.2)], "_growth double, latest double")
    of = lambda symmetric: [r[0] for r in cases.select(F.round(dict(m.measure_columns(symmetric=symmetric))["rev_growth"], 6)).collect()]
    assert of(False) == [-0.05, 0.1, 0.1, 0.1, None] and of(True) == [-0.05, 0.075, 0.2, 0.1, None]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the generated tables")
def test_filings_read_the_large_tables_once(spark):
    from cohortal.plans import filings

    d = "/root/testdata/sf0.001"
    for rows in (filings.filings(spark, d), filings.month_inputs(spark, d)["facts"]):
        assert "parquet" not in rows._jdf.queryExecution().optimizedPlan().toString()  # the sales by quarter are written by then


def test_what_is_dealt_is_read_without_another_exchange(spark):
    from pyspark.sql import functions as F

    from cohortal.plans.stage import dealt

    was = spark.conf.get("spark.sql.adaptive.enabled")
    rows = dealt(spark.range(50).selectExpr("id % 5 AS entity", "id AS item", "id AS v"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == was
    counted = rows.groupBy("entity", "item").agg(F.max("v").alias("v"))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert counted.count() == 50


def test_items_gathered_and_spread_again_are_the_same(spark):
    schema = "entity int, item string, concept string, start date, end date, val double, filed date, accn string, form string, anchor date"
    day = D
    rows = [
        (1, "revenue", "Revenues", day(2000, 1, 1), day(2000, 3, 31), 1.0, day(2000, 5, 1), "a", "10-Q", None),
        (1, "revenue", "Revenues", day(2000, 1, 1), day(2000, 6, 30), 3.0, day(2000, 8, 1), "b", "10-Q", None),
        (1, "assets", "Assets", None, day(2000, 6, 30), 9.0, day(2000, 8, 1), "b", "10-Q", day(2000, 6, 30)),
        (1, "assets", "Assets", None, day(2000, 3, 31), None, day(2000, 8, 1), "b", "10-Q", day(2000, 6, 30)),
    ]
    items = spark.createDataFrame(rows, schema)
    groups = m.gathered_items(items)
    assert groups.count() == 2
    back = m.spread_items(groups).select(*items.columns).collect()
    assert {tuple(r) for r in back} == set(rows[:3])
    from cohortal.operators import temporal as t

    quarters = t.quarters_of(groups.where("item = 'revenue'"), m.BY_ITEM).selectExpr("inline(quarters)").collect()
    assert [tuple(r) for r in quarters] == [(day(2000, 3, 31), 1.0), (day(2000, 6, 30), 2.0)]


def test_years_are_not_looked_for_anew_at_each_quarter(spark):
    from cohortal.operators import temporal as t

    flows = spark.createDataFrame([(1, "revenue", D(2000, 1, 1), D(2000, 3, 31), 1.0, D(2000, 5, 1))], "entity int, item string, start date, end date, val double, filed date")
    plan = t.quarters_of(t.gathered(flows, m.BY_ITEM), m.BY_ITEM)._jdf.queryExecution().optimizedPlan().toString()
    # The column of years is made of ``_f``; beside the read for the quarters there is one for the years, and it stands before the lambda over the quarters.
    head = plan.split("synthetic")[0]
    assert "exists(flatten" not in plan and head


def test_gathering_sorts_no_more_than_the_windows_before(spark, monkeypatch):
    from cohortal.plans import stage

    seen = []
    monkeypatch.setattr(stage, "materialised", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    schema = "entity long, taxonomy string, concept string, unit string, start date, end date, val double, filed date, accn string, form string, seq int"
    facts = spark.createDataFrame([(1, "us-gaap", "Revenues", "USD", D(2000, 1, 1), D(2000, 3, 31), 1.0, D(2000, 5, 1), "a", "10-Q", 0)], schema)
    groups = m.gathered_items(m.resolve_items(m.tagged_facts(facts, "2000-11-30")), m.anchors(facts, "2000-11-30"))
    stage.dealt(groups)
    plan = seen[0].split("SortMergeJoin")[-1] if "SortMergeJoin" in seen[0] else seen[0]
    assert "ObjectHashAggregate" not in plan and plan.count("Window [") == 2 + 1
    assert spark.conf.get("spark.sql.execution.useObjectHashAggregateExec") == "true"
    placed = plan[plan.index("Window ["):].split("Exchange hashpartitioning(entity")[0]
    assert placed.count(" Sort [") == 2  # one for taxonomy and version, one for the items


def test_a_written_table_gives_a_branch_its_own_columns_and_rows(spark):
    from cohortal.plans import stage

    made = stage.written(spark.createDataFrame([(1, "a", 2.0), (2, None, 3.0)], "entity long, concept string, val double"))
    plan = made.where("concept = 'a'").select("val")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<concept:string,val:double>" in plan and "EqualTo(concept,a)" in plan
    assert sorted(map(tuple, made.collect())) == [(1, "a", 2.0), (2, None, 3.0)]
