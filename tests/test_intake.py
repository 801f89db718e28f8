"""The front half of a month: who is scored and why others are not; drift against last month; notes beside the measures."""

from datetime import date as D

import pytest
from pyspark.sql import functions as F

from cohortal.functions.spec import Settings
from cohortal.plans import intake, panel
from cohortal.plans import measures as m

DAY = "2026-08-31"
LISTING = "listing string, name string, sector string, industry string, market_cap double, volume double, last_sale double"


def listing(name, cap=2e9, volume=1e6, kind="Common Stock"):
    return (name, f"{name} Inc. {kind}", "Technology", "Computer Software", cap, volume, 10.0)


def known(entity, domestic=True, n=8, latest=D(2026, 6, 30), newer=None):
    return (entity, domestic, n, latest, newer)


@pytest.fixture
def run(spark):
    def go(listings, ids, filers, prices, prior=(), settings=Settings()):
        rows = intake.staged(
            spark.createDataFrame(listings, LISTING),
            spark.createDataFrame(ids, "listing string, entity string"),
            spark.createDataFrame(filers, "entity string, domestic boolean, n_filings int, latest date, newer struct<form: string, filed: date, report_date: date>"),
            spark.createDataFrame(prices, "listing string, adv double"),
            spark.createDataFrame([(x,) for x in prior], "listing string"),
            DAY, settings,
        )
        return rows, {r.listing: r for r in rows.collect()}

    return go


def test_every_rule_in_its_order(run):
    names = ["OK", "WAR", "SMALL", "NOID", "AA", "AB", "NOFACT", "NOPRICE", "FOREIGN", "SHORT", "STALE", "THIN", "BOTH"]
    listings = [listing(x) for x in names if x not in ("WAR", "SMALL", "AB", "BOTH")] + [listing("WAR", kind="Warrants"), listing("SMALL", 9e8), listing("AB", volume=2e6), listing("BOTH", 9e8, kind="Warrants")]
    ids = [(x, "A" if x in ("AA", "AB") else x) for x in names if x != "NOID"]
    filers = [known(x) for x in ("OK", "A", "NOPRICE", "THIN", "SMALL", "WAR")] + [known("FOREIGN", False), known("SHORT", n=3), known("STALE", latest=D(2025, 9, 30))]
    _, got = run(listings, ids, filers, [(x, 4e6 if x == "THIN" else 9e6) for x in names if x != "NOPRICE"])
    stages = {x: r.stage for x, r in got.items()}
    assert stages == {
        "OK": None, "WAR": "not_common", "BOTH": "not_common", "SMALL": "market_cap_floor", "NOID": "no_sec_match", "AA": "share_class", "AB": None, "NOFACT": "no_facts",
        "NOPRICE": "no_price", "FOREIGN": "foreign_filer", "SHORT": "short_history", "STALE": "stale", "THIN": "illiquid",
    }
    assert got["AB"].share_classes == ["AA", "AB"] and got["AA"].reason == "AB stands for the company"
    assert got["SHORT"].reason == "3 periodic filings" and got["STALE"].reason == "latest report is 2025-09-30" and got["OK"].reason is None


def test_floors_give_room_to_those_scored_before(run):
    caps = {"A": 8.5e8, "B": 8e8, "C": 7.99e8, "D": 9.99e8, "E": None}
    thin = {"F": 4.96e6, "G": 4.96e6, "H": 3.9e6}
    names = [*caps, *thin]
    filers = [known(x) for x in names]
    rows, got = run([listing(x, caps.get(x, 2e9)) for x in names], [(x, x) for x in names], filers, [(x, thin.get(x, 9e6)) for x in names], prior=["A", "B", "C", "E", "F", "H"])
    assert {x: r.stage for x, r in got.items()} == {"A": None, "B": None, "C": "market_cap_floor", "D": "market_cap_floor", "E": "market_cap_floor", "F": None, "G": "illiquid", "H": "illiquid"}
    assert [x for x, r in sorted(got.items()) if r.kept_small] == ["A", "B"] and [x for x, r in sorted(got.items()) if r.kept_thin] == ["F"]
    steps = {r.stage: (r.survivors, r.dropped, r.kept_below) for r in intake.funnel(rows).collect()}
    assert steps["listed"] == (8, 0, 0) and steps["market_cap_floor"] == (5, 3, 2) and steps["illiquid"] == (3, 2, 1) and len(steps) == 1 + len(intake.STAGES)


def test_a_stale_report_is_carried_only_while_a_newer_one_is_on_the_index(run):
    new = ("10-Q", D(2026, 8, 20), D(2026, 6, 30))
    cases = {"CARRIED": (D(2026, 1, 31), new), "NOINDEX": (D(2026, 1, 31), None), "TOOOLD": (D(2025, 9, 30), new), "NEWCOMER": (D(2026, 1, 31), new), "FRESH": (D(2026, 3, 31), new)}
    _, got = run([listing(x) for x in cases], [(x, x) for x in cases], [known(x, latest=a, newer=b) for x, (a, b) in cases.items()], [(x, 9e6) for x in cases], prior=[x for x in cases if x != "NEWCOMER"])
    assert {x: (r.stage, r.carried) for x, r in got.items()} == {"CARRIED": (None, True), "NOINDEX": ("stale", False), "TOOOLD": ("stale", False), "NEWCOMER": ("stale", False), "FRESH": (None, False)}


def test_filers_count_periodic_filings_of_the_first_concept(spark):
    fact = lambda e, c, form, accn, day="2026-06-30", tax="us-gaap": (e, tax, c, "USD", None, D.fromisoformat(day), 1.0, D(2026, 7, 30), accn, form, 0)
    rows = [fact("A", "Assets", "10-Q", "1"), fact("A", "Assets", "10-Q", "1", "2025-12-31"), fact("A", "Assets", "8-K", "2"), fact("A", "Liabilities", "10-K", "3"), fact("A", "Assets", "10-K", "4")]
    rows += [fact("B", "StockholdersEquity", "20-F", "5"), fact("C", "Revenues", "10-Q", "6"), fact("D", "Assets", "10-Q", "7", tax="ifrs-full")]
    facts = spark.createDataFrame(rows, "entity string, taxonomy string, concept string, unit string, start date, end date, val double, filed date, accn string, form string, seq int")
    newer = spark.createDataFrame([("A", "10-Q", D(2026, 8, 20), D(2026, 7, 31)), ("A", "10-K", D(2026, 8, 25), D(2026, 7, 31)), ("A", "10-Q", D(2026, 9, 20), D(2026, 8, 31))], "entity string, form string, filed date, report_date date")
    got = {r.entity: r for r in intake.filers(facts, DAY, newer).collect()}
    assert (got["A"].domestic, got["A"].n_filings, got["A"].newer.form) == (True, 2, "10-K")
    assert (got["B"].domestic, got["B"].n_filings, got["B"].newer) == (False, 1, None)
    assert set(got) == {"A", "B", "C", "D"} and got["C"].n_filings is None and got["D"].n_filings is None


def test_exits_take_the_listing_s_own_rule(spark):
    rows = spark.createDataFrame([("L1", "stale", "r1"), ("L2", "share_class", "r2"), ("L3", "not_common", "r3"), ("L4", None, None)], "listing string, stage string, reason string")
    prior = spark.createDataFrame([(f"E{k}", f"L{k}") for k in range(1, 6)], "entity string, listing string")
    got = {(kind, r.entity, r.reason) for kind, df in intake.exits_of(rows, prior) for r in df.collect()}
    assert got == {("excluded", "E1", "r1"), ("share_class", "E2", "r2"), ("unlisted", "E3", "r3")}


def test_lost_measures_are_those_of_both_months(spark):
    now = spark.createDataFrame([("A",), ("B",)], "entity string")
    before = spark.createDataFrame([("A",), ("B",), ("C",)], "entity string")
    grid = spark.createDataFrame([("A", "x", None, "negative equity"), ("A", "y", 5.0, None), ("B", "x", None, "not tagged")], "entity string, metric string, pct double, reason string")
    then = spark.createDataFrame([("A", "x", 1.0), ("A", "y", 1.0), ("A", "z", 1.0), ("B", "x", None), ("C", "x", 1.0)], "entity string, metric string, pct double")
    assert {tuple(r) for r in panel.lost_since(now, grid, before, then).collect()} == {("A", "x", "negative equity", True), ("A", "z", "not looked at in this segment", False)}


def test_notes_and_the_audit_of_ignored_tags(spark):
    q = lambda k: (D(2024 + (k + 2) // 4, (k + 2) % 4 * 3 + 1, 1), [D(2024, 9, 30), D(2024, 12, 31), D(2025, 3, 31), D(2025, 6, 30), D(2025, 9, 30), D(2025, 12, 31), D(2026, 3, 31), D(2026, 6, 30)][k])
    rows = []
    for e in ("A", "B"):
        for k in range(8):
            start, end = q(k)
            hit = -60.0 if k == 6 and e == "A" else 0.0
            rows += [(e, "OperatingIncomeLoss", start, end, 50.0 + hit), (e, "Revenues", start, end, 100.0), (e, "NetIncomeLoss", start, end, 30.0)]
            for c, v in (("Assets", 900.0), ("StockholdersEquity", 400.0), ("Liabilities", 500.0), ("CashAndCashEquivalentsAtCarryingValue", 10.0), ("LongTermDebtNoncurrent", 90.0)):
                rows.append((e, c, None, end, v))
    rows.append(("A", "GoodwillImpairmentLoss", *q(6), 60.0))
    rows += [("A", "Goodwill", None, D(2025, 6, 30), 5.0), ("A", "Goodwill", None, D(2024, 12, 31), 6.0)]
    facts = spark.createDataFrame(
        [(e, "us-gaap", c, "USD", a, b, v, D(2026, 8, 1), "x", "10-Q", 0) for e, c, a, b, v in rows],
        "entity string, taxonomy string, concept string, unit string, start date, end date, val double, filed date, accn string, form string, seq int",
    )
    wide = m.measures(facts, spark.createDataFrame([("A", 1e3), ("B", 1e3)], "entity string, market_cap double"), DAY).cache()
    notes = {tuple(r) for r in m.note_rows(wide).collect()}
    assert ("A", "ebit", "one_off_charge", "GoodwillImpairmentLoss", D(2026, 3, 31), 60.0) in notes
    assert ("A", "inputs", "ignored_tag", "Goodwill", D(2025, 6, 30), None) in notes and not any(n[0] == "B" and n[2] != "closing_capital" for n in notes)
    assert [tuple(r) for r in m.ignored_tags(wide).collect()] == [("A", "Goodwill", D(2025, 6, 30))]
    raw = {r.entity: r.raw_inputs for r in wide.select("entity", "raw_inputs").collect()}
    assert (raw["A"].ebit, raw["B"].ebit, raw["A"].debt, raw["A"].market_cap) == (200.0, 200.0, 90.0, 1000.0)
