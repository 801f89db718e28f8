import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortal.operators import temporal as t

D = dt.date
FACTS = "entity string, concept string, start date, end date, val double, filed date, seq int"


def quarters(n, first=(2021, 1), val=lambda k: 100.0):
    out, (y, q) = [], first
    for k in range(n):
        start = D(y, 3 * q - 2, 1)
        end = (D(y + (q == 4), (3 * q) % 12 + 1, 1)) - dt.timedelta(1)
        out.append((start, end, val(k)))
        y, q = (y + 1, 1) if q == 4 else (y, q + 1)
    return out


def flows(spark, rows, entity="A", concept="x"):
    return spark.createDataFrame([(entity, concept, s, e, v, e + dt.timedelta(40), k) for k, (s, e, v) in enumerate(rows)], FACTS)


def test_visibility_and_versions(spark):
    rows = [("A", "x", None, D(2024, 3, 31), v, f, k) for k, (v, f) in enumerate([(1.0, D(2024, 5, 1)), (2.0, D(2024, 8, 1)), (3.0, D(2025, 1, 1)), (9.0, D(2024, 8, 1))])]
    f = spark.createDataFrame(rows, FACTS).withColumns({"form": F.lit("10-Q"), "unit": F.lit("USD")})
    seen = t.latest_version(t.visible(f, "2024-12-31", t.FORMS, t.UNITS), ["entity", "concept", "end"])
    assert [r.val for r in seen.collect()] == [2.0]
    assert t.visible(f.withColumn("form", F.lit("DEF 14A")), "2024-12-31", t.FORMS).isEmpty()


def test_first_taxonomy_wins_even_if_its_rows_are_filtered_later(spark):
    rows = [("A", "x", "ifrs", 1.0), ("A", "x", "gaap", 2.0), ("A", "y", "ifrs", 3.0)]
    f = spark.createDataFrame(rows, "entity string, concept string, taxonomy string, val double")
    assert sorted(r.val for r in t.first_taxonomy(f, ["gaap", "ifrs"]).collect()) == [2.0, 3.0]


def test_priority_and_largest(spark):
    rows = [("A", D(2024, 1, 1), 5.0, 0, 1, 0), ("A", D(2024, 6, 1), 3.0, 1, 2, 0), ("A", D(2024, 6, 1), 4.0, 2, 3, 0)]
    f = spark.createDataFrame(rows, "entity string, filed date, val double, priority int, concept int, seq int")
    assert t.priority_merge(f, ["entity"]).first().val == 5.0
    assert t.largest_in_newest(f, ["entity"]).first().val == 4.0


def test_asof_includes_the_same_day(spark):
    facts = spark.createDataFrame([("A", D(2024, 1, 1), 1.0), ("A", D(2024, 3, 1), 2.0)], "e string, d date, v double")
    probes = spark.createDataFrame([("A", D(2024, 3, 1), 1), ("A", D(2024, 2, 1), 2), ("A", D(2023, 1, 1), 3), ("B", D(2024, 1, 1), 4)], "e string, at date, id int")
    got = {r.id: r.v for r in t.asof(probes, facts, ["e"], "at", "d", ["v"]).collect()}
    assert got == {1: 2.0, 2: 1.0, 3: None, 4: None}


def test_nearest_takes_the_earlier_on_ties(spark):
    facts = spark.createDataFrame([("A", D(2024, 1, 1), 1.0), ("A", D(2024, 1, 21), 2.0)], "e string, d date, v double")
    probes = spark.createDataFrame([("A", D(2024, 1, 11), 1), ("A", D(2024, 1, 20), 2), ("A", D(2024, 6, 1), 3)], "e string, at date, id int")
    got = {r.id: r.v for r in t.nearest(probes, facts, ["e"], "at", "d", 45, ["v"]).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: None}


def test_stub_gives_the_missing_quarter(spark):
    f = flows(spark, [(D(2024, 1, 1), D(2024, 9, 30), 300.0), (D(2024, 1, 1), D(2024, 12, 31), 450.0)])
    r = t.stub_synthesis(f, ["entity", "concept"]).collect()
    assert [(x.start, x.end, x.val) for x in r] == [(D(2024, 10, 1), D(2024, 12, 31), 150.0)]


def test_quarterly_series_drops_a_year_tagged_as_a_quarter(spark):
    rows = [*quarters(3, (2024, 1)), (D(2024, 10, 1), D(2024, 12, 31), 400.0), (D(2024, 1, 1), D(2024, 12, 31), 400.0), (D(2024, 1, 1), D(2024, 9, 30), 300.0)]
    got = {r.end: r.val for r in t.quarterly_series(flows(spark, rows), ["entity", "concept"]).collect()}
    assert got[D(2024, 12, 31)] == 100.0 and len(got) == 4


def test_annual_series_keeps_years_far_from_the_last_kept(spark):
    ends = [D(2024, 12, 31), D(2024, 9, 30), D(2023, 12, 31), D(2023, 6, 30)]
    f = flows(spark, [(e - dt.timedelta(364), e, float(k)) for k, e in enumerate(ends)])
    years = t.annual_series(f, ["entity"]).first().years
    assert [y.end for y in years] == [D(2024, 12, 31), D(2023, 12, 31)]
    assert t.annual_series(f, ["entity"], F.lit("2026-06-30").cast("date")).first().years == []


def test_ttm_prefers_quarters_over_an_old_year(spark):
    rows = [*quarters(5, (2024, 1), lambda k: 100.0 + k), (D(2024, 1, 1), D(2024, 12, 31), 406.0)]
    r = t.ttm(flows(spark, rows), ["entity", "concept"]).first()
    assert (r.val, r.basis, r.end) == (410.0, "ttm", D(2025, 3, 31))
    r = t.ttm(flows(spark, [(D(2024, 1, 1), D(2024, 12, 31), 406.0)]), ["entity", "concept"]).first()
    assert (r.val, r.basis) == (406.0, "fy")
    assert t.ttm(flows(spark, quarters(3)), ["entity", "concept"]).isEmpty()


def test_ttm_equals_a_sequential_reading(spark):
    """Brute force: tile backwards, the longest that fits first."""
    rows = [(D(2023, 7, 1), D(2023, 12, 31), 50.0), (D(2024, 1, 1), D(2024, 6, 30), 60.0), (D(2024, 4, 1), D(2024, 6, 30), 31.0), (D(2023, 4, 1), D(2023, 6, 30), 20.0)]
    cursor, covered, total = max(e for _, e, _ in rows), 0, 0.0
    while covered < 350:
        s, e, v = max((r for r in rows if abs((r[1] - cursor).days) <= 4 and (r[1] - r[0]).days <= 366 - covered + 12), key=lambda r: r[1] - r[0])
        cursor, covered, total = s - dt.timedelta(1), covered + (e - s).days, total + v
    assert t.ttm(flows(spark, rows), ["entity", "concept"]).first().val == total == 110.0


def test_rolling_sum_needs_four_close_quarters(spark):
    rows = quarters(5)
    s = spark.createDataFrame([("A", e, v) for _, e, v in rows[:2] + rows[3:]], "entity string, end date, val double")
    assert [r.val_ttm for r in t.rolling_sum4(s, ["entity"], "end", "val").orderBy("end").collect()] == [None, None, None, None]
    s = spark.createDataFrame([("A", e, v) for _, e, v in rows], "entity string, end date, val double")
    assert [r.val_ttm for r in t.rolling_sum4(s, ["entity"], "end", "val").orderBy("end").collect()][3:] == [400.0, 400.0]


def test_reference_date_needs_five_concepts(spark):
    rows = [("A", f"c{k}", None, D(2024, 6, 30) if k < 5 else D(2024, 9, 30), 1.0, D(2024, 11, 1), 0) for k in range(8)]
    assert t.reference_date(spark.createDataFrame(rows, FACTS), ["entity"], "2024-12-31").first().anchor == D(2024, 6, 30)


def test_merge_predecessors_counts_repeats_once(spark):
    rows = [("NEW", f"n{k}", None, D(2024, 1, 1), float(k), D(2024, 2, 1), k) for k in range(7)]
    rows += [("OLD", "o", None, D(2023, 1, 1), 1.0, D(2023, 2, 1), 0), ("OLD", "o2", None, D(2023, 1, 1), 1.0, D(2023, 2, 1), 0), ("OLD", "n0", None, D(2024, 1, 1), 0.0, D(2024, 2, 1), 9)]
    got = t.merge_predecessors(spark.createDataFrame(rows, FACTS), spark.createDataFrame([("OLD", "NEW")], "predecessor string, successor string"))
    assert got.count() == 9 and {r.entity for r in got.collect()} == {"NEW"}


def test_momentum_and_volume(spark):
    rows = [("A", D(2023, 8, 30), 100.0, 10.0), ("A", D(2024, 7, 30), 150.0, 10.0), ("A", D(2024, 8, 30), 999.0, None), ("B", D(2023, 8, 1), 100.0, 1.0), ("B", D(2024, 7, 31), 150.0, 1.0)]
    p = spark.createDataFrame(rows, "entity string, d date, close double, volume double")
    assert {r.entity: r.momentum for r in t.momentum(p, "2024-08-31", 12).collect()} == {"A": 0.5, "B": None}
    assert {r.entity: r.adv for r in t.average_dollar_volume(p, "2024-08-31", 2).collect()}["A"] == pytest.approx(1500.0)


def test_tiles_are_looked_through_once_a_step(spark):
    rows = spark.createDataFrame([(1, "2023-01-01", "2023-12-31", 4.0, "2024-02-01")], "entity int, start string, end string, val double, filed string")
    flows = rows.select("entity", F.to_date("start").alias("start"), F.to_date("end").alias("end"), "val", F.to_date("filed").alias("filed"))
    out = t.ttm(flows, ["entity"])
    assert [(r.val, r.basis) for r in out.collect()] == [(4.0, "fy")]
    assert str(t.tiled(F.col("facts"))).count("array_max") <= 2  # the last end, and the best tile of a step
