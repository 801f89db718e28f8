import math
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortal.functions import scalars as sc
from cohortal.functions import stats
from cohortal.functions.spec import LINE_ITEMS, METRICS, weight_vectors


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_null_safe_arithmetic(spark):
    r = one(
        spark, sc.safe_div(F.lit(1.0), F.lit(0.0)), sc.safe_div(F.lit(6.0), F.lit(3.0)), sc.positive_ratio(F.lit(1.0), F.lit(-2.0)), sc.finite(F.lit(math.nan)),
        sc.finite(F.lit(math.inf)), sc.clamp(F.lit(2.0), 0, 1), sc.sum_of_present(F.lit(None).cast("double"), F.lit(2.0)), sc.sum_of_present(F.lit(None).cast("double")),
    )
    assert list(r) == [None, 2.0, None, None, None, 1.0, 2.0, None]


def test_dates_and_text(spark):
    d = F.lit("2024-03-31").cast("date")
    r = one(
        spark, sc.iso_date(F.lit("2024-02-29T10:00")).cast("string"), sc.iso_date(F.lit("bad")), sc.month_key(d), sc.month_end_back(d, 1).cast("string"),
        sc.shift_months(d, -1).cast("string"), sc.padded_id(F.lit("42")), sc.money(F.lit(" $1,234.50 ")), sc.money(F.lit("n/a")),
        sc.contains_text(F.lit("Acme 100%"), "100%"), sc.contains_text(F.lit(None).cast("string"), "x"), sc.whole_word(F.lit("Warrants of X"), "warrant"),
        sc.display_name(F.lit("Acme Corp Class A Common Stock of it")), sc.cap_text(F.lit(2.5e9)), sc.percent_text(F.lit(12.34), 1),
    )
    assert list(r) == [
        "2024-02-29", None, "2024-03", "2024-02-29", "2024-02-29", "0000000042", 1234.5, None, True, False, False, "Acme Corp (A)", "$2.5B", "+12.3%",
    ]


def test_formats_of_missing_values(spark):
    none = F.lit(None).cast("double")
    r = one(spark, sc.money_text(none), sc.cap_text(F.lit(float("nan"))), sc.percent_text(none), sc.metric_text(F.lit(-0.051), F.lit("pp")), sc.short_sector(none.cast("string")), sc.full_date(none.cast("string").cast("date")), sc.full_date(F.lit("2026-08-31").cast("date")))
    assert list(r) == ["\u2014", "\u2014", "\u2014", "-5.1pp", "\u2014", "\u2014", "31 Aug 2026"]


def test_share_links(spark):
    r = one(spark, sc.parse_share_link(F.lit("abc:2024-01-02,bad!,abc:2024-05-05, X.Y"), "2024-09-09").alias("x")).x
    assert [(p.id, p.day) for p in r] == [("ABC", "2024-01-02"), ("X.Y", "2024-09-09")]
    assert one(spark, sc.share_link(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("d1"), F.lit("d2"))))[0] == "A:d1,B:d2"


def test_a_long_share_link_is_read_in_one_pass(spark):
    n = 30_000
    link = ",".join(x for i in range(n) for x in (f"C{i % 7}:2024-01-02", "!broken", f"c{i}"))
    rows = spark.createDataFrame([(link,)], "x string")
    began = time.monotonic()
    got = rows.select(sc.parse_share_link("x", "2024-09-09").alias("x")).first().x
    assert time.monotonic() - began < 60
    assert [p.id for p in got] == [f"C{i}" for i in range(n)]
    assert {p.day for p in got[:7]} == {"2024-01-02"} and {p.day for p in got[7:]} == {"2024-09-09"}


def test_caps_are_taken_to_six_digits_before_they_are_shown(spark):
    got = one(spark, sc.cap_text(F.lit(1.3499996e9)), sc.cap_text(F.lit(1.3499994e9)), sc.cap_text(F.lit(12.345e12)), sc.cap_text(F.lit(12.3449994e12)), sc.cap_text(F.lit(1.4999996e6)))
    assert list(got) == ["$1.4B", "$1.3B", "$12.35T", "$12.34T", "$1M"]


@given(st.floats(-50, 150, allow_nan=False), st.sampled_from("abcd"))
def test_rebalance_always_sums_to_100(value, key):
    out = sc.rebalance(dict.fromkeys("abcd", 25.0), key, value)
    assert round(sum(out.values()), 6) == 100 and min(out.values()) >= 0


def test_csv_round_trip():
    rows = [["a", 'say "hi"', "x,y"], ["1", "", "line\r\nend"]]
    assert sc.parse_csv(sc.quote_csv(rows)) == rows


def pct(spark, values, better=True):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("g", F.lit(1))
    return [r.p for r in rows.withColumn("p", stats.tie_percentile("v", ["g"], better)).orderBy("i").collect()]


def test_tie_percentile(spark):
    assert pct(spark, [1.0, 2.0, 2.0, 4.0, None]) == [0.0, 50.0, 50.0, 100.0, None]
    assert pct(spark, [1.0, 2.0, 3.0], better=False) == [100.0, 50.0, 0.0]
    assert pct(spark, [7.0]) == [50.0]
    assert pct(spark, [None]) == [None]


def test_winsorized(spark):
    rows = spark.createDataFrame([(float(i), i // 50) for i in range(102)], "v double, g int")
    got = {r.v: r.w for r in rows.withColumn("w", stats.winsorized("v", ["g"])).collect()}
    assert got[0.0] == pytest.approx(2.45) and got[49.0] == pytest.approx(46.55) and got[20.0] == 20.0
    assert got[100.0] == 100.0  # two values only: left alone


def test_decile_differs_from_ntile(spark):
    got = [r.d for r in spark.range(12).select(stats.decile(F.col("id"), F.lit(12)).alias("d")).collect()]
    assert got == [1, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10]


def test_weighted_composite(spark):
    rows = spark.createDataFrame([(90.0, None, 30.0), (None, None, None)], "a double, b double, c double")
    c = stats.weighted_composite({"a": "a", "b": "b", "c": "c"}, {"a": 50, "b": 30, "c": 50})
    assert [r[0] for r in rows.select(c).collect()] == [60.0, None]


def test_trend_dispersion_and_scaling(spark):
    rows = spark.createDataFrame([(g, x, y) for g, ys in enumerate([[1.0, 2.0, 3.0, 4.0], [4.0, 3.0, 2.0, 1.0]]) for x, y in enumerate(ys)], "g int, x int, y double")
    got = {r.g: r.d for r in rows.groupBy("g").agg(stats.trend_dispersion("y", "x").alias("d")).collect()}
    assert got[0] == pytest.approx(0, abs=1e-6) and got[1] == pytest.approx(1.2909944)
    assert [r.s for r in rows.where("g = 0").withColumn("s", stats.min_max_scaled("y", ["g"])).orderBy("x").collect()] == pytest.approx([0, 1 / 3, 2 / 3, 1])


def test_most_common_takes_the_first_seen(spark):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (1, None, 0)], "g int, v string, o int")
    assert [tuple(r) for r in stats.most_common(rows, ["g"], "v", "o").collect()] == [(1, "b", 2)]


def test_registry(spark):
    assert len(METRICS) == 35 and len({m.key for m in METRICS}) == 35
    assert weight_vectors(spark).count() == 231
    assert all(LINE_ITEMS.values())
