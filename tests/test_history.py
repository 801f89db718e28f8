"""Chains kept up month by month, months that are whole or absent, record fingerprints, packs, places."""

import pytest
from pyspark.sql import functions as F

from cohortal.operators import screen
from cohortal.plans import chain, pack, panel, score
from cohortal.sources import readers, sinks

PANEL = "month string, entity string, price double, prior_price double"
ROWS = [
    ("2026-08", "SPLIT", 100.0, None), ("2026-09", "SPLIT", 98.0, 100.0), ("2026-10", "SPLIT", 15.0, 14.7),
    ("2026-08", "GAP", 10.0, None), ("2026-10", "GAP", 12.0, 11.0),
    ("2026-08", "UNKNOWN", 10.0, 9.0), ("2026-09", "UNKNOWN", 11.0, None), ("2026-10", "UNKNOWN", 12.0, 11.0),
    ("2026-08", "GONE", 5.0, None), ("2026-09", "GONE", 6.0, 5.5),
    ("2026-09", "ZERO", 0.0, None), ("2026-10", "ZERO", 7.0, 6.0), ("2026-10", "NEW", 3.0, None),
    ("2026-09", "NONE", None, None), ("2026-10", "NONE", None, 4.0),
]


def adjusted(df):
    return {(r.month, r.entity): r.price_adj for r in df.collect()}


@pytest.fixture
def record(spark, tmp_path):
    path, rows = str(tmp_path / "record"), spark.createDataFrame(ROWS, PANEL)
    for month in ("2026-08", "2026-09", "2026-10"):
        assert chain.chain_month(spark, path, rows.where(F.col("month") == month), month) == [month]
    return path, rows


def test_months_one_by_one_equal_the_whole(spark, record):
    path, rows = record
    got = adjusted(chain.on_newest_basis(readers.read_months(spark, path)))
    assert got == adjusted(panel.chain_linked(rows)) == adjusted(chain.on_newest_basis(chain.linked_history(rows)))
    assert [got[m, "SPLIT"] for m in ("2026-08", "2026-09", "2026-10")] == [15.0, 14.7, 15.0]
    assert got["2026-08", "GAP"] is None and got["2026-08", "UNKNOWN"] is None and got["2026-09", "UNKNOWN"] == 11.0
    assert got["2026-08", "GONE"] == 5.5 and got["2026-09", "ZERO"] is None and got["2026-10", "NONE"] is None


def test_a_month_reads_the_month_before_alone(spark, record):
    path, _ = record
    assert {f.split("/")[-2] for f in chain.before(spark, path, "2026-10").inputFiles()} == {"month=2026-09"}
    assert chain.before(spark, path, "2026-08") is None


def test_a_split_behind_the_newest_month_is_restated(spark, record):
    path, rows = record
    latest = spark.createDataFrame([("SPLIT", 7.5, 7.35), ("OTHER", 1.0, 1.0)], "entity string, price double, prior_price double")
    made = chain.restated(readers.read_months(spark, path), latest, "2026-10", chain.before(spark, path, "2026-10"))
    got = adjusted(chain.on_newest_basis(made))
    assert [got[m, "SPLIT"] for m in ("2026-08", "2026-09", "2026-10")] == [7.5, 7.35, 7.5]
    assert got == adjusted(panel.chain_linked(rows, latest)) and got["2026-08", "GONE"] == 5.5
    assert adjusted(chain.on_newest_basis(readers.read_months(spark, path)))["2026-10", "SPLIT"] == 15.0  # the record stays


def test_a_write_that_dies_leaves_no_month(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "months")
    rows = lambda v, *months: spark.createDataFrame([(m, v) for m in months], "month string, v long")
    assert sinks.append_months(rows(1, "2026-01"), path) == ["2026-01"]
    move, moved = sinks._move, []

    def dies(*args):
        if moved:
            raise RuntimeError("lost")
        moved.append(move(*args))

    monkeypatch.setattr(sinks, "_move", dies)
    with pytest.raises(RuntimeError):
        sinks.append_months(rows(2, "2026-02", "2026-03"), path)
    assert {r.month: r.v for r in readers.read_months(spark, path).collect()} == {"2026-01": 1, "2026-02": 2}
    monkeypatch.setattr(sinks, "_move", move)
    assert sinks.append_months(rows(3, "2026-02", "2026-03"), path) == ["2026-03"]
    assert {r.month: r.v for r in readers.read_months(spark, path).collect()} == {"2026-01": 1, "2026-02": 2, "2026-03": 3}


def test_a_month_without_its_mark_is_skipped_and_replaced(spark, tmp_path):
    path = str(tmp_path / "months")
    rows = lambda v: spark.createDataFrame([("2026-01", v)], "month string, v long")
    rows(9).drop("month").write.parquet(f"{path}/month=2026-01")
    with pytest.raises(readers.SourceError):
        readers.read_months(spark, path)
    assert sinks.append_months(rows(1), path) == ["2026-01"] and readers.read_months(spark, path).first().v == 1
    assert sinks.append_months(rows(2), path) == [] and sinks.append_months(rows(2), path, force=True) == ["2026-01"]
    assert readers.read_months(spark, path).first().v == 2


def test_a_changed_field_is_refused(spark):
    rows = spark.createDataFrame([("A", "x", None, 1.0), ("A", "x", None, 1.0), ("B", None, "x", None)], "entity string, a string, b string, v double")
    same = sinks.same_but
    assert same(rows, rows.orderBy(F.desc("entity")).select("v", "b", "a", "entity"), [])
    assert same(rows, rows.withColumn("v", F.lit(3.0)), ["v"]) and not same(rows, rows.withColumn("v", F.lit(3.0)), [])
    assert not same(rows, rows.withColumns({"a": F.col("b"), "b": F.col("a")}), [])  # a null and a text change places
    assert not same(rows, rows.dropDuplicates(), []) and not same(rows, rows.drop("v"), [])
    changed = rows.withColumn("a", F.when(F.col("entity") == "B", "y").otherwise(F.col("a")))
    assert {(r.side, '"y"' in r.row) for r in sinks.changed_rows(rows, changed, []).collect()} == {("before", False), ("after", True)}
    extra = spark.createDataFrame([("B", 7.0), ("B", 8.0)], "entity string, v double")  # would repeat a row
    with pytest.raises(ValueError, match="only its own column"):
        sinks.back_fill(rows, extra, ["entity"], "v")
    assert sinks.back_fill(rows, extra.limit(1), ["entity"], "v").where("entity = 'B'").first().v == 7.0


def test_a_subset_leaves_no_row_without_its_score(spark, tmp_path):
    scores = spark.createDataFrame(
        [(m, e, f"n,{e}", "s", seg, k) for m in ("1", "2") for k, (e, seg) in enumerate([("A", "x"), ("B", "x"), ("C", "y"), ("D", "z")], 1) if (m, e) != ("1", "B")],
        "month string, entity string, name string, sector string, segment string, rank int",
    )
    metrics = scores.select("month", "entity", F.lit("m").alias("metric"), F.lit(1.0).alias("raw"), F.lit(2.0).alias("pct"))
    gone = spark.createDataFrame([("2", "Q", 'a "b"', "y", "unlisted", "left\nbehind")], "month string, entity string, name string, segment string, kind string, reason string")
    spec = spark.createDataFrame([("m", "quality", False)], "metric string, factor string, higher_better boolean")
    full = pack.build(scores, metrics, gone, spec)
    assert {r.month: r.not_ranked_recorded for r in full[pack.MONTHS].collect()} == {"1": "not recorded", "2": "yes"}
    cut = pack.subset(full, ["x", "y"], pack.top_today(scores, 1))
    got = {n: cut[n].count() for n in pack.TABLES}
    assert got == {pack.MONTHS: 2, pack.DICTIONARY: 1, pack.COMPANIES: 2, pack.SCORES: 4, pack.METRICS: 4, pack.NOT_RANKED: 1}  # y has none in the first place, so it stays whole
    keys = lambda n: {(r.month, r.entity) for r in cut[n].collect()}
    assert keys(pack.SCORES) == keys(pack.METRICS) == {(m, e) for m in "12" for e in "AC"}
    manifest = pack.write(cut, str(tmp_path / "pack"))
    assert {r.file: r.n_rows for r in manifest.collect()} | {pack.NOT_RANKED: 1} == got
    back = pack.read(spark, str(tmp_path / "pack"), pack.SCORES, "month string, entity string, name string, sector string, segment string, rank int")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cut[pack.SCORES].collect()))


def test_places_in_every_direction(spark):
    rows = spark.createDataFrame([("x", f"e{k}", v, t) for k, (v, t) in enumerate([(3.0, "b"), (None, None), (1.0, "A"), (3.0, "a"), (None, "C")])] + [("y", "e9", None, "q")], "s string, entity string, v double, t string")
    order = lambda *a: [r.entity for r in screen.placed(rows, ["s"], *a).where("s = 'x'").orderBy("place").collect()]
    assert order("v", True) == ["e0", "e3", "e2", "e1", "e4"] and order("v", False) == ["e2", "e0", "e3", "e1", "e4"]
    assert order("t", False, True) == ["e1", "e2", "e3", "e0", "e4"] and order("t", True, True) == ["e4", "e0", "e2", "e3", "e1"]
    assert screen.placed(rows, ["s"], "v", True).where("s = 'y'").first().place == 1


def test_one_reading_serves_all_keys_and_horizons(spark):
    rows = spark.range(40).selectExpr("cast(id as string) as entity", "id").crossJoin(spark.range(6).selectExpr("format_string('2026-%02d', id + 1) as month", "id as m"))
    rows = rows.where("not (m = 2 and id < 3)").select("month", "entity", (100 - F.col("id")).cast("double").alias("a"), (F.col("id") * 7 % 40).cast("double").alias("b"), (100 + F.col("m") * (F.col("id") % 5)).cast("double").alias("price_adj"))
    got = {(r.key, r.horizon, r.month, r.entity): (round(r.fwd, 9), r.bucket) for r in panel.decile_grid(rows, ["a", "b"], [1, 3]).collect()}
    want = {}
    for key in ("a", "b"):
        for h in (1, 3):
            want |= {(key, h, r.month, r.entity): (round(r.fwd, 9), r.bucket) for r in panel.score_deciles(panel.forward_returns(rows, h), key).collect()}
    assert got == want and len(got) > 500


def test_a_regression_gap_needs_no_window(spark):
    rows = spark.createDataFrame([(k, None if k % 3 else "p", k / 100, 1 / (2 + k % 4)) for k in range(30)], "entity long, peer string, x double, y double")
    out = score.regression_gap(rows, ["peer"], "x", "y")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("gap is not null").count() == 30 and abs(out.agg(F.sum("gap")).first()[0]) < 1e-9
    assert score.regression_gap(rows.limit(7), ["peer"], "x", "y").where("gap is not null").count() == 0


def test_a_record_is_begun_from_a_panel_written_once(spark, monkeypatch):
    from cohortal import catalog_history

    seen = []
    plain = sinks.append_months
    monkeypatch.setattr(sinks, "append_months", lambda rows, *more, **named: seen.append(rows.inputFiles()) or plain(rows, *more, **named))
    catalog_history._chain_record(spark, "/root/testdata/sf0.001")
    assert len(seen) == 3 and not any("lineitem" in f or "orders" in f for files in seen for f in files)


def test_a_record_is_put_on_the_newest_basis_without_a_join(spark, record):
    made = chain.on_newest_basis(readers.read_months(spark, record[0]))
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
