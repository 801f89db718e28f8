import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortal.functions.spec import FACTORS, Metric, Registry, Settings
from cohortal.operators import classify, eligibility, screen
from cohortal.plans import panel, score

D = dt.date
KEYS = ["roic", "gpoa", "earn_var", "ebit_ev", "ebitda_ev", "fcf_ev", "delta_gpoa", "rev_growth", "debt_equity", "net_debt_ebitda", "altman_z"]


def values(i):
    return dict(
        roic=0.05 + 0.01 * i, gpoa=0.10 + 0.01 * i, earn_var=0.20 - 0.005 * i, ebit_ev=0.02 + 0.002 * i, ebitda_ev=0.03 + 0.002 * i, fcf_ev=0.01 + 0.002 * i,
        delta_gpoa=0.01 * i, rev_growth=0.02 * i, debt_equity=2 - 0.05 * i, net_debt_ebitda=4 - 0.1 * i, altman_z=1 + 0.2 * i,
    )


def inputs(spark, change=None, sector=lambda i: "Tech"):
    rows = [(f"T{i}", "operating", sector(i), 1000.0 - i) for i in range(30)]
    long = []
    for i in range(30):
        v = values(i) | (change or {}).get(i, {})
        long += [(f"T{i}", k, v[k]) for k in KEYS if v[k] is not None]
    return (
        spark.createDataFrame(rows, "entity string, segment string, peer string, market_cap double"),
        spark.createDataFrame(long, "entity string, metric string, raw double"),
        Registry().table(spark).where(F.col("metric").isin(KEYS)),
    )


SETTINGS = Settings(min_cohort=8)


def run(spark, **kw):
    return score.score_segments(*inputs(spark, **kw), settings=SETTINGS)


def test_ranking_from_best_to_worst(spark):
    scored, short = run(spark)
    rows = {r.entity: r for r in scored.collect()}
    assert sorted(r["rank"] for r in rows.values()) == list(range(1, 31)) and short.isEmpty()
    assert rows["T28"].composite == rows["T29"].composite == max(r.composite for r in rows.values())  # both clipped
    assert rows["T29"].decile == 1 and rows["T0"].decile == 10 and rows["T0"].peer_size == 30


def test_hurdle(spark):
    grid = score.percentile_grid(*inputs(spark, change={29: {"roic": 0.05}, 5: {"roic": None}}), SETTINGS)
    got = {r.entity: (r.pct, r.basis) for r in grid.where("metric = 'rev_growth'").collect()}
    assert got["T29"] == (50.0, "sector|below-hurdle") and got["T5"][0] is None and got["T28"][0] > 90


def test_thin_groups_among_all_of_their_segment(spark):
    rows = [("T", "op", "m", float(k), True, "thin" if k % 5 == 0 else "big", "universe" if k % 5 == 0 else "sector", f"e{k}") for k in range(20)]
    grid = spark.createDataFrame(rows, "x string, segment string, metric string, raw double, higher_better boolean, cohort string, basis string, entity string")
    plain = score.Settings(winsor=(0.0, 100.0))
    pct = lambda settings: {r.entity: r.pct for r in score.percentiles(grid, settings).collect()}
    pool, segment = pct(plain), pct(score.Settings(winsor=(0.0, 100.0), thin_fallback="segment"))
    assert [pool[f"e{k}"] for k in (0, 5, 10, 15)] == [0.0, 33.3, 66.7, 100.0] and [segment[f"e{k}"] for k in (0, 5, 10, 15)] == [0.0, 26.3, 52.6, 78.9]
    assert {e: p for e, p in pool.items() if int(e[1:]) % 5} == {e: p for e, p in segment.items() if int(e[1:]) % 5}
    assert score.percentiles(grid, plain).columns == score.percentiles(grid, score.Settings(thin_fallback="segment")).columns


def test_thin_groups_are_pooled_with_each_other(spark):
    rows, _, _ = inputs(spark, sector=lambda i: "Tiny" if i < 3 else "Small" if i < 6 else "Tech")
    got = {r.entity: (r.cohort, r.basis) for r in score.with_cohort(rows, 8).collect()}
    assert got["T0"] == got["T4"] == ("pooled_thin", "universe") and got["T9"] == ("Tech", "sector")


def test_coverage_gate(spark):
    gone = dict.fromkeys(["roic", "gpoa", "ebit_ev", "ebitda_ev", "fcf_ev", "debt_equity", "altman_z", "delta_gpoa"])
    scored, short = run(spark, change={0: gone})
    assert [r.entity for r in short.collect()] == ["T0"] and scored.count() == 29


def test_metric_that_few_have_is_left_out(spark):
    grid = score.applicable(score.measure_grid(*inputs(spark, change={i: {"gpoa": None} for i in range(19)})))
    assert "gpoa" not in {r.metric for r in grid.select("metric").distinct().collect()}


def test_large_cohorts_are_ranked_by_ranges_with_the_same_result(spark):
    import dataclasses

    change = {i: {"gpoa": 0.3, "roic": None if i % 3 else 0.1} for i in range(0, 30, 2)}
    given = inputs(spark, change=change, sector=lambda i: "Lone" if i == 7 else "Pair" if i < 2 else "Tech")
    settings = dataclasses.replace(SETTINGS, min_cohort=0)
    rows = lambda s: sorted((r.entity, r.metric, None if r.win is None else round(r.win, 9), r.pct) for r in score.percentile_grid(*given, s).collect())
    assert rows(settings) == rows(dataclasses.replace(settings, window_rows=0))


def test_stability(spark):
    rows = [("A", "s", 1, 95.0, 95.0, 95.0, 95.0), ("B", "s", 2, 90.0, 90.0, 10.0, 10.0), ("C", "s", 3, 10.0, 10.0, 90.0, 90.0)]
    scored = spark.createDataFrame(rows, "entity string, segment string, rank long, " + ", ".join(f"{f} double" for f in FACTORS))
    got = {r.entity: (r.rank_min, r.rank_max, r.stability) for r in score.rank_stability(scored, (10, 20, 25, 30, 40)).collect()}
    assert got["A"] == (1, 1, 1.0) and got["B"][:2] == (2, 3)


def test_what_if(spark):
    scored, _ = run(spark)
    same = score.what_if(scored, dict.fromkeys(FACTORS, 25.0))
    assert score.displacement(same).first().displaced == 0
    assert score.what_if(scored, {"quality": 100.0, "growth": 0.0, "valuation": 0.0, "health": 0.0}).count() == 30


def test_regression_gap_needs_eight(spark):
    rows = spark.createDataFrame([("a" if i < 9 else "b", 0.05 * i, 0.5 + 0.1 * i) for i in range(12)], "g string, x double, y double")
    got = score.regression_gap(rows, ["g"], "x", "y").collect()
    assert all((r.gap is None) == (r.g == "b") for r in got)
    assert sum(r.gap for r in got if r.gap is not None) == pytest.approx(0, abs=1e-9)


def test_retention(spark):
    rows = spark.createDataFrame([(850e6, True), (800e6, True), (799e6, True), (999e6, False), (1e9, False), (None, True)], "v double, was boolean")
    assert [r[0] for r in rows.select(eligibility.clears("v", 1e9, "was")).collect()] == [True, True, False, False, True, False]


def test_cascade(spark):
    cols = "entity string, has_facts boolean, domestic boolean, n_filings int, latest date, newer struct<form: string>, adv double, was_scored boolean"
    rows = [
        ("ok", True, True, 9, D(2026, 6, 30), None, 9e6, False), ("none", False, None, None, None, None, 9e6, False), ("price", True, True, 9, D(2026, 6, 30), None, None, False),
        ("foreign", True, False, 9, D(2026, 6, 30), None, 9e6, False), ("short", True, True, 2, D(2026, 6, 30), None, 9e6, False),
        ("stale", True, True, 9, D(2025, 9, 30), None, 9e6, True), ("thin", True, True, 9, D(2026, 6, 30), None, 3.9e6, True),
        ("kept", True, True, 9, D(2026, 6, 30), None, 4.96e6, True), ("new", True, True, 9, D(2026, 6, 30), None, 4.96e6, False),
        ("carried", True, True, 9, D(2025, 12, 31), ("10-Q",), 9e6, True),
    ]
    staged = eligibility.cascade(spark.createDataFrame(rows, cols), "2026-08-31")
    got = {r.entity: (r.stage, r.carried) for r in staged.collect()}
    assert got == {
        "ok": (None, False), "none": ("no_facts", False), "price": ("no_price", False), "foreign": ("foreign_filer", False), "short": ("short_history", False),
        "stale": ("stale", False), "thin": ("illiquid", False), "kept": (None, False), "new": ("illiquid", False), "carried": (None, True),
    }
    assert [r.survivors for r in eligibility.funnel(staged).orderBy("step").collect()] == [10, 9, 8, 7, 6, 5, 3]


def test_classification(spark):
    rows = [
        ("Finance", "Real Estate Investment Trusts", None, None, "reits"), ("Finance", "Life Insurance", None, None, "insurers"), ("Finance", "Investment Bankers/Brokers", None, None, "capital_markets"),
        ("Finance", "Major Banks", None, None, "banks"), ("Finance", "Finance Companies", 5.0, 100.0, "banks"), ("Finance", "Finance: Consumer Services", 1.3, 100.0, "operating"),
        ("Finance", "Finance: Consumer Services", None, None, "operating"), ("Real Estate", "Other Consumer Services", None, None, "operating"), ("Real Estate", "Homebuilding", None, None, "operating"),
        ("Real Estate", "Building operators", None, None, "reits"), ("Real Estate", "Trusts Except Educational", None, None, "reits"), ("Finance", "Insurance Agents, Brokers & Service", None, None, "insurers"),
        ("Finance", "Investment Managers", None, None, "capital_markets"), ("Technology", "Real Estate Investment Trusts", None, None, "operating"), (None, None, None, None, "operating"),
        ("Health Care", "Biotechnology", None, None, "pre_revenue"), ("Health Care", "Medicinal Chemicals", None, None, "pre_revenue"), ("Technology", "Software", None, None, "operating"),
    ]
    df = spark.createDataFrame(rows, "sector string, industry string, nii double, assets double, want string")
    none = F.lit(None).cast("double")
    seg = classify.segment(F.col("sector"), F.col("industry"), none, F.col("nii"), F.col("assets"), F.lit(False))
    assert [r.got for r in df.withColumn("got", seg).collect()] == [r[-1] for r in rows]
    ask = lambda sector, industry, revenue, fund, **kw: spark.range(1).select(classify.segment(F.lit(sector), F.lit(industry), F.lit(revenue), none, none, F.lit(fund), **kw)).first()[0]
    assert ask("Health Care", "Biotechnology", 1e6, False) == "pre_revenue" and ask("Health Care", "Biotechnology", 5e9, False) == "operating"
    assert ask("Finance", "Finance: Consumer Services", 1e9, True) == "banks" and ask("Finance", "Finance: Consumer Services", 1e9, False, evidence=False) == "banks"
    assert spark.range(1).select(classify.peer_group(F.lit("operating"), F.lit(None).cast("string"), F.lit(""), F.lit(1.0))).first()[0] is None


def test_common_stock(spark):
    names = {
        "Acme Common Stock": True, "Acme Warrant": False, "Acme Warrants Common Stock": True, "Acme 5% Preferred Common Stock": False, "Acme Acquisition Corp Common Stock": False, "Acme Trust Common Stock": False,
        "Acme American Depositary Shares": False, "Acme Bond Index Portfolio": False, "Acme Capital Stock": False, "Acme Class B Ordinary Shares": True, "Acme": False, None: False,
    }
    df = spark.createDataFrame(list(names.items()), "name string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", classify.is_common_stock("name")).collect())


def test_ranks_by_slices_equal_a_window(spark):
    import random

    rng = random.Random(4)
    rows = [(k, rng.choice("ab"), rng.choice(["p", "q", None]), rng.choice([None, 0.0, 100.0, round(rng.uniform(0, 100), 2), 50.05]), rng.choice([None, 1.0, 2.0])) for k in range(600)]
    df = spark.createDataFrame(rows, "entity long, segment string, peer string, composite double, market_cap double")
    got = {r.entity: (r.rank, r.peer_rank, r.peer_size) for r in score.with_peer_decile(score.with_rank(df)).collect()}
    order = lambda r: (r[3] is None, -(r[3] or 0), r[4] is None, -(r[4] or 0), r[0])
    for r in rows:
        ahead = lambda same: 1 + sum(order(x) < order(r) for x in rows if same(x))
        peers = [x for x in rows if x[1:3] == r[1:3]]
        want = (ahead(lambda x: x[1] == r[1]), *((None, None) if r[2] is None else (ahead(lambda x: x[1:3] == r[1:3]), len(peers))))
        assert got[r[0]] == want


def test_chain_links(spark):
    cols = "month string, entity string, price double, prior_price double"
    rows = [("2026-01", "A", 100.0, None), ("2026-02", "A", 98.0, 100.0), ("2026-03", "A", 15.0, 14.7), ("2026-01", "B", 10.0, None), ("2026-03", "B", 12.0, 11.0), ("2026-01", "C", 5.0, None), ("2026-02", "C", 6.0, None), ("2026-03", "C", 7.0, 6.0)]
    got = {(r.month, r.entity): r.price_adj for r in panel.chain_linked(spark.createDataFrame(rows, cols)).collect()}
    assert [got[m, "A"] for m in ("2026-01", "2026-02", "2026-03")] == [15.0, 14.7, 15.0]
    assert got["2026-01", "B"] is None and got["2026-03", "B"] == 12.0  # a month is missing
    assert got["2026-01", "C"] is None and got["2026-02", "C"] == 6.0  # a link is missing


def history(spark, months=16, n=60):
    rows = [(f"{2025 + m // 12}-{m % 12 + 1:02d}", f"E{t:02d}", 100.0 - t, 100 * (1 + 0.01 * (n - t) * m)) for m in range(months) for t in range(n)]
    return spark.createDataFrame(rows, "month string, entity string, composite double, price_adj double")


def test_forward_deciles(spark):
    buckets = panel.score_deciles(panel.forward_returns(history(spark), 3))
    r = panel.decile_verdict(buckets).first()
    assert panel.decile_means(buckets).count() == 10 and r.monotonic and r.interpretable and r.observations == 13 and r.top_spread > 0
    assert panel.score_deciles(panel.forward_returns(history(spark, n=20), 3)).isEmpty()


def test_deciles_of_rows_that_come_in_another_order_each_time(spark):
    def mixed(batches):
        whole = pa.Table.from_batches(batches)
        yield from whole.take(pa.array(np.random.default_rng().permutation(len(whole)))).combine_chunks().to_batches()

    n = 300_000
    value = (F.col("id") * 48271 % 2147483647).cast("double").alias("composite")
    rows = spark.range(n, numPartitions=2).select(F.lit("2024-01").alias("month"), F.col("id").alias("entity"), value, F.lit(0.0).alias("fwd"))
    spark.conf.set("spark.sql.exchange.reuse", "false")  # as on a cluster, where blocks arrive in another order at each reading
    try:
        got = panel.score_deciles(rows.mapInArrow(mixed, rows.schema)).select("entity", "bucket").toPandas()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    best = sorted(range(n), key=lambda i: (-(i * 48271 % 2147483647), i))
    assert len(got) == n and dict(zip(got.entity, got.bucket)) == {e: k * 10 // n + 1 for k, e in enumerate(best)}


def test_exits_and_drift(spark):
    cols = "entity string, name string, sector string, segment string, rank long"
    prior = spark.createDataFrame([(e, e, "s", "t", k + 1) for k, e in enumerate("abcdefg")], cols)
    now = prior.where("entity = 'a'")
    src = lambda ids: spark.createDataFrame([(e, f"why {e}") for e in ids], "entity string, reason string")
    sources = list(zip(panel.EXIT_KINDS, map(src, ["bc", "cd", "e", "f", "g"]), strict=False))
    got = {r.entity: r.kind for r in panel.exits(prior, now, sources).collect()}
    assert got == {"b": "excluded", "c": "excluded", "d": "insufficient_data", "e": "share_class", "f": "market_cap_floor", "g": "no_sec_match"}
    lost = spark.createDataFrame([], "economic boolean")
    status = lambda a, b: panel.drift_report(a, b, lost, prior.limit(0), prior.limit(0)).first().status
    assert status(prior, None) == "baseline" and status(prior, prior) == "ok" and status(now, prior) == "block"


def test_portfolio(spark):
    universe = spark.createDataFrame([("A", "Tech", 10.0), ("B", "Tech", 6.0), ("C", "Energy", -4.0), ("D", "Energy", -6.0)], "entity string, sector string, change double")
    ts = lambda d: dt.datetime(2026, 1, d)
    watch = spark.createDataFrame([("A", ts(1), None), ("C", ts(1), ts(5)), ("D", ts(6), None)], "entity string, added_at timestamp, removed_at timestamp")
    at = spark.createDataFrame([(e, ts(5)) for e in "ABCD"], "entity string, instant timestamp")
    held = screen.held_at(watch, at)
    assert {r.entity for r in held.collect()} == {"A"}
    r = screen.portfolio_summary(held, universe).first()
    assert (r.mean_change, r.universe_mean, r.spread, r.sector_spread, r.n_held) == (10.0, 1.5, 8.5, 2.0, 1)


def test_screen_and_search(spark):
    rows = spark.createDataFrame([("AB", "Alpha", "Tech", 1.0, 80.0, 1), ("ABC", "Beta AB", None, None, 60.0, 2), ("X", "about", "Tech", 2.0, None, None)], "entity string, name string, sector string, change double, composite double, decile int")
    ids = lambda df: [r.entity for r in df.collect()]
    assert ids(screen.screen(rows, min_change=0.5, min_composite=1.0)) == ["AB"]
    assert ids(screen.screen(rows, sectors=[screen.NO_SECTOR])) == ["ABC"]
    assert ids(screen.top_decile(rows)) == ["AB"] and len(ids(screen.top_decile(rows, "b"))) == 3
    assert ids(screen.sorted_by(rows, "score")) == ["AB", "ABC", "X"]
    found = screen.cross_search(rows.withColumn("segment", F.lit("s")), rows.limit(0), "ab", "other")
    assert ids(found) == ["AB", "ABC", "X"]


def test_metric_record():
    assert Metric("k", "quality").segments == ()


def test_stability_in_blocks_equals_a_window_over_every_weighting(spark, monkeypatch):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from cohortal.functions import stats
    from cohortal.functions.spec import weight_vectors
    from cohortal.plans import sweep

    monkeypatch.setattr(sweep, "BLOCK", 7)
    rnd, rows = random.Random(3), []
    for segment, n in (("s", 40), ("t", 15), ("u", 1)):
        for k in range(n):
            few = rnd.random() < 0.4
            values = [None if rnd.random() < 0.15 else float(rnd.choice([0, 50, 50.1, 100])) if few else rnd.randrange(1001) / 10 for _ in FACTORS]
            rows.append((f"{segment}{k}", segment, k + 1, *([None] * 4 if k == 3 else [0.0] * 4 if k in (4, 5) else values)))
    scored = spark.createDataFrame(rows, "entity string, segment string, rank long, " + ", ".join(f"{f} double" for f in FACTORS))
    made = score.rank_stability(scored)
    value = stats.weighted_composite({f: f for f in FACTORS}, {f: F.col(f"w_{f}") for f in FACTORS})
    tried = scored.crossJoin(weight_vectors(spark)).withColumn("c", F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(-1.0)))
    placed = tried.withColumn("r", F.row_number().over(Window.partitionBy("segment", "vector").orderBy(F.desc("c"), "rank")))
    want = placed.groupBy("entity", "segment").agg(F.min("r"), F.max("r"), F.floor(F.median("r")))
    told = lambda df: sorted(tuple(r)[:5] for r in df.collect())
    assert told(made) == told(want)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()  # no row for each entity and weighting
