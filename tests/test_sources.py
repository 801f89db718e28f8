import json

import pytest
from pyspark.sql import functions as F

from cohortal.functions.spec import Settings
from cohortal.sources import readers, sinks


def put(tmp_path, name, doc):
    p = tmp_path / name
    p.write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return str(p)


def test_universe(spark, tmp_path):
    row = dict.fromkeys(readers.LISTING_KEYS, "") | {"symbol": " ab ", "name": "A", "lastsale": "$1.50", "marketCap": "2,000", "volume": "x"}
    r = readers.read_universe(spark, put(tmp_path, "u.json", {"data": {"rows": [row]}})).first()
    assert (r.entity, r.last_sale, r.market_cap, r.volume, r.sector) == ("AB", 1.5, 2000.0, None, None)
    with pytest.raises(readers.SourceError):
        readers.read_universe(spark, put(tmp_path, "v.json", {"data": {"rows": [{"symbol": "x"}]}}))


def test_id_map_refuses_few(spark, tmp_path):
    path = put(tmp_path, "ids.json", "\n".join(json.dumps({"ticker": f"t{k}", "cik_str": k}) for k in range(10)))
    assert readers.read_id_map(spark, path, 10).where("entity = 'T3'").first().id == "0000000003"
    with pytest.raises(readers.SourceError):
        readers.read_id_map(spark, path)


def test_nested_facts(spark, tmp_path):
    doc = {"cik": 7, "entityName": "x", "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2024-06-30", "val": 5, "filed": "2024-08-01", "accn": "a", "form": "10-Q"}, {"start": "2024-01-01", "end": "2024-06-30", "val": 6, "filed": "2024-08-01", "accn": "a", "form": "10-Q"}]}}}}}
    rows = readers.read_facts(spark, put(tmp_path, "f.json", doc)).orderBy("seq").collect()
    assert [(r.entity, r.concept, r.unit, str(r.start), r.val) for r in rows] == [("0000000007", "Assets", "USD", "None", 5.0), ("0000000007", "Assets", "USD", "2024-01-01", 6.0)]


def test_filing_index(spark, tmp_path):
    recent = {"accessionNumber": ["1", "2", "3"], "form": ["10-K", "8-K12B", "10-Q"], "filingDate": ["2024-03-01", "2024-04-01", "2024-05-01"], "reportDate": ["2023-12-31", "", "2024-03-31"]}
    docs = spark.read.schema(readers.FILING_SCHEMA).json(put(tmp_path, "s.json", {"cik": "9", "filings": {"recent": recent}}))
    assert readers.newest_filing(docs, "2024-04-30").first().newer.form == "10-K"
    assert readers.newest_filing(docs, "2024-12-31").first().newer.form == "10-Q"
    assert readers.has_successor_notice(docs).first().successor_notice


def test_prices(spark, tmp_path):
    chart = {"chart": {"result": [{"meta": {"symbol": "ab"}, "timestamp": [86400, 172800], "indicators": {"quote": [{"close": [1.0, 2.0], "volume": [10, 20]}], "adjclose": [{"adjclose": [0.5, None]}]}, "events": {"splits": {"1": {"date": 86400, "numerator": 2, "denominator": 1}}}}]}}
    path = put(tmp_path, "p.json", chart)
    assert [(r.entity, str(r.d), r.close) for r in readers.read_prices(spark, path).collect()] == [("AB", "1970-01-02", 0.5)]
    docs = spark.read.schema(readers.CHART_SCHEMA).option("multiLine", True).json(path)
    assert readers.splits(docs).first().ratio == 2.0
    assert readers.read_csv_prices(spark, put(tmp_path, "p.csv", "Date,Close,Volume\n2024-01-02,5,7\n"), "X").first().close == 5.0
    with pytest.raises(readers.SourceError):
        readers.read_csv_prices(spark, put(tmp_path, "q.csv", "<!DOCTYPE html>"), "X")
    with pytest.raises(readers.SourceError):
        readers.provider("nope")


def test_settings():
    assert readers.load_settings('{"min_cohort": 5, "sweep": [10, 20]}') == Settings(min_cohort=5, sweep=(10, 20))
    with pytest.raises(readers.SourceError):
        readers.load_settings('{"no": 1}')
    with pytest.raises(readers.SourceError):
        readers.load_weights('{"quality": 90}')


def test_months_are_append_only(spark, tmp_path):
    path = str(tmp_path / "months")
    rows = lambda v, *months: spark.createDataFrame([(m, v) for m in months], "month string, v int")
    assert sinks.append_months(rows(1, "2024-01"), path) == ["2024-01"]
    assert sinks.append_months(rows(2, "2024-01", "2024-02"), path) == ["2024-02"]
    got = {r.month: r.v for r in readers.read_months(spark, path).collect()}
    assert got == {"2024-01": 1, "2024-02": 2}
    assert sinks.append_months(rows(3, "2024-01"), path, force=True) == ["2024-01"]
    assert {r.month: r.v for r in readers.read_months(spark, path).collect()} == {"2024-01": 3, "2024-02": 2}
    assert sinks.append_months(rows(3, "2024-03"), path, keep_history=False) == []
    assert readers.read_months(spark, path, "2024-02").count() == 1


def test_back_fill_and_equality(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, 5, "y")], "k int, v int, o string")
    extra = spark.createDataFrame([(1, 7), (2, 9)], "k int, v int")
    assert {r.k: r.v for r in sinks.back_fill(rows, extra, ["k"], "v").collect()} == {1: 7, 2: 5}
    with pytest.raises(ValueError):
        sinks.back_fill(rows, extra.unionByName(extra), ["k"], "v")
    assert sinks.same_but(rows, rows.withColumn("v", F.lit(0)), ["v"]) and not sinks.same_but(rows, rows.limit(1), ["v"])


def test_exports(spark):
    rows = spark.createDataFrame([("s", 2, "B", None, 1.0), ("s", 1, "A", "Al", 2.5)], "segment string, rank long, entity string, name string, composite double")
    assert sinks.table_text(rows).first().text == "1. A Al: 2.50\n2. B : 1.00"
    p = spark.createDataFrame([("2024-02", "A", "m", 2.0, None), ("2024-01", "A", "m", 1.0, 49.6)], "month string, entity string, metric string, raw double, pct double")
    assert sinks.trend_text(p).first().trend == "2024-01 1.00 (p50) | 2024-02 2.00"
    assert "... and 1 more" in sinks.report_markdown("t", {"s": rows}, cap=1)
    assert sinks.zip_pack({"t": rows}, "notes")[:2] == b"PK"
