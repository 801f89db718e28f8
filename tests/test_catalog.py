import os

import duckdb
import pytest

from cohortal import catalog, catalog_history, catalog_measures, catalog_sources  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple("" if r[k] is None else str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", ["winsorized_percentile", "peer_composite_rank", "rank_stability", "point_in_time_latest", "asof_balance", "nearest_snapshot", "chain_linked_price", "eligibility_cascade", "portfolio_summary", "segment_and_peer", "common_stock", "drift_status", "facts_to_items", "trailing_year_of_facts", "measures_trends", "facts_scan", "month_record", "share_links", "six_kinds_of_exits", "monthly_funnel", "monthly_excluded", "measure_notes", "chain_update", "chain_restated", "data_pack_subset", "company_export", "named_sorts", "decile_analysis", "regression_gap", "weight_rebalance"])
def test_query_equals_its_oracle(spark, oracle, name):
    df, want = catalog.QUERIES[name](spark, DATA), oracle.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry_point_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
