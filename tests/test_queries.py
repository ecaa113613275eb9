"""Registered queries against their SQL, over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from millrace import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["temporal_entropy_over_time", "temporal_rate", "spatial_sum_without", "spatial_topk", "spatial_of_temporal_avg_quantile", "binary_nested", "range_rate", "range_quantile", "window_sliding_sum", "summary_merge_rate", "delta_set_added_removed", "retention_circular", "sql_nested", "filter_nre", "stream_tumbling", "stream_closed_windows", "fallback_limit_by", "quantile_summary", "window_sliding_quantile", "range_quantile_summary", "hll_distinct", "cms_heap_topk", "hydra_kll", "planned_sum", "planned_quantile", "stream_quantile", "stream_delta_sets", "retention_read_based", "topk_avg", "source_json", "source_csv", "filter_normal_form", "stream_late_forwarded"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want, key=key)


def test_flagship_has_a_row_per_type(spark):
    assert entry.entry(spark).count() == 5


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
