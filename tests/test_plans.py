"""Catalogue checks: SQL twins on the small tables, and plan shapes."""

import os

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    problem, _, _ = compare(lambda *_: df, oracle_sql().get(name), spark, con, SF)
    assert problem is None


def test_entry(spark):
    assert entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    text = plan(queries()["heatmap_data"](spark, SF))
    assert "l_extendedprice" in text and "l_tax" not in text and "l_orderkey" not in text


def test_comparisons_scan_once(spark):
    spark.catalog.clearCache()  # a kept plan would show its own scan
    once = ("paired_delta", "delta_ci", "energy_matrix", "pct_change_matrix", "best_variant", "stats_by_benchmark",
            "stats_by_variant", "stats_by_benchmark_variant", "stats_vs_baseline", "table2_by_variant", "overall_stats")
    for name in once:
        assert plan(queries()[name](spark, SF)).count("FileScan parquet") == 1
