"""Plan-shape checks: the scale properties the design relies on."""

import os

import pytest

from panelcast.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_aggregate_partially_before_the_shuffle_and_prune_the_scan(spark):
    plan = _plan(catalog.range_slice(spark, SF))
    assert plan.index("partial_max_by") > plan.index("Exchange hashpartitioning(ticker")
    assert "SortAggregate" not in plan  # decimal order key keeps the hash path
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    # six of lineitem's eleven columns are read
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "l_shipdate" in ln][0]
    assert not any(c in scan for c in ("l_discount", "l_tax", "l_returnflag", "l_linestatus"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_feature_windows_share_one_spec_and_partition_by_ticker(spark):
    df = catalog.feature_table(spark, SF)
    df.collect()
    plan = _plan(df)
    final = plan.split("Initial Plan")[0]
    assert final.count("Window [") == 1
    assert "windowspecdefinition(ticker" in final


def test_ks_cumulative_windows_are_split_by_bucket(spark):
    plan = _plan(catalog.ks_drift_statistic(spark, SF))
    assert "windowspecdefinition(series_id#" in plan
    assert "hashpartitioning(series_id" in plan
    # the running sums over values are partitioned by (series, bucket)
    assert "Exchange hashpartitioning(series_id" in plan and ", bucket#" in plan
    assert "partial_percentile_approx" in plan


def test_no_cross_products_in_any_sql_checked_query(spark):
    import __spark_entry__ as entry
    for name in oracle.SQL:
        if name in ("streaming_monthly_bars", "streaming_drift_updates"):
            continue
        plan = _plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name", ["forward_fill", "back_fill", "null_counts", "drop_missing", "align_asof",
                                  "feature_table_backfilled", "feature_table", "correlation_matrix"])
def test_trades_are_read_once(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF)).split("Initial Plan")[0]
    assert sum("FileScan parquet" in ln and "l_shipdate" in ln for ln in plan.splitlines()) == 1
