"""Plan-shape checks on the real test tables (sf0.001)."""

import re
from collections import Counter

import pytest
from pyspark.sql import DataFrameWriter

SF = "/root/testdata/sf0.001"


def _plan(df):
    """The executed plan; of an adaptive plan that ran, the final one."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _final_plan(df):
    """The plan of a frame that a writer has just taken (planned once more: the
    same scans)."""
    return _plan(df)


def test_date_bounds_push_to_scan(spark):
    from panelcast.sources.views import daily_ship
    plan = _plan(daily_ship(spark, SF, "1996-01-01", "1997-12-31"))
    assert "PushedFilters" in plan and "l_shipdate" in plan.split("PushedFilters")[1][:300]


def test_scan_prunes_columns(spark):
    from panelcast.sources.views import monthly_orders
    plan = _plan(monthly_orders(spark, SF))
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "o_custkey" not in schema and "o_totalprice" in schema


#: Landed tables that a query reads, each exactly once.
READS = {
    "corr_rank": {"orders": 1}, "target_join": {"orders": 1}, "feature_matrix": {"orders": 1},
    "panel_union": {"orders": 1, "customer": 1, "nation": 1, "lineitem": 1},
    "nested_export": {"orders": 1, "customer": 1, "nation": 1, "lineitem": 1},
    "eval_metrics": {"lineitem": 1}, "resid_autocorr": {"lineitem": 1}, "walk_forward_ar": {"lineitem": 1},
    "expanding_cv_ar": {"lineitem": 1}, "describe_quartiles": {"lineitem": 1}, "winsorize": {"lineitem": 1},
    "decompose": {"lineitem": 1}, "spread": {"orders": 1, "customer": 1}, "full_join_pair": {"orders": 1, "customer": 1},
}


@pytest.mark.parametrize("name", sorted(READS))
def test_landed_tables_are_read_once(spark, name, tmp_path):
    """All plans that a query runs, while it is built and when its result is
    taken, together scan each landed table once."""
    from __spark_entry__ import queries
    found = []
    plain = DataFrameWriter.parquet

    def noted(self, path, *a, **k):
        out = plain(self, path, *a, **k)
        found.append(_final_plan(self._df))
        return out
    DataFrameWriter.parquet = noted
    try:
        df = queries()[name](spark, SF)
        df.collect()
        found.append(_plan(df))
    finally:
        DataFrameWriter.parquet = plain
    scans = Counter(re.findall(r"sf0\.001/(\w+)\.parquet", "\n".join(found)))
    assert scans == READS[name]


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["entity_id", "rank", "variable", "correlation"]


def test_no_single_partition_cartesian_or_nested_loop_plans(spark):
    """Every registered query of the library (model fits aside) plans without a single
    partition exchange, cartesian product or nested-loop join."""
    from __spark_entry__ import REGISTRY, queries
    skip = {"forest_fit", "top_importance", "model_compare", "lasso_fit", "gbt_fit", "stream_hourly", "stream_state_hourly", "model_table",
            "best_model", "metrics_long", "importance_total", "forest_shape", "gbt_shape", "lasso_shape"}
    bad = {}
    for name in set(REGISTRY) - skip:
        fn = queries()[name]
        plan = _plan(fn(spark, SF))
        flags = [k for k in ("SinglePartition", "CartesianProduct", "BroadcastNestedLoopJoin") if k in plan]
        if flags:
            bad[name] = flags
    assert bad == {}
