"""Every registered query against its DuckDB oracle on sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SQL = {n: E.oracle(n) for n in E.REGISTRY if E.oracle(n)}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    rel = con.sql(SQL[name])
    assert sdf.columns == list(rel.columns)
    s = sorted(tuple(_norm(v) for v in r) for r in sdf.collect())
    d = sorted(tuple(_norm(v) for v in r) for r in rel.fetchall())
    assert s == d


#: Queries without SQL, and the test that checks each of them.
TESTED_ELSEWHERE = {
    "forest_fit": "test_comparison.py::test_forest_of_unlimited_depth_is_the_recursive_one",
    "gbt_fit": "test_comparison.py::test_pooled_models_beat_the_mean_on_train",
    "lasso_fit": "test_comparison.py::test_lasso_meets_its_optimality_conditions",
    "top_importance": "test_comparison.py::test_importances_per_entity_sum_to_one",
    "lasso_entities": "test_selection.py::test_lasso_meets_its_optimality_conditions_per_entity",
    "model_compare": "test_comparison.py::test_comparison_against_numpy",
    "model_table": "test_comparison.py::test_model_table_has_a_row_with_a_reason_for_every_pair",
    "best_model": "test_comparison.py::test_best_model_is_the_smallest_test_rmse",
    "metrics_long": "test_comparison.py::test_comparison_against_numpy",
}


def test_every_query_without_sql_has_a_test_of_its_own():
    assert set(E.REGISTRY) - set(SQL) == set(TESTED_ELSEWHERE)
    here = os.path.dirname(os.path.abspath(__file__))
    for where in TESTED_ELSEWHERE.values():
        file, name = where.split("::")
        assert f"def {name}(" in open(os.path.join(here, file)).read()
