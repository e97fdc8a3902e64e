"""Every registered query with SQL agrees with DuckDB at the smallest scale."""

import os
import sys

import pytest

from conftest import SF

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402
from strainwise.registry import oracle_sql, queries  # noqa: E402

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, duck, name):
    assert check.compare(queries()[name](spark, SF), duck, ORACLE[name]) == ""


def test_fitted_queries_are_the_only_ones_without_sql():
    assert set(queries()) - set(ORACLE) == {
        "reg_ridge", "reg_forest", "reg_gbt", "reg_gbt_subsample", "model_comparison",
        "best_model", "feature_importance", "tree_attribution", "risk_probability", "score_roster_model", "segment_employees"}
