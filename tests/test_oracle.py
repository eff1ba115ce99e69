"""Every query with a SQL twin gives the same rows as the twin, on whole tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from latelens import oracle, registry  # noqa: E402
from tests.oracle_check import compare, connect  # noqa: E402

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_twin(spark, con, name):
    problem = compare(registry.queries()[name](spark, FOLDER), con, SQL[name])
    assert problem is None, problem


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and list(rows[0].asDict()) == ["customer_state", "n", "late_pct"]


def test_only_model_queries_lack_a_twin():
    assert set(registry.queries()) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(registry.queries()) - set(SQL) == {
        "model_comparison", "scored_orders", "feature_importances", "importance_of_seller_rate"
    }
