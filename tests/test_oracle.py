"""Every registered query against its SQL counterpart, on the smallest sample data."""

import os

import pytest

import __spark_entry__ as contract
import check_queries
from oracle_catalog import ORACLES
from query_catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample data not present")


# Queries over all seven models; their `_window` forms are checked against SQL.
SEVEN = {
    "walk_forward", "backtest_metrics", "leaderboard", "accuracy_table", "hist_vs_predicted", "forecast_points",
    "revenue_forecast", "actual_plus_forecast", "saved_questions",
}


@pytest.fixture(scope="module")
def connection():
    return check_queries.connect(FOLDER)


def test_catalogs_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) - set(ORACLES) == {"bt_gbt", "bt_gbt_min5", "leaderboard_seven", "forecast_trees", *SEVEN}
    assert {f"{key}_window" for key in SEVEN} <= set(ORACLES)


def test_entry(spark):
    assert len(contract.entry(spark).columns) == 23


# Each of the seven-model queries repeats the fits of the two tree models; two of them stand for all.
@pytest.mark.parametrize("key", [k for k in QUERIES if k not in SEVEN - {"revenue_forecast"} and k != "leaderboard_seven"])
def test_query(spark, connection, key):
    verdict, _, rows = check_queries.compare(spark, connection, FOLDER, key)
    assert verdict in ("ok", "rows only") and rows > 0
