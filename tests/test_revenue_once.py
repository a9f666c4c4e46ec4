"""Line items become revenue from one reading of them; results as by hand."""

import datetime as dt
from collections import Counter

import pytest

from recurring_metrics.sources import star
from tests.test_roll_up import nodes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders: one of two months, one listed twice, one without a day; lines of an unknown order and of none."""
    path = str(tmp_path_factory.mktemp("star"))
    lines = [
        (1, 1, "2024-03-31"), (1, 2, "2024-02-29"), (1, 3, "2024-02-01"), (1, 3, "2024-02-01"), (1, 4, None),
        (2, 1, "2024-05-02"), (2, 2, "2023-05-02"), (3, 1, None), (4, 1, "2024-01-01"), (None, 1, "2024-01-01"),
    ]
    spark.createDataFrame(
        [(k, n, 10.0, 0.0, 0.0, "N", d and dt.datetime.fromisoformat(d)) for k, n, d in lines],
        "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp",
    ).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(
        [(1, 7), (2, 8), (2, 9), (3, None), (None, 5)], "o_orderkey long, o_custkey long"
    ).write.parquet(f"{path}/orders.parquet")
    return path


def test_line_items_are_read_and_moved_once(spark, folder):
    """Before, a second scan of all lines was summed to the orders' first months, and moved for that."""
    plan = list(nodes(star.revenue(spark, folder)._jdf.queryExecution().optimizedPlan()))
    columns = [n.output().mkString(",") for n in plan if n.children().isEmpty()]
    assert sum("l_orderkey" in c for c in columns) == 1
    assert not any(n.nodeName() == "Aggregate" for n in plan)


def test_first_months_of_orders_listed_twice_and_of_none(spark, folder):
    got = Counter((r.revenue_id, r.customer_id, r.revenue_type) for r in star.revenue(spark, folder).collect())
    assert got == Counter(
        {
            ("1-1", 7, "Recurring"): 1, ("1-2", 7, "New"): 1, ("1-3", 7, "New"): 2, ("1-4", 7, "Recurring"): 1,
            ("2-1", 8, "Recurring"): 1, ("2-1", 9, "Recurring"): 1, ("2-2", 8, "New"): 1, ("2-2", 9, "New"): 1,
            ("3-1", None, "Recurring"): 1, ("4-1", None, "Recurring"): 1, ("1", None, "Recurring"): 1,
        }
    )


def test_without_the_type_no_window_is_made(spark, folder):
    read = star.revenue(spark, folder).select("customer_id", "net_revenue")
    assert not any(n.nodeName() == "Window" for n in nodes(read._jdf.queryExecution().optimizedPlan()))
