"""What is moved when revenue is made, attributed and joined with the customers; results as by hand."""

import datetime as dt
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql.types import DecimalType

from recurring_metrics.operators.revenue import attribute_revenue, categorize_revenue
from recurring_metrics.plans.summary import monthly_summary
from recurring_metrics.sources import star
from tests.test_revenue import tables as summary_tables
from tests.test_roll_up import nodes

JAN, FEB = dt.date(2024, 1, 1), dt.date(2024, 2, 1)


def optimized(df):
    return list(nodes(df._jdf.queryExecution().optimizedPlan()))


def inputs(join):
    """Names and types of a join's left rows."""
    output = join.left().output()
    return [(output.apply(i).name(), output.apply(i).dataType().simpleString()) for i in range(output.size())]


def test_amounts_at_the_customers_fit_eighteen_digits(make):
    """Before, sums of 22 digits met there; such amounts are kept as byte arrays in every row."""
    made = monthly_summary(summary_tables(make), ["segment", "region"])
    joins = [n for n in optimized(made) if n.nodeName() == "Join" and "_part" in dict(inputs(n))]
    amounts = [t for n in joins for _, t in inputs(n) if t.startswith("decimal")]
    assert len(amounts) == 3
    assert all(DecimalType(*map(int, t[8:-1].split(","))).precision <= 18 for t in amounts)


def test_rows_with_customers_are_moved_once_for_the_attribution(make):
    """Before, they were summed by customer, subscription and month first, at the price of a shuffle of their own."""
    t = summary_tables(make)
    with_customers = optimized(categorize_revenue(t["fact_revenue"], t["fact_subscription"]))
    assert not any(n.nodeName() == "Aggregate" for n in with_customers)
    company = optimized(categorize_revenue(t["fact_revenue"], t["fact_subscription"], by_customer=False))
    assert any(n.nodeName() == "Aggregate" for n in company)


def test_first_subscriptions_of_two_customers_and_of_a_hot_one(make):
    """A repeated subscription that is first for two customers counts for both, as in any join."""
    subs = make.subscriptions(
        ("S1", "C1", "2024-01-05", None, 1), ("S1", "C2", "2024-01-05", None, 1), ("S2", "C3", "2024-01-05", None, 1),
        ("S3", "C3", "2024-02-05", None, 1), (None, "C4", "2024-02-05", None, 1),
    )
    revenue = make.revenue(
        *[("C3", "S2", "2024-01-31", i, "New") for i in range(200)],
        *[("C1", "S1", "2024-02-01", 3, kind) for kind in ("New", "Recurring", None)],
        *[(None, None, "2024-01-01", i, "New") for i in range(50)],
        ("C3", "S3", "2024-02-01", 7, "New"), ("C4", None, "2024-02-01", 8, "New"), ("C1", "S1", None, 9, "New"),
    )
    got = {(r.customer_id, r.month, r.category): float(r.net_revenue) for r in attribute_revenue(revenue, subs).collect()}
    assert got == {
        ("C3", JAN, "new"): 19900.0,
        ("C1", FEB, "new"): 6.0,
        ("C1", FEB, "renewal"): 6.0,
        (None, JAN, "expansion"): 1225.0,
        ("C3", FEB, "expansion"): 7.0,
        ("C4", FEB, "expansion"): 8.0,
    }


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Lines of an order of two months, of an order listed twice, of no order, without an order, without a day."""
    path = str(tmp_path_factory.mktemp("star"))
    at = lambda d: None if d is None else dt.datetime.fromisoformat(d)
    lines = [
        (1, 1, 100.0, 0.1, 0.05, "R", "2024-01-20"), (1, 2, 10.0, None, 0.05, "N", "2024-02-01"),
        (2, 1, 10.0, 0.0, None, "R", "2024-02-02"), (3, 1, 10.0, 0.0, 0.0, None, "2024-02-03"),
        (None, 1, 5.0, 0.0, 0.0, "N", "2024-01-04"), (1, 3, 1.0, 0.0, 0.0, "N", None),
    ]
    spark.createDataFrame(
        [(*r[:-1], at(r[-1])) for r in lines],
        "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp",
    ).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 8), (2, 8), (None, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    return path


def test_line_items_as_revenue(spark, folder):
    got = Counter(
        (r.revenue_id, r.customer_id, r.net_revenue, r.revenue_type) for r in star.revenue(spark, folder).collect()
    )
    assert got == Counter(
        [
            ("1-1", 7, Decimal("85.00"), "New"),
            ("1-2", 7, None, "Recurring"),
            ("2-1", 8, None, "New"),
            ("2-1", 8, None, "New"),
            ("3-1", None, Decimal("10.00"), "Recurring"),
            ("1", None, Decimal("5.00"), "Recurring"),
            ("1-3", 7, Decimal("1.00"), "Recurring"),
        ]
    )


def test_only_amounts_that_are_read_are_moved(spark, folder):
    """Before, price, discount, tax and the return flag of every line went into the join with the orders."""
    read = star.revenue(spark, folder).select("customer_id", "revenue_date", "net_revenue", "revenue_type")
    joins = [n for n in optimized(read) if n.nodeName() == "Join" and "net_revenue" in dict(inputs(n))]
    assert [[c for c, _ in inputs(n)] for n in joins] == [["subscription_id", "revenue_date", "net_revenue"]]
