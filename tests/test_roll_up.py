"""The roll-up of blocks with customers: narrow rows at the one join, results as by hand."""

import datetime as dt
from decimal import Decimal

import pytest

from recurring_metrics.operators.calendar import ONCE_PER_CUSTOMER, fixed_spine, roll_up
from recurring_metrics.plans.summary import monthly_summary
from tests.test_revenue import tables as summary_tables

MONTHS = [dt.date(2024, m, 1) for m in (1, 2, 3)]
KEYS = ("segment", "region")


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_rows_at_the_customers_are_as_wide_as_one_block(make):
    """Before, a row held the measures of all blocks: 20 columns, nearly all of them empty."""
    optimized = monthly_summary(summary_tables(make), list(KEYS))._jdf.queryExecution().optimizedPlan()
    joins = [
        n for n in nodes(optimized)
        if n.nodeName() == "Join" and n.joinType().toString() == "Inner" and "customer_id" in n.condition().toString()
    ]
    assert [n.left().output().size() for n in joins] == [4 + 9]


def test_only_what_is_counted_once_is_summed_by_customer(make):
    """An aggregate by customer and month has to hold a measure that is counted once."""
    optimized = monthly_summary(summary_tables(make), list(KEYS))._jdf.queryExecution().optimizedPlan()
    by_customer = [
        n.toString() for n in nodes(optimized)
        if n.nodeName() == "Aggregate" and [e.toString().split("#")[0] for e in map(n.groupingExpressions().apply, range(n.groupingExpressions().size()))] == ["customer_id", "month"]
    ]
    assert by_customer and all(ONCE_PER_CUSTOMER[0] in text.splitlines()[0] for text in by_customer)


@pytest.fixture(scope="module")
def blocks(spark):
    """Three blocks: a decimal and a flag counted once, two decimals of other scales, a double."""
    usage = [("A", MONTHS[i % 2], 1, Decimal(i)) for i in range(40)] + [("B", MONTHS[0], 1, None), (None, MONTHS[0], 1, Decimal(9))]
    deals = [("A", MONTHS[i % 3], Decimal("0.25"), Decimal("1.1234")) for i in range(3000)] + [("B", None, Decimal(1), Decimal(1)), ("C", MONTHS[2], Decimal(7), None)]
    scores = [("B", MONTHS[1], 0.5, 3), ("D", MONTHS[1], 8.0, 8)]
    return [
        spark.createDataFrame(usage, "customer_id string, month date, usage_customer_count long, paid decimal(12,2)"),
        spark.createDataFrame(deals, "customer_id string, month date, small decimal(12,2), fine decimal(17,4)"),
        spark.createDataFrame(scores, "customer_id string, month date, score double, paid int"),
    ]


def test_blocks_of_any_type_and_a_customer_with_nearly_all_rows(spark, make, blocks):
    customers = make.customers(("A", "S", "R"), ("B", "S", "R"), ("C", "T", "R"), ("C", "T", "R"), ("D", None, "R"))
    spine = fixed_spine(spark, MONTHS[0], MONTHS[2], customers, KEYS)
    got = {
        (r.segment, r.month.month): (r.usage_customer_count, float(r.paid), float(r.small), float(r.fine), r.score)
        for r in roll_up(blocks, spine, customers, KEYS).collect()
    }
    assert got == {
        ("S", 1): (2, 380.0, 250.0, 1123.4, 0.0),
        ("S", 2): (1, 403.0, 250.0, 1123.4, 0.5),
        ("S", 3): (0, 0.0, 250.0, 1123.4, 0.0),
        ("T", 1): (0, 0.0, 0.0, 0.0, 0.0),
        ("T", 2): (0, 0.0, 0.0, 0.0, 0.0),
        # a customer listed twice counts twice, as in any join
        ("T", 3): (0, 0.0, 14.0, 0.0, 0.0),
    }


def test_blocks_without_series(spark, blocks):
    got = {
        r.month.month: (r.usage_customer_count, float(r.paid), float(r.small), r.score)
        for r in roll_up(blocks, fixed_spine(spark, MONTHS[0], MONTHS[2])).collect()
    }
    assert got == {1: (3, 389.0, 250.0, 0.0), 2: (1, 411.0, 250.0, 8.5), 3: (0, 0.0, 257.0, 0.0)}
