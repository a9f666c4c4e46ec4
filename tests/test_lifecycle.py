"""Customer counts, MRR snapshots and first subscriptions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from recurring_metrics.operators.calendar import fixed_spine, roll_up
from recurring_metrics.operators.lifecycle import (
    customer_changes,
    customer_lifecycle,
    first_subscriptions,
    flag_first_subscription,
    fully_churned_count,
)
from recurring_metrics.operators.snapshots import mrr_block
from tests.conftest import day, rows


def months(spark, subscriptions, first="2024-01-01", last="2024-06-01"):
    rolled = roll_up(
        [mrr_block(subscriptions), customer_changes(subscriptions).drop("customer_id")],
        fixed_spine(spark, day(first), day(last)),
    )
    return {
        r.month.month + 12 * (r.month.year - 2024): (
            float(r.mrr), r.active_customers, r.new_customers, r.churned_customers,
        )
        for r in rolled.collect()
    }


def test_end_on_last_day_counts_that_month(spark, make):
    got = months(spark, make.subscriptions(("S1", "C1", "2024-02-10", "2024-03-31", 10)))
    assert got[1] == (0, 0, 0, 0)
    assert got[2] == (10, 1, 1, 0)
    assert got[3] == (10, 1, 0, 1)
    assert got[4] == (0, 0, 0, 0)


def test_end_mid_month_is_active_but_not_in_mrr(spark, make):
    got = months(spark, make.subscriptions(("S1", "C1", "2024-02-10", "2024-03-15", 10)))
    assert got[2] == (10, 1, 1, 0)
    assert got[3] == (0, 1, 0, 1)
    assert got[4] == (0, 0, 0, 0)


def test_start_and_end_inside_one_month(spark, make):
    got = months(spark, make.subscriptions(("S1", "C1", "2024-02-10", "2024-02-20", 10)))
    assert got[2] == (0, 1, 1, 1)
    assert all(v == (0, 0, 0, 0) for m, v in got.items() if m != 2)


def test_start_equals_end_on_month_end(spark, make):
    got = months(spark, make.subscriptions(("S1", "C1", "2024-02-29", "2024-02-29", 10)))
    assert got[2] == (10, 1, 1, 1)
    assert got[3] == (0, 0, 0, 0)


def test_one_open_subscription_prevents_churn(spark, make):
    subs = make.subscriptions(
        ("S1", "C1", "2024-01-05", "2024-02-10", 10), ("S2", "C1", "2024-01-20", None, 5)
    )
    got = months(spark, subs)
    assert got[1] == (15, 1, 1, 0)
    assert got[2] == (5, 1, 0, 0)
    assert got[6] == (5, 1, 0, 0)
    assert rows(fully_churned_count(subs)) == [(0,)]


def test_both_ended_churns_in_month_of_later_end(spark, make):
    subs = make.subscriptions(
        ("S1", "C1", "2024-01-05", "2024-04-10", 10), ("S2", "C1", "2024-01-20", "2024-02-03", 5)
    )
    got = months(spark, subs)
    assert [got[m][3] for m in range(1, 7)] == [0, 0, 0, 1, 0, 0]
    assert [got[m][1] for m in range(1, 7)] == [1, 1, 1, 1, 0, 0]
    assert rows(customer_lifecycle(subs), "customer_id", "has_open", "churn_month") == [
        ("C1", False, dt.date(2024, 4, 1))
    ]


def test_gap_between_subscriptions(spark, make):
    subs = make.subscriptions(
        ("S1", "C1", "2024-01-05", "2024-02-10", 10), ("S2", "C1", "2024-05-20", None, 5)
    )
    got = months(spark, subs)
    assert [got[m][1] for m in range(1, 7)] == [1, 1, 0, 0, 1, 1]
    assert [got[m][2] for m in range(1, 7)] == [1, 0, 0, 0, 0, 0]
    assert [got[m][3] for m in range(1, 7)] == [0] * 6


def test_before_the_spine_feeds_levels_but_not_events(spark, make):
    subs = make.subscriptions(("S1", "C1", "2022-05-05", None, 7))
    assert months(spark, subs)[1] == (7, 1, 0, 0)


def test_ties_on_start_go_to_the_smaller_id(make):
    subs = make.subscriptions(
        ("S2", "C1", "2024-01-05", None, 1),
        ("S1", "C1", "2024-01-05", None, 1),
        ("S0", "C1", None, None, 1),
    )
    assert rows(first_subscriptions(subs)) == [("C1", "S1")]
    assert rows(flag_first_subscription(subs), "subscription_id", "is_first") == [
        ("S0", False), ("S1", True), ("S2", False),
    ]


def brute_force(subs, months):
    """Every subscription against every month, as a range join."""
    spine = months.select("month", F.last_day("month").alias("last"))
    live = spine.join(
        subs,
        (F.col("start_date") <= F.col("last"))
        & (F.col("end_date").isNull() | (F.col("end_date") >= F.col("month"))),
        "left",
    )
    at_end = F.col("end_date").isNull() | (F.col("end_date") >= F.col("last"))
    return live.groupBy("month").agg(
        F.coalesce(F.sum(F.when(at_end, F.col("mrr"))), F.lit(0)).cast("double").alias("mrr"),
        F.countDistinct("customer_id").alias("active_customers"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_range_join_with_one_hot_customer(spark, make, seed):
    """A third of all subscriptions belong to one customer."""
    pick = random.Random(seed)
    data = []
    for i in range(600):
        start = dt.date(2023, 6, 1) + dt.timedelta(days=pick.randrange(500))
        length = pick.choice([None, 0, 1, 10, 31, 60, pick.randrange(400)])
        end = None if length is None else start + dt.timedelta(days=length)
        if end and pick.random() < 0.3:
            end = (end.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
        customer = "HOT" if i % 3 == 0 else f"C{pick.randrange(60)}"
        data.append((f"S{i:04}", customer, start.isoformat(), end and end.isoformat(), i + 0.25))
    subs = make.subscriptions(*data)
    spine = fixed_spine(spark, dt.date(2024, 1, 1), dt.date(2025, 6, 1))
    rolled = roll_up([mrr_block(subs), customer_changes(subs).drop("customer_id")], spine)
    got = rolled.select("month", F.col("mrr").cast("double").alias("mrr"), "active_customers")
    assert rows(got) == rows(brute_force(subs, spine))
