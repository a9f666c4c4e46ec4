"""Filters, the filtered monthly series, KPIs and percent changes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recurring_metrics.functions import numbers
from recurring_metrics.operators.filters import (
    DashboardFilter,
    apply_filters,
    filter_options,
    tier_catalog,
)
from recurring_metrics.plans import dashboard
from recurring_metrics.plans.summary import monthly_summary
from tests.conftest import rows
from tests.test_revenue import tables as summary_tables

YEAR = DashboardFilter(dt.date(2024, 1, 1), dt.date(2024, 12, 1))


def tables(make):
    return {
        "dim_customer": make.customers(("C1", "SMB", "EU"), ("C2", "Startup", "US")),
        "dim_product_plan": make.plans(("P1", "Core"), ("P2", "Add-on")),
        "fact_subscription": make.subscriptions(
            ("S1", "C1", "2023-01-05", None, 10, "P1"),
            ("S2", "C1", "2024-02-05", "2024-12-31", 5, "P2"),
            ("S3", "C2", "2024-03-05", None, 7, "P1"),
            ("S4", "C2", "2024-03-05", None, 7, None),
            ("S5", "C9", "2024-03-05", None, 7, "P1"),
        ),
        "fact_revenue": make.revenue(
            ("C1", "S1", "2024-02-10", 10, "Recurring"),
            ("C1", "S2", "2024-02-29", 5, "New"),
            ("C2", "S3", "2024-03-31", 7, "New"),
            ("C2", "S4", "2024-03-31", 100, "New"),
            ("C9", "S5", "2024-03-31", 100, "New"),
            ("C1", "S9", "2024-03-31", 100, "New"),
        ),
        "fact_churn": make.churn(("C1", "S2", "2024-12-31", 5)),
    }


def test_unmatched_facts_drop_out_even_without_a_choice(make):
    got = apply_filters(tables(make), YEAR)
    assert rows(got["fact_subscription"], "subscription_id") == [("S1",), ("S2",), ("S3",)]
    assert rows(got["fact_revenue"], "subscription_id") == [("S1",), ("S2",), ("S3",)]
    assert rows(got["fact_churn"], "subscription_id") == [("S2",)]


def test_dates_filter_facts_to_the_last_day_but_not_subscriptions(make):
    choice = DashboardFilter(dt.date(2024, 2, 1), dt.date(2024, 2, 1))
    got = apply_filters(tables(make), choice)
    assert rows(got["fact_revenue"], "subscription_id") == [("S1",), ("S2",)]
    assert got["fact_churn"].count() == 0
    assert got["fact_subscription"].count() == 3


def test_time_of_day_on_the_last_day_is_inside(spark, make):
    t = tables(make)
    late = t["fact_revenue"].withColumn(
        "revenue_date", F.expr("timestamp(revenue_date) + interval 23 hours")
    )
    got = apply_filters({**t, "fact_revenue": late}, DashboardFilter(dt.date(2024, 3, 1), dt.date(2024, 3, 1)))
    assert rows(got["fact_revenue"], "subscription_id") == [("S3",)]


def test_a_filter_can_turn_expansion_into_new(make):
    t = tables(make)

    def february(choice):
        series = dashboard.monthly_series(dashboard.select_dashboard(t, choice), choice)
        return series.where("month = '2024-02-01'").first()

    assert (february(YEAR).new, february(YEAR).expansion) == (0.0, 5.0)
    only = DashboardFilter(YEAR.start_month, YEAR.end_month, families=("Add-on",))
    assert (february(only).new, february(only).expansion) == (5.0, 0.0)


def test_segment_and_region_choices_combine(make):
    choice = DashboardFilter(YEAR.start_month, YEAR.end_month, ("SMB",), ("US",))
    got = apply_filters(tables(make), choice)
    assert got["fact_subscription"].count() == 0 and got["dim_customer"].count() == 0


def test_kpis_sum_or_take_the_last_month(make):
    selection = dashboard.select_dashboard(tables(make), YEAR)
    series = dashboard.monthly_series(selection, YEAR)
    assert series.count() == 12
    assert dashboard.kpi_summary(series).first().asDict() == {
        "total_revenue": 22.0, "current_mrr": 22.0, "current_arr": 264.0, "active_customers": 2,
        "new_customers": 1, "churned_customers": 0, "churned_revenue": 5.0,
    }
    empty = dashboard.kpi_summary(series.where("false")).first()
    assert set(empty.asDict().values()) == {0}
    assert rows(dashboard.revenue_by_segment(selection)) == [("SMB", 15.0), ("Startup", 7.0)]
    assert [tuple(r) for r in dashboard.revenue_by_product(selection).collect()] == [
        ("Core", 17.0), ("Add-on", 5.0),
    ]


def test_unfiltered_series_equals_the_summary(make):
    t = summary_tables(make)
    t["dim_product_plan"] = make.plans(("P1", "Core"))
    choice = DashboardFilter(dt.date(2024, 1, 1), dt.date(2024, 4, 1))
    series = dashboard.monthly_series(dashboard.select_dashboard(t, choice), choice)
    names = {"new": "new_revenue", "expansion": "expansion_revenue", "renewal": "renewal_revenue",
             "churned_revenue": "churn_revenue"}
    assert rows(series) == rows(monthly_summary(t), *[names.get(c, c) for c in series.columns])


def test_months_are_first_days():
    with pytest.raises(ValueError, match="first day"):
        DashboardFilter(dt.date(2024, 1, 2), dt.date(2024, 2, 1))


def test_kpi_trend_badges(spark, make):
    measures = list(dashboard.GOOD_IS_UP)
    data = [
        (dt.date(2024, 1, 1), 9.0, 9.0, 9.0, 9, 9, 9, 9.0),
        (dt.date(2024, 2, 1), 100.0, -50.0, 0.0, 10, 10000, 4, 10.0),
        (dt.date(2024, 3, 1), 110.0, -25.0, 5.0, 9, 10001, 2, 12.0),
    ]
    series = spark.createDataFrame(data, ["month", *measures])
    got = {r.kpi: (r.pct_change, r.trend) for r in dashboard.kpi_trends(series).collect()}
    assert got["total_revenue"] == (10.0, "positive")
    assert got["mrr"] == (50.0, "positive")
    assert got["arr"] == (None, None)
    assert got["active_customers"] == (-10.0, "negative")
    assert got["new_customers"][1] == "neutral"
    assert got["churned_customers"] == (-50.0, "positive")
    assert got["churned_revenue"] == (20.0, "negative")
    single = dashboard.kpi_trends(series.limit(1)).collect()
    assert all(r.pct_change is None and r.trend is None for r in single)


def test_three_percent_changes(spark):
    df = spark.createDataFrame([(1.0, -2.0), (5.0, 0.0), (3.0, 2.0)], "new double, old double")
    new, old = F.col("new"), F.col("old")
    got = df.select(
        numbers.growth(new, old), numbers.percent_change(new, old),
        numbers.percent_change_abs(new, old),
        numbers.classify_driver(numbers.percent_change(new, old)),
    )
    assert [tuple(r) for r in got.collect()] == [
        (-1.5, -150.0, 150.0, "down"), (None, None, None, "n/a"), (0.5, 50.0, 50.0, "up"),
    ]


def test_options_and_tiers(spark, make):
    t = tables(make)
    customers = t["dim_customer"].union(spark.createDataFrame([("C7", None, None)], t["dim_customer"].schema))
    customers = customers.withColumn("industry", F.when(F.col("customer_id") != "C7", "Retail"))
    assert rows(filter_options(customers, t["dim_product_plan"], t["fact_revenue"])) == [
        ("industry", "Retail"), ("max_month", "2024-03-01"), ("min_month", "2024-02-01"),
        ("product_family", "Add-on"), ("product_family", "Core"),
        ("region", "EU"), ("region", "US"), ("segment", "SMB"), ("segment", "Startup"),
    ]
    plans = spark.createDataFrame(
        [("Pro", 2), ("Pro", 2), ("Basic", 1), ("Odd", None)], "plan_tier_name string, plan_tier_order int"
    )
    assert [r.plan_tier_name for r in tier_catalog(plans).collect()] == ["Basic", "Pro", "Odd"]
