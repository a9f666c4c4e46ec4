"""Monthly series, KPIs and breakdowns over a filtered selection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurring_metrics.functions.numbers import classify_trend, percent_change_abs
from recurring_metrics.operators.calendar import fixed_spine, roll_up
from recurring_metrics.operators.filters import DashboardFilter, apply_filters, within_months
from recurring_metrics.operators.revenue import churn_block, compact_revenue, revenue_block
from recurring_metrics.operators.snapshots import mrr_block
from recurring_metrics.plans.summary import (
    double,
    mrr_columns,
    revenue_columns,
    status_block,
    status_columns,
)

# KPI -> whether a rise is good news.
GOOD_IS_UP = {
    "total_revenue": True,
    "mrr": True,
    "arr": True,
    "active_customers": True,
    "new_customers": True,
    "churned_customers": False,
    "churned_revenue": False,
}


def select_dashboard(tables: Mapping[str, DataFrame], choice: DashboardFilter) -> dict[str, DataFrame]:
    """The filtered selection behind one dashboard page.

    The date range goes to the scan of the revenue rows. What passes is summed
    to customer, subscription, month and type before the filter joins, which is
    exact because the filter works on whole months.
    """
    needed = ("dim_customer", "dim_product_plan", "fact_subscription", "fact_churn")
    frames = {name: tables[name] for name in needed}
    billed = within_months(tables["fact_revenue"], "revenue_date", choice)
    frames["fact_revenue"] = compact_revenue(billed)
    return apply_filters(frames, choice, split=False)


def monthly_series(selection: Mapping[str, DataFrame], choice: DashboardFilter) -> DataFrame:
    """One row per chosen month; `first` is judged among the filtered subscriptions."""
    subscriptions = selection["fact_subscription"]
    rolled = roll_up(
        [
            revenue_block(selection["fact_revenue"], subscriptions),
            churn_block(selection["fact_churn"]),
            status_block(subscriptions),
            mrr_block(subscriptions),
        ],
        fixed_spine(subscriptions.sparkSession, choice.start_month, choice.end_month),
    )
    return rolled.select(
        "month",
        *revenue_columns("{}"),
        *mrr_columns(),
        *status_columns(),
        double("churn_revenue", "churned_revenue"),
    )


def kpi_summary(series: DataFrame) -> DataFrame:
    """One row: sums over the range, and levels of its last month; zeros when empty."""

    def latest(column: str):
        return F.max_by(column, "month")

    def total(column: str):
        return F.sum(column)

    parts = {
        "total_revenue": total("total_revenue"),
        "current_mrr": latest("mrr"),
        "current_arr": latest("arr"),
        "active_customers": latest("active_customers"),
        "new_customers": total("new_customers"),
        "churned_customers": total("churned_customers"),
        "churned_revenue": total("churned_revenue"),
    }
    return series.agg(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in parts.items()])


def kpi_trends(series: DataFrame) -> DataFrame:
    """Per KPI: last and previous month, percent change, and the badge class."""
    measures = list(GOOD_IS_UP)
    by_month = Window.orderBy(F.col("month").desc())
    tail = (
        series.select("month", *[F.col(m).cast("double").alias(m) for m in measures])
        .orderBy(F.col("month").desc())
        .limit(2)
        .withColumn("position", F.row_number().over(by_month))
    )
    long = tail.unpivot(["position"], measures, "kpi", "value")
    pairs = long.groupBy("kpi").agg(
        F.max(F.when(F.col("position") == 1, F.col("value"))).alias("current_value"),
        F.max(F.when(F.col("position") == 2, F.col("value"))).alias("previous_value"),
    )
    good = F.create_map(*[F.lit(v) for pair in GOOD_IS_UP.items() for v in pair])[F.col("kpi")]
    return pairs.withColumn(
        "pct_change", percent_change_abs(F.col("current_value"), F.col("previous_value"))
    ).withColumn("trend", classify_trend(F.col("pct_change"), good))


def _ranked(df: DataFrame, key: str) -> DataFrame:
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.sum("net_revenue").cast("double").alias("net_revenue"))
        .orderBy(F.col("net_revenue").desc(), key)
    )


def revenue_by_segment(selection: Mapping[str, DataFrame]) -> DataFrame:
    """Net revenue per customer segment, largest first."""
    by_customer = selection["fact_revenue"].groupBy("customer_id").agg(
        F.sum("net_revenue").alias("net_revenue")
    )
    segment = selection["dim_customer"].select("customer_id", "segment")
    return _ranked(by_customer.join(segment, "customer_id", "left"), "segment")


def revenue_by_product(selection: Mapping[str, DataFrame]) -> DataFrame:
    """Net revenue per product family, largest first."""
    by_subscription = selection["fact_revenue"].groupBy("subscription_id").agg(
        F.sum("net_revenue").alias("net_revenue")
    )
    plan = selection["fact_subscription"].select("subscription_id", "plan_id")
    by_plan = (
        by_subscription.join(plan, "subscription_id", "left")
        .groupBy("plan_id")
        .agg(F.sum("net_revenue").alias("net_revenue"))
    )
    family = selection["dim_product_plan"].select("plan_id", "product_family")
    return _ranked(by_plan.join(family, "plan_id", "left"), "product_family")
