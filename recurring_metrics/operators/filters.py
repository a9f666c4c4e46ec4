"""The dashboard filter: one set of choices applied across all tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurring_metrics.functions.dates import month_floor
from recurring_metrics.operators.split_join import heavy_keys, known_keys, owned_facts


@dataclass(frozen=True)
class DashboardFilter:
    """Months from start_month to end_month inclusive; an empty list filters nothing.

    Months are given by their first day.
    """

    start_month: dt.date
    end_month: dt.date
    segments: Sequence[str] = field(default_factory=tuple)
    regions: Sequence[str] = field(default_factory=tuple)
    families: Sequence[str] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if self.start_month.day != 1 or self.end_month.day != 1:
            raise ValueError("start_month and end_month must be the first day of a month")


def _only(df: DataFrame, column: str, chosen: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isin(list(chosen))) if chosen else df


def within_months(df: DataFrame, column: str, choice: DashboardFilter) -> DataFrame:
    """Rows dated from the first day of the start month to the last of the end month."""
    day = F.col(column).cast("date")
    return df.where(day.between(F.lit(choice.start_month), F.last_day(F.lit(choice.end_month))))


def apply_filters(
    tables: Mapping[str, DataFrame], choice: DashboardFilter, split: bool = True
) -> dict[str, DataFrame]:
    """Filtered customers, plans, subscriptions, revenue and churn.

    Customers and plans restrict subscriptions, which restrict revenue and
    churn; a fact whose customer, plan or subscription is unknown drops out even
    when nothing is chosen. Dates restrict revenue and churn only. Semi-joins
    never multiply rows. With `split`, a pass over the keys of subscriptions and revenue looks
    for those that hold a large share of the rows (this runs a job each), and their rows
    are dealt to many tasks; that is of no use where the facts are summed per subscription
    and month already. A subscription churns once, so churn has no such keys.
    """
    customers = _only(tables["dim_customer"], "segment", choice.segments)
    customers = _only(customers, "region", choice.regions)
    plans = _only(tables["dim_product_plan"], "product_family", choice.families)
    customer_ids, plan_ids = customers.select("customer_id"), plans.select("plan_id")

    def heavy(df: DataFrame, *columns: str) -> dict:
        return heavy_keys(df, columns) if split else {}

    subscriptions = tables["fact_subscription"]
    parts = heavy(subscriptions, "customer_id", "plan_id")
    for ids in (customer_ids, plan_ids):
        key = ids.columns[0]
        subscriptions = known_keys(subscriptions, ids, key, parts.get(key, {}))
    subscription_ids = subscriptions.select("subscription_id")

    def facts(name: str, day: str) -> DataFrame:
        rows = within_months(tables[name], day, choice)
        if split and name == "fact_revenue":
            parts = heavy(rows, "subscription_id")["subscription_id"]
            return owned_facts(rows, customer_ids, subscriptions, parts)
        return (
            rows.join(customer_ids, "customer_id", "left_semi")
            .join(subscription_ids, "subscription_id", "left_semi")
        )

    return {
        "dim_customer": customers,
        "dim_product_plan": plans,
        "fact_subscription": subscriptions,
        "fact_revenue": facts("fact_revenue", "revenue_date"),
        "fact_churn": facts("fact_churn", "churn_date"),
    }


def filter_options(customers: DataFrame, plans: DataFrame, revenue: DataFrame) -> DataFrame:
    """Choices the filter offers: (option, value), values as text, months as dates."""

    def distinct(df: DataFrame, column: str, option: str) -> DataFrame:
        return (
            df.where(F.col(column).isNotNull())
            .select(F.lit(option).alias("option"), F.col(column).alias("value"))
            .distinct()
        )

    month = month_floor("revenue_date")
    bounds = revenue.agg(
        F.min(month).cast("string").alias("min_month"), F.max(month).cast("string").alias("max_month")
    ).unpivot([], ["min_month", "max_month"], "option", "value")
    return (
        distinct(customers, "segment", "segment")
        .unionByName(distinct(customers, "region", "region"))
        .unionByName(distinct(customers, "industry", "industry"))
        .unionByName(distinct(plans, "product_family", "product_family"))
        .unionByName(bounds)
        .orderBy("option", "value")
    )


def tier_catalog(plans: DataFrame) -> DataFrame:
    """Distinct plan tiers in tier order."""
    return (
        plans.select("plan_tier_name", "plan_tier_order")
        .dropDuplicates()
        .orderBy(F.col("plan_tier_order").asc_nulls_last(), "plan_tier_name")
    )
