"""The monthly revenue summary, for the company or for many series at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurring_metrics.functions.numbers import ratio
from recurring_metrics.operators.activity import opportunity_block, usage_block
from recurring_metrics.operators.calendar import revenue_spine, roll_up
from recurring_metrics.operators.lifecycle import customer_changes
from recurring_metrics.operators.revenue import CATEGORIES, churn_block, revenue_block, total_block
from recurring_metrics.operators.snapshots import mrr_block

Tables = Mapping[str, DataFrame]


def status_block(subscriptions: DataFrame, by_customer: bool = False) -> DataFrame:
    changes = customer_changes(subscriptions)
    return changes if by_customer else changes.drop("customer_id")


def double(column: str | Column, name: str) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return value.cast("double").alias(name)


def revenue_columns(pattern: str = "{}_revenue") -> list[Column]:
    """Total revenue, and each category under the name the pattern gives it."""
    new, expansion, renewal = (F.col(f"{c}_revenue") for c in CATEGORIES)
    return [
        double(new + expansion + renewal, "total_revenue"),
        double(new, pattern.format("new")),
        double(renewal, pattern.format("renewal")),
        double(expansion, pattern.format("expansion")),
    ]


def status_columns() -> list[Column]:
    return [F.col(c) for c in ("active_customers", "new_customers", "churned_customers")]


def mrr_columns() -> list[Column]:
    return [double("mrr", "mrr"), double(F.col("mrr") * 12, "arr")]


def usage_columns() -> list[Column]:
    """Averages over usage rows; a month without usage has 0.0, not NULL."""

    def mean(total: str, name: str) -> Column:
        value = ratio(F.col(total).cast("double"), F.col("usage_rows").cast("double"))
        return F.coalesce(value, F.lit(0.0)).alias(name)

    return [
        mean("active_users_sum", "avg_active_users"),
        F.col("total_login_count"),
        mean("feature_usage_sum", "avg_feature_usage"),
        F.col("total_api_calls"),
        F.col("usage_customer_count"),
    ]


def opportunity_columns() -> list[Column]:
    """Deal measures; win_rate is NULL in a month without closed deals."""
    won, lost = F.col("deals_won"), F.col("deals_lost")
    return [
        F.col("pipeline_open_count"),
        double("pipeline_open_value", "pipeline_open_value"),
        double("pipeline_weighted_value", "pipeline_weighted_value"),
        won,
        lost,
        double("won_value", "won_value"),
        ratio(won.cast("double"), (won + lost).cast("double")).alias("win_rate"),
    ]


# Fact -> its contributions, which are sums of its rows alone; called with (rows, by_customer).
FACT_BLOCKS = {
    "fact_churn": churn_block,
    "fact_customer_usage": lambda usage, by_customer: usage_block(usage),
    "fact_sales_pipeline": opportunity_block,
}


def monthly_summary(
    tables: Tables, series_keys: Sequence[str] = (), blocks: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """All monthly measures on the spine of billed months.

    With series_keys (customer attributes such as segment and region) there is
    one row per series and month, otherwise one per month. `blocks` holds the
    contributions of the FACT_BLOCKS by customer where they were made before.
    """
    split = bool(series_keys)
    subscriptions, revenue = tables["fact_subscription"], tables["fact_revenue"]
    customers = tables["dim_customer"] if split else None
    if blocks is None:
        blocks = {name: make(tables[name], split) for name, make in FACT_BLOCKS.items()}
    rolled = roll_up(
        [
            revenue_block(revenue, subscriptions, split),
            status_block(subscriptions, split),
            mrr_block(subscriptions, split),
            *blocks.values(),
        ],
        revenue_spine(revenue, customers, series_keys),
        customers,
        series_keys,
    )
    return rolled.select(
        *series_keys,
        "month",
        *revenue_columns(),
        double("churn_revenue", "churn_revenue"),
        *status_columns(),
        *mrr_columns(),
        *usage_columns(),
        *opportunity_columns(),
    )


def revenue_series(tables: Tables, series_keys: Sequence[str] = ()) -> DataFrame:
    """Total net revenue per series and month of the spine."""
    revenue = tables["fact_revenue"]
    customers = tables["dim_customer"] if series_keys else None
    rolled = roll_up(
        [total_block(revenue, bool(series_keys))],
        revenue_spine(revenue, customers, series_keys),
        customers,
        series_keys,
    )
    return rolled.select(*series_keys, "month", double("total_revenue", "total_revenue"))


def latest_months(summary: DataFrame, months: int = 6) -> DataFrame:
    """The last rows of the summary by month."""
    return summary.orderBy(F.col("month").desc()).limit(months)
