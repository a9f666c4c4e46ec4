"""Product usage and sales opportunities as monthly contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurring_metrics.functions.dates import month_floor

CLOSED_STAGES = ("Closed Won", "Closed Lost")


def usage_block(usage: DataFrame) -> DataFrame:
    """Sums and row counts behind the monthly usage averages, by customer.

    `usage_customer_count` is 1 on every row and is counted once per customer
    and month by the roll-up.
    """
    return usage.select(
        "customer_id",
        month_floor("usage_date").alias("month"),
        F.col("active_users").cast("long").alias("active_users_sum"),
        F.col("feature_usage").cast("long").alias("feature_usage_sum"),
        F.lit(1).cast("long").alias("usage_rows"),
        F.col("login_count").cast("long").alias("total_login_count"),
        F.col("api_calls").cast("long").alias("total_api_calls"),
        F.col("customer_id").isNotNull().cast("long").alias("usage_customer_count"),
    )


def opportunity_block(opportunities: DataFrame, by_customer: bool = False) -> DataFrame:
    """Open, won, lost and weighted deal measures by expected close month.

    The weighted value takes every stage, closed ones included.
    """
    stage, value = F.col("stage"), F.col("deal_value")
    is_open = F.coalesce(~stage.isin(*CLOSED_STAGES), F.lit(True))
    won, lost = stage == "Closed Won", stage == "Closed Lost"
    return opportunities.select(
        *(["customer_id"] if by_customer else []),
        month_floor("expected_close_date").alias("month"),
        is_open.cast("long").alias("pipeline_open_count"),
        F.when(is_open, value).alias("pipeline_open_value"),
        (value * F.col("probability")).alias("pipeline_weighted_value"),
        F.coalesce(won, F.lit(False)).cast("long").alias("deals_won"),
        F.coalesce(lost, F.lit(False)).cast("long").alias("deals_lost"),
        F.when(won, value).alias("won_value"),
    )
