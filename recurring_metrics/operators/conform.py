"""Raw tables to typed, trimmed dimension and fact tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurring_metrics.sources.tables import LazyTables

# Rank of each plan tier.
TIER_ORDER = {"Starter": 1, "Professional": 2, "Business": 3, "Enterprise": 4}

MONEY = "decimal(12,2)"


def split_last(text: str) -> tuple[Column, Column]:
    """Both sides of the last ' - ' of a column, trimmed.

    Without a delimiter the whole text is the left side and the right is NULL.
    """
    pattern = r"(?s)^(.*) - (.*)$"
    value = F.col(text)
    has_delimiter = value.contains(" - ")
    left = F.when(has_delimiter, F.regexp_extract(value, pattern, 1)).otherwise(value)
    right = F.when(has_delimiter, F.regexp_extract(value, pattern, 2))
    return F.trim(left), F.trim(right)


def _dates(*names: str) -> list[Column]:
    return [F.col(n).cast("date").alias(n) for n in names]


def _money(*names: str) -> list[Column]:
    return [F.col(n).cast(MONEY).alias(n) for n in names]


def _text(*names: str) -> list[Column]:
    return [F.trim(n).alias(n) for n in names]


def conform_customers(raw: DataFrame) -> DataFrame:
    industry, region = split_last("industryregion")
    return raw.select(
        "customer_id",
        "customer_name",
        industry.alias("industry"),
        region.alias("region"),
        F.col("customer_segment").alias("segment"),
        *_dates("acquisition_date"),
    )


def conform_plans(raw: DataFrame) -> DataFrame:
    family, tier = split_last("plan_name")
    ranks = F.create_map(*[F.lit(v) for pair in TIER_ORDER.items() for v in pair])
    return raw.select(
        "plan_id",
        "product_id",
        family.alias("product_family"),
        "plan_name",
        tier.alias("plan_tier_name"),
        ranks[tier].alias("plan_tier_order"),
        "billing_frequency",
        *_money("price"),
    )


def conform_subscriptions(raw: DataFrame) -> DataFrame:
    return raw.select(
        "subscription_id",
        "customer_id",
        "plan_id",
        *_dates("start_date", "end_date", "renewal_date"),
        *_text("status"),
        *_money("mrr", "arr"),
    )


def conform_revenue(raw: DataFrame) -> DataFrame:
    return raw.select(
        *[c for c in ("revenue_id",) if c in raw.columns],
        "customer_id",
        "subscription_id",
        *_dates("revenue_date"),
        *_money("gross_revenue", "discount", "refund", "net_revenue"),
        *_text("revenue_type"),
    )


def _required_int(name: str) -> Column:
    value = F.col(name).cast("int")
    stop = F.raise_error(F.lit(f"{name} must not be null")).cast("int")
    return F.when(value.isNull(), stop).otherwise(value).alias(name)


def conform_usage(raw: DataFrame) -> DataFrame:
    """A usage row with a missing counter stops the job."""
    counters = ("active_users", "login_count", "session_count", "feature_usage", "api_calls")
    return raw.select("customer_id", *_dates("usage_date"), *map(_required_int, counters))


def conform_churn(raw: DataFrame) -> DataFrame:
    return raw.select(
        "customer_id",
        "subscription_id",
        *_dates("churn_date"),
        *_text("churn_reason"),
        *_money("mrr_lost"),
    )


def conform_opportunities(raw: DataFrame) -> DataFrame:
    return raw.select(
        "opportunity_id",
        "customer_id",
        *_dates("expected_close_date"),
        *_money("deal_value"),
        *_text("stage"),
        F.col("probability").cast("decimal(4,2)").alias("probability"),
    )


def conform_tickets(raw: DataFrame) -> DataFrame:
    return raw.select(
        "ticket_id",
        "customer_id",
        *_dates("created_date", "resolved_date"),
        *_text("priority", "category"),
        F.col("resolution_time").cast("decimal(10,2)").alias("resolution_time"),
    )


# Processed table name -> (raw table name, conforming step).
CONFORMED: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "dim_customer": ("raw_dim_customer", conform_customers),
    "dim_product_plan": ("raw_dim_product_plan", conform_plans),
    "fact_subscription": ("raw_fact_subscription", conform_subscriptions),
    "fact_revenue": ("raw_fact_revenue", conform_revenue),
    "fact_customer_usage": ("raw_fact_customer_usage", conform_usage),
    "fact_churn": ("raw_fact_churn", conform_churn),
    "fact_sales_pipeline": ("raw_fact_sales_pipeline", conform_opportunities),
    "fact_support_ticket": ("raw_fact_support_ticket", conform_tickets),
}


def conform_all(raw: Mapping[str, DataFrame]) -> LazyTables:
    """Processed tables for every raw table that is present."""
    return LazyTables(
        {
            name: lambda step=step, source=source: step(raw[source])
            for name, (source, step) in CONFORMED.items()
            if source in raw
        }
    )
