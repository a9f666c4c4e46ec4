"""Billed revenue by month, split into new, expansion and renewal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurring_metrics.functions.dates import month_floor
from recurring_metrics.operators.lifecycle import first_subscriptions

CATEGORIES = ("new", "expansion", "renewal")
# Fixed value: tasks that the rows of one subscription are dealt to in the join with the first subscriptions.
SPREAD = 16


def compact_revenue(revenue: DataFrame) -> DataFrame:
    """One row per customer, subscription, month and type, dated on the month start.

    Exact for every monthly measure and every filter by customer, subscription
    or whole months. Summing before the joins that follow keeps a subscription
    with a large share of all rows from filling one join task.
    """
    return (
        revenue.groupBy(
            "customer_id",
            "subscription_id",
            month_floor("revenue_date").alias("revenue_date"),
            "revenue_type",
        )
        .agg(F.sum("net_revenue").alias("net_revenue"))
    )


def categorize_revenue(
    revenue: DataFrame, subscriptions: DataFrame, by_customer: bool = True
) -> DataFrame:
    """Net revenue with month and category (and customer), rows or partial sums of them.

    A row of type 'New' is `new` on the customer's first subscription and
    `expansion` on any other, also on one that is unknown. Every other type,
    a missing one too, is `renewal`. Only 'New' rows keep their subscription. Without
    customers, everything else is summed away before the join. With them a sum would
    leave nearly as many rows, each with a wider amount, so the rows are joined as they are:
    those of a subscription are dealt to SPREAD parts by a hash of the row, and the
    first subscriptions repeated once per part. Rows without a subscription cannot
    match; `part` hands them to different join tasks.
    """
    is_new = F.coalesce(F.col("revenue_type") == "New", F.lit(False))
    customer = ["customer_id"] if by_customer else []
    known = revenue.select(
        *customer,
        month_floor("revenue_date").alias("month"),
        is_new.alias("is_new"),
        F.when(is_new, F.col("subscription_id")).alias("subscription_id"),
        "net_revenue",
    ).where(F.col("month").isNotNull())
    first = first_subscriptions(subscriptions).select("subscription_id", F.lit(True).alias("is_first"))
    unmatched = F.col("subscription_id").isNull()
    if by_customer:
        own = F.pmod(F.xxhash64("*"), F.lit(SPREAD))
        part = F.when(unmatched, F.pmod(F.xxhash64("*"), F.lit(1024))).otherwise(own)
        parts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(SPREAD)])).alias("part")
        # Hashed per task, so the rows are not sorted; once shuffled at any size.
        first = first.select("*", parts).hint("shuffle_hash")
    else:
        known = known.groupBy("month", "is_new", "subscription_id").agg(F.sum("net_revenue").alias("net_revenue"))
        part = F.when(unmatched, F.pmod(F.hash("month"), F.lit(1024))).otherwise(0)
        first = first.withColumn("part", F.lit(0))
    category = (
        F.when(~F.col("is_new"), "renewal").when(F.col("is_first"), "new").otherwise("expansion")
    )
    return known.withColumn("part", part).join(first, ["subscription_id", "part"], "left").select(
        *customer, "month", category.alias("category"), "net_revenue"
    )


def attribute_revenue(
    revenue: DataFrame, subscriptions: DataFrame, by_customer: bool = True
) -> DataFrame:
    """Net revenue by month and category (and customer), one row each."""
    customer = ["customer_id"] if by_customer else []
    return (
        categorize_revenue(revenue, subscriptions, by_customer)
        .groupBy(*customer, "month", "category")
        .agg(F.sum("net_revenue").alias("net_revenue"))
    )


def revenue_block(
    revenue: DataFrame, subscriptions: DataFrame, by_customer: bool = False
) -> DataFrame:
    """categorize_revenue with one column per category, all always present."""
    amounts = [
        F.when(F.col("category") == c, F.col("net_revenue")).alias(f"{c}_revenue")
        for c in CATEGORIES
    ]
    return categorize_revenue(revenue, subscriptions, by_customer).select(
        *(["customer_id"] if by_customer else []), "month", *amounts
    )


def total_block(revenue: DataFrame, by_customer: bool = False) -> DataFrame:
    """Total net revenue rows, for results that need no attribution."""
    return revenue.select(
        *(["customer_id"] if by_customer else []),
        month_floor("revenue_date").alias("month"),
        F.col("net_revenue").alias("total_revenue"),
    )


def churn_block(churn: DataFrame, by_customer: bool = False) -> DataFrame:
    """MRR lost to cancellations, by churn month."""
    return churn.select(
        *(["customer_id"] if by_customer else []),
        month_floor("churn_date").alias("month"),
        F.col("mrr_lost").alias("churn_revenue"),
    )
