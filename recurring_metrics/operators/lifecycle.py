"""Customer life cycle: first subscription, full churn, active months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurring_metrics.functions.dates import month_floor

# Stands for "never ends"; later than any month a table can hold.
OPEN_ENDED = "9000-01-01"


def first_subscriptions(subscriptions: DataFrame) -> DataFrame:
    """The first subscription of each customer: (customer_id, subscription_id).

    Ties on the start date go to the smaller subscription_id. Filtering on rank
    one lets Spark keep a single row per customer before the shuffle, so a
    customer holding a large share of all subscriptions costs no more.
    """
    by_start = Window.partitionBy("customer_id").orderBy(
        F.col("start_date").asc_nulls_last(), "subscription_id"
    )
    return (
        subscriptions.select("customer_id", "subscription_id", "start_date")
        .withColumn("position", F.row_number().over(by_start))
        .where(F.col("position") == 1)
        .select("customer_id", "subscription_id")
    )


def flag_first_subscription(subscriptions: DataFrame) -> DataFrame:
    """Adds is_first: whether the row is its customer's first subscription."""
    first = first_subscriptions(subscriptions).select(
        "subscription_id", F.lit(True).alias("is_first")
    )
    return subscriptions.join(first, "subscription_id", "left").withColumn(
        "is_first", F.coalesce("is_first", F.lit(False))
    )


def customer_lifecycle(subscriptions: DataFrame) -> DataFrame:
    """Per customer: first start, whether a subscription is open, last end, churn month.

    A customer counts as churned only when no subscription is open any more.
    """
    return (
        subscriptions.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.min("start_date").alias("first_start"),
            F.bool_or(F.col("end_date").isNull()).alias("has_open"),
            F.max("end_date").alias("last_end"),
        )
        .withColumn("churn_month", F.when(~F.col("has_open"), month_floor("last_end")))
    )


def fully_churned_count(subscriptions: DataFrame) -> DataFrame:
    """One row: the number of customers without any open subscription."""
    return customer_lifecycle(subscriptions).agg(
        F.count_if(~F.col("has_open")).alias("fully_churned_customers")
    )


def customer_changes(subscriptions: DataFrame) -> DataFrame:
    """Monthly changes per customer: (customer_id, month, active, new, churned).

    `active_customers` holds +1 in the first month of a covered stretch and -1
    in the month after it, so a running sum gives the customers with any
    subscription overlapping each month, every customer counted once. Rows of a
    customer are first reduced to one per start month, which bounds the window
    below by the number of months whatever a customer holds.
    """
    open_ended = F.lit(OPEN_ENDED).cast("date")
    per_start = (
        subscriptions.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id", month_floor("start_date").alias("start_month"))
        .agg(
            F.max(month_floor("end_date")).alias("stop_month"),
            F.bool_or(F.col("end_date").isNull()).alias("open"),
        )
    )
    whole = Window.partitionBy("customer_id")
    ordered = whole.orderBy("start_month")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    covered_to = F.when(
        F.col("start_month").isNotNull(),
        F.when(F.col("open"), open_ended).otherwise(F.col("stop_month")),
    )
    spans = (
        per_start.withColumn("covered_to", covered_to)
        .select(
            "customer_id",
            "covered_to",
            # only the months not yet covered by spans that started earlier
            F.greatest(
                "start_month", F.add_months(F.max("covered_to").over(earlier), 1)
            ).alias("covered_from"),
            F.when(F.row_number().over(ordered) == 1, True).alias("leads"),
            F.min("start_month").over(whole).alias("first_month"),
            F.when(
                ~F.bool_or("open").over(whole), F.max("stop_month").over(whole)
            ).alias("churn_month"),
        )
    )
    adds = F.col("covered_from") <= F.col("covered_to")
    closes = adds & (F.col("covered_to") < open_ended)

    def change(month, active: int, new: int, churned: int):
        return F.struct(
            month.alias("month"),
            F.lit(active).alias("active_customers"),
            F.lit(new).alias("new_customers"),
            F.lit(churned).alias("churned_customers"),
        )

    changes = F.array(
        change(F.when(adds, F.col("covered_from")), 1, 0, 0),
        change(F.when(closes, F.add_months("covered_to", 1)), -1, 0, 0),
        change(F.when(F.col("leads"), F.col("first_month")), 0, 1, 0),
        change(F.when(F.col("leads"), F.col("churn_month")), 0, 0, 1),
    )
    return spans.select("customer_id", F.inline(changes)).where(F.col("month").isNotNull())
