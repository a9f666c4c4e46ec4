"""Month-end MRR without a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurring_metrics.functions.dates import month_floor


def mrr_block(subscriptions: DataFrame, by_customer: bool = False) -> DataFrame:
    """Signed MRR changes whose running sum is the MRR at each month end.

    A subscription counts from the month it starts in to the last month whose
    end it reaches; it adds its MRR in the first and takes it off in the month
    after the last. One that reaches no month end is never counted. Two rows per
    subscription replace a comparison of every subscription with every month.
    """
    counted = subscriptions.select(
        *(["customer_id"] if by_customer else []),
        "mrr",
        month_floor("start_date").alias("first_month"),
        # month after the last counted one; NULL while open
        F.when(
            F.col("end_date") == F.last_day("end_date"), F.add_months(month_floor("end_date"), 1)
        )
        .otherwise(month_floor("end_date"))
        .alias("gone_month"),
    ).where(
        F.col("gone_month").isNull() | (F.col("gone_month") > F.col("first_month"))
    )
    changes = F.array(
        F.struct(F.col("first_month").alias("month"), F.col("mrr").alias("mrr")),
        F.struct(
            F.when(F.col("first_month").isNotNull(), F.col("gone_month")).alias("month"),
            (-F.col("mrr")).cast("decimal(12,2)").alias("mrr"),
        ),
    )
    return counted.select(
        *(["customer_id"] if by_customer else []), F.inline(changes)
    ).where(F.col("month").isNotNull())
