"""The revenue forecast with its interval, and what moved behind it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurring_metrics.functions.numbers import classify_driver, percent_change
from recurring_metrics.operators.features import TARGET

HORIZON = 6
# Fixed value: standard normal quantile of 0.9, for an 80 % interval.
Z_80 = 1.2815515655446004

# Label of each driver and the summary column behind it.
DRIVERS = (
    ("MRR", "mrr"),
    ("ARR", "arr"),
    ("Active customers", "active_customers"),
    ("Expansion revenue", "expansion_revenue"),
    ("Churn revenue (MRR lost)", "churn_revenue"),
    ("Avg. active users", "avg_active_users"),
    ("Pipeline weighted value", "pipeline_weighted_value"),
    ("Win rate", "win_rate"),
)


def revenue_forecast(
    points: DataFrame,
    board: DataFrame,
    series: DataFrame,
    series_keys: Sequence[str] = (),
    created_at: dt.datetime | None = None,
) -> DataFrame:
    """The best model's forecast per series, with an 80 % interval and growth.

    The interval takes the spread of the back-test errors, wider by the square
    root of the step. Growth compares with the month before, the first forecast
    with the last actual.
    """
    winner = board.where("is_best").select(
        *series_keys, "model_name", "model_version", "residual_std"
    )
    steps = Window.partitionBy(*series_keys).orderBy("step")
    last = series.groupBy(*series_keys).agg(F.max_by(TARGET, "month").alias("last_actual"))
    if series_keys:
        chosen = points.join(winner, [*series_keys, "model_name"]).join(last, list(series_keys))
    else:
        # One row on the right-hand side: the single series' last value.
        chosen = points.join(winner, "model_name").withColumn("last_actual", last.scalar())
    half_width = F.lit(Z_80) * F.col("residual_std") * F.sqrt(F.col("step").cast("double"))
    before = F.coalesce(F.lag("predicted", 1).over(steps), F.col("last_actual"))
    return chosen.select(
        *series_keys,
        "forecast_month",
        F.col("predicted").alias("predicted_revenue"),
        (F.col("predicted") - half_width).alias("lower_bound"),
        (F.col("predicted") + half_width).alias("upper_bound"),
        percent_change(F.col("predicted"), before).alias("forecast_growth"),
        "model_name",
        "model_version",
        F.lit(created_at).cast("timestamp").alias("created_at"),
    )


def forecast_drivers(
    summary: DataFrame, series_keys: Sequence[str] = (), lookback: int = 3
) -> DataFrame:
    """Eight metrics of the latest month against `lookback` rows earlier."""
    newest = Window.partitionBy(*series_keys).orderBy(F.col("month").desc())
    columns = [column for _, column in DRIVERS]
    ends = (
        summary.select(
            *series_keys,
            "month",
            *[F.col(c).cast("double").alias(c) for c in columns],
            F.row_number().over(newest).alias("position"),
        )
        .where(F.col("position").isin(1, lookback + 1))
        .unpivot([*series_keys, "month", "position"], columns, "measure", "value")
    )
    at_latest = F.col("position") == 1
    labels = F.create_map(*[F.lit(v) for label, column in DRIVERS for v in (column, label)])
    change = percent_change(F.col("current_value"), F.col("prior_value"))
    return (
        ends.groupBy(*series_keys, "measure")
        .agg(
            F.max(F.when(at_latest, F.col("value"))).alias("current_value"),
            F.max(F.when(~at_latest, F.col("value"))).alias("prior_value"),
            F.max(F.when(at_latest, F.col("month"))).alias("as_of_month"),
        )
        .select(
            *series_keys,
            labels[F.col("measure")].alias("driver_name"),
            "current_value",
            "prior_value",
            change.alias("pct_change"),
            classify_driver(change).alias("direction"),
            "as_of_month",
            F.lit(lookback).alias("lookback_months"),
        )
    )


def actual_plus_forecast(
    series: DataFrame, forecast: DataFrame, series_keys: Sequence[str] = ()
) -> DataFrame:
    """History and forecast as one long series, told apart by `kind`."""
    history = series.select(
        *series_keys, "month", F.lit("actual").alias("kind"), F.col(TARGET).alias("revenue")
    )
    future = forecast.select(
        *series_keys,
        F.col("forecast_month").alias("month"),
        F.lit("forecast").alias("kind"),
        F.col("predicted_revenue").alias("revenue"),
        "lower_bound",
        "upper_bound",
    )
    return history.unionByName(future, allowMissingColumns=True)
