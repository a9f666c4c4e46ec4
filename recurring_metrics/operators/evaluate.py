"""Back-test accuracy and the choice of the best model, per series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurring_metrics.functions.numbers import ratio

# Order of preference between equally accurate models.
MODEL_ORDER = (
    "naive", "seasonal_naive", "moving_avg_3", "drift", "holt_linear", "gbt", "gbt_min5",
)
MODEL_VERSION = "v1"


def backtest_metrics(backtests: DataFrame, series_keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE, residual deviation and folds per series and model.

    A test month with an actual of zero has no percentage error; `folds` counts
    the months that have one.
    """
    error = F.col("actual") - F.col("predicted")
    return backtests.groupBy(*series_keys, "model_name").agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(ratio(error, F.col("actual")))) * 100).alias("mape"),
        F.stddev_samp(error).alias("residual_std"),
        F.count(ratio(error, F.col("actual"))).alias("folds"),
        F.min("month").alias("backtest_start"),
        F.max("month").alias("backtest_end"),
    )


def leaderboard(
    backtests: DataFrame,
    series_keys: Sequence[str] = (),
    evaluated_at: dt.datetime | None = None,
    model_version: str = MODEL_VERSION,
) -> DataFrame:
    """Metrics ranked by MAPE; exactly one model per series is marked best.

    Models that missed folds which another model of the series has come last.
    """
    preference = F.coalesce(
        F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), F.col("model_name")), F.lit(0)
    )
    most = F.max("folds").over(Window.partitionBy(*series_keys))
    by_mape = Window.partitionBy(*series_keys).orderBy(
        "incomplete", F.col("mape").asc_nulls_last(), preference
    )
    return (
        backtest_metrics(backtests, series_keys)
        .withColumn("incomplete", F.col("folds") < most)
        .withColumn("model_rank", F.row_number().over(by_mape))
        .drop("incomplete")
        .withColumn("is_best", F.col("model_rank") == 1)
        .withColumn("model_version", F.lit(model_version))
        .withColumn("evaluated_at", F.lit(evaluated_at).cast("timestamp"))
    )


def accuracy_table(board: DataFrame, series_keys: Sequence[str] = ()) -> DataFrame:
    """Rounded metrics in ranking order, for display.

    Rounding goes through a decimal, so that the noise of a floating-point sum
    cannot decide which way half a cent goes.
    """

    def shown(metric: str) -> Column:
        return F.round(F.col(metric).cast("decimal(28,4)"), 2).cast("double").alias(metric)

    return board.select(
        *series_keys,
        "model_name",
        *map(shown, ("mae", "rmse", "mape")),
        "is_best",
        "model_rank",
    ).orderBy(*series_keys, "model_rank")


def historical_vs_predicted(
    backtests: DataFrame, board: DataFrame, series_keys: Sequence[str] = ()
) -> DataFrame:
    """The winning model's back-test."""
    winner = board.where("is_best").select(*series_keys, "model_name", "model_version")
    return backtests.join(winner, [*series_keys, "model_name"]).select(
        *series_keys,
        "month",
        F.col("actual").alias("actual_revenue"),
        F.col("predicted").alias("predicted_revenue"),
        "model_name",
        "model_version",
    )
