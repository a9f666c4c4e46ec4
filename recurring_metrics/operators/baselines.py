"""Forecasters that need no training table: four baselines and trend smoothing.

The back-test of a baseline is a window expression, since "only earlier months"
is a frame that ends one row before. Point forecasts and smoothing work on one
row per series that holds its monthly values in order; its length is the number
of months on the spine, whatever the size of the facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurring_metrics.functions.numbers import ratio
from recurring_metrics.operators.features import TARGET, by_month

TEST_MONTHS = 12
MIN_TRAINING_MONTHS = 18
BASELINES = ("naive", "seasonal_naive", "moving_avg_3", "drift")
SMOOTHING = "holt_linear"
# The weights tried for level and trend.
SMOOTHING_WEIGHTS = (0.1, 0.3, 0.5, 0.7, 0.9)


def billed_history(series: DataFrame, series_keys: Sequence[str] = (), y: str = TARGET) -> DataFrame:
    """Each series from its first month with revenue on; months without any after that stay zero."""
    first = F.min(F.when(F.col(y) != 0, F.col("month"))).over(Window.partitionBy(*series_keys))
    return series.withColumn("first_billed", first).where("month >= first_billed").drop("first_billed")


def eligible_series(series: DataFrame, series_keys: Sequence[str] = ()) -> DataFrame:
    """Billed months per series, and whether they suffice for the walk-forward test."""
    training = F.col("months") - TEST_MONTHS
    return (
        billed_history(series, series_keys)
        .groupBy(*series_keys)
        .agg(F.count(F.lit(1)).alias("months"))
        .withColumn("training_months", training)
        .withColumn("eligible", training >= MIN_TRAINING_MONTHS)
    )


def forecastable(
    series: DataFrame, series_keys: Sequence[str] = (), min_training: int | None = MIN_TRAINING_MONTHS
) -> DataFrame:
    """The billed history of the series that are long enough; None lets all of them through."""
    billed = billed_history(series, series_keys)
    if min_training is None:
        return billed
    months = F.count(F.lit(1)).over(Window.partitionBy(*series_keys))
    return (
        billed.withColumn("billed_months", months)
        .where(F.col("billed_months") - TEST_MONTHS >= min_training)
        .drop("billed_months")
    )


def baseline_columns(series_keys: Sequence[str], y: str = TARGET) -> dict[str, Column]:
    """One-step prediction of each baseline for every month, from earlier months."""
    window = by_month(series_keys)
    row = F.row_number().over(window)
    last_three = window.rowsBetween(-3, -1)
    previous = F.lag(y, 1).over(window)
    first = F.first(y).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # mean of all earlier changes; telescopes because the spine has no gaps
    mean_change = ratio(previous - first, F.when(row > 2, (row - 2).cast("double")))
    return {
        "naive": previous,
        "seasonal_naive": F.lag(y, 12).over(window),
        "moving_avg_3": F.when(
            F.count(y).over(last_three) == 3, F.avg(y).over(last_three)
        ),
        "drift": previous + mean_change,
    }


def backtest_baselines(
    series: DataFrame,
    series_keys: Sequence[str] = (),
    models: Sequence[str] = BASELINES,
    test_months: int = TEST_MONTHS,
) -> DataFrame:
    """(series, month, model_name, actual, predicted) for the last test_months."""
    predictions = baseline_columns(series_keys)
    whole = Window.partitionBy(*series_keys)
    remaining = F.count(F.lit(1)).over(whole) - F.row_number().over(by_month(series_keys))
    return (
        series.select(
            *series_keys,
            "month",
            F.col(TARGET).alias("actual"),
            *[predictions[m].alias(m) for m in models],
            remaining.alias("remaining"),
        )
        .where(F.col("remaining") < test_months)
        .unpivot([*series_keys, "month", "actual"], list(models), "model_name", "predicted")
    )


def series_history(series: DataFrame, series_keys: Sequence[str] = ()) -> DataFrame:
    """One row per series: its values in month order, and its last month."""
    points = F.sort_array(F.collect_list(F.struct("month", F.col(TARGET).alias("y"))))
    return series.groupBy(*series_keys).agg(points.alias("points")).select(
        *series_keys,
        F.transform("points", lambda p: p["y"]).alias("ys"),
        F.transform("points", lambda p: p["month"]).alias("months"),
    )


def smoothing_runs(history: DataFrame, test_months: int = TEST_MONTHS) -> DataFrame:
    """Adds `runs`: one pass over the series for each pair of weights.

    A run starts with the first value as level and the first change as trend.
    It keeps, for each test month, the forecast made before that month was seen
    and the squared error up to then, so a single pass serves every fold.
    """
    fold = "array<struct<sse:double,predicted:double>>"
    first = F.element_at("ys", 1)
    size = F.size("ys")
    start = F.struct(
        F.lit(1).alias("seen"),
        first.alias("level"),
        (F.try_element_at("ys", F.lit(2)) - first).alias("trend"),
        F.lit(0.0).alias("sse"),
        F.array().cast(fold).alias("folds"),
    )

    def run(weights: Column) -> Column:
        alpha, beta = weights["alpha"], weights["beta"]

        def step(state: Column, y: Column) -> Column:
            expected = state["level"] + state["trend"]
            level = alpha * y + (F.lit(1.0) - alpha) * expected
            trend = beta * (level - state["level"]) + (F.lit(1.0) - beta) * state["trend"]
            error = y - expected
            made = F.struct(state["sse"].alias("sse"), expected.alias("predicted"))
            # the first trend comes from the second value, so it cannot predict it
            tested = (state["seen"] >= 2) & (state["seen"] >= size - test_months)
            return F.struct(
                (state["seen"] + 1).alias("seen"),
                level.alias("level"),
                trend.alias("trend"),
                (state["sse"] + error * error).alias("sse"),
                F.when(tested, F.concat(state["folds"], F.array(made)))
                .otherwise(state["folds"])
                .alias("folds"),
            )

        return F.aggregate(
            F.slice("ys", F.lit(2), size),
            start,
            step,
            lambda s: F.struct(
                s["sse"].alias("sse"),
                alpha.alias("alpha"),
                beta.alias("beta"),
                s["level"].alias("level"),
                s["trend"].alias("trend"),
                s["folds"].alias("folds"),
            ),
        )

    grid = F.array(
        *[
            F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"))
            for a in SMOOTHING_WEIGHTS
            for b in SMOOTHING_WEIGHTS
        ]
    )
    return history.withColumn("runs", F.transform(grid, run))


def backtest_smoothing(
    history: DataFrame, series_keys: Sequence[str] = (), test_months: int = TEST_MONTHS
) -> DataFrame:
    """Each test month predicted with the weights that fitted the months before best."""
    runs = smoothing_runs(history, test_months)
    # Months with a prediction; the first two values only start a run.
    folds = F.size(F.element_at("runs", 1)["folds"])
    exploded = runs.withColumn("folds", folds).where(F.col("folds") > 0).select(
        *series_keys,
        "ys",
        "months",
        "runs",
        "folds",
        F.explode(F.sequence(F.lit(0), F.col("folds") - 1)).alias("fold"),
    )
    position = F.size("ys") - F.col("folds") + F.col("fold") + 1
    best = F.array_min(
        F.transform(
            "runs",
            lambda r: F.struct(
                F.get(r["folds"], F.col("fold"))["sse"].alias("sse"),
                r["alpha"].alias("alpha"),
                r["beta"].alias("beta"),
                F.get(r["folds"], F.col("fold"))["predicted"].alias("predicted"),
            ),
        )
    )
    return exploded.select(
        *series_keys,
        F.element_at("months", position).alias("month"),
        F.element_at("ys", position).alias("actual"),
        F.lit(SMOOTHING).alias("model_name"),
        best["predicted"].alias("predicted"),
    )


def _moving_average_path(values: Column, horizon: int) -> Column:
    """Repeated mean of the last three values, each forecast joining the history."""

    def extend(path: Column, _: Column) -> Column:
        mean = (
            F.element_at(path, -3) + F.element_at(path, -2) + F.element_at(path, -1)
        ) / F.lit(3.0)
        return F.concat(path, F.array(mean))

    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(horizon)), F.slice(values, -3, 3), extend
    )
    return F.when(F.size(values) >= 3, F.slice(grown, 4, horizon))


def forecast_points(
    history: DataFrame,
    horizon: int,
    series_keys: Sequence[str] = (),
    models: Sequence[str] = (*BASELINES, SMOOTHING),
) -> DataFrame:
    """(series, model_name, step, forecast_month, predicted) for `horizon` months.

    Closed forms of repeating the one-step rule on its own forecasts.
    """
    rows = history
    if SMOOTHING in models:
        best = F.array_min("runs")
        rows = smoothing_runs(history, 0).withColumn("best", best)
    ys, step = F.col("ys"), F.col("step")
    size = F.size(ys)
    last = F.element_at(ys, -1)
    change = ratio(last - F.element_at(ys, 1), F.when(size > 1, (size - 1).cast("double")))
    formulas = {
        "naive": lambda: last,
        "seasonal_naive": lambda: F.get(ys, size - 12 + F.pmod(step - 1, F.lit(12))),
        "moving_avg_3": lambda: F.get(_moving_average_path(ys, horizon), step - 1),
        "drift": lambda: last + step * change,
        SMOOTHING: lambda: F.when(
            size > 1, F.col("best")["level"] + step * F.col("best")["trend"]
        ),
    }
    return (
        rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .select(
            *series_keys,
            "step",
            F.add_months(F.element_at("months", -1), step).alias("forecast_month"),
            *[formulas[m]().alias(m) for m in models],
        )
        .unpivot(
            [*series_keys, "step", "forecast_month"], list(models), "model_name", "predicted"
        )
    )
