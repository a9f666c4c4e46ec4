"""Gradient-boosted trees on the feature table, one model for all series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurring_metrics.functions.numbers import growth
from recurring_metrics.operators.baselines import TEST_MONTHS
from recurring_metrics.operators.boosting import BLOCK_ROWS, Fit, blocks_of, fit_forests, predicted, quantile_cuts
from recurring_metrics.operators.features import (
    LAGS,
    ROLLING,
    TARGET,
    append_horizon,
    by_month,
    carried_columns,
    feature_columns,
)
from recurring_metrics.sources.io import materialize

# Months of history the features of a future month reach back to.
REACH = 13


@dataclass(frozen=True)
class TreeModel:
    """Boosting settings; `refit_every` test months share one fitted model."""

    name: str
    rounds: int = 200
    depth: int = 3
    step_size: float = 0.05
    row_share: float = 0.9
    column_share: float = 0.9
    min_rows: int = 1
    seed: int = 42
    refit_every: int = 1

    def with_budget(self, rounds: int, refit_every: int) -> TreeModel:
        return replace(self, rounds=rounds, refit_every=refit_every)

    def fit_before(self, month: dt.date | None) -> Fit:
        """The fit of this model on the rows before a month, or on all."""
        until = None if month is None else month.year * 12 + month.month - 1
        return Fit(
            self.name, until, self.rounds, self.depth, self.step_size, self.row_share, self.column_share,
            self.min_rows, self.seed,
        )


GBT = TreeModel("gbt")
GBT_MIN5 = TreeModel("gbt_min5", min_rows=5)
TREE_MODELS = {m.name: m for m in (GBT, GBT_MIN5)}


def complete_rows(
    features: DataFrame, predictors: Sequence[str], series_keys: Sequence[str]
) -> DataFrame:
    """Missing predictors take the series' last known value, then zero.

    The trees here cannot score a row with a missing value.
    """
    so_far = by_month(series_keys).rowsBetween(Window.unboundedPreceding, 0)
    filled = [
        F.coalesce(F.last(c, ignorenulls=True).over(so_far).cast("double"), F.lit(0.0)).alias(c)
        for c in predictors
    ]
    return features.select(*series_keys, "month", TARGET, *filled)


def _add_months(month: dt.date, count: int) -> dt.date:
    index = month.year * 12 + month.month - 1 + count
    return dt.date(index // 12, index % 12 + 1, 1)


def backtest_trees(
    features: DataFrame,
    models: TreeModel | Sequence[TreeModel],
    series_keys: Sequence[str] = (),
    test_months: int = TEST_MONTHS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(series, month, model_name, actual, predicted) for the last test_months.

    All series share one month spine. The model for a block of test months is
    fitted on months strictly before the block, over all series together; rows
    with any missing value are not learned from. The folds of all models are
    grown together over rows that are binned once, by quantiles of the months
    before the first tested one. Pass a materialised feature table.
    """
    models = [models] if isinstance(models, TreeModel) else list(models)
    predictors = feature_columns(features, series_keys)
    last_month = features.agg(F.max("month")).first()[0]
    first_tested = _add_months(last_month, 1 - test_months)
    training = features.dropna(subset=[*predictors, TARGET])
    cuts = quantile_cuts(training.where(F.col("month") < F.lit(first_tested)), predictors)
    blocks, count = blocks_of(training, predictors, TARGET, "month", [*series_keys, "month"], cuts, block_rows)

    fits, spans = [], []
    for model in models:
        for offset in range(0, test_months, model.refit_every):
            first = _add_months(first_tested, offset)
            until = _add_months(first, min(model.refit_every, test_months - offset) - 1)
            spans.append((model.name, first, until, len(fits)))
            fits.append(model.fit_before(first))
    forests = fit_forests(blocks, count, fits, block_rows)
    # One row per fold and model.
    folds = F.broadcast(
        features.sparkSession.createDataFrame(spans, "model_name string, first_month date, until date, fold int")
    )
    tested = complete_rows(features, predictors, series_keys).where(F.col("month") >= F.lit(first_tested))
    paired = tested.join(folds, F.col("month").between(F.col("first_month"), F.col("until")))
    return predicted(paired, predictors, cuts, forests, "fold").select(
        *series_keys, "month", "model_name", F.col(TARGET).alias("actual"), "predicted"
    )


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return total / F.size(values)


def _deviation(values: Column) -> Column:
    mean = _mean(values)
    squares = F.aggregate(
        F.transform(values, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda acc, v: acc + v
    )
    return F.sqrt(squares / (F.size(values) - 1))


def next_features(tail: Column, month: Column, index: Column) -> dict[str, Column]:
    """The revenue and calendar features of the month after `tail`, a value array."""

    def back(k: int) -> Column:
        return F.when(F.size(tail) >= k, F.element_at(tail, -k))

    columns = {f"revenue_lag_{k}": back(k) for k in LAGS}
    for n in ROLLING:
        enough, last_n = F.size(tail) >= n, F.slice(tail, -n, n)
        columns[f"revenue_rolling_mean_{n}"] = F.when(enough, _mean(last_n))
        columns[f"revenue_rolling_std_{n}"] = F.when(enough, _deviation(last_n))
    columns["revenue_growth_mom_prev"] = growth(back(1), back(2))
    columns["revenue_growth_yoy_prev"] = growth(back(1), back(13))
    columns["calendar_month"] = F.month(month)
    columns["time_index"] = index
    return columns


def forecast_trees(
    summary: DataFrame,
    features: DataFrame,
    model: TreeModel | Sequence[TreeModel],
    horizon: int,
    series_keys: Sequence[str] = (),
) -> DataFrame:
    """(series, model_name, step, forecast_month, predicted) for `horizon` months, by one model or several.

    The models are fitted on the complete rows of `features`, binned once; the months ahead start from
    the row that `append_horizon` adds to `summary`. Each step rebuilds the revenue features
    from the values so far, the model's own forecasts included, and scores all series by all
    models at once. A series is one row per model with its last values in an array, so the steps
    need no further shuffle; each is written before the next begins.
    """
    models = [model] if isinstance(model, TreeModel) else list(model)
    predictors = feature_columns(features, series_keys)
    training = features.dropna(subset=[*predictors, TARGET])
    cuts = quantile_cuts(training, predictors)
    blocks, count = blocks_of(training, predictors, TARGET, "month", [*series_keys, "month"], cuts)
    forests = fit_forests(blocks, count, [m.fit_before(None) for m in models])
    newest = Window.partitionBy(*series_keys).orderBy(F.col("month").desc())
    carried = carried_columns(predictors)
    past = F.col("step") == 0
    points = F.sort_array(F.collect_list(F.when(past, F.struct("month", TARGET))))
    state = (
        append_horizon(summary, 1, series_keys)
        .withColumn("position", F.row_number().over(newest))
        .where(F.col("position") <= REACH + 1)
        .groupBy(*series_keys)
        .agg(
            F.transform(points, lambda p: p[TARGET]).alias("tail"),
            F.max(F.when(past, F.col("month"))).alias("last_month"),
            *[F.coalesce(F.max_by(c, "month").cast("double"), F.lit(0.0)).alias(c) for c in carried],
        )
    )
    length = features.groupBy(*series_keys).agg(F.max("time_index").alias("last_index"))
    if series_keys:
        state = state.join(length, list(series_keys))
    else:
        state = state.withColumn("last_index", length.scalar())
    state = state.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(len(models))])))

    kept = [*series_keys, "fold", "last_month", "last_index", *carried]
    paths: list[Column] = []
    for step in range(1, horizon + 1):
        month = F.add_months("last_month", step)
        made = next_features(F.col("tail"), month, F.col("last_index") + step)
        inputs = state.select(
            *kept,
            "tail",
            *[f"step_{s}" for s in range(1, step)],
            *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in made.items()],
        )
        scored = predicted(inputs, predictors, cuts, forests, "fold")
        # Written, as each step would repeat the expressions of all earlier ones.
        state = materialize(
            scored.select(
                *kept,
                F.concat("tail", F.array("predicted")).alias("tail"),
                *[f"step_{s}" for s in range(1, step)],
                F.col("predicted").alias(f"step_{step}"),
            )
        )
        paths.append(F.col(f"step_{step}"))
    names = F.array(*[F.lit(m.name) for m in models])
    return state.select(
        *series_keys, "fold", "last_month", F.posexplode(F.array(*paths)).alias("position", "predicted")
    ).select(
        *series_keys,
        (F.col("position") + 1).alias("step"),
        F.add_months("last_month", F.col("position") + 1).alias("forecast_month"),
        names[F.col("fold")].alias("model_name"),
        "predicted",
    )
