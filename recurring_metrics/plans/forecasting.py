"""Back-test, ranking and forecast in one go."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from recurring_metrics.operators import baselines, trees
from recurring_metrics.operators.evaluate import historical_vs_predicted, leaderboard
from recurring_metrics.operators.forecast import HORIZON, forecast_drivers, revenue_forecast
from recurring_metrics.sources.io import materialize

# Columns of the stored metrics table, after the series keys.
METRIC_COLUMNS = (
    "model_name", "mae", "rmse", "mape", "model_version", "backtest_start", "backtest_end",
    "is_best", "evaluated_at",
)
MODELS = (*baselines.BASELINES, baselines.SMOOTHING, *trees.TREE_MODELS)
WINDOW_MODELS = (*baselines.BASELINES, baselines.SMOOTHING)


def _same_months(
    features: DataFrame | None, series: DataFrame, series_keys: Sequence[str]
) -> DataFrame | None:
    """The feature rows of the months that the series has."""
    keys = [*series_keys, "month"]
    return None if features is None else features.join(series.select(*keys), keys, "left_semi")


def _require_features(
    models: Sequence[str], tree_models: Mapping[str, trees.TreeModel], features: DataFrame | None
) -> None:
    if features is None and any(m in tree_models for m in models):
        raise ValueError("tree models need the feature table")


def walk_forward(
    series: DataFrame,
    series_keys: Sequence[str] = (),
    models: Sequence[str] = MODELS,
    features: DataFrame | None = None,
    tree_models: Mapping[str, trees.TreeModel] = trees.TREE_MODELS,
    test_months: int = baselines.TEST_MONTHS,
    min_training: int | None = baselines.MIN_TRAINING_MONTHS,
) -> DataFrame:
    """One-step predictions of the chosen models for the last test months.

    A series begins with its first billed month; series too short for the test
    are left out (`baselines.eligible_series` lists them). Tree models also need
    the materialised feature table; `WINDOW_MODELS` do without.
    """
    _require_features(models, tree_models, features)
    series = baselines.forecastable(series, series_keys, min_training)
    features = _same_months(features, series, series_keys)
    unknown = set(models) - set(MODELS)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    parts = []
    plain = [m for m in models if m in baselines.BASELINES]
    if plain:
        parts.append(baselines.backtest_baselines(series, series_keys, plain, test_months))
    if baselines.SMOOTHING in models:
        history = baselines.series_history(series, series_keys)
        parts.append(baselines.backtest_smoothing(history, series_keys, test_months))
    chosen = [tree_models[m] for m in models if m in tree_models]
    if chosen:
        parts.append(trees.backtest_trees(features, chosen, series_keys, test_months))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def future_points(
    series: DataFrame,
    series_keys: Sequence[str] = (),
    models: Sequence[str] = MODELS,
    features: DataFrame | None = None,
    tree_models: Mapping[str, trees.TreeModel] = trees.TREE_MODELS,
    horizon: int = HORIZON,
    min_training: int | None = baselines.MIN_TRAINING_MONTHS,
) -> DataFrame:
    """Point forecasts of the chosen models for the months after the billed history.

    Tree models need `series` to be the whole summary, and the feature table.
    """
    _require_features(models, tree_models, features)
    series = baselines.forecastable(series, series_keys, min_training)
    features = _same_months(features, series, series_keys)
    plain = [m for m in models if m in WINDOW_MODELS]
    parts = []
    if plain:
        history = baselines.series_history(series, series_keys)
        parts.append(baselines.forecast_points(history, horizon, series_keys, plain))
    chosen = [tree_models[m] for m in models if m in tree_models]
    if chosen:
        parts.append(trees.forecast_trees(series, features, chosen, horizon, series_keys))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def forecast_outputs(
    summary: DataFrame,
    features: DataFrame,
    series_keys: Sequence[str] = (),
    models: Sequence[str] = MODELS,
    tree_models: Mapping[str, trees.TreeModel] = trees.TREE_MODELS,
    as_of: dt.datetime | None = None,
) -> dict[str, DataFrame]:
    """The four output tables. Pass materialised inputs; several results read them.

    The back-tests feed three of the tables and are written once in between.
    Points are made by the models that won somewhere.
    """
    backtests = materialize(walk_forward(summary, series_keys, models, features, tree_models))
    board = leaderboard(backtests, series_keys, as_of)
    won = {r[0] for r in board.where("is_best").select("model_name").distinct().collect()}
    winners = [m for m in models if m in won]
    points = future_points(summary, series_keys, winners, features, tree_models)
    return {
        "model_evaluation_metrics": board.select(*series_keys, *METRIC_COLUMNS),
        "historical_vs_predicted": historical_vs_predicted(backtests, board, series_keys),
        "revenue_forecast": revenue_forecast(points, board, summary, series_keys, as_of),
        "forecast_drivers": forecast_drivers(summary, series_keys),
    }
