"""Leak-free model features: everything known strictly before the month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from recurring_metrics.functions.numbers import growth, ratio

TARGET = "total_revenue"
LAGS = (1, 2, 3, 6, 12)
ROLLING = (3, 6, 12)


def by_month(series_keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*series_keys).orderBy("month")


def lag_columns(window: WindowSpec, y: str = TARGET) -> dict[str, Column]:
    return {f"revenue_lag_{k}": F.lag(y, k).over(window) for k in LAGS}


def rolling_columns(window: WindowSpec, y: str = TARGET) -> dict[str, Column]:
    """Mean and sample deviation of the n months before; NULL until n exist."""
    columns: dict[str, Column] = {}
    for n in ROLLING:
        before = window.rowsBetween(-n, -1)
        full = F.count(y).over(before) == n
        columns[f"revenue_rolling_mean_{n}"] = F.when(full, F.avg(y).over(before))
        columns[f"revenue_rolling_std_{n}"] = F.when(full, F.stddev_samp(y).over(before))
    return columns


def growth_columns(window: WindowSpec, y: str = TARGET) -> dict[str, Column]:
    def lag(k: int) -> Column:
        return F.lag(y, k).over(window)

    return {
        "revenue_growth_mom_prev": growth(lag(1), lag(2)),
        "revenue_growth_yoy_prev": growth(lag(1), lag(13)),
    }


def build_features(summary: DataFrame, series_keys: Sequence[str] = ()) -> DataFrame:
    """The feature table: target, its history, last month's measures, the calendar.

    All columns come from one window per series, hence one sort.
    """
    window = by_month(series_keys)
    described = [c for c in summary.columns if c not in (*series_keys, "month", TARGET)]
    columns: dict[str, Column] = {
        **lag_columns(window),
        **rolling_columns(window),
        **growth_columns(window),
        **{f"{c}_prev": F.lag(c, 1).over(window) for c in described},
        "churn_rate_prev": ratio(
            F.lag("churned_customers", 1).over(window).cast("double"),
            F.lag("active_customers", 2).over(window).cast("double"),
        ),
        "calendar_month": F.month("month"),
        "time_index": F.row_number().over(window) - 1,
    }
    return summary.select(
        *series_keys, "month", TARGET, *[c.alias(name) for name, c in columns.items()]
    )


def feature_columns(features: DataFrame, series_keys: Sequence[str] = ()) -> list[str]:
    """The predictors of a feature table, read from its schema."""
    return [c for c in features.columns if c not in (*series_keys, "month", TARGET)]


def carried_columns(predictors: Sequence[str]) -> list[str]:
    """Predictors without a known future value, which hold their last one."""
    recomputed = ("revenue_growth_mom_prev", "revenue_growth_yoy_prev")
    return [c for c in predictors if c.endswith("_prev") and c not in recomputed]


def append_horizon(summary: DataFrame, horizon: int, series_keys: Sequence[str] = ()) -> DataFrame:
    """The feature rows of a summary plus `horizon` future months per series, told apart by `step`.

    One month without measures is added to each series, so its features are
    built like all others and hold what the last month says. Future months know
    their calendar; carried columns hold the value of that row, or the last one
    before it; what depends on revenue is known for the first step only.
    """
    newest = summary.groupBy(*series_keys).agg(F.max("month").alias("month")).select(
        *series_keys, F.add_months("month", 1).alias("month")
    )
    known = build_features(summary.unionByName(newest, allowMissingColumns=True), series_keys)
    predictors = feature_columns(known, series_keys)
    carried = set(carried_columns(predictors))
    window = by_month(series_keys)
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    is_next = F.lead("month", 1).over(window).isNull()
    steps = F.when(is_next, F.sequence(F.lit(1), F.lit(horizon))).otherwise(F.array(F.lit(0)))
    spawned = known.select(
        "*",
        F.struct(
            *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in sorted(carried)]
        ).alias("held"),
        steps.alias("steps"),
    ).select("*", F.explode("steps").alias("step"))
    step, future = F.col("step"), F.col("step") > 0
    later = F.greatest(step - 1, F.lit(0))
    month = F.add_months("month", later)

    def predictor(name: str) -> Column:
        if name in carried:
            return F.when(future, F.col("held")[name]).otherwise(F.col(name))
        if name == "calendar_month":
            return F.month(month)
        if name == "time_index":
            return F.col(name) + later
        return F.when(step <= 1, F.col(name))

    return spawned.select(
        *series_keys, month.alias("month"), "step", TARGET, *[predictor(c).alias(c) for c in predictors]
    )


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows with both values; NULL when either is constant.

    `corr` itself raises on a constant column.
    """
    paired_x, paired_y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return ratio(F.covar_pop(x, y), F.stddev_pop(paired_x) * F.stddev_pop(paired_y))


def strongest_correlations(
    features: DataFrame, series_keys: Sequence[str] = (), top: int = 5
) -> DataFrame:
    """The predictors most correlated with the target, per series.

    A value near one points at a leak. Pairs with a NULL on either side are
    left out, as are constant columns, which have no correlation.
    """
    predictors = feature_columns(features, series_keys)
    target = F.col(TARGET)
    table = features.groupBy(*series_keys).agg(
        *[F.abs(correlation(F.col(c).cast("double"), target)).alias(c) for c in predictors]
    )
    long = table.unpivot(list(series_keys), predictors, "feature", "abs_correlation").where(
        F.col("abs_correlation").isNotNull()
    )
    strongest = Window.partitionBy(*series_keys).orderBy(F.col("abs_correlation").desc(), "feature")
    return (
        long.withColumn("position", F.row_number().over(strongest))
        .where(F.col("position") <= top)
        .select(*series_keys, "feature", "abs_correlation")
    )
