"""Every operator as a named query over the sample star schema.

Forecasting queries work on one revenue series per customer segment and region.
Doubles that are quotients or roots are rounded; sums are exact decimals until
the last step.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurring_metrics.functions.dates import calendar_parts
from recurring_metrics.operators import (
    baselines,
    calendar,
    evaluate,
    features,
    filters,
    lifecycle,
    quality,
    trees,
)
from recurring_metrics.operators import forecast as forecasts
from recurring_metrics.operators import revenue as revenue_ops
from recurring_metrics.operators.activity import opportunity_block, usage_block
from recurring_metrics.operators.snapshots import mrr_block
from recurring_metrics.plans import adhoc, dashboard, forecasting, incremental
from recurring_metrics.plans import summary as summaries
from recurring_metrics.sources import io, star
from recurring_metrics.sources.schema import RAW_TABLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SERIES = ("segment", "region")
CHOICE = filters.DashboardFilter(
    start_month=dt.date(1996, 2, 1),
    end_month=dt.date(1998, 11, 1),
    segments=("BUILDING", "MACHINERY"),
    regions=("ASIA", "EUROPE"),
    families=("ECONOMY", "PROMO", "STANDARD"),
)


def query(run: Query) -> Query:
    """Registers a function under its own name."""
    QUERIES[run.__name__] = run
    return run


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(
        *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns]
    )


def predictions(df: DataFrame, name: str = "predicted") -> DataFrame:
    """Predictions to four digits; eight decimal ones come first, so that a half is one on any engine."""
    exact = F.round(F.col(name).cast("decimal(28,8)"), 4).cast("double")
    return df.withColumn(name, exact)


# --- sources and sinks ----------------------------------------------------------


@query
def csv_roundtrip(spark, folder):
    """All nine tables through CSV files; their rows as text, one per line."""
    made = star.raw_tables(spark, folder)
    path = io.scratch_path(spark, "csv")
    for name, table in RAW_TABLES.items():
        io.write_csv_table(made[name], f"{path}/{table.file}")
    read = io.load_raw_tables(spark, path)
    lines = [
        df.select(
            F.lit(name).alias("table_name"),
            F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]).alias("line"),
        )
        for name, df in read.items()
    ]
    return reduce(DataFrame.unionByName, lines)


@query
def scan_project(spark, folder):
    columns = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"]
    return io.read_columns(spark, f"{folder}/lineitem.parquet", columns)


@query
def scan_ordered(spark, folder):
    return io.read_ordered(spark, f"{folder}/orders.parquet", ["o_orderdate", "o_orderkey"])


def _customers_written(spark, folder, again) -> DataFrame:
    path = io.scratch_path(spark, "table")
    customers = star.processed_tables(spark, folder)["dim_customer"]
    io.write_table(customers, path)
    again(customers, path)
    return spark.read.parquet(path)


@query
def sink_overwrite(spark, folder):
    return _customers_written(spark, folder, io.write_table)


@query
def sink_append(spark, folder):
    return _customers_written(spark, folder, io.append_rows)


# --- data quality ---------------------------------------------------------------


@query
def dq_row_counts(spark, folder):
    raw = star.raw_tables(spark, folder)
    orders, events = (star.source(spark, folder, name) for name in ("orders", "events"))
    sources = {
        "raw_dim_customer": star.source(spark, folder, "customer"),
        "raw_dim_date": orders.select(F.col("o_orderdate").cast("date")).distinct(),
        "raw_dim_product_plan": star.source(spark, folder, "part"),
        "raw_fact_subscription": orders,
        "raw_fact_revenue": star.source(spark, folder, "lineitem"),
        "raw_fact_customer_usage": events.select("user_id", F.pmod("event_id", F.lit(90))).distinct(),
        "raw_fact_churn": orders.where("o_orderkey % 16 <> 0"),
        "raw_fact_sales_pipeline": orders,
        "raw_fact_support_ticket": events.where("event_type = 'error'"),
    }
    return quality.reconcile_counts(sources, raw)


@query
def dq_null_counts(spark, folder):
    return quality.null_counts(star.raw_tables(spark, folder))


@query
def dq_feature_nulls(spark, folder):
    """Nulls per column of the feature table, as a refresh reports them."""
    return quality.null_counts({"ml_feature_table": _features(spark, folder)})


@query
def dq_duplicate_keys(spark, folder):
    raw = star.raw_tables(spark, folder)
    return quality.duplicate_keys({name: (raw[name], RAW_TABLES[name].key) for name in raw})


@query
def dq_orphans(spark, folder):
    return quality.orphans(star.raw_tables(spark, folder))


@query
def dq_date_ranges(spark, folder):
    return quality.date_ranges(star.raw_tables(spark, folder))


@query
def dq_revenue_reconcile(spark, folder):
    tables = star.processed_tables(spark, folder)
    attributed = revenue_ops.attribute_revenue(
        tables["fact_revenue"], tables["fact_subscription"], by_customer=False
    )
    return quality.reconcile_revenue(attributed, tables["fact_revenue"])


@query
def table_row_counts(spark, folder):
    return quality.row_counts(star.processed_tables(spark, folder))


# --- conforming -----------------------------------------------------------------


def _conformed(name: str) -> Query:
    return lambda spark, folder: star.processed_tables(spark, folder)[name]


QUERIES |= {
    "conform_customers": _conformed("dim_customer"),
    "conform_plans": _conformed("dim_product_plan"),
    "conform_subscriptions": _conformed("fact_subscription"),
    "conform_revenue": _conformed("fact_revenue"),
    "conform_usage": _conformed("fact_customer_usage"),
    "conform_churn": _conformed("fact_churn"),
    "conform_opportunities": _conformed("fact_sales_pipeline"),
    "conform_tickets": _conformed("fact_support_ticket"),
}


@query
def date_scalars(spark, folder):
    parts = calendar_parts("o_orderdate")
    return star.source(spark, folder, "orders").select(
        "o_orderkey", *[c.alias(n) for n, c in parts.items()]
    )


# --- revenue, customers, months -------------------------------------------------


@query
def revenue_attribution(spark, folder):
    tables = star.processed_tables(spark, folder)
    attributed = revenue_ops.attribute_revenue(tables["fact_revenue"], tables["fact_subscription"])
    return attributed.withColumn("net_revenue", F.col("net_revenue").cast("double"))


def _company(tables, *blocks) -> DataFrame:
    return calendar.roll_up(blocks, calendar.revenue_spine(tables["fact_revenue"]))


@query
def revenue_by_type(spark, folder):
    tables = star.processed_tables(spark, folder)
    block = revenue_ops.revenue_block(tables["fact_revenue"], tables["fact_subscription"])
    return _company(tables, block).select("month", *summaries.revenue_columns())


@query
def monthly_revenue(spark, folder):
    return summaries.revenue_series(star.processed_tables(spark, folder))


@query
def churned_revenue(spark, folder):
    tables = star.processed_tables(spark, folder)
    rolled = _company(tables, revenue_ops.churn_block(tables["fact_churn"]))
    return rolled.select("month", summaries.double("churn_revenue", "churn_revenue"))


@query
def usage_monthly(spark, folder):
    tables = star.processed_tables(spark, folder)
    rolled = _company(tables, usage_block(tables["fact_customer_usage"]))
    return rounded(
        rolled.select("month", *summaries.usage_columns()), avg_active_users=6, avg_feature_usage=6
    )


@query
def opportunities_monthly(spark, folder):
    tables = star.processed_tables(spark, folder)
    rolled = _company(tables, opportunity_block(tables["fact_sales_pipeline"]))
    return rounded(rolled.select("month", *summaries.opportunity_columns()), win_rate=6)


@query
def customer_lifecycle(spark, folder):
    return lifecycle.customer_lifecycle(star.processed_tables(spark, folder)["fact_subscription"])


@query
def fully_churned_count(spark, folder):
    return lifecycle.fully_churned_count(star.processed_tables(spark, folder)["fact_subscription"])


@query
def first_subscription(spark, folder):
    flagged = lifecycle.flag_first_subscription(
        star.processed_tables(spark, folder)["fact_subscription"]
    )
    return flagged.select("subscription_id", "customer_id", "start_date", "is_first")


@query
def month_spine(spark, folder):
    return summaries.revenue_series(star.processed_tables(spark, folder), SERIES)


@query
def mrr_snapshot(spark, folder):
    tables = star.processed_tables(spark, folder)
    rolled = _company(tables, mrr_block(tables["fact_subscription"]))
    return rolled.select("month", *summaries.mrr_columns())


@query
def customer_status(spark, folder):
    tables = star.processed_tables(spark, folder)
    rolled = _company(tables, summaries.status_block(tables["fact_subscription"]))
    return rolled.select("month", *summaries.status_columns())


MEANS = {"avg_active_users": 6, "avg_feature_usage": 6, "win_rate": 6}


@query
def incremental_summary(spark, folder):
    """The summary from mergeable state: half of each fact's rows are counted first, the others appended."""
    tables = star.processed_tables(spark, folder)
    path, state = io.scratch_path(spark, "tables"), io.scratch_path(spark, "state")
    for name in ("dim_customer", "fact_subscription"):
        io.write_table(tables[name], f"{path}/{name}")
    halves = {n: tables[n].withColumn("half", F.pmod(F.xxhash64("*"), F.lit(2))) for n in incremental.FACTS}
    # Written first where rows come from a join or a sum; the others are columns of one table, read for each half.
    halves |= {n: io.materialize(halves[n]) for n in ("fact_revenue", "fact_customer_usage")}
    for half in (0, 1):
        for name, rows in halves.items():
            io.append_rows(rows.where(F.col("half") == half).drop("half"), f"{path}/{name}")
        incremental.append(spark, path, state)
    return rounded(incremental.summary(spark, path, state), **MEANS)


@query
def monthly_summary(spark, folder):
    return rounded(summaries.monthly_summary(star.processed_tables(spark, folder)), **MEANS)


@query
def series_summary(spark, folder):
    return rounded(_series_summary(spark, folder), **MEANS)


@query
def latest_months(spark, folder):
    summary = summaries.monthly_summary(star.processed_tables(spark, folder))
    return summaries.latest_months(summary).select(
        "month", "total_revenue", "new_revenue", "expansion_revenue", "renewal_revenue",
        "churn_revenue", "mrr", "arr", "active_customers",
    )


# --- dashboard ------------------------------------------------------------------


def _selection(spark, folder) -> dict[str, DataFrame]:
    return dashboard.select_dashboard(star.processed_tables(spark, folder), CHOICE)


@query
def filtered_star(spark, folder):
    chosen = filters.apply_filters(star.processed_tables(spark, folder), CHOICE)

    def facts(table: str, label: str, day: str, amount: str) -> DataFrame:
        return chosen[table].select(
            F.lit(label).alias("fact"),
            "customer_id",
            "subscription_id",
            F.col(day).alias("fact_date"),
            F.col(amount).alias("amount"),
        )

    return (
        facts("fact_revenue", "revenue", "revenue_date", "net_revenue")
        .unionByName(facts("fact_churn", "churn", "churn_date", "mrr_lost"))
        .unionByName(facts("fact_subscription", "subscription", "start_date", "mrr"))
    )


@query
def filter_options(spark, folder):
    tables = star.processed_tables(spark, folder)
    return filters.filter_options(
        tables["dim_customer"], tables["dim_product_plan"], tables["fact_revenue"]
    )


@query
def tier_catalog(spark, folder):
    return filters.tier_catalog(star.processed_tables(spark, folder)["dim_product_plan"])


def _filtered_series(spark, folder) -> DataFrame:
    return dashboard.monthly_series(_selection(spark, folder), CHOICE)


@query
def monthly_series(spark, folder):
    return _filtered_series(spark, folder)


@query
def kpi_summary(spark, folder):
    return rounded(
        dashboard.kpi_summary(_filtered_series(spark, folder)),
        total_revenue=2, current_mrr=2, current_arr=2, churned_revenue=2,
    )


@query
def kpi_trends(spark, folder):
    return rounded(dashboard.kpi_trends(_filtered_series(spark, folder)), pct_change=6)


@query
def revenue_by_segment(spark, folder):
    return dashboard.revenue_by_segment(_selection(spark, folder))


@query
def revenue_by_product(spark, folder):
    return dashboard.revenue_by_product(_selection(spark, folder))


# --- features -------------------------------------------------------------------


def _series(spark, folder) -> DataFrame:
    return summaries.revenue_series(star.processed_tables(spark, folder), SERIES)


def _series_summary(spark, folder) -> DataFrame:
    return summaries.monthly_summary(star.processed_tables(spark, folder), SERIES)


def _features(spark, folder) -> DataFrame:
    return features.build_features(_series_summary(spark, folder), SERIES)


def _aliased(columns) -> list:
    return [c.alias(n) for n, c in columns.items()]


DEVIATIONS = {f"revenue_rolling_std_{n}": 2 for n in features.ROLLING}
ROLLING_DIGITS = {f"revenue_rolling_mean_{n}": 6 for n in features.ROLLING} | DEVIATIONS
RATIO_DIGITS = dict.fromkeys(
    (
        "revenue_growth_mom_prev", "revenue_growth_yoy_prev", "churn_rate_prev",
        "avg_active_users_prev", "avg_feature_usage_prev", "win_rate_prev",
    ),
    6,
)


@query
def revenue_lags(spark, folder):
    columns = features.lag_columns(features.by_month(SERIES))
    return _series(spark, folder).select(*SERIES, "month", "total_revenue", *_aliased(columns))


@query
def revenue_rolling(spark, folder):
    columns = features.rolling_columns(features.by_month(SERIES))
    return rounded(
        _series(spark, folder).select(*SERIES, "month", *_aliased(columns)), **ROLLING_DIGITS
    )


@query
def revenue_growth(spark, folder):
    columns = features.growth_columns(features.by_month(SERIES))
    return rounded(
        _series(spark, folder).select(*SERIES, "month", *_aliased(columns)), **RATIO_DIGITS
    )


@query
def feature_table(spark, folder):
    return rounded(_features(spark, folder), **ROLLING_DIGITS, **RATIO_DIGITS)


@query
def leak_correlation(spark, folder):
    table = rounded(_features(spark, folder), **ROLLING_DIGITS)
    return rounded(features.strongest_correlations(table, SERIES), abs_correlation=6)


@query
def ffill_horizon(spark, folder):
    # Written, as the horizon reads the summary twice.
    summary = io.materialize(_series_summary(spark, folder))
    extended = features.append_horizon(summary, forecasts.HORIZON, SERIES)
    predictors = features.feature_columns(extended, (*SERIES, "step"))
    carried = features.carried_columns(predictors)
    future = extended.where(F.col("step") > 0)
    return rounded(
        future.select(*SERIES, "step", "month", "calendar_month", "time_index", *carried),
        **RATIO_DIGITS,
    )


# --- back-tests and forecasts ---------------------------------------------------


def _backtests(spark, folder, *models) -> DataFrame:
    """Back-tests of the window models, or of some of them."""
    chosen = models or forecasting.WINDOW_MODELS
    return forecasting.walk_forward(_series(spark, folder), SERIES, chosen)


def _backtest_query(model: str) -> Query:
    return lambda spark, folder: predictions(_backtests(spark, folder, model))


QUERIES |= {
    "bt_naive": _backtest_query("naive"),
    "bt_seasonal_naive": _backtest_query("seasonal_naive"),
    "bt_moving_avg_3": _backtest_query("moving_avg_3"),
    "bt_drift": _backtest_query("drift"),
    "bt_holt": _backtest_query("holt_linear"),
    "walk_forward_window": lambda spark, folder: predictions(_backtests(spark, folder)),
}


def _tree_query(model: trees.TreeModel) -> Query:
    return lambda spark, folder: trees.backtest_trees(
        io.materialize(_features(spark, folder)), model, SERIES
    )


QUERIES |= {"bt_gbt": _tree_query(trees.GBT), "bt_gbt_min5": _tree_query(trees.GBT_MIN5)}


def _seven(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The summary, its features, and the back-tests of all seven models, as a refresh makes them."""
    summary = io.materialize(_series_summary(spark, folder))
    table = io.materialize(features.build_features(summary, SERIES))
    backtests = forecasting.walk_forward(summary, SERIES, forecasting.MODELS, table)
    return summary, table, backtests


def _points(summary: DataFrame, table: DataFrame) -> DataFrame:
    return forecasting.future_points(summary, SERIES, forecasting.MODELS, table)


@query
def walk_forward(spark, folder):
    """One-step predictions of all seven models."""
    return predictions(_seven(spark, folder)[2])


@query
def eligible_series(spark, folder):
    return baselines.eligible_series(_series(spark, folder), SERIES)


def _both(name: str, make: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> None:
    """A query over all seven models, and `name`_window over the five that SQL can repeat.

    `make` gets the series, their back-tests and what makes the points ahead.
    """

    def seven(spark, folder):
        summary, table, backtests = _seven(spark, folder)
        backtests = io.materialize(backtests)
        return make(summary, backtests, lambda: _points(summary, table))

    def window(spark, folder):
        series = _series(spark, folder)
        backtests = forecasting.walk_forward(series, SERIES, forecasting.WINDOW_MODELS)
        return make(series, backtests, lambda: forecasting.future_points(series, SERIES, forecasting.WINDOW_MODELS))

    QUERIES[name], QUERIES[f"{name}_window"] = seven, window


def _revenue_forecast(series, backtests, points) -> DataFrame:
    board = evaluate.leaderboard(backtests, SERIES)
    result = forecasts.revenue_forecast(points(), board, series, SERIES)
    return rounded(
        result.drop("created_at"),
        predicted_revenue=4, lower_bound=2, upper_bound=2, forecast_growth=6,
    )


_both(
    "backtest_metrics",
    lambda series, backtests, points: rounded(
        evaluate.backtest_metrics(backtests, SERIES), mae=4, rmse=4, mape=6, residual_std=4
    ),
)
_both(
    "leaderboard",
    lambda series, backtests, points: rounded(
        evaluate.leaderboard(backtests, SERIES).drop("residual_std", "evaluated_at"), mae=4, rmse=4, mape=6
    ),
)
_both(
    "accuracy_table",
    lambda series, backtests, points: evaluate.accuracy_table(evaluate.leaderboard(backtests, SERIES), SERIES),
)
_both(
    "hist_vs_predicted",
    lambda series, backtests, points: predictions(
        evaluate.historical_vs_predicted(backtests, evaluate.leaderboard(backtests, SERIES), SERIES), "predicted_revenue"
    ),
)
_both("revenue_forecast", _revenue_forecast)
_both(
    "actual_plus_forecast",
    lambda series, backtests, points: forecasts.actual_plus_forecast(
        series.select(*SERIES, "month", "total_revenue"), _revenue_forecast(series, backtests, points), SERIES
    ),
)


@query
def leaderboard_seven(spark, folder):
    """All seven models, the trees included, ranked per series."""
    return evaluate.leaderboard(_seven(spark, folder)[2], SERIES).drop("residual_std", "evaluated_at")


@query
def forecast_trees(spark, folder):
    """The tree models' points for the months after the history."""
    summary = io.materialize(_series_summary(spark, folder))
    table = io.materialize(features.build_features(summary, SERIES))
    return trees.forecast_trees(summary, table, list(trees.TREE_MODELS.values()), forecasts.HORIZON, SERIES)


@query
def forecast_points(spark, folder):
    """Points of all seven models for the months ahead."""
    summary = io.materialize(_series_summary(spark, folder))
    table = io.materialize(features.build_features(summary, SERIES))
    return predictions(_points(summary, table))


@query
def forecast_points_window(spark, folder):
    series = _series(spark, folder)
    return predictions(forecasting.future_points(series, SERIES, forecasting.WINDOW_MODELS))


@query
def forecast_drivers(spark, folder):
    return rounded(
        forecasts.forecast_drivers(_series_summary(spark, folder), SERIES),
        current_value=4, prior_value=4, pct_change=6,
    )


# --- ad-hoc SQL -----------------------------------------------------------------


@query
def adhoc_sql(spark, folder):
    sql = """
        SELECT customer_id, segment, CAST(SUM(net_revenue) AS DOUBLE) AS net_revenue
        FROM fact_revenue JOIN dim_customer USING (customer_id)
        GROUP BY customer_id, segment
        ORDER BY net_revenue DESC, customer_id"""
    return adhoc.run_safe_query(spark, sql, star.processed_tables(spark, folder))


def _questions(spark, folder, models) -> DataFrame:
    """All six saved questions, with the best of these models."""
    processed = star.processed_tables(spark, folder)
    summary = io.materialize(summaries.monthly_summary(processed))
    table = io.materialize(features.build_features(summary))
    backtests = io.materialize(forecasting.walk_forward(summary, (), models, table))
    board = evaluate.leaderboard(backtests)
    points = forecasting.future_points(summary, (), models, table)
    tables = {
        "fact_revenue": processed["fact_revenue"],
        "dim_customer": processed["dim_customer"],
        "fact_churn": processed["fact_churn"],
        "monthly_revenue_summary": summary,
        "model_evaluation_metrics": board,
        "revenue_forecast": forecasts.revenue_forecast(points, board, summary),
    }
    answers = [
        adhoc.saved_question(spark, question, tables).select(
            F.lit(question).alias("question"), "item", F.round("amount", 4).alias("amount")
        )
        for question in adhoc.QUESTIONS
    ]
    return reduce(DataFrame.unionByName, answers)


@query
def saved_questions(spark, folder):
    return _questions(spark, folder, forecasting.MODELS)


@query
def saved_questions_window(spark, folder):
    return _questions(spark, folder, forecasting.WINDOW_MODELS)
