"""Features, back-tests, rankings and forecasts."""

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from recurring_metrics.operators import baselines, evaluate, features, forecast, trees
from recurring_metrics.plans import forecasting
from recurring_metrics.sources.io import materialize
from tests.conftest import rows

KEYS = ["name"]
WAVE = [100 + 3 * i + 20 * math.sin(i * 0.7) + (i * 37 % 11) for i in range(40)]


def wide(spark, make, values, name="A"):
    """A summary-like table: revenue and two described measures."""
    return make.series(values, name=name).select(
        "*",
        (F.col("total_revenue") * 2).alias("mrr"),
        F.month("month").cast("long").alias("active_customers"),
        F.lit(1).cast("long").alias("churned_customers"),
        F.when(F.month("month") != 3, F.col("total_revenue") / 7).alias("win_rate"),
    )


def test_features_of_a_series(spark, make):
    got = features.build_features(wide(spark, make, WAVE), KEYS).orderBy("month").collect()
    last, y = got[-1], WAVE
    assert last.time_index == 39 and last.calendar_month == 4
    assert [last[f"revenue_lag_{k}"] for k in (1, 2, 3, 6, 12)] == [y[39 - k] for k in (1, 2, 3, 6, 12)]
    for n in (3, 6, 12):
        window = y[39 - n : 39]
        assert last[f"revenue_rolling_mean_{n}"] == pytest.approx(statistics.mean(window))
        assert last[f"revenue_rolling_std_{n}"] == pytest.approx(statistics.stdev(window))
    assert last.revenue_growth_mom_prev == pytest.approx(y[38] / y[37] - 1)
    assert last.revenue_growth_yoy_prev == pytest.approx(y[38] / y[26] - 1)
    assert last.mrr_prev == pytest.approx(2 * y[38])
    assert last.win_rate_prev is None  # nothing known for March
    assert last.churn_rate_prev == pytest.approx(1 / 2)


def test_incomplete_windows_are_null(spark, make):
    got = features.build_features(wide(spark, make, [1, 2, 3, 4]), KEYS).orderBy("month").collect()
    assert [r.revenue_rolling_mean_3 for r in got] == [None, None, None, 2.0]
    assert [r.revenue_rolling_std_3 for r in got] == [None, None, None, 1.0]
    assert all(r.revenue_lag_6 is None and r.revenue_growth_yoy_prev is None for r in got)


def test_zero_denominators_are_null(spark, make):
    got = features.build_features(wide(spark, make, [0, 5, 6]), KEYS).orderBy("month").collect()
    assert got[2].revenue_growth_mom_prev is None


def test_no_leak_from_later_months(spark, make):
    changed = [v if i < 30 else v * 9 for i, v in enumerate(WAVE)]
    before = dt.date(2022, 7, 1)  # month of index 30

    def known(values):
        table = features.build_features(wide(spark, make, values), KEYS)
        predictors = features.feature_columns(table, KEYS)
        made = make.series(values, name="A")
        tests = forecasting.walk_forward(made, KEYS, forecasting.WINDOW_MODELS)
        return (
            rows(table.where(F.col("month") <= F.lit(before)), "month", *predictors),
            rows(tests.where(F.col("month") <= F.lit(before)), "month", "model_name", "predicted"),
        )

    assert known(WAVE) == known(changed)


def reference_holt(y, horizon):
    best = None
    for a in baselines.SMOOTHING_WEIGHTS:
        for b in baselines.SMOOTHING_WEIGHTS:
            level, trend, sse = y[0], y[1] - y[0], 0.0
            for v in y[1:]:
                expected = level + trend
                new = a * v + (1 - a) * expected
                trend = b * (new - level) + (1 - b) * trend
                level, sse = new, sse + (v - expected) ** 2
            best = min(best or (sse, a, b, level, trend), (sse, a, b, level, trend))
    return [best[3] + h * best[4] for h in range(1, horizon + 1)]


def test_every_fold_uses_only_the_months_before(make):
    got = {
        (r.model_name, r.month): r.predicted
        for r in forecasting.walk_forward(make.series(WAVE, name="A"), KEYS, forecasting.WINDOW_MODELS).collect()
    }
    assert len(got) == 5 * 12
    for i in range(28, 40):
        month = dt.date(2020 + i // 12, i % 12 + 1, 1)
        past = WAVE[:i]
        assert got["naive", month] == past[-1]
        assert got["seasonal_naive", month] == past[-12]
        assert got["moving_avg_3", month] == pytest.approx(statistics.mean(past[-3:]))
        changes = [b - a for a, b in zip(past, past[1:])]
        assert got["drift", month] == pytest.approx(past[-1] + statistics.mean(changes))
        assert got["holt_linear", month] == pytest.approx(reference_holt(past, 1)[0])


def test_short_series_give_null_not_future_values(make):
    short = make.series([5, 7, 9], name="A")
    got = {
        (r.model_name, r.month.month): r.predicted
        for r in forecasting.walk_forward(short, KEYS, forecasting.WINDOW_MODELS, min_training=None).collect()
    }
    assert [got["naive", m] for m in (1, 2, 3)] == [None, 5, 7]
    assert [got["seasonal_naive", m] for m in (1, 2, 3)] == [None] * 3
    assert [got["drift", m] for m in (1, 2, 3)] == [None, None, 9]
    assert got["holt_linear", 3] == pytest.approx(9) and ("holt_linear", 2) not in got
    assert rows(baselines.eligible_series(short, KEYS)) == [("A", 3, -9, False)]
    assert rows(baselines.eligible_series(make.series(range(1, 31), name="A"), KEYS)) == [("A", 30, 18, True)]


def repeated(y, rule, horizon=6):
    grown = list(y)
    for _ in range(horizon):
        grown.append(rule(grown))
    return grown[len(y):]


def test_points_equal_repeating_the_one_step_rule(make):
    points = forecasting.future_points(make.series(WAVE, name="A"), KEYS, forecasting.WINDOW_MODELS)
    got = {}
    for r in points.orderBy("step").collect():
        got.setdefault(r.model_name, []).append(r.predicted)
    assert got["naive"] == [WAVE[-1]] * 6
    assert got["seasonal_naive"] == pytest.approx(repeated(WAVE, lambda y: y[-12]))
    assert got["moving_avg_3"] == pytest.approx(repeated(WAVE, lambda y: statistics.mean(y[-3:])))
    assert got["drift"] == pytest.approx(
        repeated(WAVE, lambda y: y[-1] + (y[-1] - y[0]) / (len(y) - 1))
    )
    assert got["holt_linear"] == pytest.approx(reference_holt(WAVE, 6))
    assert points.agg(F.min("forecast_month")).first()[0] == dt.date(2023, 5, 1)


def test_a_series_begins_with_its_first_billed_month(make):
    late, early = make.series([0.0] * 30 + WAVE[:10], name="late"), make.series(WAVE, name="early")
    gap = make.series([0.0] * 4 + [5.0] + [0.0] * 3 + WAVE[:32], name="gap")
    both = late.union(early).union(gap)
    got = {r["name"]: (r.months, r.eligible) for r in baselines.eligible_series(both, KEYS).collect()}
    assert got == {"late": (10, False), "early": (40, True), "gap": (36, True)}
    tested = forecasting.walk_forward(both, KEYS, forecasting.WINDOW_MODELS)
    assert {r["name"] for r in tested.select("name").distinct().collect()} == {"early", "gap"}
    points = forecasting.future_points(both, KEYS, ["drift"]).where("name = 'gap' AND step = 1").first()
    assert points.predicted == pytest.approx(WAVE[31] + (WAVE[31] - 5) / 35)


def test_incomplete_models_come_last(spark):
    tests = spark.createDataFrame(
        [("A", dt.date(2024, m, 1), model, 10.0, predicted)
         for m in (1, 2) for model, predicted in (("naive", 13.0), ("drift", 10.0 if m == 1 else None))],
        "name string, month date, model_name string, actual double, predicted double",
    )
    got = {r.model_name: (r.folds, r.model_rank) for r in evaluate.leaderboard(tests, KEYS).collect()}
    assert got == {"naive": (2, 1), "drift": (1, 2)}


def test_metrics_and_ranking(spark):
    tests = spark.createDataFrame(
        [("A", dt.date(2024, m, 1), model, actual, predicted)
         for m, actual in ((1, 10.0), (2, 0.0), (3, 20.0))
         for model, predicted in (("naive", 12.0), ("drift", 12.0), ("gbt", None))],
        "name string, month date, model_name string, actual double, predicted double",
    )
    board = evaluate.leaderboard(tests, KEYS, dt.datetime(2024, 5, 1))
    got = {r.model_name: r for r in board.collect()}
    naive = got["naive"]
    assert naive.mae == pytest.approx((2 + 12 + 8) / 3)
    assert naive.rmse == pytest.approx(math.sqrt((4 + 144 + 64) / 3))
    assert naive.mape == pytest.approx((0.2 + 0.4) / 2 * 100)
    assert naive.residual_std == pytest.approx(statistics.stdev([-2, -12, 8]))
    assert [got[m].model_rank for m in ("naive", "drift", "gbt")] == [1, 2, 3]
    assert [got[m].is_best for m in ("naive", "drift", "gbt")] == [True, False, False]
    assert (naive.backtest_start, naive.backtest_end) == (dt.date(2024, 1, 1), dt.date(2024, 3, 1))
    winner = evaluate.historical_vs_predicted(tests, board, KEYS)
    assert rows(winner, "model_name", "month") == [("naive", dt.date(2024, m, 1)) for m in (1, 2, 3)]
    assert [r.model_name for r in evaluate.accuracy_table(board, KEYS).collect()] == ["naive", "drift", "gbt"]


@pytest.mark.parametrize("keys", [KEYS, []])
def test_forecast_interval_and_growth(make, keys):
    series = make.series(WAVE, name="A").drop(*([] if keys else ["name"]))
    tests = forecasting.walk_forward(series, keys, forecasting.WINDOW_MODELS)
    board = evaluate.leaderboard(tests, keys)
    points = forecasting.future_points(series, keys, forecasting.WINDOW_MODELS)
    got = forecast.revenue_forecast(points, board, series, keys).orderBy("forecast_month").collect()
    best = board.where("is_best").first()
    assert len(got) == 6 and {r.model_name for r in got} == {best.model_name}
    before = WAVE[-1]
    for h, r in enumerate(got, 1):
        half = 1.2815515655446004 * best.residual_std * math.sqrt(h)
        assert r.upper_bound - r.predicted_revenue == pytest.approx(half)
        assert r.predicted_revenue - r.lower_bound == pytest.approx(half)
        assert r.forecast_growth == pytest.approx((r.predicted_revenue - before) / before * 100)
        before = r.predicted_revenue
    both = forecast.actual_plus_forecast(series, forecast.revenue_forecast(points, board, series, keys), keys)
    assert rows(both.groupBy("kind").count()) == [("actual", 40), ("forecast", 6)]


def test_drivers(spark, make):
    names = [c for _, c in forecast.DRIVERS]
    month = [dt.date(2024, m, 1) for m in (1, 2, 3, 4, 5)]
    prior = (100.0, 0.0, 10.0, -4.0, 50.0, 1.0, 1.0, None)
    latest = (102.0, 5.0, 10.05, -2.0, 40.0, 1.0, 3.0, 0.5)
    data = [(month[0], *[7.0] * 8), (month[1], *prior), (month[2], *[7.0] * 8),
            (month[3], *[7.0] * 8), (month[4], *latest)]
    schema = "month date, " + ", ".join(f"{n} double" for n in names)
    got = {r.driver_name: r for r in forecast.forecast_drivers(spark.createDataFrame(data, schema)).collect()}
    assert [got[label].direction for label, _ in forecast.DRIVERS] == [
        "up", "n/a", "flat", "down", "down", "flat", "up", "n/a",
    ]
    assert got["Expansion revenue"].pct_change == pytest.approx(-50)
    assert got["MRR"].as_of_month == month[4] and got["MRR"].lookback_months == 3


def test_horizon_rows_hold_the_last_known_values(spark, make):
    summary = wide(spark, make, WAVE)
    extended = features.append_horizon(summary, 3, KEYS)
    assert extended.where("step = 0").count() == 40
    future = extended.where("step > 0").orderBy("step").collect()
    last = summary.orderBy(F.col("month").desc()).collect()
    assert [r.time_index for r in future] == [40, 41, 42]
    assert [r.calendar_month for r in future] == [5, 6, 7]
    assert {r.mrr_prev for r in future} == {last[0].mrr}
    known = [r.win_rate for r in last if r.win_rate is not None]
    assert {r.win_rate_prev for r in future} == {known[0]}
    assert [r.revenue_lag_1 for r in future] == [WAVE[-1], None, None]
    assert all(r.total_revenue is None for r in future)


def test_correlations_rank_the_leak_first(spark, make):
    table = features.build_features(wide(spark, make, WAVE), KEYS)
    leaky = table.withColumn("copy", -F.col("total_revenue")).withColumn("constant", F.lit(1.0))
    top = features.strongest_correlations(leaky, KEYS).collect()
    assert len(top) == 5 and top[0].feature == "copy"
    assert top[0].abs_correlation == pytest.approx(1)
    assert "constant" not in {r.feature for r in top}


SMALL = {m.name: m.with_budget(3, 6) for m in (trees.GBT, trees.GBT_MIN5)}


def test_trees_predict_every_fold_without_later_months(spark, make):
    def table(change):
        frames = [
            wide(spark, make, [v * k * (change if i >= 34 else 1) for i, v in enumerate(WAVE)], n)
            for n, k in (("A", 1), ("B", 2))
        ]
        return materialize(features.build_features(frames[0].union(frames[1]), KEYS))

    plain, changed = table(1), table(5)
    for model in SMALL.values():
        got = trees.backtest_trees(plain, model, KEYS)
        assert rows(got.groupBy("name", "model_name").count()) == [
            ("A", model.name, 12), ("B", model.name, 12),
        ]
        assert got.where("predicted IS NULL OR isnan(predicted)").count() == 0
    first_block = F.col("month") < F.lit(dt.date(2022, 11, 1))
    one, other = (
        rows(trees.backtest_trees(t, SMALL["gbt"], KEYS).where(first_block), "name", "month", "predicted")
        for t in (plain, changed)
    )
    assert one == other


def test_next_features_equal_the_feature_table(spark, make):
    """The array form used for future months agrees with the window form."""
    table = features.build_features(wide(spark, make, WAVE), KEYS)
    last = table.orderBy(F.col("month").desc()).first()
    tail = spark.createDataFrame([(WAVE[26:39],)], "tail array<double>")
    made = trees.next_features(F.col("tail"), F.lit(last.month), F.lit(39))
    got = tail.select(*[c.alias(n) for n, c in made.items()]).first().asDict()
    assert got == pytest.approx({n: last[n] for n in got})


def test_outputs_with_all_models(spark, make):
    summary = wide(spark, make, WAVE)
    for _, column in forecast.DRIVERS:
        if column not in summary.columns:
            summary = summary.withColumn(column, F.col("total_revenue"))
    summary = materialize(summary)
    table = materialize(features.build_features(summary, KEYS))
    out = forecasting.forecast_outputs(summary, table, KEYS, tree_models=SMALL, as_of=dt.datetime(2024, 1, 1))
    board = out["model_evaluation_metrics"]
    assert {r.model_name for r in board.collect()} == set(forecasting.MODELS)
    assert board.where("is_best").count() == 1
    assert out["historical_vs_predicted"].count() == 12
    assert out["revenue_forecast"].where("predicted_revenue IS NOT NULL").count() == 6
    points = trees.forecast_trees(summary, table, SMALL["gbt"], 6, KEYS)
    assert points.where("predicted IS NOT NULL").count() == 6
    with pytest.raises(ValueError, match="unknown"):
        forecasting.walk_forward(summary, KEYS, ["prophet"])
