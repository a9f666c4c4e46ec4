"""Tree models forecast together: one binning and one set of steps, the same points as one by one."""

from pyspark.sql import functions as F

from recurring_metrics.operators import boosting, features, trees
from recurring_metrics.plans import forecasting
from recurring_metrics.sources.io import materialize
from tests.conftest import rows

KEYS = ["name"]
SMALL = {m.name: m.with_budget(3, 6) for m in (trees.GBT, trees.GBT_MIN5)}


def prepared(make):
    one, two = (make.series([10 + a * (i % 7) + i for i in range(40)], name=n) for a, n in ((1, "A"), (3, "B")))
    series = one.union(two).withColumn("active_customers", F.lit(5)).withColumn("churned_customers", F.month("month") % 3)
    summary = materialize(series)
    return summary, materialize(features.build_features(summary, KEYS))


def test_models_together_give_what_each_gives_alone(make):
    summary, table = prepared(make)
    models = list(SMALL.values())
    alone = [r for m in models for r in rows(trees.forecast_trees(summary, table, m, 3, KEYS))]
    together = rows(trees.forecast_trees(summary, table, models, 3, KEYS))
    assert len(together) == 2 * 2 * 3 and sorted(alone, key=str) == sorted(together, key=str)
    assert {r[-2] for r in together} == set(SMALL)


def test_both_models_are_fitted_at_once(make, monkeypatch):
    """Before, every model binned the table and wrote the steps for itself."""
    summary, table = prepared(make)
    calls = []
    monkeypatch.setattr(trees, "fit_forests", lambda b, n, fits, *a: calls.append(len(fits)) or boosting.fit_forests(b, n, fits, *a))
    points = forecasting.future_points(summary, KEYS, list(SMALL), table, SMALL, horizon=1)
    assert points.count() == 4 and calls == [2]
