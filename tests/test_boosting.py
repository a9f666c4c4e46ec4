"""Histogram boosting: a split found by hand, blocks against one block, and fits that see no later rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurring_metrics.operators import boosting
from recurring_metrics.operators.boosting import Block, Fit, Forest, Tree

COLUMNS = ["a", "b"]


def table(spark, n=400):
    rows = []
    for i in range(n):
        a, b = (i * 37) % 101, (i * 53) % 17
        rows.append((i, f"20{10 + i % 12:02d}-{1 + i % 7:02d}-01", float(a), float(b), float((a > 50) * 10 + (b > 8) * 3 + i % 2)))
    return spark.createDataFrame(rows, "id long, day string, a double, b double, y double").withColumn("month", F.to_date("day"))


def test_first_split_by_hand():
    """x = 1..6 with y = 0, 0, 0, 9, 9, 12: the best cut lies behind 3, its means are 0 and 10."""
    x = np.array([[1.0], [2], [3], [4], [5], [6]])
    y = np.array([0.0, 0, 0, 9, 9, 12])
    block = Block(boosting.binned(x, [[1, 2, 3, 4, 5]]), y, np.zeros(6, dtype=np.int64), np.arange(6))
    forest = boosting.grow_alone(Fit("one", None, rounds=1, depth=1, step=0.5), block)
    assert forest.base == 5
    tree = forest.trees[0]
    assert (tree.feature[1], tree.cut[1]) == (0, 2)
    assert tree.value[2:4].tolist() == [-2.5, 2.5]
    assert forest.predict(block.bins).tolist() == [2.5] * 3 + [7.5] * 3
    # Two rows a side at least; the third level finds nothing more to split on the left.
    deeper = boosting.grow_alone(Fit("two", None, 1, 3, 1.0, min_rows=2), block)
    assert deeper.predict(block.bins).tolist() == [0, 0, 0, 10, 10, 10]
    free = boosting.grow_alone(Fit("three", None, 1, 3, 1.0), block)
    assert free.predict(block.bins).tolist() == y.tolist()


def test_bins_hold_their_cut():
    assert boosting.binned(np.array([[1.0], [2.0], [2.5], [9.0]]), [[2.0, 3.0]]).ravel().tolist() == [0, 0, 1, 2]


def test_blocks_give_what_one_block_gives(spark):
    rows = table(spark).repartition(5)
    cuts = boosting.quantile_cuts(rows, COLUMNS)
    fits = [
        Fit("all", None, 23, 3, 0.3, 0.9, 0.9), Fit("few", 2014 * 12, 12, 2, 0.5, min_rows=5), Fit("none", 0, 5, 3, 0.1)
    ]
    args = (rows, COLUMNS, "y", "month", ["id"], cuts)
    one, count = boosting.blocks_of(*args)
    many, again = boosting.blocks_of(*args, most=60)
    assert count == again == 400 and one.count() == 1 and many.count() > 1
    alone, together = boosting.fit_forests(one, count, fits), boosting.fit_forests(many, count, fits, most=60)
    values = np.array(rows.select(*COLUMNS, "y").collect(), dtype=np.float64)
    bins, y = boosting.binned(values[:, :2], cuts), values[:, 2]
    for a, b in zip(alone, together):
        assert len(a.trees) == len(b.trees)
        assert a.predict(bins) == pytest.approx(b.predict(bins))
    assert np.abs(alone[0].predict(bins) - y).mean() < 0.8
    assert alone[2].predict(bins).tolist() == [0.0] * 400


def test_a_fit_sees_no_later_rows(spark):
    rows = table(spark)
    cuts = boosting.quantile_cuts(rows, COLUMNS)
    late = rows.withColumn("y", F.when(F.col("month") >= "2015-01-01", F.col("y") * 100).otherwise(F.col("y")))
    fit = Fit("past", 2015 * 12, 20, 3, 0.3, 0.8, 0.9)
    forests = [
        boosting.fit_forests(*boosting.blocks_of(r, COLUMNS, "y", "month", ["id"], cuts), [fit])[0] for r in (rows, late)
    ]
    bins = boosting.binned(np.array(rows.select(*COLUMNS).collect(), dtype=np.float64), cuts)
    assert forests[0].predict(bins).tolist() == forests[1].predict(bins).tolist()


def test_predictions_by_fold(spark):
    low, high = Forest(1.0, []), Forest(0.0, [Tree(np.array([-1, 0, -1, -1]), np.array([0, 0, 0, 0]), np.array([0, 0, -5.0, 5.0]))])
    rows = spark.createDataFrame([(0, 1.0), (1, 1.0), (1, 3.0), (1, None)], "fold int, a double")
    got = boosting.predicted(rows, ["a"], [[2.0]], [low, high], "fold").collect()
    assert [r["predicted"] for r in got] == [1.0, -5.0, 5.0, -5.0]
    assert boosting.predicted(rows.where("false"), ["a"], [[2.0]], [low], "fold").count() == 0
