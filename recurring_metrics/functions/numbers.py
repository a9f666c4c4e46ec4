"""Ratios and the three percent changes. Division by zero yields NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)


def growth(new: Column, old: Column) -> Column:
    """Plain relative change, as used by the model features."""
    return F.try_divide(new, old) - F.lit(1.0)


def percent_change(new: Column, old: Column) -> Column:
    """Change in percent; keeps the sign of a negative base."""
    return F.try_divide(new - old, old) * F.lit(100.0)


def percent_change_abs(new: Column, old: Column) -> Column:
    """Change in percent against the absolute base, for KPI badges."""
    return F.try_divide(new - old, F.abs(old)) * F.lit(100.0)


def classify_driver(change: Column) -> Column:
    """up / down / flat at one percent, n/a when there is no change value."""
    return (
        F.when(change.isNull(), "n/a")
        .when(change > 1, "up")
        .when(change < -1, "down")
        .otherwise("flat")
    )


def classify_trend(change: Column, good_is_up: Column) -> Column:
    """positive / negative / neutral badge class; NULL without a change value."""
    rising, falling = change > 0.05, change < -0.05
    return (
        F.when(change.isNull(), F.lit(None).cast("string"))
        .when(~rising & ~falling, "neutral")
        .when(rising == good_is_up, "positive")
        .otherwise("negative")
    )
