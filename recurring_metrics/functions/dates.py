"""Calendar-month column expressions.

Every helper casts to DATE first, so a timestamp late on the last day of a
month still belongs to that month.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def month_floor(value: Column | str) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(as_column(value).cast("date"), "MM")


def month_end(value: Column | str) -> Column:
    """Last day of the month, as DATE."""
    return F.last_day(as_column(value).cast("date"))


def next_month(value: Column | str, step: int = 1) -> Column:
    """First day of the month `step` months after the month of `value`."""
    return F.add_months(month_floor(value), step)


def month_range(first: Column, last: Column) -> Column:
    """All month starts from `first` to `last`; empty when last < first.

    The guard matters: `sequence` raises on reversed bounds.
    """
    step = F.expr("interval 1 month")
    return F.when(first <= last, F.sequence(first, last, step)).otherwise(
        F.array().cast("array<date>")
    )


def calendar_parts(value: Column | str) -> dict[str, Column]:
    """The month scalars used across the package, by output name."""
    day = as_column(value).cast("date")
    return {
        "month_start": month_floor(day),
        "month_end": month_end(day),
        "following_month": next_month(day),
        "calendar_month": F.month(day),
        "calendar_quarter": F.quarter(day),
        "calendar_year": F.year(day),
    }
