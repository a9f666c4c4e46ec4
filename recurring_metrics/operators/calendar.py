"""The month spine and the roll-up of monthly contributions onto it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType

from recurring_metrics.functions.dates import month_floor, month_range

# Contributions that become a level through a running sum.
RUNNING = ("mrr", "active_customers")
# Counted once per customer and month, however many rows contribute.
ONCE_PER_CUSTOMER = ("usage_customer_count",)
# Fixed value: tasks that the rows of one customer are dealt to in the join with the customers.
SPREAD = 16


def series_list(customers: DataFrame, series_keys: Sequence[str]) -> DataFrame:
    """Distinct complete combinations of the customer attributes in series_keys."""
    return customers.select(*series_keys).dropna().distinct()


def revenue_spine(
    revenue: DataFrame, customers: DataFrame | None = None, series_keys: Sequence[str] = ()
) -> DataFrame:
    """Every month from the first to the last billed one, for each series.

    The bounds are those of all revenue, so that series stay comparable.
    """
    bounds = revenue.agg(
        F.min(month_floor("revenue_date")).alias("first_month"),
        F.max(month_floor("revenue_date")).alias("last_month"),
    )
    months = bounds.select(month_range(F.col("first_month"), F.col("last_month")).alias("months"))
    if not series_keys:
        return months.select(F.explode("months").alias("month"))
    return series_list(customers, series_keys).select(
        *series_keys, F.explode(months.scalar()).alias("month")
    )


def fixed_spine(
    spark: SparkSession,
    first_month: dt.date,
    last_month: dt.date,
    customers: DataFrame | None = None,
    series_keys: Sequence[str] = (),
) -> DataFrame:
    """The months of a chosen range, for each series."""
    months = F.explode(month_range(F.lit(first_month), F.lit(last_month))).alias("month")
    if not series_keys:
        return spark.range(1).select(months)
    return series_list(customers, series_keys).select(*series_keys, months)


def _stacked(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _measures(block: DataFrame) -> list[str]:
    return [c for c in block.columns if c not in ("customer_id", "month")]


def sum_block(block: DataFrame) -> DataFrame:
    """A block with customers as one row per customer and month; can be repeated on its own results."""
    return block.groupBy("customer_id", "month").agg(
        *[(F.max if m in ONCE_PER_CUSTOMER else F.sum)(m).alias(m) for m in _measures(block)]
    )


def _family(kind: DataType) -> str:
    """Measures of one family can share a slot."""
    if isinstance(kind, IntegralType):
        return "whole"
    return "amount" if isinstance(kind, DecimalType) else kind.simpleString()


def _slots(blocks: Sequence[DataFrame]) -> list[dict[str, str]]:
    """For each block its measures' slots: the first of a family is `whole_1`, the second `whole_2` ..."""
    found = []
    for block in blocks:
        counts: dict[str, int] = {}
        found.append({})
        for measure in _measures(block):
            family = _family(block.schema[measure].dataType)
            counts[family] = counts.get(family, 0) + 1
            found[-1][measure] = f"{family}_{counts[family]}"
    return found


def _owned_per_series(
    blocks: Sequence[DataFrame], series_of: DataFrame, series_keys: Sequence[str]
) -> DataFrame:
    """Blocks with customers, joined with the customers' series once and summed to series and month.

    The blocks are stacked in as many columns as the widest of them has measures, told
    apart by `_block`: a row that held every block's measures would be mostly empty, and as
    costly to move and to sum as a full one. A customer's rows are dealt to SPREAD parts
    by a hash of the row, and the customers repeated once per part, so a customer with a
    large share of all facts is no hot key and the rows need no sum before the join. The
    customers are hashed per task, so the stacked rows are not sorted.
    """
    slots = _slots(blocks)
    part = F.pmod(F.xxhash64("*"), F.lit(SPREAD)).cast("int").alias("_part")
    stacked = _stacked(
        [
            b.select(
                "customer_id", "month", F.lit(i).alias("_block"), part, *[F.col(m).alias(s) for m, s in own.items()]
            )
            for i, (b, own) in enumerate(zip(blocks, slots))
        ]
    )
    parts = F.explode(F.array(*[F.lit(i) for i in range(SPREAD)])).alias("_part")
    totals = (
        stacked.join(series_of.select("*", parts).hint("shuffle_hash"), ["customer_id", "_part"])
        .groupBy(*series_keys, "month", "_block")
        .agg(*[F.sum(s).alias(s) for s in sorted({s for own in slots for s in own.values()})])
    )
    values: dict[str, list[Column]] = {}
    for i, (b, own) in enumerate(zip(blocks, slots)):
        kinds = b.agg(*[F.sum(m).alias(m) for m in own]).schema
        for m, s in own.items():
            value = F.when(F.col("_block") == i, F.col(s).cast(kinds[m].dataType))
            values.setdefault(m, []).append(value)
    return totals.select(*series_keys, "month", *[F.coalesce(*v).alias(m) for m, v in values.items()])


def _per_series(
    blocks: Sequence[DataFrame], series_of: DataFrame | None, series_keys: Sequence[str]
) -> list[DataFrame]:
    """The blocks summed to series and month: those with customers together, the others one by one."""
    dated = [block.where(F.col("month").isNotNull()) for block in blocks]
    alone = [b for b in dated if "customer_id" not in b.columns]
    # A block counted once per customer and month is first made one row for each.
    owned = [
        sum_block(b) if set(ONCE_PER_CUSTOMER) & set(b.columns) else b for b in dated if "customer_id" in b.columns
    ]
    if series_of is None:
        alone, owned = alone + owned, []
    summed = [
        b.groupBy(*series_keys, "month").agg(*[F.sum(m).alias(m) for m in _measures(b) if m not in series_keys])
        for b in alone
    ]
    return summed + ([_owned_per_series(owned, series_of, series_keys)] if owned else [])


def roll_up(
    blocks: Sequence[DataFrame],
    spine: DataFrame,
    customers: DataFrame | None = None,
    series_keys: Sequence[str] = (),
) -> DataFrame:
    """Sums all contribution blocks per series and month of the spine.

    Blocks are reduced to a row per series and month, with partial sums before
    each shuffle; only these small results are stacked and brought together with
    the spine. Months without a contribution get zero;
    months outside the spine only feed the running sums.
    """
    series_of = (
        customers.select("customer_id", *series_keys).dropna(subset=list(series_keys))
        if series_keys
        else None
    )
    marked = spine.select(*series_keys, "month", F.lit(True).alias("on_spine"))
    stacked = _stacked([*_per_series(blocks, series_of, series_keys), marked])
    measures = [c for c in stacked.columns if c not in (*series_keys, "month", "on_spine")]
    filled = stacked.groupBy(*series_keys, "month").agg(
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures],
        F.bool_or("on_spine").alias("on_spine"),
    )
    so_far = (
        Window.partitionBy(*series_keys)
        .orderBy("month")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    levels = [
        F.sum(m).over(so_far).alias(m) if m in RUNNING else F.col(m) for m in measures
    ]
    return (
        filled.select(*series_keys, "month", *levels, "on_spine")
        .where(F.col("on_spine"))
        .drop("on_spine")
    )
