"""The monthly summary from mergeable state: an append reads new fact files only.

The facts grow by files; customers, plans and subscriptions are corrected in place (an end
date is set later) and stay tables that are read whole. For every fact the state holds
sums per customer and month. Sums of parts can be summed again, so an append writes the
sums of its new files as a batch beside the earlier ones, and touches none of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurring_metrics.functions.dates import month_floor
from recurring_metrics.operators.calendar import sum_block
from recurring_metrics.plans.summary import FACT_BLOCKS, monthly_summary
from recurring_metrics.sources import versions
from recurring_metrics.sources.io import DataUnavailableError, write_table

REVENUE = "fact_revenue"
FACTS = (REVENUE, *FACT_BLOCKS)
FILES = "counted_files"


def _revenue_sums(revenue: DataFrame) -> DataFrame:
    """Revenue summed to customer and month; 'New' rows keep their subscription.

    Which of those are new and which expansion depends on the customer's first
    subscription, which a later append may change, so it is decided when read. The
    result has the columns of revenue and can be used, and summed, in its place.
    """
    is_new = F.coalesce(F.col("revenue_type") == "New", F.lit(False))
    return revenue.groupBy(
        "customer_id",
        F.when(is_new, F.col("subscription_id")).alias("subscription_id"),
        month_floor("revenue_date").alias("revenue_date"),
        F.when(is_new, F.lit("New")).alias("revenue_type"),
    ).agg(F.sum("net_revenue").cast("decimal(28,2)").alias("net_revenue"))


def _sums(name: str, fact: DataFrame) -> DataFrame:
    if name == REVENUE:
        return _revenue_sums(fact)
    return sum_block(FACT_BLOCKS[name](fact, True).where(F.col("month").isNotNull()))


def _merged(name: str, parts: DataFrame) -> DataFrame:
    """Sums of sums, with the types that they had."""
    summed = _revenue_sums(parts) if name == REVENUE else sum_block(parts)
    return summed.select(*[F.col(f.name).cast(f.dataType) for f in parts.schema])


def _state(spark: SparkSession, root: str, seen: dict, name: str) -> DataFrame:
    """The rows of all batches of one fact."""
    folders = [f"{root.rstrip('/')}/{batch}/{name}" for batch, facts in seen["batches"].items() if name in facts]
    if not folders:
        raise DataUnavailableError(f"no {name} has been counted yet")
    return spark.read.parquet(*folders)


def _counted_files(spark: SparkSession, root: str, seen: dict) -> dict[str, set[str]]:
    """The files behind the state, by fact; as many names as Spark lists for a scan of the facts."""
    if not seen["batches"]:
        return {}
    folders = [f"{root.rstrip('/')}/{batch}/{FILES}" for batch in seen["batches"]]
    rows = spark.read.schema("fact string, file string").parquet(*folders).collect()
    return {name: {r.file for r in rows if r.fact == name} for name in FACTS}


def append(spark: SparkSession, tables: str, root: str) -> dict[str, int]:
    """Counts the fact files under `tables` that the state under `root` has not seen yet.

    Returns the new files per fact. The new batch becomes visible when all of it is
    written; an append that fails leaves the state as it was. A counted file that is
    gone means that a fact was rewritten: its sums cannot be taken back, so
    that is refused, and the state has to be built anew under another root.
    """
    before = versions.current(spark, root)
    seen = before or {"batches": {}}
    counted = _counted_files(spark, root, seen)
    new: dict[str, list[str]] = {}
    for name in FACTS:
        known = counted.get(name, set())
        files = set(spark.read.parquet(f"{tables.rstrip('/')}/{name}").inputFiles())
        if lost := known - files:
            raise DataUnavailableError(f"{name}: {len(lost)} counted files are gone, build the state anew")
        new[name] = sorted(files - known)
    grown = [name for name in FACTS if new[name]]
    if grown:
        batch = versions.new_folder("batch")
        for name in grown:
            fact = spark.read.parquet(*new[name])
            write_table(_sums(name, fact), f"{root.rstrip('/')}/{batch}/{name}")
        _publish(spark, root, before, {**seen["batches"], batch: grown}, batch, new)
    return {name: len(files) for name, files in new.items()}


def _publish(spark, root, before, batches: dict, batch: str, files: dict) -> None:
    listed = [(name, file) for name in FACTS for file in files[name]]
    write_table(spark.createDataFrame(listed, "fact string, file string"), f"{root.rstrip('/')}/{batch}/{FILES}")
    versions.publish(spark, root, {"batches": batches}, before)


def compact(spark: SparkSession, root: str) -> None:
    """Sums all batches into one; readers see the old ones until it is complete."""
    before = versions.current(spark, root)
    if before is None or len(before["batches"]) < 2:
        return
    batch = versions.new_folder("batch")
    facts = sorted(reduce(set.union, map(set, before["batches"].values())))
    for name in facts:
        write_table(_merged(name, _state(spark, root, before, name)), f"{root.rstrip('/')}/{batch}/{name}")
    files = {name: sorted(found) for name, found in _counted_files(spark, root, before).items()}
    _publish(spark, root, before, {batch: facts}, batch, files)


def summary(spark: SparkSession, tables: str, root: str, series_keys: Sequence[str] = ()) -> DataFrame:
    """`monthly_summary` from the state and the tables that are read whole; no fact file is read."""
    seen = versions.current(spark, root)
    if seen is None:
        raise DataUnavailableError(f"{root} has no state yet")
    read = {n: spark.read.parquet(f"{tables.rstrip('/')}/{n}") for n in ("dim_customer", "fact_subscription")}
    read[REVENUE] = _state(spark, root, seen, REVENUE)
    return monthly_summary(read, series_keys, {name: _state(spark, root, seen, name) for name in FACT_BLOCKS})
