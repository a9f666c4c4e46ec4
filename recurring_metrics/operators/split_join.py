"""Joins whose heavy keys are split over many tasks, without adaptive execution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy when its rows would fill this part of an average task.
HEAVY_SHARE = 0.5
# Parts that the rows of a heavy key make, for each average task that they would fill.
PARTS_PER_TASK = 8
# Entries that a sketch keeps per task; it then errs by a ninth of an average task at most.
TRACKED_PER_TASK = 32
# Fixed value: the most entries a sketch may keep.
MOST_TRACKED = 1_000_000

# Key column -> parts by fingerprint of the key, for heavy keys only.
Parts = dict[str, dict[int, int]]


def heavy_keys(rows: DataFrame, columns: Sequence[str]) -> Parts:
    """The heavy keys of each column, found by one pass that reads these columns only.

    The pass keeps a frequent-items sketch of fingerprints per task; nothing is shuffled
    but the sketches. There are at most 1 / HEAVY_SHARE heavy keys for each shuffle partition,
    so what comes to the driver, and what is later sent to the tasks, is bounded.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(int(tasks / HEAVY_SHARE), MOST_TRACKED)
    tracked = min(max(1024, TRACKED_PER_TASK * tasks), MOST_TRACKED)
    found = rows.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.expr(f"approx_top_k(xxhash64(`{c}`), {most}, {tracked}) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in columns],
    ).first()

    def parts(items) -> dict[int, int]:
        fills = {key: count * tasks / found["total"] for key, count in items or ()}
        return {key: round(part * PARTS_PER_TASK) for key, part in fills.items() if part > HEAVY_SHARE}

    return {c: parts(found[c]) for c in columns}


def dealt(rows: DataFrame, known: DataFrame, on: str, parts: dict[int, int]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join on one column, and the columns to join on.

    The rows of a heavy key are dealt to parts by a hash of all their columns, and the
    known key is repeated once per part. Without heavy keys both sides stay as they are.
    Two keys of one fingerprint are split alike, so results do not hang on it.
    """
    if not parts:
        return rows, known, [on]
    heavy = F.broadcast(rows.sparkSession.createDataFrame(list(parts.items()), "_key long, _parts int"))
    whole = F.coalesce("_parts", F.lit(1))

    def marked(side: DataFrame) -> DataFrame:
        return side.withColumn("_key", F.xxhash64(on)).join(heavy, "_key", "left")

    part = F.pmod(F.xxhash64(*rows.columns), whole).cast("int").alias("_part")
    copies = F.explode(F.sequence(F.lit(0), whole - 1)).alias("_part")
    return (
        marked(rows).select(*rows.columns, part),
        marked(known).select(*known.columns, copies),
        [on, "_part"],
    )


def known_keys(rows: DataFrame, known: DataFrame, on: str, parts: dict[int, int]) -> DataFrame:
    """The rows whose key is in `known`; rows without a key drop out before the shuffle."""
    left, right, keys = dealt(rows.dropna(subset=[on]), known.select(on), on, parts)
    return left.join(right, keys, "left_semi").select(*rows.columns)


def owned_facts(
    facts: DataFrame, customers: DataFrame, subscriptions: DataFrame, parts: dict[int, int]
) -> DataFrame:
    """The facts whose customer is in `customers` and whose subscription is in `subscriptions`.

    Both are checked as one pair, so facts are shuffled once, by subscription. The customer of
    each subscription given is known; a fact that names the same customer needs no look at
    the customers, and only facts that contradict their subscription are looked up there.
    """
    complete = facts.dropna(subset=["customer_id", "subscription_id"])
    owners = subscriptions.groupBy("subscription_id").agg(F.min("customer_id").alias("_owner"))
    left, right, keys = dealt(complete, owners, "subscription_id", parts)
    held = left.join(right, keys)
    same = F.col("customer_id") == F.col("_owner")
    known = customers.select("customer_id")
    differ = held.where(~same).join(known, "customer_id", "left_semi")
    return held.where(same).select(*facts.columns).unionByName(differ.select(*facts.columns))
