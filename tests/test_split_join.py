"""Semi-joins with heavy keys: the same rows, and no task far larger than the others."""

import statistics

import pytest
from pyspark.sql import functions as F

from recurring_metrics.operators.filters import DashboardFilter, apply_filters
from recurring_metrics.operators.split_join import heavy_keys, known_keys, owned_facts
from tests.conftest import rows
from tests.test_dashboard import YEAR, tables


@pytest.fixture
def plain_shuffles(spark):
    """No adaptive execution, no broadcast of sides that Spark thinks small."""
    chosen = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name) for name in chosen}
    for name, value in chosen.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def task_rows(df):
    """Rows of the result per task of the join."""
    counted = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    return [r.n for r in counted.collect()]


def facts_with_a_heavy_subscription(spark):
    """60,000 bills of 2,000 subscriptions; one of them has a third."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 2000)
    return spark.range(60_000).select(
        (key % 500).alias("customer_id"), key.alias("subscription_id"), F.col("id").alias("amount")
    )


def test_a_third_of_the_rows_on_one_subscription(spark, plain_shuffles):
    facts = facts_with_a_heavy_subscription(spark)
    customers = spark.range(500).withColumnRenamed("id", "customer_id")
    subscriptions = spark.range(1900).select((F.col("id") % 500).alias("customer_id"), F.col("id").alias("subscription_id"))
    parts = heavy_keys(facts, ["subscription_id"])["subscription_id"]
    assert len(parts) == 1 and 40 < max(parts.values()) < 46
    got = owned_facts(facts, customers, subscriptions, parts)
    sizes = task_rows(got.where("customer_id >= 0"))
    assert len(sizes) == 16 and max(sizes) <= 2 * statistics.median(sizes)
    plain = facts.join(subscriptions, "subscription_id", "left_semi")
    assert max(task_rows(plain)) > 4 * statistics.median(task_rows(plain))
    assert rows(got, "amount") == rows(plain, "amount")


def test_a_third_of_the_subscriptions_with_one_customer(spark, plain_shuffles):
    subscriptions = facts_with_a_heavy_subscription(spark).drop("customer_id").withColumnRenamed("subscription_id", "customer_id")
    known = spark.range(1000).withColumnRenamed("id", "customer_id")
    parts = heavy_keys(subscriptions, ["customer_id", "amount"])
    assert len(parts["customer_id"]) == 1 and not parts["amount"]
    got = known_keys(subscriptions, known, "customer_id", parts["customer_id"])
    sizes = task_rows(got)
    assert max(sizes) <= 2 * statistics.median(sizes)
    assert rows(got) == rows(subscriptions.join(known, "customer_id", "left_semi").select(*subscriptions.columns))


def test_pairs_that_contradict_their_subscription_are_looked_up(spark, make):
    facts = make.revenue(
        ("C1", "S1", "2024-01-01", 1, "New"), ("C1", "S1", "2024-01-01", 1, "New"), ("C2", "S1", "2024-01-01", 2, "New"),
        ("C3", "S1", "2024-01-01", 3, "New"), (None, "S1", "2024-01-01", 4, "New"), ("C1", None, "2024-01-01", 5, "New"),
    )
    customers = make.customers(("C1", "a", "b"), ("C2", "a", "b"), ("C2", "a", "b"))
    subscriptions = make.subscriptions(("S1", "C1", "2024-01-01", None, 1), ("S1", "C1", "2024-01-01", None, 1))
    parts = heavy_keys(facts, ["subscription_id"])["subscription_id"]
    assert parts and not heavy_keys(facts.where("false"), ["subscription_id"])["subscription_id"]
    got = owned_facts(facts, customers, subscriptions, parts)
    assert [int(r[0]) for r in rows(got, "net_revenue")] == [1, 1, 2]
    assert got.columns == facts.columns
    assert owned_facts(facts.where("false"), customers, subscriptions, parts).isEmpty()
    assert owned_facts(facts, customers, subscriptions.where("false"), {}).isEmpty()


@pytest.mark.parametrize("choice", [YEAR, DashboardFilter(YEAR.start_month, YEAR.end_month, ("SMB",), (), ("Core",))])
def test_split_and_plain_filters_agree(make, choice):
    split, plain = (apply_filters(tables(make), choice, split=s) for s in (True, False))
    assert {n: rows(df, *sorted(df.columns)) for n, df in split.items()} == {
        n: rows(df, *sorted(df.columns)) for n, df in plain.items()
    }
