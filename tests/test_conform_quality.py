"""Conforming rules, CSV reading, writing, and the data-quality reports."""

import datetime as dt
from decimal import Decimal

import pytest

from recurring_metrics.operators import conform, quality
from recurring_metrics.sources import io
from recurring_metrics.sources.schema import RAW_TABLES
from tests.conftest import rows


def test_split_at_the_last_delimiter(spark):
    names = ["Real Estate - Europe", "A - B - C", "Plain", " X  -  Y ", None, "a-b"]
    raw = spark.createDataFrame([(n,) for n in names], "t string")
    left, right = conform.split_last("t")
    assert [tuple(r) for r in raw.select(left, right).collect()] == [
        ("Real Estate", "Europe"), ("A - B", "C"), ("Plain", None), ("X", "Y"), (None, None),
        ("a-b", None),
    ]


def test_plans_rank_tiers_and_unknown_is_null(spark):
    raw = spark.createDataFrame(
        [("1", "P", "Core - Starter", "Monthly", "9.5"), ("2", "P", "Core - Gold", "Annual", "1")],
        "plan_id string, product_id string, plan_name string, billing_frequency string, price string",
    )
    got = conform.conform_plans(raw)
    assert rows(got, "plan_id", "product_family", "plan_tier_name", "plan_tier_order", "price") == [
        ("1", "Core", "Starter", 1, Decimal("9.50")),
        ("2", "Core", "Gold", None, Decimal("1.00")),
    ]


def test_text_is_trimmed_and_timestamps_become_dates(spark):
    raw = spark.createDataFrame(
        [("C", "S", dt.datetime(2024, 1, 31, 23, 59), " Price ", Decimal("3.00"))],
        "customer_id string, subscription_id string, churn_date timestamp, churn_reason string, "
        "mrr_lost decimal(12,2)",
    )
    assert rows(conform.conform_churn(raw), "churn_date", "churn_reason") == [
        (dt.date(2024, 1, 31), "Price")
    ]


def test_usage_without_a_counter_stops(make):
    with pytest.raises(Exception, match="active_users must not be null"):
        conform.conform_usage(make.usage(("C1", "2024-01-01", None, 1, 1, 1, 1))).collect()


def test_csv_follows_the_header_and_reads_empty_as_null(spark, tmp_path):
    path = tmp_path / "plan.csv"
    path.write_text(
        "product_id,plan_id,plan_name,billing_frequency,price\n"
        "PROD1,PLAN1,Core - Starter,Monthly,49\nPROD1,PLAN2,,Annual,\n"
    )
    got = io.read_csv_table(spark, str(path), RAW_TABLES["raw_dim_product_plan"])
    assert got.schema == RAW_TABLES["raw_dim_product_plan"].schema
    assert rows(got) == [
        ("PLAN1", "PROD1", "Core - Starter", "Monthly", Decimal("49.00")),
        ("PLAN2", "PROD1", None, "Annual", None),
    ]


def test_csv_with_a_bad_value_or_missing_column_stops(spark, tmp_path):
    path = tmp_path / "date.csv"
    path.write_text("date,month,quarter,year\n2024-01-01,x,1,2024\n")
    with pytest.raises(Exception):
        io.read_csv_table(spark, str(path), RAW_TABLES["raw_dim_date"]).collect()
    path.write_text("date,month\n2024-01-01,1\n")
    with pytest.raises(io.DataUnavailableError, match="quarter"):
        io.read_csv_table(spark, str(path), RAW_TABLES["raw_dim_date"])


def test_write_append_and_require(spark, tmp_path):
    df, path = spark.range(5), str(tmp_path / "t")
    assert io.write_table(df, path) == 5
    assert io.append_rows(df, path) == 5
    assert spark.read.parquet(path).count() == 10
    assert io.write_table(df, path) == 5
    assert spark.read.parquet(path).count() == 5
    io.require_rows(ids=df)
    with pytest.raises(io.DataUnavailableError, match="none"):
        io.require_rows(ids=df, none=df.where("id < 0"))


def test_create_raw_catalog_tables(spark):
    io.recreate_database(spark, "raw_check", {"raw_dim_date": RAW_TABLES["raw_dim_date"]})
    assert spark.table("raw_check.raw_dim_date").columns == ["date", "month", "quarter", "year"]
    spark.sql("DROP DATABASE raw_check CASCADE")


def test_scratch_space_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = configured or spark.sparkContext.getCheckpointDir()
    assert io.scratch_path(spark, "x").startswith(folder)
    assert io.scratch_path(spark, "x") != io.scratch_path(spark, "x")
    kept = io.materialize(spark.range(3))
    assert rows(kept) == [(0,), (1,), (2,)]


def broken(spark):
    parent = spark.createDataFrame([("a",), ("b",)], "k string")
    child = spark.createDataFrame(
        [("a", 1, dt.date(2024, 1, 1)), ("x", 1, None), ("x", 2, dt.date(2024, 2, 1)), (None, 3, None)],
        "fk string, n int, d date",
    )
    return {"parent": parent, "child": child}


def test_quality_reports_on_broken_tables(spark):
    tables = broken(spark)
    assert rows(quality.orphans(tables, [("child", "fk", "parent", "k")])) == [
        ("child.fk", "parent.k", 3, "FAIL")
    ]
    assert rows(quality.null_counts({"child": tables["child"]})) == [
        ("child", "d", 2), ("child", "fk", 1), ("child", "n", 0),
    ]
    assert rows(quality.duplicate_keys({"child": (tables["child"], ["n"])})) == [("child", 1, 1)]
    assert rows(quality.date_ranges(tables)) == [
        ("child", "d", dt.date(2024, 1, 1), dt.date(2024, 2, 1))
    ]
    short = {"parent": tables["parent"], "child": tables["child"].limit(1)}
    assert rows(quality.reconcile_counts(tables, short)) == [
        ("child", 4, 1, "FAIL"), ("parent", 2, 2, "OK"),
    ]


def test_reports_on_sound_tables(spark):
    parent = spark.createDataFrame([("a",), ("b",)], "k string")
    sound = {"parent": parent, "child": parent.withColumnRenamed("k", "fk")}
    assert rows(quality.orphans(sound, [("child", "fk", "parent", "k")])) == [
        ("child.fk", "parent.k", 0, "OK")
    ]
    assert rows(quality.duplicate_keys({"p": (parent.where("false"), ["k"])})) == [("p", 0, 0)]
