"""Readers, writers and shared scratch space."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recurring_metrics.sources.schema import RAW_TABLES, RawTable


class DataUnavailableError(RuntimeError):
    """A table the caller depends on is missing or has no rows."""


def read_csv_table(spark: SparkSession, path: str, table: RawTable) -> DataFrame:
    """One CSV file or folder with its declared types; an empty cell is NULL.

    The header names the columns, so their order in the file does not matter.
    A value that does not parse stops the job instead of becoming NULL.
    """
    with_header = spark.read.option("header", True).option("nullValue", "")
    names = with_header.csv(path).columns
    missing = set(table.columns) - set(names)
    if missing:
        raise DataUnavailableError(f"{path} lacks the columns {sorted(missing)}")
    types = {f.name: f.dataType.simpleString() for f in table.schema}
    in_file_order = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
    return (
        with_header.schema(in_file_order)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .csv(path)
        .select(*table.columns)
    )


def load_raw_tables(
    spark: SparkSession, folder: str, tables: Mapping[str, RawTable] = RAW_TABLES
) -> dict[str, DataFrame]:
    """Every raw table of a folder of CSV files, by table name."""
    return {
        name: read_csv_table(spark, f"{folder.rstrip('/')}/{table.file}", table)
        for name, table in tables.items()
    }


def write_csv_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Projected table scan; only these columns are read from the files."""
    return spark.read.parquet(path).select(*columns)


def read_ordered(spark: SparkSession, path: str, order: Sequence[str]) -> DataFrame:
    """Whole table in a stated order."""
    return spark.read.parquet(path).orderBy(*order)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes a Parquet table and returns the rows written.

    The count is taken while writing, so the input is computed once.
    """
    return write_observed(df, path, [F.count(F.lit(1)).alias("rows")], mode)["rows"]


def write_observed(df: DataFrame, path: str, measures: Sequence[Column], mode: str = "overwrite") -> dict:
    """Writes a Parquet table and returns aggregates of its rows, taken while writing."""
    seen = Observation()
    df.observe(seen, *measures).write.mode(mode).parquet(path)
    return seen.get


def append_rows(df: DataFrame, path: str) -> int:
    return write_table(df, path, mode="append")


def recreate_database(spark: SparkSession, name: str, tables: Mapping[str, RawTable] = RAW_TABLES) -> None:
    """Empty catalog tables with the raw schemas, replacing what was there."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    for table, spec in tables.items():
        spark.sql(f"DROP TABLE IF EXISTS `{name}`.`{table}`")
        spark.sql(f"CREATE TABLE `{name}`.`{table}` ({spec.ddl}) USING parquet")


def require_rows(**tables: DataFrame) -> None:
    """Raises when a named table is empty; reads one row at most from each."""
    empty = [name for name, df in tables.items() if df.isEmpty()]
    if empty:
        raise DataUnavailableError(f"no rows in {', '.join(empty)}")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, taken from spark.checkpoint.dir."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise DataUnavailableError("set spark.checkpoint.dir to a folder shared by all executors")
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; the folder's owner clears it."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes an intermediate result to the shared folder and reads it back.

    Used where a result feeds several jobs (model fits). The files survive the
    loss of executors, and the result starts a fresh, short lineage.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
