"""Data-quality reports. Each is one DataFrame with a row per finding or column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurring_metrics.functions.dates import month_floor
from recurring_metrics.sources.schema import RELATIONSHIPS


def _stack(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for every table."""
    return _stack(
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    )


def reconcile_counts(
    sources: Mapping[str, DataFrame], loaded: Mapping[str, DataFrame]
) -> DataFrame:
    """Source rows against loaded rows per table, with OK or FAIL."""
    both = [
        row_counts({n: sources[n] for n in sources}).select(
            "table_name", F.col("row_count").alias("source_rows"), F.lit(0).cast("long").alias("loaded_rows")
        ),
        row_counts({n: loaded[n] for n in sources}).select(
            "table_name", F.lit(0).cast("long").alias("source_rows"), F.col("row_count").alias("loaded_rows")
        ),
    ]
    return (
        _stack(both)
        .groupBy("table_name")
        .agg(F.sum("source_rows").alias("source_rows"), F.sum("loaded_rows").alias("loaded_rows"))
        .withColumn(
            "status", F.when(F.col("source_rows") == F.col("loaded_rows"), "OK").otherwise("FAIL")
        )
    )


def null_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, null_count) for every column, one pass per table."""

    def one(name: str, df: DataFrame) -> DataFrame:
        counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        return counted.unpivot([], df.columns, "column_name", "null_count").select(
            F.lit(name).alias("table_name"), "column_name", "null_count"
        )

    return _stack(one(name, df) for name, df in tables.items())


def duplicate_keys(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Per table: how many key values repeat, and the rows beyond the first of each."""

    def one(name: str, df: DataFrame, key: Sequence[str]) -> DataFrame:
        repeats = df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
        surplus = F.col("copies") - 1
        return repeats.agg(
            F.count_if(surplus > 0).alias("duplicate_keys"),
            F.coalesce(F.sum(surplus), F.lit(0)).alias("surplus_rows"),
        ).select(F.lit(name).alias("table_name"), "duplicate_keys", "surplus_rows")

    return _stack(one(name, df, key) for name, (df, key) in tables.items())


def orphans(
    tables: Mapping[str, DataFrame],
    relationships: Sequence[tuple[str, str, str, str]] = RELATIONSHIPS,
) -> DataFrame:
    """Child rows without a parent per relationship; a NULL key is an orphan.

    Child keys are counted first, so the anti join sees each key once.
    """

    def one(child: str, key: str, parent: str, parent_key: str) -> DataFrame:
        keys = tables[child].groupBy(F.col(key).alias("key")).agg(
            F.count(F.lit(1)).alias("rows")
        )
        known = tables[parent].select(F.col(parent_key).alias("key"))
        return (
            keys.join(known, "key", "left_anti")
            .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphans"))
            .select(
                F.lit(f"{child}.{key}").alias("child"),
                F.lit(f"{parent}.{parent_key}").alias("parent"),
                "orphans",
                F.when(F.col("orphans") == 0, "OK").otherwise("FAIL").alias("status"),
            )
        )

    return _stack(one(*r) for r in relationships)


def date_ranges(tables: Mapping[str, DataFrame]) -> DataFrame:
    """First and last value of every DATE column, one pass per table."""

    def one(name: str, df: DataFrame) -> DataFrame | None:
        dates = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
        if not dates:
            return None
        bounds = df.agg(
            *[F.struct(F.min(c).alias("first_date"), F.max(c).alias("last_date")).alias(c) for c in dates]
        )
        return bounds.unpivot([], dates, "column_name", "bounds").select(
            F.lit(name).alias("table_name"), "column_name", "bounds.first_date", "bounds.last_date"
        )

    return _stack(r for r in (one(n, df) for n, df in tables.items()) if r is not None)


def profile_measures(df: DataFrame) -> list[Column]:
    """Aggregates of a load profile: rows, nulls per column, first and last date of DATE columns.

    All of them are kept as partial results per task, so they can be observed while
    the rows are written. Columns are numbered, as their names may hold anything.
    """
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(df.schema):
        column = F.col(f"`{field.name}`")
        measures.append(F.count_if(column.isNull()).alias(f"nulls_{i}"))
        if isinstance(field.dataType, T.DateType):
            measures += [F.min(column).alias(f"first_{i}"), F.max(column).alias(f"last_{i}")]
    return measures


def profile_reports(
    spark: SparkSession, schemas: Mapping[str, T.StructType], profiles: Mapping[str, Mapping], loaded: Mapping[str, DataFrame]
) -> dict[str, DataFrame]:
    """Counts, nulls and date ranges from profiles taken while the tables were written.

    The rows seen by the writer stand for the source; the stored tables are counted, which
    Parquet answers from its footers. The reports equal `reconcile_counts`,
    `null_counts` and `date_ranges`, and hold a row per table or column.
    """
    counts, nulls, dates = [], [], []
    for name, schema in schemas.items():
        seen = profiles[name]
        counts.append((name, seen["rows"]))
        for i, field in enumerate(schema):
            nulls.append((name, field.name, seen[f"nulls_{i}"]))
            if f"first_{i}" in seen:
                dates.append((name, field.name, seen[f"first_{i}"], seen[f"last_{i}"]))
    source = spark.createDataFrame(counts, "table_name string, source_rows long")
    status = F.when(F.col("source_rows") == F.col("loaded_rows"), "OK").otherwise("FAIL")
    stored = row_counts({name: loaded[name] for name in schemas}).withColumnRenamed("row_count", "loaded_rows")
    return {
        "row_counts": source.join(stored, "table_name").withColumn("status", status),
        "null_counts": spark.createDataFrame(nulls, "table_name string, column_name string, null_count long"),
        "date_ranges": spark.createDataFrame(
            dates, "table_name string, column_name string, first_date date, last_date date"
        ),
    }


def reconcile_revenue(attributed: DataFrame, revenue: DataFrame) -> DataFrame:
    """Attributed against billed revenue per month, and in total (month NULL).

    `attributed` holds (month, net_revenue) for every category. The sums are
    decimals, so equality needs no tolerance.
    """
    zero = F.lit(0).cast("decimal(12,2)")
    amount = F.col("net_revenue")
    sides = attributed.select(
        "month", amount.alias("attributed_revenue"), zero.alias("billed_revenue")
    ).unionByName(
        revenue.select(
            month_floor("revenue_date").alias("month"),
            zero.alias("attributed_revenue"),
            amount.alias("billed_revenue"),
        ).where(F.col("month").isNotNull())
    )
    monthly = sides.groupBy("month").agg(
        F.sum("attributed_revenue").alias("attributed"), F.sum("billed_revenue").alias("billed")
    )
    # the total is taken over the months, not over the rows a second time
    totals = monthly.rollup("month").agg(
        F.sum("attributed").alias("attributed"), F.sum("billed").alias("billed")
    )
    return totals.select(
        "month",
        F.col("attributed").cast("double").alias("attributed_revenue"),
        F.col("billed").cast("double").alias("billed_revenue"),
        (F.col("attributed") == F.col("billed")).alias("matches"),
    )
