"""The full refresh: source files to processed, summary, feature and output tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from recurring_metrics.operators import quality, trees
from recurring_metrics.operators.conform import conform_all
from recurring_metrics.operators.features import build_features, strongest_correlations
from recurring_metrics.operators.revenue import attribute_revenue
from recurring_metrics.plans.forecasting import MODELS, forecast_outputs
from recurring_metrics.plans.summary import monthly_summary
from recurring_metrics.sources import versions
from recurring_metrics.sources.io import load_raw_tables, require_rows, write_observed, write_table
from recurring_metrics.sources.schema import RAW_TABLES


def _store(spark: SparkSession, df: DataFrame, folder: str, name: str) -> tuple[DataFrame, int]:
    """Writes a table and returns it as read back, with its row count."""
    path = f"{folder.rstrip('/')}/{name}"
    rows = write_table(df, path)
    return spark.read.schema(df.schema).parquet(path), rows


def load_and_check(
    spark: SparkSession, source: str, target: str
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Loads the CSV folder into raw tables; returns them and the load reports.

    Rows, nulls and date ranges are counted while the tables are written, so a source
    file is read once and a stored table only for its keys.
    """
    files = load_raw_tables(spark, source)
    paths = {name: f"{target.rstrip('/')}/{name}" for name in files}
    profiles = {name: write_observed(df, paths[name], quality.profile_measures(df)) for name, df in files.items()}
    raw = {name: spark.read.schema(df.schema).parquet(paths[name]) for name, df in files.items()}
    schemas = {name: df.schema for name, df in files.items()}
    reports = quality.profile_reports(spark, schemas, profiles, raw)
    reports["duplicate_keys"] = quality.duplicate_keys({name: (raw[name], RAW_TABLES[name].key) for name in raw})
    reports["orphans"] = quality.orphans(raw)
    return raw, reports


class LoadCheckError(RuntimeError):
    """A check of the loaded or derived tables failed."""


def failed_checks(reports: Mapping[str, DataFrame]) -> list[str]:
    """Names of the reports that hold a failure.

    Counts and orphans carry a status, keys must not repeat, reconciled revenue
    must match. Nulls, date ranges and correlations are for reading only.
    """
    failures = {
        "row_counts": "status <> 'OK'",
        "orphans": "status <> 'OK'",
        "duplicate_keys": "duplicate_keys > 0",
        "revenue_reconciliation": "NOT matches",
    }
    return [name for name, bad in failures.items() if name in reports and not reports[name].where(bad).isEmpty()]


def refresh(
    spark: SparkSession,
    source: str,
    target: str,
    as_of: dt.datetime | None = None,
    series_keys: Sequence[str] = (),
    models: Sequence[str] = MODELS,
    tree_models: Mapping[str, trees.TreeModel] = trees.TREE_MODELS,
    strict: bool = False,
) -> dict[str, int]:
    """Rebuilds every table under `target` from the CSV files under `source`.

    Each stage is written before the next reads it, as all later stages share
    it. The load checks, the reconciliation of the attributed revenue, the nulls
    of the feature table and its strongest correlations are written as
    `check_*` tables, and `check_status` says OK or FAIL for each that can fail.
    With `strict`, a failure ends the refresh. `as_of` stamps the outputs; the
    current time by default. Returns the rows written per table.
    """
    written: dict[str, int] = {}
    as_of = as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    status: list[tuple[str, str]] = []

    def store(name: str, df: DataFrame) -> DataFrame:
        stored, written[name] = _store(spark, df, target, name)
        return stored

    def check(reports: Mapping[str, DataFrame]) -> None:
        stored = {name: store(f"check_{name}", report) for name, report in reports.items()}
        failed = failed_checks(stored)
        status.extend((name, "FAIL" if name in failed else "OK") for name in stored)
        if failed and strict:
            raise LoadCheckError(f"failed checks: {', '.join(failed)}")

    raw, reports = load_and_check(spark, source, target)
    check(reports)
    tables = {name: store(name, df) for name, df in conform_all(raw).items()}
    require_rows(dim_customer=tables["dim_customer"], fact_revenue=tables["fact_revenue"])
    attributed = attribute_revenue(
        tables["fact_revenue"], tables["fact_subscription"], by_customer=False
    )
    check({"revenue_reconciliation": quality.reconcile_revenue(attributed, tables["fact_revenue"])})
    summary = store("monthly_revenue_summary", monthly_summary(tables, series_keys))
    features = store("ml_feature_table", build_features(summary, series_keys))
    check(
        {
            "feature_nulls": quality.null_counts({"ml_feature_table": features}),
            "leak_correlations": strongest_correlations(features, series_keys),
        }
    )
    outputs = forecast_outputs(summary, features, series_keys, models, tree_models, as_of)
    for name, df in outputs.items():
        store(name, df)
    store("check_status", spark.createDataFrame(status, "check string, status string"))
    return written


def refresh_version(spark: SparkSession, source: str, root: str, **options) -> dict[str, int]:
    """A refresh into a new version of `root`, which readers see once all of it is written.

    Takes the options of `refresh`. A refresh that fails leaves the version before it
    as it was; `versions.read_tables` reads the current one.
    """
    before = versions.current(spark, root)
    folder = versions.new_folder("version")
    written = refresh(spark, source, f"{root.rstrip('/')}/{folder}", **options)
    versions.publish(spark, root, {"folder": folder, "tables": sorted(written)}, before)
    return written
