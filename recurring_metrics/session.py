"""A Spark session for local runs, tests and the bench."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", **settings: str) -> SparkSession:
    """local[cores] with adaptive execution; on a cluster use the session given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("recurring-metrics")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    use_shared_folder(session)
    return session


def use_shared_folder(spark: SparkSession) -> None:
    """Gives a one-process session a temporary shared folder if none is configured."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    one_process = context.master == "local" or context.master.startswith("local[")
    if one_process and not configured:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="recurring-metrics-"))
