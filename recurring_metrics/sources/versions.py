"""Folders whose contents change all at once: versions, and a small pointer that is swapped last.

    root/CURRENT            JSON: what readers see
    root/<name>-<id>/...    folders that a version consists of

A writer fills new folders and then replaces CURRENT by one rename. A reader, and a
writer that fails midway, never meets half a version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from recurring_metrics.sources.io import DataUnavailableError

POINTER = "CURRENT"


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def new_folder(name: str) -> str:
    """A name under the root that no version uses yet."""
    return f"{name}-{uuid.uuid4().hex}"


def current(spark: SparkSession, root: str) -> dict | None:
    """What CURRENT says, or None before the first version."""
    pointer = _path(spark, root, POINTER)
    files = pointer.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, content: dict, replaces: dict | None) -> None:
    """Makes `content` what readers see; it must stay small, as it goes through the driver.

    `replaces` is what the writer started from; when another writer has published
    since then, nothing is changed. There should be one writer at a time: two that
    publish within the same moment are not told apart.
    """
    if current(spark, root) != replaces:
        raise DataUnavailableError(f"{root} was changed by another writer")
    config = spark._jsc.hadoopConfiguration()
    draft, pointer = _path(spark, root, new_folder(".draft")), _path(spark, root, POINTER)
    stream = draft.getFileSystem(config).create(draft)
    try:
        stream.write(json.dumps(content).encode("utf-8"))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(pointer.toUri(), config).rename(draft, pointer, options)


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current version of a refreshed folder, by name."""
    seen = current(spark, root)
    if seen is None:
        raise DataUnavailableError(f"{root} has no version yet")
    folder = f"{root.rstrip('/')}/{seen['folder']}"
    return {name: spark.read.parquet(f"{folder}/{name}") for name in seen["tables"]}
