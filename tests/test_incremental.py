"""Appends equal a full rebuild and read new files only; versions change all at once."""

import pytest

from recurring_metrics.plans import incremental
from recurring_metrics.plans import refresh as refreshing
from recurring_metrics.plans.summary import monthly_summary
from recurring_metrics.sources import versions
from recurring_metrics.sources.io import DataUnavailableError, append_rows, write_table
from tests.conftest import rows
from tests.test_revenue import tables as summary_tables

KEYS = ("segment", "region")


@pytest.fixture
def grown(make, tmp_path):
    """Tables on disk, their first rows already counted, the others appended after that."""
    tables, folder = summary_tables(make), str(tmp_path / "tables")
    later = {name: [i % 2 for i in range(tables[name].count())] for name in incremental.FACTS}
    halves = {}
    for name, marks in later.items():
        found = tables[name].collect()
        halves[name] = [
            tables[name].sparkSession.createDataFrame([r for r, m in zip(found, marks) if m == half], tables[name].schema)
            for half in (0, 1)
        ]
    for name, df in tables.items():
        write_table(halves[name][0] if name in halves else df, f"{folder}/{name}")
    return folder, {name: halves[name][1] for name in halves}


def full(spark, folder, keys):
    names = ("dim_customer", "fact_subscription", *incremental.FACTS)
    return monthly_summary({n: spark.read.parquet(f"{folder}/{n}") for n in names}, keys)


def test_an_append_equals_a_rebuild_and_reads_new_files_only(spark, grown, tmp_path, monkeypatch):
    folder, rest = grown
    root = str(tmp_path / "state")
    first = incremental.append(spark, folder, root)
    assert all(first.values())
    assert rows(incremental.summary(spark, folder, root)) == rows(full(spark, folder, ()))
    for name, df in rest.items():
        append_rows(df, f"{folder}/{name}")
    read = {}
    sums = incremental._sums
    monkeypatch.setattr(incremental, "_sums", lambda name, df: read.update({name: set(df.inputFiles())}) or sums(name, df))
    old = incremental._counted_files(spark, root, versions.current(spark, root))
    incremental.append(spark, folder, root)
    assert set(read) == set(rest)
    assert not any(read[name] & old[name] for name in read)
    assert incremental.append(spark, folder, root) == dict.fromkeys(incremental.FACTS, 0)
    want = rows(full(spark, folder, KEYS))
    assert rows(incremental.summary(spark, folder, root, KEYS)) == want
    incremental.compact(spark, root)
    assert len(versions.current(spark, root)["batches"]) == 1
    made = incremental.summary(spark, folder, root, KEYS)
    assert rows(made) == want
    assert not any(f"/{name}/" in file for file in made.inputFiles() for name in incremental.FACTS if "/tables/" in file)
    write_table(rest["fact_revenue"], f"{folder}/fact_revenue")
    with pytest.raises(DataUnavailableError, match="gone"):
        incremental.append(spark, folder, root)


def test_an_append_that_fails_leaves_the_state(spark, grown, tmp_path, monkeypatch):
    folder, rest = grown
    root = str(tmp_path / "state")
    with pytest.raises(DataUnavailableError):
        incremental.summary(spark, folder, root)
    incremental.append(spark, folder, root)
    before = versions.current(spark, root)
    for name, df in rest.items():
        append_rows(df, f"{folder}/{name}")

    def fail(name, df):
        raise RuntimeError("lost")

    monkeypatch.setattr(incremental, "_revenue_sums", lambda df: fail("", df))
    with pytest.raises(RuntimeError):
        incremental.append(spark, folder, root)
    assert versions.current(spark, root) == before


def test_a_refresh_that_fails_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")

    def write(spark, source, target, rows):
        written = {"a": write_table(spark.range(rows), f"{target}/a")}
        if rows > 5:
            raise RuntimeError("lost midway")
        return {**written, "b": write_table(spark.range(rows), f"{target}/b")}

    monkeypatch.setattr(refreshing, "refresh", write)
    refreshing.refresh_version(spark, "", root, rows=3)
    old = versions.read_tables(spark, root)
    with pytest.raises(RuntimeError):
        refreshing.refresh_version(spark, "", root, rows=9)
    assert {n: df.count() for n, df in versions.read_tables(spark, root).items()} == {"a": 3, "b": 3}
    refreshing.refresh_version(spark, "", root, rows=4)
    assert {n: df.count() for n, df in versions.read_tables(spark, root).items()} == {"a": 4, "b": 4}
    assert old["a"].count() == 3
    with pytest.raises(DataUnavailableError, match="another writer"):
        versions.publish(spark, root, {}, None)
