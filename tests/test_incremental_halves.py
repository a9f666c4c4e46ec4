"""The query that counts half of each fact first: what it writes on the way."""

import datetime as dt

import pytest

import query_catalog
from recurring_metrics.sources import io


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two customers, four orders with two lines each, a few events."""
    path = str(tmp_path_factory.mktemp("star"))
    day = lambda i: dt.datetime(1996, 1, 5) + dt.timedelta(days=40 * i)
    made = {
        "region": ([(1, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(1, "CHINA", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, f"C{i}", 1, "BUILDING") for i in (1, 2)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "orders": (
            [(i, i % 2 + 1, day(i), 100.0 * i, "1-URGENT") for i in range(1, 5)],
            "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double, o_orderpriority string",
        ),
        "lineitem": (
            [(i, i, n, 10.0 * i, 0.1, 0.0, "N", day(i + n)) for i in range(1, 5) for n in (1, 2)],
            "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_discount double, l_tax double, "
            "l_returnflag string, l_shipdate timestamp",
        ),
        "events": ([(i, i % 2 + 1, "view") for i in range(6)], "event_id long, user_id long, event_type string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def test_only_joined_and_summed_facts_are_written_before_their_halves(spark, folder, monkeypatch):
    """Before, churn and opportunities, columns of one table, were written whole too, and every row hashed twice."""
    seen = []
    monkeypatch.setattr(io, "materialize", lambda df, real=io.materialize: seen.append(df.columns) or real(df))
    got = query_catalog.incremental_summary(spark, folder).orderBy("month").collect()
    assert len(seen) == 2 and all("half" in columns for columns in seen)
    assert got == query_catalog.monthly_summary(spark, folder).orderBy("month").collect()
    assert sum(r.total_revenue for r in got) == 180.0
