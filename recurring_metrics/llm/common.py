"""Shared pieces of the corpus operators: safe columns, links to components, text batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurring_metrics.sources.io import materialize

# The white space of the contracts: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\f\r"


def free_name(df: DataFrame, base: str) -> str:
    """`base`, or `base` with underscores until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def column(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id is not among `ids` (one column); null ids stay."""
    key = free_name(docs, "dropped_id")
    gone = ids.toDF(key)
    return docs.join(gone, column(id_col) == column(key), "left_anti")


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of the links (a, b).

    Alternates two steps until nothing changes: every node hands its smallest
    neighbour to its larger neighbours, then to its smaller ones. Each step
    shrinks the distance to the root, so the rounds grow with the logarithm of
    the longest path. Only minima are grouped, never whole neighbourhoods, and
    each round is written to the shared folder.
    """
    edges = materialize(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    for _ in range(rounds):
        branching = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        nested = edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi")
        if branching.union(nested).isEmpty():  # stars only
            break
        both = edges.union(edges.select("b", "a"))
        roots = both.groupBy("a").agg(F.min("b").alias("n")).select(
            F.col("a").alias("u"), F.least("a", "n").alias("root")
        )
        large = both.where("b > a").join(roots, F.col("a") == F.col("u")).select(
            F.col("b").alias("a"), F.col("root").alias("b")
        )
        own = roots.where("u <> root").select(F.col("u").alias("a"), F.col("root").alias("b"))
        flat = large.where("a <> b").union(own).distinct()
        lowest = flat.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("u"), "root")
        small = flat.join(lowest, F.col("a") == F.col("u")).where("b <> root").select(
            F.col("b").alias("a"), F.col("root").alias("b")
        )
        edges = materialize(
            small.union(lowest.select(F.col("u").alias("a"), F.col("root").alias("b"))).distinct()
        )
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct()
    )


def slices(batch: pa.RecordBatch, columns: list[str], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch with about `limit` bytes of text each, one row at least."""
    offset, size = 0, 0
    lengths = [0] * batch.num_rows
    for name in columns:
        for i, n in enumerate(pa.compute.binary_length(batch.column(name)).to_pylist()):
            lengths[i] += n or 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(offset, i - offset)
            offset, size = i, 0
        size += n
    if offset < batch.num_rows:
        yield batch.slice(offset)


def tokenizer_path(name: str) -> str:
    """Where a file of the public tokenizers lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def arrow_schema(ddl: str) -> pa.Schema:
    """An Arrow schema from `name type, ...` with long, string, boolean and binary columns."""
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])
