"""Exact duplicates by content sort: range-partition the normalised text, sort, compare neighbours.

White space is deleted before texts are compared. Splitters sampled by Spark deal
the normalised texts to ranges, every range is sorted externally, equal texts lie
side by side, and a window compares each row with its neighbour in full. Splitters are
made of the first `PREFIX` characters and a fingerprint, as whole texts are too large for
the driver; rows are sorted by these two and then by the whole text.

A text with very many copies would fill one range. Texts seen more than `run_rows`
times are found by a count of 64-bit fingerprints, summed before the shuffle; their
rows are dealt to slices by a hash of the id, so a hot text becomes many runs. What
holds for the whole text (its best row and its size) comes from an aggregation over
just those rows that combines equal texts on the map side. At most
`HOT_TEXTS` texts can be hot, since each has over one part in `HOT_TEXTS` of all
rows; that bounds the broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurring_metrics.llm.common import SPACES, column, free_name

HOT_TEXTS = 10_000
RUN_ROWS = 1_000
PREFIX = 32


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def label_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    into: str = "copies",
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """All rows and columns of `docs`, and a struct column `into` about equal texts.

    Its fields: keep_id (id of the row that stays), group_size, kept,
    text_sha256 (of the normalised text). The row with the most code points in
    the original text stays, then the one with the smallest id; a null id comes
    last. Null text is empty text, and all empty texts are equal. If rows repeat,
    exactly one row of a group is kept. An empty table gives an empty table. A
    column of `docs` called `into` is an error.
    """
    if free_name(docs, into) != into:
        raise ValueError(f"the table already has a column {into}")
    limit = max(run_rows, docs.count() // HOT_TEXTS)
    ident, text = column(id_col), column(text_col)
    body = normalised(text)
    size = F.char_length(F.coalesce(text, F.lit("")))

    plain = docs.select(ident.alias("id"), size.alias("size"), body.alias("body")).withColumn(
        "print", F.xxhash64("body")
    )
    seen = plain.groupBy("print").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > limit)
    hot = (
        plain.join(F.broadcast(seen), "print")
        .groupBy("print", "body")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.max(F.struct("size", (-F.col("id")).alias("neg"))).alias("best"),
        )
        .select(
            F.col("print"),
            F.sha2("body", 256).alias("digest"),
            F.col("copies"),
            (-F.col("best.neg")).alias("best_id"),
            F.ceil(F.col("copies") / limit).alias("parts"),
        )
        .groupBy("print")
        .agg(F.map_from_entries(F.collect_list(F.struct("digest", F.struct("copies", "best_id", "parts")))).alias("texts"))
    )

    row, of = free_name(docs, "row"), free_name(docs, "hot_text")
    tag = docs.select(F.struct(*[column(c) for c in docs.columns]).alias(row))
    own = F.col(row)
    tag = tag.withColumn("print", F.xxhash64(normalised(own[text_col])))
    tag = tag.join(F.broadcast(hot), "print", "left")
    tag = tag.select(
        row,
        "print",
        F.substring(normalised(own[text_col]), 1, PREFIX).alias("prefix"),
        F.when(
            F.col("texts").isNotNull(),
            F.element_at("texts", F.sha2(normalised(own[text_col]), 256)),
        ).alias(of),
    )
    tag = tag.withColumn(
        "slice", F.coalesce(F.pmod(F.xxhash64(own[id_col]), F.col(of)["parts"]), F.lit(0))
    )
    # Splitters travel through the driver: a prefix and the fingerprint stand for the text.
    dealt = tag.repartitionByRange("prefix", "print", "slice")
    dealt = dealt.withColumn("body", normalised(own[text_col]))

    run = Window.partitionBy("prefix", "print", "body", "slice")
    length = F.char_length(F.coalesce(own[text_col], F.lit("")))
    first = run.orderBy(length.desc(), own[id_col].asc_nulls_last())
    marked = dealt.select(
        row,
        of,
        "slice",
        F.row_number().over(first).alias("rank"),
        F.first(own[id_col]).over(first).alias("run_id"),
        F.count(F.lit(1)).over(run).alias("run_size"),
        F.sha2("body", 256).alias("digest"),
    )
    spread = F.col(of).isNotNull()
    keep_id = F.when(spread, F.col(of)["best_id"]).otherwise(F.col("run_id"))
    best_slice = F.pmod(F.xxhash64(keep_id), F.col(of)["parts"])
    kept = (F.col("rank") == 1) & (~spread | (F.col("slice") == best_slice))
    return marked.select(
        *[own[c].alias(c) for c in docs.columns],
        F.struct(
            keep_id.alias("keep_id"),
            F.when(spread, F.col(of)["copies"]).otherwise(F.col("run_size")).alias("group_size"),
            kept.alias("kept"),
            F.col("digest").alias("text_sha256"),
        ).alias(into),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of equal texts, with the columns of `docs`."""
    into = free_name(docs, "copies")
    marked = label_copies(docs, id_col, text_col, into)
    return marked.where(F.col(into)["kept"]).select(*[column(c) for c in docs.columns])
