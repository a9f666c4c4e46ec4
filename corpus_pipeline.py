"""A corpus made ready for training, in five stages over the whole documents table.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with their
columns; the last returns the packed pieces. `run` writes every stage to the shared
folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurring_metrics.llm import exact_dedup, language_id, minhash_dedup, packing, secret_forest
from recurring_metrics.llm.common import without
from recurring_metrics.sources.io import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; null texts and those without a letter go.

    Without labelled rows no language is learned, and only those go.
    """
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.keep_known(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates.

    Texts without words, and rows with a null id, stay; rows that repeat an id go or
    stay together.
    """
    gone = minhash_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return without(docs, gone)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with credentials masked where they stand.

    Null, empty and harmless texts stay as they are; a null length becomes that of
    the text, if there is one.
    """
    model = secret_forest.fit(secret_forest.sample_findings(spark))
    masked = secret_forest.mask(docs, model)
    if "n_chars" not in docs.columns:
        return masked
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training windows.

    A null or empty text gives its end mark alone; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact),
    ("minhash_dedup", drop_near),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

# Language models, forests and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
