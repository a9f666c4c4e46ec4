"""Language identification in two steps: the language family, then the language within it.

Texts are counted in hashed pairs and triples of their bytes (lower-cased, with digits and
signs blanked). A logistic regression chooses the family; linear support vector machines,
one for each pair of languages of a family, then vote. Both are Spark ML models fitted on
at most `per_language` distinct labelled texts of each language. As all models are linear in
the relative counts, a text's scores are the means of the weights of its grams; whole texts
are scored in numpy, window by window.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurring_metrics.llm.common import column, slices
from recurring_metrics.sources.io import materialize

BUCKETS = 1 << 12
PER_LANGUAGE = 600
WINDOW = 1 << 20
UNKNOWN = "und"
# Language codes by family; a code not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic",
    "no": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance",
    "ca": "romance", "ro": "romance", "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic",
}
_LETTER = regex.compile(r"\p{L}")
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[:128] = 32
_BLANK[97:123] = np.arange(97, 123)


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket of every byte pair and triple that is not blank, a window of the text at a time."""
    data = np.frombuffer((" " + text.lower() + " ").encode(), dtype=np.uint8)
    for at in range(0, max(len(data) - 2, 1), WINDOW):
        b = _BLANK[data[at : at + WINDOW + 2]].astype(np.uint32)
        if len(b) < 3:
            continue
        pair = b[:-2] << np.uint32(8) | b[1:-1]
        triple = pair << np.uint32(8) | b[2:]
        seen = pair != 0x2020
        pair = (pair * np.uint32(0x9E3779B1)) >> np.uint32(20)
        triple = (triple * np.uint32(0x85EBCA6B) ^ np.uint32(0x5BD1E995)) * np.uint32(0xC2B2AE35) >> np.uint32(20)
        yield np.concatenate((pair[seen], triple[seen]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, ["text"]):
            rows = []
            for text in batch["text"].to_pylist():
                total = sum((np.bincount(g, minlength=BUCKETS) for g in grams(text)), np.zeros(BUCKETS))
                rows.append((total / max(total.sum(), 1)).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [batch["lang"], pa.array(rows, pa.list_(pa.float64()))], ["lang", "shares"]
            )


@dataclass
class Model:
    """Weights per bucket (a column per score), intercepts, and what each score means."""

    weights: np.ndarray
    intercepts: np.ndarray
    families: list[str]
    languages: dict[str, list[str]]
    pairs: list[tuple[str, str]] = field(default_factory=list)

    def decide(self, score: np.ndarray) -> tuple[str, float]:
        """The language and its confidence from the scores of one text."""
        n = len(self.families)
        e = np.exp(score[:n] - score[:n].max())
        family = int(e.argmax())
        names = self.languages[self.families[family]]
        votes = dict.fromkeys(names, 0.0)
        for (one, two), margin in zip(self.pairs, score[n:]):
            if one in votes and two in votes:
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, 2.0 * margin))))
                votes[one] += p
                votes[two] += 1 - p
        best = max(sorted(names), key=votes.get)
        share = votes[best] / (len(names) - 1) if len(names) > 1 else 1.0
        return best, float(e[family] / e.sum() * share)


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    families: Mapping[str, str] = FAMILIES,
    per_language: int = PER_LANGUAGE,
) -> Model | None:
    """Learns from rows with a language and a text; None if there are none.

    Of a language with more than `per_language` distinct texts, the
    `per_language` first ones in the order of a hash are taken, each once, however
    often it repeats. Every language with a text has at least one in the sample.
    """
    rows = labelled.select(column(lang_col).alias("lang"), column(text_col).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    marked = rows.withColumn("mark", F.xxhash64("text"))
    by_mark = Window.partitionBy("lang").orderBy("mark")
    # Written, so that its small size is known and no text moves for the join.
    chosen = materialize(
        marked.select("lang", "mark").distinct()
        .withColumn("place", F.row_number().over(by_mark))
        .where(F.col("place") <= per_language)
        .select("lang", "mark")
    )
    # Bounded by `per_language` rows of each language; copies of a text go before they meet.
    taken = marked.join(chosen, ["lang", "mark"]).groupBy("lang", "mark").agg(F.first("text").alias("text"))
    counted = materialize(taken.select("lang", "text").mapInArrow(_counts, "lang string, shares array<double>"))
    data = counted.coalesce(2).select("lang", array_to_vector("shares").alias("features")).persist()
    present = [r["lang"] for r in data.select("lang").distinct().collect()]
    if not present:
        data.unpersist()
        return None

    by_family: dict[str, list[str]] = {}
    for lang in sorted(present):
        by_family.setdefault(families.get(lang, lang), []).append(lang)
    names = sorted(by_family)
    columns, constants, pairs = [], [], []

    def indexed(of: Mapping[str, float]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("lang"))

    if len(names) > 1:
        target = {lang: float(i) for i, f in enumerate(names) for lang in by_family[f]}
        found = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=25).fit(
            data.withColumn("label", indexed(target))
        )
        matrix = found.coefficientMatrix.toArray()
        columns += list(matrix)
        constants += list(found.interceptVector.toArray())
    else:
        columns.append(np.zeros(BUCKETS))
        constants.append(0.0)
    for family in names:
        for one, two in itertools.combinations(by_family[family], 2):
            found = LinearSVC(regParam=1e-3, maxIter=10, tol=1e-4).fit(
                data.where(F.col("lang").isin(one, two)).withColumn(
                    "label", (F.col("lang") == one).cast("double")
                )
            )
            pairs.append((one, two))
            columns.append(found.coefficients.toArray())
            constants.append(found.intercept)
    data.unpersist()
    return Model(np.array(columns).T.astype(np.float32).copy(), np.array(constants), names, by_family, pairs)


def _judge(model: Model | None, text: str | None) -> tuple[str, float]:
    """The language of one text and its confidence."""
    if model is None or not text or not _LETTER.search(text):
        return UNKNOWN, 0.0
    total, n = np.zeros(model.weights.shape[1]), 0
    for g in grams(text):
        total += model.weights[g].sum(axis=0, dtype=np.float64)
        n += len(g)
    return model.decide(total / max(n, 1) + model.intercepts)


def _predict(shared: object) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [_judge(shared.value, t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"],
                    pa.array([lang for lang, _ in judged], pa.string()),
                    pa.array([score for _, score in judged], pa.float64()),
                ],
                ["id", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred and score (0 to 1) of every row; only the text is used.

    `und` with score 0 for a null text, a text without a letter, or without a
    model. Repeated rows give repeated answers; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    raw = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    kind = raw.schema["id"].dataType.simpleString()
    return raw.mapInArrow(_predict(shared), f"id {kind}, lang_pred string, score double").withColumnRenamed(
        "id", id_col
    )


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of the documents that is never learned from."""
    remainder = F.crc32(column(id_col).cast("string").cast("binary")) % 4
    return F.coalesce(remainder == 2, F.lit(False))


def keep_known(
    docs: DataFrame, model: Model | None, text_col: str = "text", min_score: float = 0.0
) -> DataFrame:
    """The rows of `docs` whose language is recognised (with a score over `min_score`).

    Without a model no language can be told: then only null texts and those
    without a letter go. Python gets the text alone and gives back a mark, so documents
    are not held there, nor on their way there and back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        if shared.value is None:
            return pa.array([bool(_LETTER.search(t.as_py() or "")) for t in texts], pa.bool_())
        judged = (_judge(shared.value, t.as_py()) for t in texts)
        return pa.array([lang != UNKNOWN and score > min_score for lang, score in judged], pa.bool_())

    return docs.where(known(column(text_col)))
