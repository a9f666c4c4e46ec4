"""Toxicity of texts: gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled texts is dealt into three parts. From the first two a lexicon is
learned: words and word beginnings that many toxic texts hold and few others, with the log of
how much more often. The features of a text are the densities of lexicon words by strength,
of a fixed list of insults, how near they stand to words of the second person, and the rates
of capitals, of punctuation and of disguised words. Rows of one of the two parts get their
features from the other part's lexicon, so that the trees do not see how well a lexicon fits
the texts that it was learned from. The third part, which neither lexicon nor trees know,
calibrates the trees' margin to a probability by isotonic regression; its rows weigh as much
as the labels they stand for.

Texts are read in numpy, each distinct token once per worker; trees and calibration are
Spark ML models.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurring_metrics.llm.common import column, slices
from recurring_metrics.sources.io import materialize

# Learned from at most so many texts of each label; terms kept; toxic texts that must hold a term.
PER_LABEL, MOST_TERMS, SUPPORT = 4_000, 3_000, 4
# A term counts this often in one text at most; the least log ratio of a term; tiers of strength.
REPEATS, LEAST, TIERS = 3, 1.2, (1.2, 2.2, 3.2)
TREES, DEPTH, STEP = 30, 4, 0.2
PREDICTED = 0.7
WINDOW, TOKENS, TOKEN_CHARS = 1 << 20, 400_000, 16_000_000
NEAR = 5
# Usual insults, and words of the second person, in a few languages.
INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass loser losers scum trash garbage pathetic worthless "
    "disgusting clown fool freak creep pig retard retarded bastard bitch asshole shit fuck fucking jerk coward liar "
    "idiote imbécile crétin connard salope merde stupide débile idioten dumm dummkopf arschloch scheiße schlampe "
    "trottel depp idiota estúpido estúpida imbécil tonto mierda cabrón puta basura".split()
)
SECOND = frozenset(
    "you your yours yourself you're youre u ur du dich dir dein deine deinen ihr euch euer sie ihnen "
    "tu toi ton ta tes vous votre vos te tú ti tus usted ustedes vosotros vuestro".split()
)
_PLAIN = str.maketrans("013457@$!|+€", "oieastasilte")
_EDGES = regex.compile(r"^[^\p{L}\p{N}@$*]+|[^\p{L}\p{N}@$*]+$")
_HIDDEN = regex.compile(r"\p{L}[0-9@$*!|+#€]+\p{L}|\p{L}(?:[.\-_*]\p{L}){2,}")
_STRETCHED = regex.compile(r"(\p{L})\1{2,}")
FEATURES = (
    "words", *[f"hits_{t}" for t in range(len(TIERS))], *[f"density_{t}" for t in range(len(TIERS))],
    "strength", "strongest", "kinds", "insults", "insult_density", "second", "nearest", "near_share", "capitals",
    "shouted", "bangs", "questions", "runs_of_signs", "signs", "hidden", "stretched", "spelled", "undone",
)


def core(token: str) -> str:
    """A token in lower case without the signs around it."""
    return _EDGES.sub("", token.lower())


def keys(word: str) -> list[str]:
    """The lexicon terms of a word: itself, closed by a sign, and its beginnings."""
    return [word + "$", *(word[:k] for k in (3, 4, 5, 6) if len(word) > k)]


def windows(text: str) -> Iterator[str]:
    """A text in windows that end at white space, unless one token is longer."""
    at = 0
    while at < len(text):
        end = min(at + WINDOW, len(text))
        if end < len(text):
            gap = regex.compile(r"\s").search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


class Tokens:
    """Numbers of the tokens met so far, and what is known of each."""

    COLUMNS = 13
    WEIGHT, INSULT, YOU, SHOUTED, HIDDEN, STRETCHED, BANGS, ASKS, LETTERS, UPPERS, CHARS, SINGLE, UNDONE = range(13)

    def __init__(self, lexicon: Mapping[str, float]):
        self.lexicon = lexicon
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows, self.chars = np.zeros((1024, self.COLUMNS), dtype=np.float32), 0

    def weight(self, word: str) -> float:
        return max((self.lexicon.get(k, 0.0) for k in keys(word)), default=0.0)

    def add(self, token: str) -> int:
        n = self.known[token] = len(self.known)
        self.chars += len(token)
        if n >= len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        word = core(token)
        letters = sum(map(str.isalpha, token))
        uppers = sum(map(str.isupper, token))
        weight, insult = self.weight(word), word in INSULTS
        hidden = bool(_HIDDEN.search(word))
        stretched = bool(_STRETCHED.search(word))
        undone = 0.0
        if hidden or stretched or "*" in word:
            clear = _STRETCHED.sub(r"\1", regex.sub(r"[.\-_*]", "", word).translate(_PLAIN))
            undone = float(clear in INSULTS or (weight < TIERS[-1] <= self.weight(clear)))
        self.rows[n] = (
            weight, insult, word in SECOND, letters > 1 and letters == uppers, hidden, stretched, token.count("!"),
            token.count("?"), letters, uppers, len(token), letters == 1 == len(word), undone,
        )
        return n

    def numbers(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > TOKENS or self.chars > TOKEN_CHARS:
            self.clear()
        known, add = self.known, self.add
        found = list(map(known.get, tokens))
        return np.array([add(t) if n is None and t not in known else known[t] if n is None else n for n, t in zip(found, tokens)], dtype=np.int64)

    def features(self, text: str) -> np.ndarray:
        """The features of a whole text."""
        total = np.zeros(self.COLUMNS)
        hits, densest, kinds = np.zeros(len(TIERS)), 0.0, 0
        near, nearest, runs, spelled, words = 0, 20.0, 0, 0, 0
        for part in windows(text):
            tokens = part.split()
            if not tokens:
                continue
            numbers = self.numbers(tokens)
            rows = self.rows[numbers]
            words += len(rows)
            total += rows.sum(axis=0, dtype=np.float64)
            weight = rows[:, self.WEIGHT]
            hits += [(weight >= t).sum() for t in TIERS]
            bad = np.flatnonzero((weight >= TIERS[1]) | (rows[:, self.INSULT] > 0) | (rows[:, self.UNDONE] > 0))
            densest = max(densest, float(weight.max()))
            runs += int((rows[:, self.BANGS] + rows[:, self.ASKS] >= 2).sum())
            single = rows[:, self.SINGLE] > 0
            spelled += int((single[1:] & single[:-1]).sum())
            if len(bad):
                kinds += len(np.unique(numbers[bad]))
                you = np.flatnonzero(rows[:, self.YOU] > 0)
                if len(you):
                    after = np.searchsorted(you, bad)
                    gap = np.minimum(
                        np.abs(you[np.minimum(after, len(you) - 1)] - bad), np.abs(you[np.maximum(after - 1, 0)] - bad)
                    )
                    near += int((gap <= NEAR).sum())
                    nearest = min(nearest, float(gap.min()))
        n, chars, letters = max(words, 1), max(total[self.CHARS], 1.0), max(total[self.LETTERS], 1.0)
        signs = total[self.CHARS] - total[self.LETTERS]
        return np.array(
            [
                math.log1p(words), *np.log1p(hits), *(hits / n), total[self.WEIGHT] / n, densest, math.log1p(kinds),
                math.log1p(total[self.INSULT]), total[self.INSULT] / n, total[self.YOU] / n, nearest,
                near / max(hits[1], total[self.INSULT], 1.0), total[self.UPPERS] / letters, total[self.SHOUTED] / n,
                total[self.BANGS] / chars, total[self.ASKS] / chars, runs / n, signs / chars, total[self.HIDDEN] / n,
                total[self.STRETCHED] / n, spelled / n, total[self.UNDONE] / n,
            ]
        )


@dataclass
class Model:
    """What scoring needs; without both labels in the sample only `prior` is used."""

    prior: float
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, label, term, uses, texts): how often texts of a batch use each term."""
    for whole in batches:
        for batch in slices(whole, ["text"], 4 << 20):
            uses: dict[tuple, Counter] = {}
            texts: dict[tuple, Counter] = {}
            for part, label, text in zip(*(batch[c].to_pylist() for c in ("part", "label", "text"))):
                own: Counter = Counter()
                for piece in windows(text):
                    for token, n in Counter(piece.split()).items():
                        for key in keys(word) if (word := core(token)) else ():
                            own[key] += n
                uses.setdefault((part, label), Counter()).update({k: min(n, REPEATS) for k, n in own.items()})
                texts.setdefault((part, label), Counter()).update(own.keys())
            for (part, label), counted in uses.items():
                size = len(counted)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size, part), pa.int32()), pa.array(np.full(size, label), pa.float64()),
                        pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64()),
                        pa.array([texts[part, label][k] for k in counted], pa.int64()),
                    ],
                    ["part", "label", "term", "uses", "texts"],
                )


def _ratio(toxic: Column, other: Column, n_toxic: Column, n_other: Column) -> Column:
    """The log of how much more often toxic texts use a term."""
    return F.log((toxic + 0.1) / n_toxic) - F.log((other + 0.5) / n_other)


def lexicons(sample: DataFrame, most: int, support: int) -> list[dict[str, float]]:
    """Terms and their log ratios from part 0, from part 1, and from both."""
    used = sample.where("part < 2")
    sizes = {(r["part"], r["label"]): r["count"] for r in used.groupBy("part", "label").count().collect()}
    raw = used.select("part", "label", "text").mapInArrow(
        _terms, "part int, label double, term string, uses long, texts long"
    )
    sums = raw.groupBy("term").agg(
        *[
            F.coalesce(F.sum(F.when((F.col("part") == p) & (F.col("label") == y), F.col(of))), F.lit(0)).alias(f"{of}{p}{y}")
            for p in (0, 1)
            for y in (0, 1)
            for of in (("uses", "texts") if y else ("uses",))
        ]
    )
    sums = materialize(sums.where(F.col("texts01") + F.col("texts11") >= support))
    out = []
    for parts in ((0,), (1,), (0, 1)):
        of = lambda name, y: sum((F.col(f"{name}{p}{y}") for p in parts[1:]), F.col(f"{name}{parts[0]}{y}"))
        n = {y: float(max(1, sum(sizes.get((p, float(y)), 0) for p in parts))) for y in (0, 1)}
        least = max(2, support * len(parts) // 2)
        ratio = _ratio(of("uses", 1), of("uses", 0), F.lit(n[1]), F.lit(n[0]))
        gain = of("uses", 1) / n[1] - of("uses", 0) / n[0]
        best = (
            sums.where(of("texts", 1) >= least).select("term", ratio.alias("ratio"), gain.alias("gain"))
            .where(F.col("ratio") >= LEAST).orderBy(F.col("gain").desc(), "term").limit(most)
        )
        out.append({r["term"]: r["ratio"] for r in best.collect()})
    return out


def _features(shared: object, keep: list[str]) -> object:
    """Features of every row; the part says whose lexicon is used, the last one without a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: dict[int, Tokens] = {}
        for whole in batches:
            for batch in slices(whole, ["text"]):
                parts = batch["part"].to_pylist() if "part" in keep else [2] * batch.num_rows
                rows = []
                for part, text in zip(parts, batch["text"].to_pylist()):
                    if part not in tokens:
                        tokens[part] = Tokens(shared.value[{0: 1, 1: 0}.get(part, 2)])
                    rows.append(tokens[part].features(text or ""))
                yield pa.RecordBatch.from_arrays(
                    [batch[c] for c in keep] + [pa.array(rows, pa.list_(pa.float64()))], [*keep, "values"]
                )

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_label: int = PER_LABEL,
    most_terms: int = MOST_TERMS,
    support: int = SUPPORT,
) -> Model:
    """Learns from the texts of `docs` whose id has a label of 0 or 1 in `labels`.

    Of each label, the `per_label` first ids in the order of a hash are taken;
    rows with another or no label, id or text are not learned from. Only these
    rows are broadcast. If a label or a part is missing, the share of label 1 is
    every text's score (0 without any label).
    """
    known = labels.select(column(id_col).alias("id"), column(label_col).cast("double").alias("label")).where(
        "id IS NOT NULL AND label IN (0.0, 1.0)"
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1.0, 0) / total if total else 0.0
    if len(counts) < 2:
        return Model(prior, {})
    mark = F.xxhash64("id", F.lit(11))
    by_mark = Window.partitionBy("label").orderBy(mark, "id")
    chosen = materialize(
        known.withColumn("place", F.row_number().over(by_mark)).where(F.col("place") <= per_label)
        .select("id", "label", F.element_at(F.array(*map(F.lit, (0, 1, 2, 0, 1))), (F.pmod(mark, F.lit(5)) + 1).cast("int")).alias("part"))
    )
    texts = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).where("text IS NOT NULL")
    # Two labels of `per_label` rows at most.
    sample = materialize(texts.join(F.broadcast(chosen), "id").select("part", "label", "text"))
    taken = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    seen = {(r["part"], r["label"]) for r in sample.select("part", "label").distinct().collect()}
    if len(seen) < 6:
        return Model(prior, {})
    made = lexicons(sample, most_terms, support)
    shared = docs.sparkSession.sparkContext.broadcast(made)
    weight = F.when(F.col("label") == 1, counts[1.0] / taken[1.0]).otherwise(counts[0.0] / taken[0.0])
    rows = materialize(
        sample.mapInArrow(_features(shared, ["part", "label"]), "part int, label double, values array<double>")
    ).select("part", "label", array_to_vector("values").alias("features"), weight.alias("weight"))
    rows = rows.coalesce(4).persist()
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, weightCol="weight", seed=5).fit(rows.where("part < 2"))
    margins = trees.transform(rows.where("part = 2")).select(
        "label", "weight", vector_to_array("rawPrediction")[1].alias("margin")
    )
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(margins)
    rows.unpersist()
    return Model(prior, made[2], trees, calibration)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, score (0 to 1) and predicted (score of `PREDICTED` at least) of every row.

    Only the text is used; null counts as empty, which is scored like any other
    text. Null ids and repeated rows are scored as they are; an empty table gives
    no rows. Other columns are not read.
    """
    raw = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    if model.trees is None:
        judged = raw.select("id", F.lit(float(model.prior)).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast([model.lexicon] * 3)
        kind = raw.schema["id"].dataType.simpleString()
        values = raw.mapInArrow(_features(shared, ["id"]), f"id {kind}, values array<double>")
        vectors = values.select("id", array_to_vector("values").alias("features"))
        margins = model.trees.transform(vectors).select("id", vector_to_array("rawPrediction")[1].alias("margin"))
        fitted = model.calibration.transform(margins).select("id", "prediction")
        judged = fitted.select("id", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("score"))
    predicted = (F.col("score") >= PREDICTED).cast("int")
    return judged.select(F.col("id").alias(id_col), "score", predicted.alias("predicted"))


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the documents that is never learned from."""
    return F.coalesce(F.crc32(column(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
