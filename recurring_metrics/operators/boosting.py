"""Gradient-boosted regression trees by histograms, many fits at once.

Every feature is binned once, by quantiles of the rows that all fits may see. A fit is a
model and the month before which its rows lie, so the folds of a walk-forward test and several
models are grown together: for each tree level there is one aggregation over the binned rows,
which gives the number and the sum of residuals for every fit, node, feature and bin. The best
split of every node follows from these sums alone.

Rows travel as blocks, one row of bytes per partition. Few rows make one block, and then each
fit is grown whole in a task of its own, from the same code: the sums that other blocks would
add are missing, nothing else differs.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurring_metrics.sources.io import materialize

BINS = 64
# Rows of one block. Up to so many rows every fit is one task.
BLOCK_ROWS = 50_000
# Rounds after which the blocks are written again with the predictions so far.
WRITE_EVERY = 10


@dataclass(frozen=True)
class Fit:
    """One model on the rows of the months before `until` (months since year 0; all if None)."""

    name: str
    until: int | None
    rounds: int
    depth: int
    step: float
    row_share: float = 1.0
    column_share: float = 1.0
    min_rows: int = 1
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number, children of k are 2k and 2k + 1; a feature of -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        size = 2 ** (depth + 1)
        return Tree(np.full(size, -1, dtype=np.int16), np.zeros(size, dtype=np.int16), np.zeros(size))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each binned row has come to."""
        at = np.ones(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            right = bins[rows, np.maximum(feature, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + right, at)


@dataclass
class Forest:
    base: float
    trees: list[Tree]

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for tree in self.trees:
            out += tree.value[tree.nodes(bins)]
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chosen_rows(fit: Fit, round_: int, keys: np.ndarray) -> np.ndarray:
    """The share of rows that a round sees, by a hash of the row's key."""
    if fit.row_share >= 1:
        return np.ones(len(keys), dtype=bool)
    salt = _mixed(np.array([fit.seed * 1_000_003 + round_], dtype=np.uint64))
    return _mixed(keys.view(np.uint64) ^ salt) < np.uint64(fit.row_share * float(2**64 - 2**12))


def chosen_columns(fit: Fit, round_: int, count: int) -> np.ndarray:
    """Whether a round may split by each feature."""
    most = max(1, int(round(fit.column_share * count)))
    picked = np.random.default_rng((fit.seed, round_)).permutation(count)[:most]
    return np.isin(np.arange(count), picked)


class Block:
    """Binned rows of one partition, and every fit's predictions for them."""

    def __init__(self, bins: np.ndarray, target: np.ndarray, month: np.ndarray, keys: np.ndarray):
        self.bins, self.target, self.month, self.keys = bins, target, month, keys
        self.predicted: dict[int, np.ndarray] = {}

    def rows(self, fit: Fit) -> np.ndarray:
        return np.ones(len(self.month), dtype=bool) if fit.until is None else self.month < fit.until

    def totals(self, fit: Fit) -> np.ndarray:
        """Rows and sum of the target of a fit."""
        seen = self.target[self.rows(fit)]
        return np.array([len(seen), seen.sum()])

    def apply(self, k: int, base: float, trees: Sequence[Tree]) -> None:
        at = self.predicted.setdefault(k, np.full(len(self.bins), base))
        for tree in trees:
            at += tree.value[tree.nodes(self.bins)]

    def sums(self, k: int, fit: Fit, round_: int, tree: Tree, level: int) -> np.ndarray:
        """(nodes of the level, features, bins, [rows, residuals])."""
        features = self.bins.shape[1]
        used = self.rows(fit) & chosen_rows(fit, round_, self.keys)
        bins = self.bins[used]
        node = tree.nodes(bins) - 2**level
        held = (node >= 0) & (node < 2**level)
        bins, node = bins[held], node[held]
        residual = (self.target - self.predicted[k])[used][held]
        size = 2**level * features * BINS
        place = ((node[:, None] * features + np.arange(features)) * BINS + bins).ravel()
        out = np.empty((size, 2))
        out[:, 0] = np.bincount(place, minlength=size)
        out[:, 1] = np.bincount(place, weights=np.repeat(residual, features), minlength=size)
        return out.reshape(2**level, features, BINS, 2)


def split(fit: Fit, round_: int, tree: Tree, level: int, sums: np.ndarray) -> None:
    """Splits the nodes of a level where that lowers the squared error, and gives them values."""
    features = sums.shape[1]
    allowed = chosen_columns(fit, round_, features)
    left = sums.cumsum(axis=2)
    total = left[:, :1, -1:, :]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0]
        whole = total[:, 0, 0, 1] ** 2 / total[:, 0, 0, 0]
    gain[(left[..., 0] < fit.min_rows) | (right[..., 0] < fit.min_rows)] = -np.inf
    gain[:, ~allowed] = -np.inf
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    for i, at in enumerate(best.tolist()):
        node, (rows, residual) = 2**level + i, total[i, 0, 0]
        if not rows:
            continue
        if level == 0:
            tree.value[node] = fit.step * residual / rows
        if not flat[i, at] - whole[i] > 1e-9 * max(1.0, abs(whole[i])):
            continue
        feature, cut = divmod(at, BINS)
        tree.feature[node], tree.cut[node] = feature, cut
        for child, (n, r) in ((2 * node, left[i, feature, cut]), (2 * node + 1, right[i, feature, cut])):
            tree.value[child] = fit.step * r / n


# (fit number, round, trees of all fits, level) -> sums of each fit
Sums = Callable[[int, dict[int, Tree], int], dict[int, np.ndarray]]


def grow(fits: Sequence[Fit], numbers: Sequence[int], sums: Sums, keep: Callable[[int, dict[int, Tree]], None]) -> None:
    """Grows the fits of these numbers round by round; `keep` gets each round's trees."""
    for round_ in range(max((fits[k].rounds for k in numbers), default=0)):
        trees = {k: Tree.empty(fits[k].depth) for k in numbers if round_ < fits[k].rounds}
        for level in range(max(fits[k].depth for k in trees)):
            for k, found in sums(round_, trees, level).items():
                split(fits[k], round_, trees[k], level, found)
        keep(round_, trees)


def grow_alone(fit: Fit, block: Block) -> Forest:
    """One fit on the rows of one block."""
    n, total = block.totals(fit)
    forest = Forest(total / n if n else 0.0, [])
    block.predicted = {}
    block.apply(0, forest.base, [])

    def sums(round_: int, trees: dict[int, Tree], level: int) -> dict[int, np.ndarray]:
        return {0: block.sums(0, fit, round_, trees[0], level)} if level < fit.depth else {}

    def keep(round_: int, trees: dict[int, Tree]) -> None:
        forest.trees.append(trees[0])
        block.apply(0, forest.base, [trees[0]])

    grow([fit], [0], sums, keep)
    return forest


# ---- in Spark ----
def quantile_cuts(rows: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """At most bins - 1 ascending cuts per column, from one pass of approximate quantiles."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in columns]).first()
    return [sorted(set(found[c] or ())) for c in columns]


def binned(values: np.ndarray, cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin numbers of (rows, columns) values: how many cuts lie below each."""
    out = np.zeros(values.shape, dtype=np.uint8)
    for j, own in enumerate(cuts):
        out[:, j] = np.searchsorted(np.asarray(own, dtype=np.float64), values[:, j], side="left")
    return out


BLOCKS = "block long, data binary"


def _packed(cuts: Sequence[Sequence[float]], most: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            parts = [np.concatenate(p) for p in zip(*held)]
            order = np.argsort(parts[3], kind="stable")  # sums do not depend on the order of arrival
            data = pickle.dumps(Block(binned(parts[0], cuts)[order], *(p[order] for p in parts[1:])), protocol=5)
            return pa.RecordBatch.from_pydict({"block": pa.array([0], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            if batch.num_rows:
                values = batch["values"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                held.append((values, *(batch[c].to_numpy() for c in ("target", "month", "key"))))
            if sum(len(h[1]) for h in held) >= most:
                yield made()
                held = []
        if held:
            yield made()

    return run


def blocks_of(
    rows: DataFrame, columns: Sequence[str], target: str, month: str, key: Sequence[str],
    cuts: Sequence[Sequence[float]], most: int = BLOCK_ROWS,
) -> tuple[DataFrame, int]:
    """The rows as blocks, and how many rows there are. Columns must not be null."""
    slim = rows.select(
        F.array(*[F.col(c).cast("double") for c in columns]).alias("values"),
        F.col(target).cast("double").alias("target"),
        (F.year(month) * 12 + F.month(month) - 1).cast("long").alias("month"),
        F.xxhash64(*key).alias("key"),
    )
    stored = materialize(slim)
    count = stored.count()
    # Few rows meet in one block; more stay as they are dealt.
    dealt = stored.coalesce(1) if count <= most else stored
    blocks = dealt.mapInArrow(_packed(cuts, most), BLOCKS)
    return materialize(blocks.withColumn("block", F.monotonically_increasing_id())), count


def fit_forests(blocks: DataFrame, count: int, fits: Sequence[Fit], most: int = BLOCK_ROWS) -> list[Forest]:
    """The forest of every fit. Forests alone come to the driver: rounds x 2 ** (depth + 1) nodes each."""
    if count <= most:
        return _each_alone(blocks, fits)
    return _together(blocks, fits)


def _each_alone(blocks: DataFrame, fits: Sequence[Fit]) -> list[Forest]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = pickle.loads(rows["data"].iloc[0])
        return pd.DataFrame({"fit": [key[0]], "forest": [pickle.dumps(grow_alone(fits[key[0]], block), protocol=5)]})

    numbered = blocks.withColumn("fit", F.explode(F.array(*[F.lit(i) for i in range(len(fits))])))
    grown = numbered.repartition(len(fits), "fit").groupBy("fit").applyInPandas(run, "fit int, forest binary")
    found = {r["fit"]: pickle.loads(r["forest"]) for r in grown.collect()}
    return [found.get(i, Forest(0.0, [])) for i in range(len(fits))]


def _together(blocks: DataFrame, fits: Sequence[Fit]) -> list[Forest]:
    spark = blocks.sparkSession
    numbers = list(range(len(fits)))

    def added(parts: DataFrame) -> dict[int, np.ndarray]:
        """Sums of the blocks' arrays per fit; only one array per fit reaches the driver."""

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, dtype=np.float64) for x in rows["sums"])
            return pd.DataFrame({"fit": [key[0]], "sums": [total.tobytes()]})

        # Tasks add up their own blocks first, then groups of tasks, then all.
        halves = parts.withColumn("deal", F.spark_partition_id() % 32).groupBy("fit", "deal").applyInPandas(
            lambda key, rows: run(key[:1], rows), "fit int, sums binary"
        )
        return {
            r["fit"]: np.frombuffer(r["sums"], dtype=np.float64)
            for r in halves.groupBy("fit").applyInPandas(run, "fit int, sums binary").collect()
        }

    def over_blocks(table: DataFrame, make: Callable[[Block], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for data in batch["data"]:
                    for k, found in make(pickle.loads(data.as_buffer())):
                        total[k] = total[k] + found if k in total else found
            if total:
                yield pa.RecordBatch.from_pydict(
                    {"fit": pa.array(list(total), pa.int32()), "sums": pa.array([x.tobytes() for x in total.values()], pa.binary())}
                )

        return table.mapInArrow(run, "fit int, sums binary")

    totals = added(over_blocks(blocks, lambda block: ((k, block.totals(fits[k])) for k in numbers)))
    forests = [Forest(totals[k][1] / totals[k][0] if totals[k][0] else 0.0, []) for k in numbers]
    bases = [f.base for f in forests]
    state = {"blocks": blocks, "since": 0}

    def written() -> DataFrame:
        """The blocks with the predictions of all rounds so far."""
        shared = spark.sparkContext.broadcast([f.trees[state["since"] :] for f in forests])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, data in zip(batch["block"].to_pylist(), batch["data"]):
                    block = pickle.loads(data.as_buffer())
                    for k in numbers:
                        block.apply(k, bases[k], shared.value[k])
                    yield pa.RecordBatch.from_pydict(
                        {"block": pa.array([number], pa.int64()), "data": pa.array([pickle.dumps(block, protocol=5)], pa.binary())}
                    )

        return materialize(state["blocks"].mapInArrow(run, BLOCKS))

    def sums(round_: int, trees: dict[int, Tree], level: int) -> dict[int, np.ndarray]:
        recent = {k: forests[k].trees[state["since"] :] for k in trees}
        shared = spark.sparkContext.broadcast((trees, recent))

        def make(block: Block) -> Iterator[tuple[int, np.ndarray]]:
            grown, earlier = shared.value
            for k, tree in grown.items():
                if level < fits[k].depth:
                    block.apply(k, bases[k], earlier[k])
                    yield k, block.sums(k, fits[k], round_, tree, level).ravel()

        found = added(over_blocks(state["blocks"], make))
        return {k: x.reshape(2**level, -1, BINS, 2) for k, x in found.items()}

    def keep(round_: int, trees: dict[int, Tree]) -> None:
        for k, tree in trees.items():
            forests[k].trees.append(tree)
        if (round_ + 1) % WRITE_EVERY == 0:
            state["blocks"] = written()
            state["since"] = round_ + 1

    grow(fits, numbers, sums, keep)
    return forests


def predicted(
    rows: DataFrame, columns: Sequence[str], cuts: Sequence[Sequence[float]], forests: Sequence[Forest],
    chosen: str, name: str = "predicted",
) -> DataFrame:
    """`rows` with a prediction by the forest whose number the column `chosen` holds."""
    shared = rows.sparkSession.sparkContext.broadcast((cuts, forests))

    @F.pandas_udf("double")
    def score(values: pd.Series, number: pd.Series) -> pd.Series:
        cuts, forests = shared.value
        out = np.full(len(values), np.nan)
        if len(values):
            bins = binned(np.stack(values.to_numpy()).astype(np.float64), cuts)
            for k in np.unique(number.to_numpy()).tolist():
                at = (number == k).to_numpy()
                out[at] = forests[int(k)].predict(bins[at])
        return pd.Series(out)

    inputs = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    return rows.withColumn(name, score(inputs, F.col(chosen)))
