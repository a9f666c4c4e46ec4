"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample so that the signs of the rotated components,
cut at the sample's medians, form balanced codes that keep angles; several rotations give
as many bits as the tables need. A table holds a substring of the code: vectors with an
equal substring (and label) share a bucket. How often a cut separates a pair at the threshold
is measured on the sample, against planted neighbours: vectors that share a direction are
separated far more often than their angle says. The substring's length is the cheapest for
that rate (none, hence all pairs, if codes do not help), and tables are added until planted
pairs are missed no more than allowed. In the buckets the original vectors are compared, in
double precision.

Vectors of different lengths never meet: each length has tables of its own, and a length
with few vectors is one bucket per label. Equal vectors are one class. Buckets with one member are dropped before any vector moves.
Large buckets are cut into blocks, and pairs of blocks meet in tasks of bounded size. A
pair found in several tables is counted in the first one only. Tasks return link counts
and a spanning forest of the links, not the pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurring_metrics.llm.common import column, components
from recurring_metrics.sources.io import materialize

THRESHOLD, SAMPLE, ROUNDS, MISS, BLOCK = 0.98, 4_000, 25, 1e-3, 1024
FEWEST_BITS, MOST_BITS = 8, 20
# Planted pairs of each kind; costs of placing a row in a table, of moving its vector, of a comparison.
PLANTED, PLACED, MOVED, COMPARED = 4_000, 2.0, 10.0, 0.05


def rotations(sample: np.ndarray, rounds: int = ROUNDS) -> Iterator[np.ndarray]:
    """(dims x dims) projections without end.

    Each rotation starts at random and is alternated with the codes: signs of
    the rotated sample, then the rotation that brings the sample nearest to them.
    """
    dims = sample.shape[1]
    centred = sample - sample.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    principal = sample @ axes
    for seed in itertools.count():
        rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
        for _ in range(rounds):
            turned = principal @ rotation
            codes = np.where(turned >= np.median(turned, axis=0), 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ principal)
            rotation = (left @ right).T
        yield axes @ rotation


def learn_rotations(sample: np.ndarray, bits: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(dims x bits) projections and their medians, `dims` bits from each rotation."""
    made = itertools.islice(rotations(sample, rounds), math.ceil(bits / sample.shape[1]))
    projection = np.concatenate(list(made), axis=1)[:, :bits]
    return projection, np.median(sample @ projection, axis=0)


def planted_pairs(sample: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors of the sample and neighbours whose cosine to them is `threshold`.

    They lie in random directions, and in directions of the differences of the sample.
    """
    chooser = np.random.default_rng(11)
    base = sample[np.arange(max(PLANTED, len(sample))) % len(sample)]
    pairs = []
    for away in (
        chooser.standard_normal(base.shape),
        sample[chooser.integers(len(sample), size=len(base))] - base,
    ):
        away = away - (away * base).sum(axis=1, keepdims=True) * base
        size = np.linalg.norm(away, axis=1)
        far = size > 1e-9
        beside = away[far] / size[far, None]
        if far.any():
            pairs.append((base[far], threshold * base[far] + math.sqrt(max(0.0, 1 - threshold**2)) * beside))
    return pairs


def plan_tables(vectors: int, rate: float, miss: float = MISS, block: int = BLOCK) -> tuple[int, int]:
    """Bits per substring and number of tables if a bit separates a linked pair at this rate."""

    def tables(bits: int) -> int:
        same = (1 - rate) ** bits
        return 1 if same >= 1 else math.ceil(math.log(miss) / math.log1p(-same))

    def cost(bits: int) -> float:
        others = vectors / 2**bits
        moved = (1 - math.exp(-others)) * max(1.0, others / block)
        return tables(bits) * (PLACED + MOVED * moved + COMPARED * others)

    most = min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(max(vectors, 2)))))
    bits = min(range(most, -1, -1), key=cost)
    return bits, tables(bits)


def learn_tables(
    sample: np.ndarray, vectors: int, threshold: float, miss: float = MISS, block: int = BLOCK
) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Projections, medians, bits per substring and number of tables for unit vectors like the sample.

    A quarter of the sample is not learned from: its vectors get the planted
    neighbours, as codes fit what they were learned from too well. Tables are
    added until the share of planted pairs that agree in none is `miss` at most,
    for every kind of pair, and are never fewer than the rate asks for.
    """
    away = np.arange(len(sample)) % 4 == 3
    learned, kept = (sample[~away], sample[away]) if away.any() else (sample, sample)
    left = planted_pairs(kept, threshold)
    allowed = [miss * len(x) for x, _ in left]
    more = rotations(learned)
    spare = np.zeros((sample.shape[1], 0))

    def cuts(bits: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal spare
        while spare.shape[1] < bits:
            spare = np.concatenate((spare, next(more)), axis=1)
        taken, spare = spare[:, :bits], spare[:, bits:]
        return taken, np.median(learned @ taken, axis=0)

    def apart(x: np.ndarray, y: np.ndarray, cut: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return (x @ cut[0] >= cut[1]) != (y @ cut[0] >= cut[1])

    trial = cuts(max(MOST_BITS, sample.shape[1]))
    spare = np.concatenate((trial[0], spare), axis=1)
    rates = [apart(x, y, trial).mean() for x, y in left]
    bits, planned = plan_tables(vectors, max([math.acos(min(1.0, threshold)) / math.pi, *rates]), miss, block)
    if not bits:
        return trial[0][:, :0], trial[1][:0], 0, 1
    made, step = [], max(1, planned // 10)
    while len(made) * step < planned or any(len(x) > n for (x, _), n in zip(left, allowed)):
        if len(made) * step > 10 * planned:
            # In few dimensions all rotations may end alike: then all pairs are compared.
            return trial[0][:, :0], trial[1][:0], 0, 1
        made.append(cuts(bits * step))
        for k, (x, y) in enumerate(left):
            lost = apart(x, y, made[-1]).reshape(len(x), step, bits).any(axis=2).all(axis=1)
            left[k] = x[lost], y[lost]
    projection, medians = (np.concatenate(parts, axis=-1) for parts in zip(*made))
    return projection, medians, bits, len(made) * step


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; the largest component goes first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(values: pa.Array, dims: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The components of all lists in a row, and where each list begins and the last ends."""
    ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return values.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], ends))


def _code(shared: object) -> object:
    """The keys of vectors; a length without learned cuts has one key for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dims"].to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                projection, medians, bits, tables = shared.value.get(d, (None, None, 0, 1))
                if bits:
                    signs = _unit(_matrix(part["vector"], d)) @ projection >= medians
                    keys = signs.reshape(len(signs), tables, bits) @ (1 << np.arange(bits)).astype(np.int64)
                else:
                    keys = np.zeros((part.num_rows, 1), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["label"], part["dims"], pa.array(list(keys), pa.list_(pa.int64()))],
                    ["id", "label", "dims", "keys"],
                )

    return run


def _compare(threshold: float) -> object:
    """Link counts and forests of sorted groups (label, dims, table, bucket, i, j)."""

    def linked(alone, ids, side, tables, vectors, keys, weights):
        """`alone`: the members of one block, not of a pair of blocks."""
        if alone:
            x = y = np.arange(len(ids))
        else:
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(x) or not len(y):
            return ids[:0], np.empty(0, dtype=np.int64), []
        unit = _unit(vectors)
        count = np.zeros(len(ids), dtype=np.int64)
        root = np.arange(len(ids))
        forest = []

        def top(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for at in range(0, len(x), 256):
            rows = x[at : at + 256]
            near = unit[rows] @ unit[y].T >= threshold
            i, j = np.nonzero(near)
            i, j = rows[i], y[j]
            keep = ids[i] < ids[j] if x is y else ids[i] != ids[j]
            i, j = i[keep], j[keep]
            # A pair belongs to the first table where its substrings agree.
            first = (keys[i] == keys[j]).argmax(axis=1) == tables[0]
            i, j = i[first], j[first]
            np.add.at(count, i, weights[j])
            np.add.at(count, j, weights[i])
            for a, b in zip(i.tolist(), j.tolist()):
                p, q = top(a), top(b)
                if p != q:
                    root[p] = q
                    forest.append((ids[a], ids[b]))
        hit = np.flatnonzero(count)
        return ids[hit], count[hit], forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit():
            parts = [np.concatenate([h[k] for h in held]) for k in range(1, 7)]
            if len(parts[0]) < 2:
                return None
            alone = held[0][0][-2] == held[0][0][-1]
            ids, count, forest = linked(alone, *parts)
            if not len(ids):
                return None
            a = np.concatenate((ids, [p for p, _ in forest])).astype(np.int64)
            none = np.full(len(ids), -1, dtype=np.int64)
            b = pa.array(
                np.concatenate((none, [q for _, q in forest])).astype(np.int64),
                mask=np.arange(len(a)) < len(ids),
            )
            links = np.concatenate((count, np.zeros(len(forest)))).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(links)], ["a", "b", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch[c].to_numpy() for c in ("label", "dims", "table", "bucket", "i", "j")], axis=1)
            plain = [batch[c].to_numpy() for c in ("id", "side", "table")]
            listed = [_flat(batch[c]) for c in ("vector", "keys")]
            copies = batch["copies"].to_numpy()
            new = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            edges = [0, *new.tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if held and (held[0][0] != group[lo]).any():
                    if (made := emit()) is not None:
                        yield made
                    held.clear()
                # All vectors of a group are of one length.
                lists = [values[at[lo] : at[hi]].reshape(hi - lo, -1) for values, at in listed]
                held.append((group[lo], *[c[lo:hi] for c in plain], *lists, copies[lo:hi]))
        if held and (made := emit()) is not None:
            yield made

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    sample: int = SAMPLE,
    miss: float = MISS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of `vectors`: the id, n_links, component_id and kept.

    Vectors of one label (of any type that can be compared) are linked from a cosine of `threshold` on; n_links
    counts the other rows linked directly, component_id is the smallest id that
    links reach. Null and zero vectors, vectors with null or non-finite
    components, and rows with a null label or id are linked with nothing, nor are
    vectors of different lengths. At most about `sample` vectors of a length are
    used to learn its rotations; all are indexed, and lengths with at most `block`
    vectors are compared in full. Rows that repeat an id are counted as rows of
    their own. Other columns are not read.
    """
    spark = vectors.sparkSession
    raw = vectors.select(
        column(id_col).cast("long").alias("id"),
        column(label_col).alias("label"),
        column(vector_col).cast("array<double>").alias("vector"),
    )
    if not isinstance(raw.schema["label"].dataType, (T.IntegralType, T.BooleanType)):
        # Labels of other types get numbers; equal ones the same.
        names = raw.select("label").where("label IS NOT NULL").distinct()
        numbered = materialize(names.withColumn("number", F.monotonically_increasing_id()))
        raw = materialize(raw.join(numbered, "label", "left").select("id", F.col("number").alias("label"), "vector"))
    raw = raw.withColumn("label", F.col("label").cast("long"))
    sound = (
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    usable = raw.where(sound)
    classes = materialize(
        usable.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    )
    sized = classes.withColumn("dims", F.size("vector"))
    # Few lengths have more vectors than a block; only those come to the driver.
    lengths = {r["dims"]: r["count"] for r in sized.groupBy("dims").count().where(F.col("count") > block).collect()}
    counts = classes.select("id", (F.col("copies") - 1).alias("links"))
    cuts = {}
    for dims, total in sorted(lengths.items()):
        share = min(1.0, sample / total)
        chosen = sized.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < 1_000_003 * share))
        learned = _matrix(chosen.select("vector").toArrow()["vector"].combine_chunks(), dims)
        if not len(learned):
            learned = np.eye(dims)
        cuts[dims] = learn_tables(_unit(learned), total, threshold, miss, block)
    shared = spark.sparkContext.broadcast(cuts)
    coded = materialize(
        sized.select("id", "label", "dims", "vector").mapInArrow(
            _code(shared), "id long, label long, dims int, keys array<long>"
        )
    )
    bucket = ["label", "dims", "table", "bucket"]
    placed = coded.select("id", "label", "dims", F.posexplode("keys").alias("table", "bucket"))
    sizes = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = placed.join(sizes, bucket).withColumn("blocks", F.ceil(F.col("members") / block))
    members = members.withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *bucket,
        "id",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    rows = (
        met.join(coded.select("id", "label", "dims", "keys"), ["id", "label", "dims"])
        .join(sized.select("id", "label", "dims", "vector", "copies"), ["id", "label", "dims"])
        .select(*bucket, "i", "j", "id", "side", "vector", "keys", "copies")
    )
    found = materialize(
        rows.repartition(*bucket, "i", "j")
        .sortWithinPartitions(*bucket, "i", "j")
        .mapInArrow(_compare(threshold), "a long, b long, links long")
    )
    counts = counts.union(found.where("b IS NULL").select("a", "links"))
    edges = found.where("b IS NOT NULL").select("a", "b")
    links = counts.groupBy("id").agg(F.sum("links").alias("n_links"))
    groups = components(edges)
    of_class = (
        classes.join(links, "id")
        .join(groups, "id", "left")
        .select("label", "vector", "n_links", F.coalesce("component", "id").alias("component_id"))
    )
    # Unsound rows keep their own key, so that no hot null meets in one task.
    rows = raw.withColumn("sound", F.coalesce(sound, F.lit(False)))
    joined = rows.where("sound").join(of_class, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = joined.union(alone)
    return out.select(
        F.col("id").alias(id_col),
        "n_links",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
