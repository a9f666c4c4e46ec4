"""Near duplicates by b-bit MinHash.

Each text's shingle set gets `HASHES` minima. Groups of `ROWS` full minima are the
band keys; of every minimum the lowest `BITS` bits are packed into the signature. Two
texts are candidates when a band key agrees and the similarity estimated from the
packed bits, corrected for bits that agree by chance, is not far below the threshold.
Every link is confirmed on the full shingle sets. A pair at the threshold of 0.85 goes
without a common band with a probability under one in a million.

Groups may be huge, so pairs are never listed in full:

1. Texts with equal shingle sets (by a 256-bit digest) become one class; only
   representatives go on.
2. In each bucket of a band, members meet only the smallest one (a star). Each takes its
   best-looking star centre, and those pairs are confirmed.
3. Only buckets that still hold several components go on. Their members meet in blocks
   of bounded size, spread over tasks. A first pass over the signatures marks the members
   with a candidate of another component, each pair in the first band that it shares; the
   marked ones meet again with their texts, all their candidates are compared in full, and
   a spanning forest of the links comes back. No pairs are written, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurring_metrics.llm.common import column, components, slices
from recurring_metrics.llm.pieces import gathered
from recurring_metrics.llm.shingles import mix, shingle_sets
from recurring_metrics.sources.io import materialize

ROWS, BANDS, BITS = 6, 32, 4
HASHES = ROWS * BANDS
LANES = 64 // BITS
# Candidates may look this much less similar than the threshold: over four standard errors.
MARGIN = 0.12
BLOCK, SHINGLES = 1024, 400_000
_STEPS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = (np.arange(LANES) * BITS).astype(np.uint64)
_ONES = np.uint64(0x1111111111111111)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each of the multiplicative hashes over a set, in bounded memory."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(best, (shingles[at : at + 1024, None] * _STEPS).min(axis=0), out=best)
    return best


def signature(best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (HASHES * BITS / 64 words) and one key per band, of many rows of minima."""
    low = mix(best) & np.uint64(2**BITS - 1)
    packed = np.bitwise_or.reduce(low.reshape(len(best), -1, LANES) << _SHIFTS, axis=2)
    keys = np.zeros((len(best), BANDS), dtype=np.uint64)
    rows = best.reshape(len(best), BANDS, ROWS)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(31) + rows[:, :, k])
    keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
    return packed.view(np.int64), keys.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, ["text"]):
            sets = shingle_sets([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch["text"]])
            full = [s for s in sets if len(s)]
            packed, keys = signature(np.array([minima(s) for s in full]).reshape(-1, HASHES))
            row = iter(range(len(full)))
            places = [next(row) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch["id"],
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([blake2b(s.tobytes(), digest_size=32).digest() for s in sets], pa.binary()),
                    "sig": pa.array([None if p is None else packed[p] for p in places], pa.list_(pa.int64())),
                    "bands": pa.array([None if p is None else keys[p] for p in places], pa.list_(pa.int64())),
                }
            )


SKETCH = "id long, n_shingles long, digest binary, sig array<long>, bands array<long>"


def estimated(left: str, right: str) -> Column:
    """Similarity from two signatures: unequal lanes counted by bits, chance agreement removed."""
    differing = F.expr(
        f"aggregate(zip_with({left}, {right}, (x, y) -> bit_count(("
        "(x ^ y) | shiftrightunsigned(x ^ y, 1) | shiftrightunsigned(x ^ y, 2) | shiftrightunsigned(x ^ y, 3)"
        f") & {int(_ONES)}L)), 0, (a, b) -> a + b)"
    )
    chance = 2.0**-BITS
    return ((1.0 - differing / HASHES) - chance) / (1.0 - chance)


def _confirm(threshold: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ["ta", "tb"]):
                take = [
                    [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch[c]] for c in ("ta", "tb")
                ]
                sets = shingle_sets(take[0] + take[1])
                good = []
                for i in range(batch.num_rows):
                    a, b = sets[i], sets[i + batch.num_rows]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    good.append(bool(both) and 100 * both >= threshold * (len(a) + len(b) - both))
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(
                    pa.array(good, pa.bool_())
                )

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; texts has (id, text)."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_confirm(threshold), "a long, b long")


def _lanes_unequal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Unequal lanes of every row of x against every row of y."""
    total = np.zeros((len(x), len(y)), dtype=np.uint16)
    for k in range(x.shape[1]):
        z = x[:, k, None] ^ y[None, :, k]
        z |= z >> np.uint64(1)
        z |= z >> np.uint64(2)
        total += np.bitwise_count(z & _ONES).astype(np.uint16)
    return total


def _near_pairs(block: dict, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (rows i, j) of a block: other component, alike enough, first met in this band."""
    side, comps, sigs, bands = block["side"], block["comp"], block["sig"], block["bands"]
    if comps.min() == comps.max():
        return
    alone = block["i"] == block["j"]
    rows = np.arange(len(side)) if alone else np.flatnonzero(side == 0)
    cols = rows if alone else np.flatnonzero(side == 1)
    for at in range(0, len(rows), 128):
        r = rows[at : at + 128]
        near = _lanes_unequal(sigs[r], sigs[cols]) <= most
        near &= comps[r][:, None] != comps[cols][None, :]
        if alone:
            near &= r[:, None] < cols[None, :]
        i, j = np.nonzero(near)
        i, j = r[i], cols[j]
        for part in range(0, len(i), 1 << 16):
            x, y = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            band = (bands[x] == bands[y]).argmax(axis=1)
            here = bands[x, band] == block["key"]
            if here.any():
                yield x[here], y[here]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The groups (key, i, j) of sorted rows, as arrays; groups may span batches."""
    held: list[dict] = []

    def joined() -> dict:
        out = {n: np.concatenate([h[n] for h in held]) for n in held[0] if n not in ("group", "texts")}
        key, i, j = held[0]["group"].tolist()
        return out | {"key": key, "i": i, "j": j, "texts": [t for h in held for t in h["texts"]]}

    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch[c].to_numpy() for c in ("key", "i", "j")], axis=1)
        columns = {c: batch[c].to_numpy() for c in ("id", "comp", "side")}
        for c in ("sig", "bands"):
            columns[c] = batch[c].flatten().to_numpy().reshape(batch.num_rows, -1)
        columns["sig"] = columns["sig"].view(np.uint64)
        texts = batch["text"] if "text" in batch.schema.names else None
        new = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        edges = [0, *new.tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if held and (held[0]["group"] != group[lo]).any():
                yield joined()
                held = []
            own = [] if texts is None else [t.as_buffer().to_pybytes() for t in texts.slice(lo, hi - lo)]
            held.append({n: c[lo:hi] for n, c in columns.items()} | {"group": group[lo], "texts": own})
    if held:
        yield joined()


def _mark(most: float) -> object:
    """The members of each block that have a candidate, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            found = [np.unique(np.concatenate(pair)) for pair in _near_pairs(block, most)]
            if found:
                rows = np.unique(np.concatenate(found))
                same = {c: np.full(len(rows), block[c], dtype=np.int64) for c in ("key", "i", "j")}
                own = {c: block[c][rows].astype(np.int64) for c in ("id", "comp", "side")}
                yield pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in (same | own).items()})

    return run


MARKED = "key long, i long, j long, id long, comp long, side long"


def _verify(most: float, threshold: int) -> object:
    """Links (a, b) of each block: all candidates compared in full, as a spanning forest."""

    def links(block: dict) -> list[tuple[int, int]]:
        sets: list[np.ndarray] = []
        for at in range(0, len(block["texts"]), 256):
            sets += shingle_sets(block["texts"][at : at + 256])
        size = np.array([len(s) for s in sets])
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.cumsum(size) - size
        present = np.zeros(int(codes.max()) + 1, dtype=bool)
        root, made = {}, []

        def top(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        for i, j in _near_pairs(block, most):
            for x in np.unique(i).tolist():
                others = j[i == x]
                mine = top(int(block["comp"][x]))
                others = others[[top(c) != mine for c in block["comp"][others].tolist()]]
                if not len(others):
                    continue
                own = codes[first[x] : first[x] + size[x]]
                present[own] = True
                places = gathered(first[others], size[others])
                both = np.add.reduceat(present[codes[places]].astype(np.int64), np.cumsum(size[others]) - size[others])
                present[own] = False
                for y in others[100 * both >= threshold * (size[x] + size[others] - both)].tolist():
                    p, q = top(int(block["comp"][x])), top(int(block["comp"][y]))
                    if p != q:
                        root[q] = p
                        made.append((int(block["id"][x]), int(block["id"][y])))
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            made = links(block)
            if made:
                a, b = zip(*made)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def remaining_links(members: DataFrame, reps: DataFrame, texts: DataFrame, threshold: int, block: int) -> DataFrame:
    """Links (a, b) between different components among the members (key, id, comp) of buckets.

    A bucket is cut into blocks by a hash of the id, so that a block holds about
    `block` members and `SHINGLES` shingles; each pair of blocks meets in one group.
    """
    most = HASHES * (1 - (2.0**-BITS + (1 - 2.0**-BITS) * (threshold / 100 - MARGIN)))
    known = members.join(reps, "id")
    sizes = known.groupBy("key").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") / SHINGLES)
        ).alias("blocks")
    )
    dealt = known.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "id",
        "comp",
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).cast("long").alias("side"),
        "sig",
        "bands",
    )

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    marked = materialize(in_blocks(met).mapInArrow(_mark(most), MARKED))
    again = marked.join(reps.select("id", "sig", "bands"), "id").join(texts, "id").select(
        "key", "i", "j", "id", "comp", "side", "sig", "bands", "text"
    )
    return in_blocks(again).mapInArrow(_verify(most, threshold), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = 85,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of `docs`: the id, n_shingles, component_id and kept.

    Texts are linked when 100 * intersection >= threshold * union of their sets
    of 5-word shingles (`shingles.py`). The component is the smallest id that
    links reach; kept marks that row. Null, empty and blank texts have no
    shingles and no links. Rows with a null id are their own component (null) and
    kept. Rows that repeat an id should repeat its text; they share its row
    values. Other columns are not read.
    """
    raw = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    sketch = materialize(raw.mapInArrow(_sketch, SKETCH))
    known = sketch.where("id IS NOT NULL AND n_shingles > 0")
    classes = materialize(known.groupBy("digest").agg(F.min("id").alias("rep")))
    reps = materialize(
        known.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
        .select("id", "n_shingles", "sig", "bands")
        .dropDuplicates(["id"])
    )
    sigs = reps.select("id", "sig")
    texts = raw.join(sigs.select("id"), "id", "left_semi").dropDuplicates(["id"])

    banded = reps.select("id", F.explode("bands").alias("key"))
    shared = (
        banded.groupBy("key")
        .agg(F.min("id").alias("centre"), F.max("id").alias("last"))
        .where("centre <> last")
        .select("key", "centre")
    )
    met = materialize(banded.join(shared, "key"))

    star = (
        met.where("id <> centre").select("id", "centre").distinct()
        .join(sigs, "id")
        .join(sigs.select(F.col("id").alias("centre"), F.col("sig").alias("centre_sig")), "centre")
        .select("id", "centre", estimated("sig", "centre_sig").alias("likeness"))
        .where(F.col("likeness") >= threshold / 100 - MARGIN)
        .groupBy("id")
        .agg(F.max(F.struct("likeness", (-F.col("centre")).alias("neg"))).alias("best"))
        .select(F.col("id").alias("a"), (-F.col("best.neg")).alias("b"))
    )
    links = materialize(confirmed(star, texts, threshold))
    groups = components(links)
    members = met.select("key", "id").join(groups, "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("comp")
    )
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    todo = members.join(mixed.where("lo <> hi").select("key"), "key", "left_semi")
    found = materialize(remaining_links(todo, reps, texts, threshold, block))
    if not found.isEmpty():
        groups = components(links.union(found))

    of_class = classes.join(groups, classes["rep"] == groups["id"], "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id")
    )
    # Texts without shingles are a class of no use: they pass by the join.
    worded = sketch.where("n_shingles > 0").select("id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.col("component_id"))
    out = worded.select("id", "n_shingles", component.alias("component_id")).union(
        sketch.where("n_shingles = 0").select("id", "n_shingles", "id")
    )
    component = F.col("component_id")
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        "component_id",
        (F.coalesce(component == F.col("id"), F.lit(True))).alias("kept"),
    )
