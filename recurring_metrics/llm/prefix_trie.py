"""A prefix trie of conversations as balanced parentheses, one sequence per shard.

A turn is named by 128 bits of SHA-256, a conversation by its turns' names in a row: its
path. Sorted by path, conversations stand in the trie's depth-first order, and ranges of
them are shards. A shard writes the nodes that its paths pass as balanced parentheses, with
the relative depth (excess) after every sign. Blocks of signs keep their lowest excess, and
a tree of minima over the blocks finds the close of a node: the first place where the excess
falls below that at its opening. What lies between is the node's subtree, so that

* members and saved tokens are differences of arrays that add up along the sequence,
* leaves are the pairs `()` in between, by rank.

Only nodes on the first and the last path of a shard can have a part in another one: the
spines. Their parts are merged by node. What the merged spine nodes themselves add to their
ancestors is summed along each spine; a node that lies on several counts on the first one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurring_metrics.llm.common import column
from recurring_metrics.sources.io import materialize

NAME, BLOCK = 32, 64
WORD = r"[^\x20\x09-\x0D]+"
# Ids of a node's own members are written in pieces of this many.
LISTED = 4096


class Parens:
    """A sequence of opening (True) and closing (False) signs."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1)).astype(np.int64)
        pad = -len(opens) % BLOCK
        self.blocks = np.append(self.excess, np.full(pad, np.iinfo(np.int64).max)).reshape(-1, BLOCK)
        self.lowest = [self.blocks.min(axis=1)] if len(opens) else []
        while self.lowest and len(self.lowest[-1]) > 1:
            below = self.lowest[-1]
            if len(below) % 2:
                below = np.append(below, np.iinfo(np.int64).max)
            self.lowest.append(np.minimum(below[::2], below[1::2]))
        pairs = np.zeros(len(opens), dtype=np.int64)
        pairs[1:] = opens[:-1] & ~opens[1:]
        self.leaf_rank = np.cumsum(pairs)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Where each of the nodes opened at these places closes."""
        out = np.empty(len(at), dtype=np.int64)
        for lo in range(0, len(at), 1 << 14):
            out[lo : lo + (1 << 14)] = self._findclose(at[lo : lo + (1 << 14)])
        return out

    def _within(self, block: np.ndarray, first: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place from `first` on in each block whose excess is `below` at most; whether there is one."""
        hit = (self.blocks[block] <= below[:, None]) & (np.arange(BLOCK) >= first[:, None])
        return hit.argmax(axis=1), hit.any(axis=1)

    def _findclose(self, at: np.ndarray) -> np.ndarray:
        below = self.excess[at] - 1
        node = at // BLOCK
        place, found = self._within(node, at % BLOCK + 1, below)
        out = node * BLOCK + place
        left = np.flatnonzero(~found)
        node, low, level = node[left], below[left], np.zeros(len(left), dtype=np.int64)
        going = np.ones(len(left), dtype=bool)
        # Up until a right neighbour holds the place, then down to its block.
        for k, minima in enumerate(self.lowest):
            beside = node + 1
            ok = going & (node % 2 == 0) & (beside < len(minima))
            ok[ok] = minima[beside[ok]] <= low[ok]
            node = np.where(ok, beside, np.where(going, node // 2, node))
            level[ok] = k
            going &= ~ok
        for k in range(len(self.lowest) - 1, 0, -1):
            down = level == k
            child = node[down] * 2
            node[down] = np.where(self.lowest[k - 1][child] <= low[down], child, child + 1)
            level[down] = k - 1
        place, _ = self._within(node, np.zeros(len(node), dtype=np.int64), low)
        out[left] = node * BLOCK + place
        return out

    def leaves(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        """The pairs `()` from each opening to its close."""
        return self.leaf_rank[close] - self.leaf_rank[at]


def name(*parts: Column) -> Column:
    """The name of a turn: half of a SHA-256, in hexadecimal digits."""
    sized = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.substring(F.sha2(F.concat(*sized), 256), 1, NAME)


def turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turns): the named turns of every conversation in order, with their words."""
    role, text = (F.coalesce(column(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = rows.select(
        column(conv_col).cast("long").alias("conv_id"),
        F.struct(
            column(turn_col).alias("turn"), name(role, text).alias("name"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        ).alias("at"),
    ).where("conv_id IS NOT NULL")
    return named.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("turns"))


def with_heads(convs: DataFrame, every: int, most: int) -> DataFrame:
    """Each conversation c with its first h turns taken from c - c % `every`.

    h is the CRC-32 of the decimal id, modulo `most` + 1.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    own = convs.withColumn("h", h).withColumn("of", F.col("conv_id") - F.col("conv_id") % every)
    heads = convs.select(F.col("conv_id").alias("of"), F.slice("turns", 1, most).alias("head")).where(
        F.col("of") % every == 0
    )
    head = F.coalesce(F.slice("head", 1, F.col("h")), F.slice("turns", 1, 0))
    return own.join(heads, "of", "left").select(
        "conv_id", F.concat(head, F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")).alias("turns")
    )


OUT = (
    "kind int, chain long, node string, up string, depth long, conv_id long, up_conv long, n_convs long, "
    "n_children long, n_leaves long, saved long, words long, ends string, first long"
)
# Kinds of rows: a whole node, a part of a spine node, a piece of the ids that end at a spine node.
WHOLE, PART, ENDS = 0, 1, 2
_FIELDS = [c.split() for c in OUT.split(", ")]
_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[k]) for n, k in _FIELDS])


def _shared(a: str, b: str) -> int:
    """Turns that two paths begin with alike."""
    most = min(len(a), len(b)) // NAME
    if a[: most * NAME] == b[: most * NAME]:
        return most
    low, high = 0, most  # the answer lies in [low, high)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * NAME : middle * NAME] == b[low * NAME : middle * NAME]:
            low = middle
        else:
            high = middle
    return low


class Shard:
    """The trie of rows sorted by path and id; `words` has the words of each turn of a row."""

    def __init__(self, rows: list[tuple[str, int, list[int]]]):
        self.ids = np.array([r[1] for r in rows], dtype=np.int64)
        new = [i for i, r in enumerate(rows) if not i or r[0] != rows[i - 1][0]]
        self.paths = [rows[i][0] for i in new]
        self.first_row = np.array([*new, len(rows)], dtype=np.int64)
        signs, depth, owner, words, at = bytearray(), [], [], [], []
        stack = 0
        for u, i in enumerate(new):
            path, size = rows[i][0], len(rows[i][0]) // NAME
            keep = _shared(self.paths[u - 1], path) if u else -1
            if u:
                signs += bytes(stack - keep)
            for d in range(keep + 1, size + 1):
                depth.append(d)
                owner.append(u)
                words.append(rows[i][2][d - 1] if d else 0)
                at.append(len(signs))
                signs.append(1)
            stack = size
        signs += bytes(stack + 1)
        self.depth, self.owner = np.array(depth, dtype=np.int64), np.array(owner, dtype=np.int64)
        self.words, at = np.array(words, dtype=np.int64), np.array(at, dtype=np.int64)
        parens = Parens(np.frombuffer(bytes(signs), dtype=np.uint8).astype(bool))
        close = parens.findclose(at)
        nodes = len(at)
        # The nodes of a subtree are k .. after[k] - 1, its rows begin[k] .. end[k] - 1.
        self.after = np.searchsorted(at, close)
        self.begin = self.first_row[self.owner]
        self.end = self.first_row[np.append(self.owner, len(self.paths))[self.after]]
        self.leaf = close == at + 1
        self.leaves = parens.leaves(at, close)
        self.n_convs = self.end - self.begin
        bounds = np.stack([self.begin, self.end], axis=1).reshape(-1)
        self.lowest = np.minimum.reduceat(np.append(self.ids, np.iinfo(np.int64).max), bounds)[::2]
        self.last = np.searchsorted(self.owner, np.arange(len(self.paths)), side="right") - 1
        self.up = self._parents()
        self.spine = np.zeros(nodes, dtype=bool)
        self.left = np.flatnonzero(self.owner == 0)
        right, k = [], int(self.last[-1])
        while k >= 0:
            right.append(k)
            k = int(self.up[k])
        self.right = np.array(right[::-1], dtype=np.int64)
        self.spine[self.left] = self.spine[self.right] = True

    def _parents(self) -> np.ndarray:
        """The node above each node, -1 for the root."""
        up, stack = np.full(len(self.depth), -1, dtype=np.int64), []
        for k, d in enumerate(self.depth.tolist()):
            del stack[d:]
            if d:
                up[k] = stack[d - 1]
            stack.append(k)
        return up

    def within(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value over the subtree of every node."""
        total = np.concatenate(([0], np.cumsum(values)))
        return total[self.after] - total[: len(self.after)]

    def rows(self, chain: int) -> Iterator[dict]:
        """Columns of the output: whole nodes, parts of spine nodes, and ids that end at those."""
        whole = ~self.spine
        saved = (self.n_convs - 1) * self.words
        done = self.within(np.where(whole, saved, 0))
        leaves = self.leaves - self.within((self.spine & self.leaf).astype(np.int64))
        below = np.bincount(self.up[whole & (self.up >= 0)], minlength=len(self.up))
        names = {**_names(self.paths[0], self.left), **_names(self.paths[-1], self.right)}

        ids = [str(i) for i in self.ids.tolist()]
        own = dict(zip(self.last.tolist(), range(len(self.paths))))
        ends = [""] * len(self.up)
        for k, u in own.items():
            ends[k] = ",".join(ids[self.first_row[u] : self.first_row[u + 1]])
        k = np.flatnonzero(whole)
        up = self.up[k]
        outer = self.spine[up]
        yield {
            "kind": np.full(len(k), WHOLE), "chain": np.where(self.owner[up] == 0, chain, chain + 1),
            "up": [names[x] if o else None for x, o in zip(up.tolist(), outer.tolist())], "depth": self.depth[k],
            "conv_id": self.lowest[k], "up_conv": pa.array(self.lowest[up], pa.int64(), mask=outer),
            "n_convs": self.n_convs[k], "n_children": below[k], "n_leaves": leaves[k], "saved": done[k],
            "ends": [hashlib.sha256(ends[x].encode()).hexdigest() for x in k.tolist()],
        }
        for side, nodes in ((0, self.left), (1, self.right)):
            if side and len(self.paths) == 1:
                continue
            counted = self.owner[nodes] > 0 if side else np.ones(len(nodes), dtype=bool)
            yield {
                "kind": np.full(len(nodes), PART), "chain": np.full(len(nodes), chain + side),
                "node": [names[x] for x in nodes.tolist()],
                "up": [names[x] if x >= 0 else None for x in self.up[nodes].tolist()], "depth": self.depth[nodes],
                "conv_id": pa.array(self.lowest[nodes], pa.int64(), mask=~counted),
                "n_convs": self.n_convs[nodes] * counted, "n_children": below[nodes] * counted,
                "n_leaves": leaves[nodes] * counted, "saved": done[nodes] * counted, "words": self.words[nodes],
            }
        for k, u in own.items():
            if self.spine[k]:
                first = int(self.first_row[u])
                starts = list(range(first, int(self.first_row[u + 1]), LISTED))
                yield {
                    "kind": np.full(len(starts), ENDS), "node": [names[k]] * len(starts),
                    "ends": [",".join(ids[i : min(i + LISTED, self.first_row[u + 1])]) for i in starts],
                    "first": self.ids[starts],
                }


def _names(path: str, nodes: np.ndarray) -> dict[int, str]:
    """Digests of the beginnings of a path, one for each of its nodes from the root down."""
    state, out = hashlib.sha256(), {}
    for d, k in enumerate(nodes.tolist()):
        if d:
            state.update(path[(d - 1) * NAME : d * NAME].encode())
        out[k] = state.copy().hexdigest()
    return out


def _table(columns: dict) -> pa.RecordBatch:
    size = len(columns["kind"])
    arrays = [
        pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _ARROW
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _shards(most: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("path", "conv_id", "words"))):
                held.append(row)
                size += len(row[2]) + 1
                if size >= most:
                    yield from map(_table, Shard(held).rows(chain))
                    held, size, chain = [], 0, chain + 2
        if held:
            yield from map(_table, Shard(held).rows(chain))

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the ids of each node, from pieces sorted by node and first id."""
    node, state = None, None
    for batch in batches:
        done = []
        for name_, piece in zip(batch["node"].to_pylist(), batch["ends"].to_pylist()):
            if name_ != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = name_, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        yield pa.RecordBatch.from_pydict(
            {"node": pa.array([d[0] for d in done], pa.string()), "ends": pa.array([d[1] for d in done], pa.string())}
        )
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends": [state.hexdigest()]})


def _merged(parts: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spine nodes in full, and each chain's nodes with their smallest member."""
    nodes = parts.groupBy("node").agg(
        F.max("up").alias("up"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"), F.max("words").alias("words"), F.min("chain").alias("home"),
    )
    nodes = materialize(nodes)
    inner = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("more"))
    nodes = nodes.join(inner, "node", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("more", F.lit(0))
    )
    own = nodes.select(
        "node", "home", ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved"),
        (F.col("n_children") == 0).cast("long").alias("own_leaf"),
    )
    upward = Window.partitionBy("chain").orderBy(F.col("depth").desc())
    here = F.col("chain") == F.col("home")
    along = (
        parts.select("chain", "node", "depth").join(own, "node")
        .select(
            "node",
            F.sum(F.when(here, F.col("own_saved")).otherwise(0)).over(upward).alias("s"),
            F.sum(F.when(here, F.col("own_leaf")).otherwise(0)).over(upward).alias("l"),
        )
        .groupBy("node").agg(F.sum("s").alias("more_saved"), F.sum("l").alias("more_leaves"))
    )
    ended = pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(
        _listed, "node string, ends string"
    )
    above = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("up_conv"))
    full = nodes.join(along, "node").join(ended, "node", "left").join(above, "up", "left").select(
        "conv_id", "depth", "up_conv", "n_convs", "n_children",
        (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"),
        (F.col("saved") + F.col("more_saved")).alias("saved"),
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends"),
    )
    chains = parts.select("chain", F.col("node").alias("up")).join(
        nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("spine_conv")), "up"
    )
    return full, chains


def prefix_trie(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    every: int = 20,
    most_heads: int = 3,
    shard_turns: int = 500_000,
) -> DataFrame:
    """One row per node of the trie of all conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. Conversations are rebuilt first: h turns of the
    conversation c - c % `every`, then c's own after its first h, with h from c's
    CRC-32, `most_heads` at most; `most_heads` 0 takes them as they are.

    Turns are in order, null ones first; turns of equal number by the name of
    what was said. Null role or text is empty. Rows without a conversation id
    belong to none and are left out; an empty table has no nodes. Repeated rows
    are turns of their own. A conversation's names and word counts (40 bytes a
    turn) are one row; texts stay where they are. Other columns are not read.
    """
    convs = turns(rows, conv_col, turn_col, role_col, text_col)
    if most_heads:
        convs = with_heads(materialize(convs), every, most_heads)
    paths = materialize(
        convs.select(
            "conv_id",
            F.array_join(F.transform("turns", lambda t: t["name"]), "").alias("path"),
            F.transform("turns", lambda t: t["words"]).alias("words"),
        )
    )
    made = materialize(
        paths.repartitionByRange("path", "conv_id")
        .sortWithinPartitions("path", "conv_id")
        .mapInArrow(_shards(shard_turns), OUT)
    )
    parts = made.where(F.col("kind") == PART)
    full, chains = _merged(parts, made.where(F.col("kind") == ENDS).select("node", "ends", "first"))
    names = ["conv_id", "depth", "up_conv", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    whole = made.where(F.col("kind") == WHOLE)
    inside = whole.where("up IS NULL").select(*names)
    beside = whole.where("up IS NOT NULL").drop("up_conv").join(chains, ["chain", "up"]).withColumnRenamed(
        "spine_conv", "up_conv"
    )
    return full.select(*names).union(inside).union(beside.select(*names)).toDF(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
