"""A Merkle manifest of a dataset, with a proof for every row.

Rows become leaves; the leaves of each part (a language, say) form a tree in the order of
their ids, and the parts' roots form a tree in the order of their names. Every `WIDTH`
consecutive nodes of a level have one parent.

The trees are cut into superblocks of `WIDTH ** LEVELS` consecutive nodes. Going up, each
superblock is reduced to its top node on its own; the tops form the next tier, until one
node is left. Going down, every superblock is cogrouped with the one row that it needs from
outside: for each level above its top, the digests to the left and to the right of the path.
The group then finishes everything at once: it reduces its nodes again, joins the siblings
found inside with those from above, and folds each leaf up to the root. No task ever holds
more than one superblock, and a part with a third of all rows is many superblocks.

Places within a part come from a sort over ranges: rows are numbered within their partition,
and the counts of the (few) pieces of partitions and parts give the offsets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurring_metrics.llm.common import column
from recurring_metrics.sources.io import materialize

WIDTH, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ABOVE = "above array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A value as its byte count, a colon and itself; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def parents(nodes: list[str], width: int) -> list[str]:
    return [digest("".join(nodes[i : i + width])) for i in range(0, len(nodes), width)]


def reduced(nodes: list[str], total: int, width: int, levels: int) -> list[list[str]]:
    """All levels of a superblock from its nodes up to its top.

    `total` is the number of nodes of the whole tier: if they are one superblock,
    the tree ends with the first lone node, else the top lies `levels` above.
    """
    made = [nodes]
    for _ in range(levels):
        if total <= width**levels and len(made[-1]) == 1:
            break
        made.append(parents(made[-1], width))
    return made


def paths(made: list[list[str]], width: int) -> list[list[tuple[str, str]]]:
    """For every node of a superblock: what lies left and right of its path, level by level."""
    out = []
    for at in range(len(made[0])):
        path = []
        for level in made[:-1]:
            first = at // width * width
            path.append(("".join(level[first:at]), "".join(level[at + 1 : first + width])))
            at //= width
        out.append(path)
    return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and its path lead to."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def _numbered(rows: DataFrame, order: Sequence[str], ranges: Sequence[str | Column]) -> DataFrame:
    """Adds `place`, from 0 within each `part` in this order, and `total`, the part's rows.

    Rows are sorted over ranges; a window sees one row per partition and part only.
    `ranges` begin like `order` but may be shorter, as samples of them reach the driver.
    """
    ordered = rows.repartitionByRange("part", *ranges).sortWithinPartitions("part", *order)
    marked = materialize(ordered.withColumn("mark", F.monotonically_increasing_id()))
    marked = marked.withColumn("run", F.shiftright("mark", 33))
    runs = marked.groupBy("part", "run").agg(F.min("mark").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("part").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "part", "run", "first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("part")).alias("total"),
    )
    return marked.join(runs, ["part", "run"]).select(
        *rows.columns, (F.col("mark") - F.col("first") + F.col("before")).alias("place"), "total"
    )


class Tree:
    """Tiers of nodes (part, place, total, node, block) from leaves to one node per part."""

    def __init__(self, nodes: DataFrame, width: int, levels: int):
        self.width, self.levels, self.size = width, levels, width**levels
        self.tiers = [self._blocks(nodes)]
        while (most := self.tiers[-1].agg(F.max("total")).first()[0]) is not None and most > 1:
            tops = self.tiers[-1].groupBy("part", "block").applyInPandas(
                self._top(), "part string, place long, total long, node string"
            )
            self.tiers.append(self._blocks(materialize(tops)))

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.floor(F.col("place") / self.size))

    def _top(self):
        width, levels, size = self.width, self.levels, self.size

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows, total = rows.sort_values("place"), int(rows["total"].iloc[0])
            top = reduced(rows["node"].tolist(), total, width, levels)[-1][0]
            return pd.DataFrame({"part": [key[0]], "place": [key[1]], "total": [-(-total // size)], "node": [top]})

        return run

    def tops(self) -> DataFrame:
        """(part, node): the root of every part."""
        return self.tiers[-1].select("part", "node")

    def down(self, above: DataFrame, finish, schema: str, extra: Sequence[str] = ()) -> DataFrame:
        """Carries what lies above each part's root (part, above) down to the leaves.

        `finish(rows, top, paths)` makes the result of one superblock of leaves from
        its rows by place, the row from above and the whole path of each leaf.
        """
        width, levels = self.width, self.levels

        def meet(last, out: str, nodes: DataFrame, outer: DataFrame) -> DataFrame:
            def run(rows: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
                if not len(rows):
                    return last(rows, None, [])
                rows, top = rows.sort_values("place"), outside.iloc[0]
                made = reduced(rows["node"].tolist(), int(rows["total"].iloc[0]), width, levels)
                rest = [(x["left"], x["right"]) for x in top["above"]]
                return last(rows, top, [path + rest for path in paths(made, width)])

            return nodes.groupBy("part", "block").cogroup(outer.groupBy("part", "block")).applyInPandas(run, out)

        def carry(rows: pd.DataFrame, top, ways: list) -> pd.DataFrame:
            lists = [[{"left": a, "right": b} for a, b in way] for way in ways]
            made = {"part": rows["part"].tolist(), "block": rows["place"].tolist(), "above": lists}
            return pd.DataFrame({**made, **{c: [None if top is None else top[c]] * len(rows) for c in extra}})

        names = "".join(f", {c} string" for c in extra)
        outer = above.withColumn("block", F.lit(0).cast("long"))
        if len(self.tiers) == 1:  # lone leaves: each is its own root
            return meet(finish, schema, self.tiers[0], outer)
        for tier in self.tiers[-2:0:-1]:
            outer = materialize(meet(carry, f"part string, block long, {ABOVE}{names}", tier, outer))
        return meet(finish, schema, self.tiers[0], outer)


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    part_col: str = "lang",
    fields: Sequence[str] = FIELDS,
    arrived: DataFrame | None = None,
    width: int = WIDTH,
    levels: int = LEVELS,
) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root, verified) of every row of `docs`.

    `fields` are hashed into the leaf in this order; `fields` must not be empty.
    `proof` lists what lies left and right of the path at each level, from the leaf
    up. `arrived` is the table as someone received it, with the same columns and
    one row per id: each leaf is made again from it, folded along the proof of
    the manifest, and verified when that gives the root. Without it, `docs`
    itself is folded. An id that did not arrive gives null and false.

    A null part is a part of its own, before all others. Ids ascend, null ones
    first, ties by leaf; repeated rows are leaves of their own. With `arrived`, rows
    with a null id count as not arrived. An empty table has no rows and no root.
    """
    whole = [column(f) for f in fields]
    part = F.coalesce(F.concat(F.lit("="), column(part_col).cast("string")), F.lit(""))
    rows = docs.select(column(id_col).alias("id"), part.alias("part"), leaf(whole).alias("node"))
    if arrived is None:
        rows = rows.withColumn("seen", F.col("node"))
    else:
        again = arrived.select(column(id_col).alias("id"), leaf(whole).alias("seen")).where("id IS NOT NULL")
        rows = rows.join(again, "id", "left")
    return _proved(materialize(rows), id_col, width, levels)


def manifest_with_check(
    docs: DataFrame,
    changed: dict[str, Column],
    id_col: str = "doc_id",
    part_col: str = "lang",
    fields: Sequence[str] = FIELDS,
    width: int = WIDTH,
    levels: int = LEVELS,
) -> DataFrame:
    """As `manifest`, where what arrived is `docs` with some columns replaced by expressions.

    Both leaves come from one pass over the rows, without a join; rows of equal or
    null ids are checked on their own.
    """
    part = F.coalesce(F.concat(F.lit("="), column(part_col).cast("string")), F.lit(""))
    rows = docs.select(
        column(id_col).alias("id"),
        part.alias("part"),
        leaf([column(f) for f in fields]).alias("node"),
        leaf([changed.get(f, column(f)) for f in fields]).alias("seen"),
    )
    return _proved(materialize(rows), id_col, width, levels)


def _proved(rows: DataFrame, id_col: str, width: int, levels: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    trees = Tree(materialize(_numbered(rows, ["id", "node"], ["id", F.substring("node", 1, 6)])), width, levels)
    roots = trees.tops().select(F.lit("").alias("part"), F.col("part").alias("name"), "node")
    over = Tree(materialize(_numbered(roots, ["name"], ["name"])), width, levels)

    def name_paths(nodes: pd.DataFrame, top, ways: list) -> pd.DataFrame:
        lists = [[{"left": a, "right": b} for a, b in way] for way in ways]
        root = [None if top is None else top["root"]] * len(nodes)
        made = {"part": nodes.get("name", pd.Series(dtype=object)).tolist(), "above": lists}
        return pd.DataFrame({**made, "subroot": nodes["node"].tolist(), "root": root})

    start = over.tops().select(
        "part", F.array().cast("array<struct<left:string,right:string>>").alias("above"), F.col("node").alias("root")
    )
    above = materialize(over.down(start, name_paths, f"part string, {ABOVE}, subroot string, root string", ["root"]))

    def prove(nodes: pd.DataFrame, top, ways: list) -> pd.DataFrame:
        n = len(nodes)
        root = None if top is None else top["root"]
        seen = [None if pd.isna(x) else x for x in nodes["seen"]]
        ends = [None if x is None else folded(x, way) for x, way in zip(seen, ways)]
        return pd.DataFrame(
            {
                "id": nodes["id"], "leaf": nodes["node"], "subroot": [None if top is None else top["subroot"]] * n,
                "root": [root] * n, "proof": [[{"left": a, "right": b} for a, b in way] for way in ways],
                "folded_root": ends, "verified": [x is not None and x == root for x in ends],
            }
        )

    out = (
        f"id {kind}, leaf string, subroot string, root string, proof array<struct<left:string,right:string>>, "
        "folded_root string, verified boolean"
    )
    return trees.down(above, prove, out, ["subroot", "root"]).withColumnRenamed("id", id_col)


def proof_digest(proof: str = "proof") -> Column:
    """The digest of all siblings of a proof, level by level from left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda x: F.concat(x["left"], x["right"]))), 256)
