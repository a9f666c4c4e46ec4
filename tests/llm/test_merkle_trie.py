"""Merkle manifests and conversation tries against plain versions."""

import binascii
import hashlib

import pytest
from pyspark.sql import functions as F

from recurring_metrics.llm import merkle_manifest
from tests.llm.conftest import prose


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """All levels; every level is a list of digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 8 * 8
        run = level[first : first + 8]
        out.append((run[: at - first], run[at - first + 1 :]))
        at //= 8
    return out


def plain_manifest(rows, lower=lambda r: False):
    rows = [r.asDict() for r in rows]
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r)
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        leaves = [(r, plain_leaf([r[f] for f in fields])) for r in by_lang[name]]
        leaves.sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        trees[name] = leaves, plain_tree([d for _, d in leaves])
    top = plain_tree([trees[n][1][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        leaves, levels = trees[name]
        for i, (r, d) in enumerate(leaves):
            way = siblings(levels, i) + siblings(top, k)
            other = dict(r, text=r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])) if lower(r) else r
            node = plain_leaf([other[f] for f in fields])
            for left, right in way:
                node = sha("".join(left) + node + "".join(right))
            proof = sha("".join(x for left, right in way for x in left + right))
            out.append((r["doc_id"], d, levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def ordered(rows):
    return sorted(rows, key=str)


def spark_manifest(docs, **more):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    made = merkle_manifest.manifest_with_check(docs, {"text": F.when(hit, lowered).otherwise(F.col("text"))}, **more)
    return [
        tuple(r)
        for r in made.select(
            "doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest().alias("p"), "folded_root", "verified"
        ).collect()
    ]


def tampered(r):
    return r["doc_id"] is not None and binascii.crc32(str(r["doc_id"]).encode()) % 3 == 0


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(table, levels):
    rows = [(i * 3, f"Text {i} É", "en" if i % 3 else "de", f"s{i % 2}") for i in range(150)]
    rows += [(7000, None, None, None), (7001, "A", "zz"), (7002, "b", "é"), (7003, "", "")]
    docs = table(*rows)
    assert ordered(spark_manifest(docs, levels=levels)) == ordered(plain_manifest(docs.collect(), tampered))


@pytest.mark.parametrize("count", [1, 8, 9, 64, 65])
def test_one_language(table, count):
    docs = table(*[(i, prose(i, 5), "en") for i in range(count)])
    assert ordered(spark_manifest(docs, levels=1)) == ordered(plain_manifest(docs.collect(), tampered))


def test_manifest_of_odd_rows(odd, empty):
    assert ordered(spark_manifest(odd)) == ordered(plain_manifest(odd.collect(), tampered))
    assert spark_manifest(empty) == []


def test_what_arrived(table):
    docs = table(*[(i, prose(i, 5), "en") for i in range(20)])
    changed = docs.where("doc_id <> 3").withColumn("text", F.when(F.col("doc_id") == 5, "x").otherwise(F.col("text")))
    got = {r["doc_id"]: r["verified"] for r in merkle_manifest.manifest(docs, arrived=changed).collect()}
    assert {d for d, ok in got.items() if not ok} == {3, 5} and len(got) == 20


def plain_trie(rows, every=20, most=3):
    import re

    own = {}
    for r in rows:
        if r["conv_id"] is not None:
            own.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    for c, said in own.items():
        named = [(t, sha(f"{len(a.encode())}:{a}{len(b.encode())}:{b}")[:32], a, b) for t, a, b in said]
        own[c] = [x[2:] for x in sorted(named, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]
    nodes = {}
    for c, said in own.items():
        h = binascii.crc32(str(c).encode()) % (most + 1)
        parent = c - (c - every * int(c / every))
        built = own.get(parent, [])[:h] + said[h:]
        for d in range(len(built) + 1):
            nodes.setdefault(tuple(built[:d]), [[], []])
            nodes[tuple(built[:d])][0].append(c)
        nodes[tuple(built)][1].append(c)
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0 for k in nodes}
    children = {k: [x for x in nodes if len(x) == len(k) + 1 and x[:-1] == k] for k in nodes}

    def below(k):
        return [k] + [y for x in children[k] for y in below(x)]

    out = []
    for k, (members, ends) in nodes.items():
        sub = below(k)
        out.append(
            (
                min(members), len(k), min(nodes[k[:-1]][0]) if k else None, len(members), len(children[k]),
                sum(not children[x] for x in sub), sum((len(nodes[x][0]) - 1) * words[x] for x in sub),
                sha(",".join(map(str, sorted(ends)))),
            )
        )
    return out


CONVS = "conv_id long, turn long, role string, text string, node string, kind int"


def conversation_rows(seed, count, hot=False):
    import random

    chooser = random.Random(seed)
    rows = []
    for c in range(count):
        n = chooser.randint(0, 6)
        for t in range(n):
            text = "same start" if hot and (t < 2 or c % 3 == 0) else f"w{chooser.randrange(3)} x y"[: chooser.randint(2, 6)]
            rows.append((c * 7 - 30, t, ["user", "assistant"][t % 2], text, "n", 1))
    chooser.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, hot, shard", [(1, False, 7), (2, True, 5), (3, True, 1), (4, False, 10_000), (5, True, 40)])
def test_trie(spark, seed, hot, shard):
    from recurring_metrics.llm import prefix_trie

    docs = spark.createDataFrame(conversation_rows(seed, 60, hot), CONVS)
    got = [tuple(r) for r in prefix_trie.prefix_trie(docs, shard_turns=shard).collect()]
    assert ordered(got) == ordered(plain_trie(docs.collect()))


def test_trie_of_odd_rows(spark):
    from recurring_metrics.llm import prefix_trie

    rows = [
        (None, 0, "user", "lost", "", 0), (1, None, None, None, "", 0), (1, 0, "user", "", "", 0), (2, 0, "", "", "", 0),
        (3, 0, "user", "x " * 50_000, "", 0), (3, 0, "user", "x " * 50_000, "", 0), (4, 2, "user", "é\x0b中 a", "", 0),
        (4, 2, "assistant", "tie", "", 0), (0, 0, "user", "head", "", 0), (-7, 1, "user", "head", "", 0),
    ]
    docs = spark.createDataFrame(rows, CONVS)
    assert ordered(tuple(r) for r in prefix_trie.prefix_trie(docs).collect()) == ordered(plain_trie(docs.collect()))
    assert prefix_trie.prefix_trie(docs.where("false")).count() == 0


def test_parens():
    import random

    import numpy as np

    from recurring_metrics.llm.prefix_trie import Parens

    chooser = random.Random(5)
    signs, depth = [1], 1
    for _ in range(5000):
        up = depth == 1 or chooser.random() < (0.7 if len(signs) % 900 < 450 else 0.3)
        signs.append(1 if up else 0)
        depth += 1 if up else -1
    signs += [0] * depth
    stack, close = [], {}
    for i, s in enumerate(signs):
        if s:
            stack.append(i)
        else:
            close[stack.pop()] = i
    at = np.array(sorted(close))
    assert Parens(np.array(signs, dtype=bool)).findclose(at).tolist() == [close[i] for i in at.tolist()]
