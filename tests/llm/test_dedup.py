"""Duplicate finders against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from recurring_metrics.llm import embedding_itq, exact_dedup, minhash_dedup
from recurring_metrics.llm.common import components, free_name, without
from tests.llm.conftest import prose


def brute_components(ids, links):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    chooser = random.Random(seed)
    links = [(chooser.randrange(80), chooser.randrange(80)) for _ in range(45)]
    links += [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 220)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == brute_components(ids, [(a, b) for a, b in links if a != b])


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without_keeps_null_ids(spark, odd):
    gone = spark.createDataFrame([(1,), (12,)], "n long")
    assert without(odd, gone).count() == odd.count() - 3
    assert free_name(odd, "KEPT") == "KEPT_"


def brute_exact(rows):
    groups = {}
    for r in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        groups.setdefault(body, []).append(r)
    out = []
    for body, members in groups.items():
        order = sorted(
            members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)
        )
        digest = hashlib.sha256(body.encode()).hexdigest()
        out += [(r["doc_id"], order[0]["doc_id"], len(members), i == 0, digest) for i, r in enumerate(order)]
    return sorted(map(str, out))


@pytest.mark.parametrize("run_rows", [1, 2, 1000])
def test_exact(odd, run_rows):
    got = exact_dedup.label_copies(odd, run_rows=run_rows).select("doc_id", "copies.*").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_exact(odd.collect())


@pytest.mark.parametrize("run_rows", [1, 20, 1000])
def test_exact_hot_text(table, run_rows):
    docs = table(*[(i, "same  text" if i % 3 else f"t {i % 40}") for i in range(600)], *[(1, "same  text")] * 2)
    got = exact_dedup.label_copies(docs, run_rows=run_rows).select("doc_id", "copies.*").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_exact(docs.collect())
    assert exact_dedup.drop_copies(docs).count() == sum(r["kept"] for r in got)


def test_exact_empty(empty):
    assert exact_dedup.label_copies(empty).count() == 0
    assert exact_dedup.drop_copies(empty).columns == empty.columns


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_near(rows):
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    found = brute_components(ids, links)
    return sorted((i, len(sets[i]), found[i], found[i] == i) for i in ids)


def edited(text, n, seed):
    words, chooser = text.split(), random.Random(seed)
    for _ in range(n):
        words[chooser.randrange(len(words))] = f"new{chooser.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_docs(table):
    rows = []
    for base in range(12):
        text = prose(base, 150)
        rows.append((len(rows) * 3, text))
        for k in range(14):
            rows.append((len(rows) * 3, edited(text, k % 6, base * 100 + k)))
    chain = prose(77, 200)
    for k in range(20):
        chain = edited(chain, 2, 900 + k)
        rows.append((len(rows) * 3, chain))
    rows += [(5000 + i, t) for i, t in enumerate([None, "", "  \n", "One two", "one  TWO", "é É", "É É", "a"])]
    return table(*rows)


@pytest.mark.parametrize("block", [1024, 3])
def test_near(near_docs, block):
    got = sorted(tuple(r) for r in minhash_dedup.near_duplicates(near_docs, block=block).collect())
    assert got == brute_near(near_docs.collect())


def test_near_odd(odd, empty):
    known = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = sorted(tuple(r) for r in minhash_dedup.near_duplicates(known).collect())
    assert got == brute_near(known.collect())
    rows = minhash_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and all(r["kept"] for r in rows if r["doc_id"] is None)
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_estimate_is_near_the_similarity():
    chooser = np.random.default_rng(2)
    base = chooser.integers(0, 2**63, 4000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(2000 * share / (1 + share) * 2)
        a, b = base[:2000], base[2000 - n : 4000 - n]
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        packed, _ = minhash_dedup.signature(np.array([minhash_dedup.minima(a), minhash_dedup.minima(b)]))
        unequal = minhash_dedup._lanes_unequal(packed[:1].view(np.uint64), packed[1:].view(np.uint64))[0, 0]
        chance = 2.0**-minhash_dedup.BITS
        assert abs(((1 - unequal / minhash_dedup.HASHES) - chance) / (1 - chance) - real) < minhash_dedup.MARGIN


def brute_vectors(rows, threshold=0.98):
    sound = {}
    for r in rows:
        v = r["embedding"]
        if r["label"] is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        sound[r["vec_id"]] = (r["label"], np.array(v, dtype=float))
    ids, links = sorted(sound), []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (la, x), (lb, y) = sound[a], sound[b]
            if la == lb and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links.append((a, b))
    found = brute_components(ids, links)
    count = {i: 0 for i in ids}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {r["vec_id"]: (count.get(r["vec_id"], 0), found.get(r["vec_id"], r["vec_id"])) for r in rows}


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors(spark, block):
    chooser = np.random.default_rng(5)
    rows = []
    for base in range(30):
        v = chooser.standard_normal(24)
        for k in range(1 + base % 9):
            w = v + chooser.standard_normal(24) * (0.0 if k == 1 else 0.05)
            rows.append((len(rows), [float(x) for x in w.astype(np.float32)], base % 3))
    n = len(rows)
    rows += [
        (n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] * 24, 1), (n + 3, rows[0][1], None),
        (n + 4, [None] + [1.0] * 23, 1), (n + 5, [], 1), (n + 6, [float("inf")] * 24, 1),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding_itq.near_vectors(table, block=block).collect()
    want = brute_vectors(table.collect())
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_itq.near_vectors(table.where("false")).count() == 0


def test_recall_on_sample_data(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_itq.near_vectors(table).collect()}
    want = brute_vectors(table.collect())
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in got)


def test_codes_are_balanced():
    sample = np.random.default_rng(1).standard_normal((500, 16))
    projection, medians = embedding_itq.learn_rotations(sample, 40, 5)
    share = ((sample @ projection) >= medians).mean(axis=0)
    assert projection.shape == (16, 40) and (abs(share - 0.5) < 0.01).all()


def leaning(n, dims, cosine, seed):
    """Unit vectors whose mean pairwise cosine is about `cosine`."""
    noise = np.random.default_rng(seed).standard_normal((n, dims)) / np.sqrt(dims)
    made = np.sqrt(1 - cosine) * noise
    made[:, 0] += np.sqrt(cosine)
    return embedding_itq._unit(made)


@pytest.mark.parametrize("cosine", [0.0, 0.7, 0.85])
def test_recall_of_leaning_vectors(spark, cosine):
    base = leaning(6000, 64, cosine, 2)
    (_, beside), *_ = embedding_itq.planted_pairs(base[:400], 0.9805)
    beside = beside[:400]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(np.concatenate((base, beside)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_itq.near_vectors(table).collect()}
    assert sum(got[6000 + i] >= 1 for i in range(400)) >= 0.99 * 400


def test_tables_for_few_dimensions():
    circle = embedding_itq._unit(np.random.default_rng(4).standard_normal((2000, 2)))
    projection, medians, bits, tables = embedding_itq.learn_tables(circle, 2000, 0.98)
    assert projection.shape == (2, bits * tables) and len(medians) == bits * tables


def test_vectors_of_several_lengths(spark):
    chooser, rows = np.random.default_rng(8), []
    for dims, groups in ((24, 20), (16, 12), (3, 2), (70, 1)):
        for base in range(groups):
            v = chooser.standard_normal(dims)
            for k in range(1 + base % 4 if dims != 70 else 2):
                w = v + chooser.standard_normal(dims) * 0.05
                rows.append((len(rows), [float(x) for x in w], base % 2))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unequal = [r for r in table.collect()]
    want = {}
    for dims in (24, 16, 3, 70):
        want |= brute_vectors([r for r in unequal if len(r["embedding"]) == dims])
    assert sum(want[r["vec_id"]][0] for r in unequal if len(r["embedding"]) == 16) > 0
    for block in (1024, 7):
        got = embedding_itq.near_vectors(table, block=block).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("block", [1, 2, 3])
def test_blocks_with_an_empty_side(spark, block):
    """Seven close vectors in blocks of one: some pairs of blocks have members on one side only."""
    rows = [(i, [1.0, 0.001 * i, 0.002], 5) for i in range(7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_itq.near_vectors(table, block=block).collect()}
    assert got == {i: (6, 0) for i in range(7)}


def test_vectors_of_extreme_size_and_labels_of_text(spark):
    rows = [
        (1, [1e200, 2e200, 0.0], "a"), (2, [1e-200, 2e-200, 1e-210], "a"), (3, [1.0, 2.0, 0.0], "a"),
        (4, [1.0, 2.0, 0.0], "b"), (5, [2.0, 4.0, 0.0], "b"), (6, [1.0, 2.0, 0.0], None), (7, [-1.0, -2.0, 0.0], "a"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_itq.near_vectors(table).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}


def test_exact_dedup_without_python(odd):
    for made in (exact_dedup.label_copies(odd), exact_dedup.drop_copies(odd)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
