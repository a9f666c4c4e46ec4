"""Toxicity on texts with planted insults, listed and learned ones."""

import random

import pytest
from pyspark.sql import functions as F

from recurring_metrics.llm import toxicity
from tests.llm.conftest import WORDS


def writing(seed, toxic, n=80):
    chooser = random.Random(seed)
    words = [chooser.choice(WORDS) + str(chooser.randrange(20)) for _ in range(chooser.randint(20, n))]
    if toxic:
        for _ in range(chooser.randint(3, 6)):
            at = chooser.randrange(len(words))
            bad = ["moron", "you idiot", "zorgul" + chooser.choice(["a", "en", "ist", "ung"])][toxic % 3]
            words.insert(at, bad)
    return " ".join(words)


@pytest.fixture(scope="module")
def learned(spark, table):
    rows = [(i, writing(i, 1 + i % 3 if i % 4 == 0 else 0)) for i in range(1600)]
    docs = table(*rows)
    labels = spark.createDataFrame(
        [(i, 1 if i % 4 == 0 else 0, 5) for i in range(1600)] + [(1, None, 1), (None, 1, 1), (9999, 1, 0)],
        "doc_id long, toxic int, kept int",
    )
    return docs, labels, toxicity.fit(docs, labels.where(~toxicity.held_out()))


def test_toxic_texts(learned):
    docs, _, model = learned
    got = {r["doc_id"]: r for r in toxicity.score(docs.where(toxicity.held_out()), model).collect()}
    assert len(got) > 400 and all(0 <= r["score"] <= 1 for r in got.values())
    caught = sum(r["predicted"] for d, r in got.items() if d % 4 == 0)
    wrong = sum(r["predicted"] for d, r in got.items() if d % 4)
    assert caught >= 0.9 * sum(d % 4 == 0 for d in got)
    assert wrong <= 0.01 * len(got)
    assert all((r["score"] >= 0.7) == bool(r["predicted"]) for r in got.values())


def test_lexicon_holds_words_that_no_list_has(learned):
    assert learned[2].lexicon.get("zorgul", 0) > 2 and "alpha$" not in learned[2].lexicon


def test_scores_read_the_text_only(learned, table):
    docs, _, model = learned
    text = docs.where("doc_id = 3").first()["text"]
    rows = table((3, text), (4, text, "en", "toxic"), (None, text, None, "x"))
    assert len({r["score"] for r in toxicity.score(rows, model).collect()}) == 1


def test_odd_texts(learned, odd, empty):
    _, labels, model = learned
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r["doc_id"], set()).add(r["score"])
    assert by_text[2] == by_text[1]
    assert toxicity.score(empty, model).count() == 0
    alone = toxicity.fit(empty, labels)
    assert {round(r["score"], 9) for r in toxicity.score(odd, alone).collect()} == {round(401 / 1601, 9)}
    assert {r["score"] for r in toxicity.score(odd, toxicity.fit(odd, labels.where("false"))).collect()} == {0.0}


def test_sample_is_bounded(learned, monkeypatch):
    docs, labels, _ = learned
    sizes = []
    real = toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df: (lambda out: (sizes.append(out.count()), out)[1])(real(df)))
    toxicity.fit(docs.union(docs.where("doc_id < 100")), labels, per_label=50)
    assert sizes[0] == 100


def test_windows_hold_all_tokens(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)) + " " + "x" * 500
    whole = toxicity.Tokens({}).features(text)
    monkeypatch.setattr(toxicity, "WINDOW", 100)
    assert [t for part in toxicity.windows(text) for t in part.split()] == text.split()
    assert toxicity.Tokens({}).features(text) == pytest.approx(whole)


def test_disguised_words(spark):
    tokens = toxicity.Tokens({})
    at = toxicity.FEATURES.index
    for text in ("you 1d10t x", "such an i.d.i.o.t today", "stuuupid x y"):
        assert tokens.features(text)[at("undone")] > 0, text
    plain = tokens.features("état-major it's 12-34 A4 x2")
    assert plain[at("undone")] == plain[at("insults")] == 0
