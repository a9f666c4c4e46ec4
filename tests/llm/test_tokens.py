"""Tokenizing operators against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recurring_metrics.llm import bpe_chunks, packing, pretoken, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
SIGNS = [
    "'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "\xa0", "é", "1", "²", "x", "!", "...",
    "’", " ", "中文", "😀", "\x1c", "\x85", "R", "'S", "<|endoftext|>", "́", "٣", "ª", "the", " of",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranked():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, seed=3):
    chooser = random.Random(seed)
    return ["".join(chooser.choice(SIGNS) for _ in range(chooser.randint(0, 50))) for _ in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("".join(SIGNS)), max_size=40), min_size=1, max_size=5))
def test_any_text(texts):
    whole = Tokenizer.from_file(JSON) if not hasattr(test_any_text, "lib") else test_any_text.lib
    test_any_text.lib = whole
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [list(i) for i in packing.encode(texts, JSON)] == want
    assert token_counts._counts(JSON).of(texts) == [len(w) for w in want]


def test_odd_texts(library, ranked):
    texts = odd_texts(1500)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(i) for i in packing.encode(texts, JSON)] == want
    assert token_counts._counts(JSON).of(texts) == [len(w) for w in want]
    plain = [ranked.encode_ordinary(t) for t in texts]
    got = bpe_chunks.encode_texts(texts, RANKS)
    assert [list(i) for i in got] == plain
    assert [bpe_chunks.decode_ids(i, RANKS) for i in got] == [t.encode() for t in texts]


def test_transducer_agrees_with_pieces():
    codes, _ = pretoken.code_points(odd_texts(800, 5))
    for chunk in (1, 7, 128):
        assert (token_counts.piece_starts(codes, chunk) == pretoken.starts(codes)).all()


def test_maps_compose():
    chooser = np.random.default_rng(1)
    maps = chooser.integers(0, 13, (37, 13)).astype(np.uint8)
    scanned, state = token_counts.composed(maps), np.arange(13)
    for one, all_before in zip(maps, scanned):
        state = one[state]
        assert (state == all_before).all()


@pytest.mark.parametrize("chunk,overlap", [(16, 8), (5, 5), (64, 6)])
def test_chunks_are_stitched(chunk, overlap):
    for text in odd_texts(200, 8):
        codes, _ = pretoken.code_points([text])
        want = np.flatnonzero(pretoken.starts(codes)[:-1])
        assert bpe_chunks.stitched_starts([codes[:-1]], chunk, overlap)[0].tolist() == want.tolist()


def test_piece_longer_than_any_chunk(ranked):
    text = "a" * 20_000 + " " * 20_000 + "b 'll"
    assert bpe_chunks.encode_texts([text], RANKS)[0].tolist() == ranked.encode_ordinary(text)


def test_count_table(spark, odd, empty, library):
    got = {tuple(r) for r in token_counts.count_tokens(odd).collect()}
    want = set()
    for row in odd.collect():
        text = row["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.add((row["doc_id"], len(text.encode()), n, n > 512))
    assert got == want
    assert token_counts.count_tokens(empty).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.load(P.path("word_bpe_49k.json"))


def test_encode_and_decode(spark, odd, empty, ranked):
    encoded = bpe_chunks.encode(odd)
    rows = bpe_chunks.decode(encoded).collect()
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in odd.collect())
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in rows) == texts
    want = {hashlib.sha256(np.array(ranked.encode_ordinary(t), "<u4").tobytes()).hexdigest() for _, t in texts}
    assert {hashlib.sha256(bytes(r["ids"])).hexdigest() for r in rows} == want
    assert bpe_chunks.decode(bpe_chunks.encode(empty)).count() == 0


def check_packing(docs, rows, library, length=2048):
    want = {}
    for row in docs:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids + [1]
        want.setdefault(row["doc_id"], []).append(ids)
    by_window, seen = {}, {}
    for r in rows:
        ids = want[r["doc_id"]][0]
        assert r["doc_tokens"] == len(ids) and r["length"] > 0
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for pieces in by_window.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length
    for doc, copies in want.items():
        total = sum(size for _, size in seen[doc])
        assert total == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for start, size in sorted(seen[doc]):
                assert start == at
                at += size
    return by_window


def test_packing(spark, odd, empty, library):
    known = odd.where("doc_id IS NOT NULL")
    windows = check_packing(known.collect(), packing.pack(known).collect(), library)
    fill = sorted(sum(s for _, s in w) for w in windows.values())
    assert all(f > 2048 - packing.MIN_CUT for f in fill[1:])
    assert packing.pack(odd).where("doc_id IS NULL").count() >= 2
    assert packing.pack(empty).count() == 0


def test_packing_many_partitions(spark, table, library):
    from tests.llm.conftest import prose

    docs = table(*[(i, prose(i, 5 + i * 7 % 400)) for i in range(300)]).repartition(9)
    windows = check_packing(docs.collect(), packing.pack(docs, open_windows=4).collect(), library)
    fill = sorted(sum(s for _, s in w) for w in windows.values())
    assert sum(fill) / (2048 * len(fill)) > 0.98


def test_window_keeps_bounds():
    windows = packing.Windows(100, 3, 5)
    out = []
    chooser = random.Random(4)
    for i in range(200):
        out += windows.place(i, 0, np.arange(chooser.randint(1, 250)), 0)
        assert len(windows.room) <= 3 and windows.room == sorted(windows.room)
    assert all(95 < sum(len(p[2]) for p in w) <= 100 for w in out)
