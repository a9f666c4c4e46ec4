"""Texts count as equal only when they are: pairs that deceive sums of codes times powers."""

import numpy as np
import pytest

from recurring_metrics.llm import bpe_chunks, minhash_dedup, packing, pieces, token_counts
from recurring_metrics.llm.common import tokenizer_path

PATH = "byte_bpe_50k.json"


def deceiving(n: int) -> tuple[str, str]:
    """Two words of n letters by the Thue-Morse rule: the second exchanges the letters of the first."""
    signs = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)


def library(text: str) -> list[int]:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(PATH)).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_of_equal_sums(spark, size):
    import public_tokenizers
    import tiktoken

    one, two = deceiving(size)
    docs = spark.createDataFrame([(1, one), (2, two), (3, one), (4, two)], "doc_id long, text string").coalesce(1)

    ids = {i: library(t) for i, t in ((1, one), (2, two), (3, one), (4, two))}
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    assert counts == {i: len(x) for i, x in ids.items()}

    for i, got in zip((1, 2, 3, 4), packing.encode([one, two, one, two], tokenizer_path(PATH))):
        assert got.tolist() == ids[i]

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    exact = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_chunks.ranks(path), special_tokens={}
    )
    for text, got in zip((one, two), bpe_chunks.encode_texts([one, two], path)):
        assert got.tolist() == exact.encode_ordinary(text)
        assert bpe_chunks.decode_ids(got, path) == text.encode()

    linked = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert linked == {1: 1, 2: 2, 3: 1, 4: 2}


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(pieces, "piece_hashes", lambda codes, begin, end: np.full(len(begin), 7, dtype=np.uint64))
    text = ["ab", "cd", "ab", "efg", "cd", "ab"]
    codes = np.array([ord(c) for c in "".join(text)], dtype=np.uint32)
    end = np.cumsum([len(t) for t in text])
    begin = end - [len(t) for t in text]
    known = pieces.Known()
    for _ in range(2):
        numbers, new = known.numbers(codes, begin, end)
        met: dict[int, str] = {}
        for number, piece in zip(numbers.tolist(), text):
            assert met.setdefault(number, piece) == piece
        assert len(met) == 3 and len(set(new.tolist())) == len(new)
    assert len(known.hashes) == 1
