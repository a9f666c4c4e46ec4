"""Token ids of many texts at once: cut into pieces, encode each distinct piece once.

Pieces count as equal when their code points are; hashes only find them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from recurring_metrics.llm.pretoken import BLANK, STOP, classes, code_points, starts
from recurring_metrics.llm.shingles import MOVE, SIGN, mix

# (code points, begins, ends) -> (ids, first, size)
Encoder = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
MOST, MOST_CODES = 400_000, 8_000_000


def piece_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every piece codes[begin:end]; the pieces cover the array in order.

    Every code point is mixed with its place before the sum is taken.
    """
    length = end - begin
    place = (np.arange(len(codes)) - np.repeat(begin, length)).astype(np.uint64)
    sums = np.add.reduceat(mix((codes.astype(np.uint64) + np.uint64(1)) * SIGN + place * MOVE), begin)
    return mix(sums ^ (length.astype(np.uint64) << np.uint64(40)))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, where each is seen first, and the place of every value among them."""
    inverse, values = pd.factorize(hashes)
    where = np.empty(len(values), dtype=np.int64)
    where[inverse[::-1]] = np.arange(len(hashes) - 1, -1, -1)
    return values, where, inverse


def gathered(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i] .. first[i] + size[i] - 1 of every i, one after the other."""
    out = np.cumsum(size) - size
    return np.repeat(first - out, size) + np.arange(int(size.sum()))


def same_codes(
    a: np.ndarray, a_first: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_first: np.ndarray, b_size: np.ndarray
) -> np.ndarray:
    """Whether piece i of a and piece i of b have the same code points; pieces are not empty."""
    same = a_size == b_size
    at = np.flatnonzero(same)
    if len(at):
        size = a_size[at]
        unlike = a[gathered(a_first[at], size)] != b[gathered(b_first[at], size)]
        same[at] = ~np.logical_or.reduceat(unlike, np.cumsum(size) - size)
    return same


class Known:
    """Numbers for the distinct pieces met so far, from 0 on.

    Pieces are looked up by hash and compared by code points. A piece whose hash
    belongs to another one gets a number each time it is met.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.hashes, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.codes = np.empty(0, np.uint32)

    def full(self) -> bool:
        return len(self.size) > MOST or len(self.codes) > MOST_CODES

    def numbers(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of every piece codes[begin:end], and the places of the pieces that got a new one, in order."""
        hashes, where, inverse = distinct(piece_hashes(codes, begin, end))
        length = end - begin
        head = where[inverse]
        odd = np.flatnonzero(~same_codes(codes, begin, length, codes, begin[head], length[head]))
        if len(odd):
            # Unequal pieces of one hash: classes of their own.
            own: dict[bytes, int] = {}
            for i in odd.tolist():
                inverse[i] = own.setdefault(codes[begin[i] : end[i]].tobytes(), len(where) + len(own))
            extra, place = np.unique(inverse[odd], return_index=True)
            where, hashes = np.append(where, odd[place]), np.append(hashes, hashes[inverse[head[odd[place]]]])
        at = np.searchsorted(self.hashes, hashes)
        there = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.hashes)
        there[inside] = self.hashes[at[inside]] == hashes[inside]
        numbers = np.full(len(hashes), -1, dtype=np.int64)
        hit = np.flatnonzero(there)
        if len(hit):
            old, piece = self.number[at[hit]], where[hit]
            same = same_codes(codes, begin[piece], length[piece], self.codes, self.first[old], self.size[old])
            numbers[hit[same]] = old[same]
        new = np.flatnonzero(numbers < 0)
        if len(new):
            new = new[np.argsort(hashes[new], kind="stable")]
            numbers[new] = len(self.size) + np.arange(len(new))
            size = length[where[new]]
            self.first = np.append(self.first, len(self.codes) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.codes = np.append(self.codes, codes[gathered(begin[where[new]], size)].astype(np.uint32))
            # A hash finds one piece only.
            fresh = new[~there[new] & np.append(True, hashes[new][1:] != hashes[new][:-1])]
            self.number = np.insert(self.number, at[fresh], numbers[fresh])
            self.hashes = np.insert(self.hashes, at[fresh], hashes[fresh])
        return numbers[inverse], where[new]


class PieceTable:
    """Ids of the pieces met so far; it starts anew when the pieces are too many.

    `encode` takes code points and the bounds of distinct pieces in them; it
    returns ids, and where each piece's ids begin and how many they are.
    """

    def __init__(self, encode: Encoder):
        self.encode, self.known = encode, Known()
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def encode_codes(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each piece has."""
        if self.known.full():
            self.clear()
        row, new = self.known.numbers(codes, begin, end)
        if len(new):
            ids, first, size = self.encode(codes, begin[new], end[new])
            self.first = np.concatenate((self.first, len(self.ids) + first))
            self.size = np.concatenate((self.size, size))
            self.ids = np.concatenate((self.ids, ids))
        count = self.size[row]
        return self.ids[gathered(self.first[row], count)], count

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        if not texts:
            return []
        codes, ends = code_points(texts)
        begin = np.flatnonzero(starts(codes))
        end = np.append(begin[1:], len(codes))
        real = codes[begin] != STOP
        # Leaving out the closing signs keeps the rest in order.
        kept = codes[codes != STOP]
        length = (end - begin)[real]
        first = np.cumsum(length) - length
        if not len(first):
            return [np.empty(0, np.int32) for _ in texts]
        ids, count = self.encode_codes(kept, first, first + length)
        owner = np.searchsorted(ends, begin[real], side="right")
        per_text = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(per_text)[:-1])


def rank_encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """Encodes pieces by byte-level ranks.

    Pieces that are not white space go in one call, each after a line feed: a
    line feed before a piece is a piece of its own, and no other has its id.
    """
    import tiktoken

    core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    feed = ranks[b"\n"]

    def encode(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        white = classes()[codes[end - 1]] >= BLANK
        plain = np.flatnonzero(~white)
        length = end[plain] - begin[plain]
        joined = np.full(int(length.sum()) + len(plain), 10, dtype="<u4")
        joined[gathered(np.cumsum(length + 1) - length, length)] = codes[gathered(begin[plain], length)]
        ids = np.asarray(core.encode_to_numpy(joined.tobytes().decode("utf-32-le"))).astype(np.int32)
        feeds = np.flatnonzero(ids == feed)
        first, size = np.zeros(len(begin), dtype=np.int64), np.zeros(len(begin), dtype=np.int64)
        first[plain] = feeds + 1
        size[plain] = np.diff(np.append(feeds, len(ids))) - 1
        more, total = [ids], len(ids)
        for i in np.flatnonzero(white).tolist():
            own = core.encode_ordinary(codes[begin[i] : end[i]].astype("<u4").tobytes().decode("utf-32-le"))
            more.append(np.array(own, dtype=np.int32))
            first[i], size[i] = total, len(own)
            total += len(own)
        return np.concatenate(more), first, size

    return encode
