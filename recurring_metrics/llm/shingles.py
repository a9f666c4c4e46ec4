"""Sets of hashed word shingles of many texts at once, in numpy.

Words are the runs between white space, with A-Z lower-cased. A shingle is `width`
words in a row; a text with fewer words is one shingle of all of them. Shingles are
64-bit hashes of the words' bytes: each byte is mixed with its place before a word's sum is
taken, and each word is mixed into the shingle in turn.
"""

from __future__ import annotations

import numpy as np

WINDOW = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Odd factors of a sign and of its place in a word.
SIGN, MOVE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a byte array, window by window."""
    hashes, firsts, at = [], [], 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        if end < len(data):
            gap = np.flatnonzero(_SPACE[data[at:end]])
            while not len(gap) and end < len(data):  # one word longer than the window
                end = min(end + WINDOW, len(data))
                gap = np.flatnonzero(_SPACE[data[at:end]])
            if end < len(data) or len(gap):
                end = at + int(gap[-1]) + 1
        h, f = _window_hashes(data[at:end])
        hashes.append(h)
        firsts.append(f + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts)


def _window_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    length = last - first
    letters = (_LOWER[data[~space]].astype(np.uint64) + np.uint64(1)) * SIGN
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(len(letters)) - np.repeat(begin, length)
    sums = np.add.reduceat(mix(letters + place.astype(np.uint64) * MOVE), begin)
    return mix(sums ^ length.astype(np.uint64)), first


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For every text its sorted distinct shingle hashes; none for a text without words."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    words, first = word_hashes(data)
    bound = np.concatenate(([0], np.searchsorted(first, ends)))
    sums = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        sums = mix(sums * SIGN + words[k : k + len(sums)])
    out = []
    for lo, hi in zip(bound[:-1], bound[1:]):
        n = hi - lo
        if n >= width:
            out.append(np.unique(sums[lo : hi - width + 1]))
        elif n:
            short = np.array([n], dtype=np.uint64)
            for k in range(lo, hi):
                short = mix(short * SIGN + words[k])
            out.append(short)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
