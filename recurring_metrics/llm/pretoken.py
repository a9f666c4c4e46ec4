"""Where byte-level BPE cuts texts before merging, found for many texts at once in numpy.

The cuts are those of the public pattern (contractions, an optional space with a run of
letters, of numbers or of other signs, and runs of white space of which the last sign
goes to what follows). Texts are held as code points; a sign outside Unicode ends each.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

END, LETTER, NUMBER, OTHER, BLANK, SPACE = range(6)
STOP = 0x110000


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, and END for STOP."""
    kinds = np.full(STOP + 1, OTHER, dtype=np.uint8)
    signs = "".join(chr(c) for c in range(STOP) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, signs):
            first, last = ord(signs[found.start()]), ord(signs[found.end() - 1])
            kinds[first : last + 1] = kind
    kinds[0xD800:0xE000] = OTHER
    kinds[32] = BLANK
    kinds[STOP] = END
    return kinds


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each closed by STOP, and the places after each STOP."""
    parts, stop = [], np.array([STOP], dtype=np.uint32)
    for text in texts:
        parts += (np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), stop)
    ends = np.cumsum([len(p) for p in parts])[1::2] if parts else np.empty(0, np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), ends


def starts(codes: np.ndarray) -> np.ndarray:
    """True where a piece begins; each STOP counts as a piece of its own."""
    n = len(codes)
    if not n:
        return np.empty(0, dtype=bool)
    kind = classes()[codes]
    before = np.concatenate(([END], kind[:-1])).astype(np.uint8)
    after = np.concatenate((kind[1:], [END])).astype(np.uint8)
    blank, blank_before = kind >= BLANK, before >= BLANK
    begins = np.where(
        blank,
        ~blank_before | ((after < BLANK) & (after != END)),
        (before == END) | (before == SPACE) | (~blank_before & (before != kind)),
    )
    begins |= kind == END
    tail = np.full(4, STOP, dtype=np.uint32)
    long = np.concatenate((codes, tail))
    quote = np.flatnonzero((codes == 39) & begins)
    if len(quote):
        one, two = long[quote + 1], long[quote + 2]
        short = np.isin(one, np.array([ord(c) for c in "stmd"], dtype=np.uint32))
        pair = (
            ((one == ord("r")) & (two == ord("e")))
            | ((one == ord("v")) & (two == ord("e")))
            | ((one == ord("l")) & (two == ord("l")))
        )
        begins[quote[short | pair] + 1] = False
        close = np.concatenate((quote[short] + 2, quote[pair] + 3))
        # A space after a contraction begins a piece already, or leads a run of white space.
        close = close[close < n]
        begins[close[kind[close] < BLANK]] = True
    return begins
