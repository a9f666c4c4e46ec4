"""Token counts by finite-state transducers compiled from a tokenizer file.

Two deterministic transducers work in cascade.

The first reads characters by class and marks where pieces (pre-tokens) begin. A batch of
texts is cut into equal chunks that ignore text borders; each chunk is read from all states
at once, which gives a map from entry state to exit state. The maps compose, so a parallel
prefix scan over the chunks gives every chunk's true entry state; a second pass marks the
pieces.

The second reads the bytes of a piece. Its states are what byte-pair merging can still
change: the longest suffix that begins some vocabulary token, with the last token and the
relative count at each of its positions. Every transition carries the change in the number
of tokens, so the sum along a path is the piece's token count. States and transitions are
compiled when first met; a piece is read once per worker.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurring_metrics.llm.common import column, slices, tokenizer_path
from recurring_metrics.llm.pieces import Known
from recurring_metrics.llm.pretoken import BLANK, LETTER, NUMBER, SPACE, STOP, classes, code_points
from recurring_metrics.llm.vocabulary import byte_level

CHUNK, LIMIT, MOST, NEVER = 128, 512, 800_000, 1 << 60

# ---- the piece transducer: states and input classes ----
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, BLANK_1, SPACE_1, BLANK_2, SPACE_2, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CLOSED = range(13)
STATES = 13
C_END, C_LETTER, C_NUMBER, C_OTHER, C_BLANK, C_SPACE, C_QUOTE, C_STMD, C_R, C_V, C_L, C_E = range(12)
INPUTS = 16
HERE, BEFORE = 1, 2  # a piece begins at this character; at the one before


def _move(state: int, sign: int) -> tuple[int, int]:
    """Next state and output of the piece transducer."""
    letter = sign in (C_LETTER, C_STMD, C_R, C_V, C_L, C_E)
    if sign == C_END:
        return START, HERE | (BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0)
    if state == QUOTE:
        pending = {C_STMD: CLOSED, C_R: QUOTE_R, C_V: QUOTE_V, C_L: QUOTE_L}
        if sign in pending:
            return pending[sign], 0
        if sign in (C_OTHER, C_QUOTE):
            return IN_OTHERS, 0
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if sign == {QUOTE_R: C_E, QUOTE_V: C_E, QUOTE_L: C_L}[state]:
            return CLOSED, 0
        after, out = _move(IN_LETTERS, sign)
        return after, out | BEFORE
    white = state in (BLANK_1, SPACE_1, BLANK_2, SPACE_2)
    if sign in (C_BLANK, C_SPACE):
        if white:
            return (BLANK_2 if sign == C_BLANK else SPACE_2), 0
        return (BLANK_1 if sign == C_BLANK else SPACE_1), HERE
    out = BEFORE if state in (BLANK_2, SPACE_2) else 0
    attached = state in (BLANK_1, BLANK_2)
    if letter:
        return IN_LETTERS, out | (0 if attached or state == IN_LETTERS else HERE)
    if sign == C_NUMBER:
        return IN_NUMBERS, out | (0 if attached or state == IN_NUMBERS else HERE)
    if attached or state == IN_OTHERS:
        return IN_OTHERS, out
    return (QUOTE if sign == C_QUOTE else IN_OTHERS), out | HERE


_MOVES = [_move(s, min(c, C_E)) for s in range(STATES) for c in range(INPUTS)]
NEXT = np.array([m[0] for m in _MOVES], dtype=np.uint8)
OUT = np.array([m[1] for m in _MOVES], dtype=np.uint8)


@functools.cache
def _inputs() -> np.ndarray:
    kinds = classes()
    signs = np.full(STOP + 1, C_OTHER, dtype=np.uint8)
    for kind, sign in ((LETTER, C_LETTER), (NUMBER, C_NUMBER), (BLANK, C_BLANK), (SPACE, C_SPACE)):
        signs[kinds == kind] = sign
    for letters, sign in (("'", C_QUOTE), ("stmd", C_STMD), ("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E)):
        signs[[ord(c) for c in letters]] = sign
    signs[STOP] = C_END
    return signs


def composed(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (rows) under composition, in log2(rows) steps."""
    out, step = maps, 1
    while step < len(out):
        later = np.take_along_axis(out[step:], out[:-step], axis=1)
        out = np.concatenate((out[:step], later))
        step *= 2
    return out


def piece_starts(codes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """True where a piece begins; each STOP counts as a piece of its own."""
    n = len(codes)
    if not n:
        return np.empty(0, dtype=bool)
    lanes = -(-n // chunk)
    signs = np.zeros(lanes * chunk, dtype=np.uint8)
    signs[:n] = _inputs()[codes]
    steps = np.ascontiguousarray(signs.reshape(lanes, chunk).T)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (lanes, 1))
    for row in steps:
        maps = NEXT[maps * np.uint8(INPUTS) + row[:, None]]
    entry = np.concatenate(([START], composed(maps)[:-1, START])).astype(np.uint8)
    out = np.empty((chunk, lanes), dtype=np.uint8)
    for i, row in enumerate(steps):
        at = entry * np.uint8(INPUTS) + row
        out[i], entry = OUT[at], NEXT[at]
    flags = out.T.reshape(-1)
    begins = (flags & HERE) > 0
    begins[:-1] |= (flags[1:] & BEFORE) > 0
    return begins[:n]


# ---- the count transducer ----
class CountTransducer:
    """Compiled lazily from a byte-level vocabulary and its merges by rank."""

    def __init__(self, tokens: set[bytes], merges: dict[tuple[bytes, bytes], int]):
        self.tokens, self.merges = tokens, merges
        self.parts = {a + b: (a, b, rank) for (a, b), rank in merges.items()}
        self.begins = {t[:k] for t in tokens for k in range(1, len(t))}
        self.edges: tuple[dict, dict] = {}, {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        start = (b"", ((None, 0),))
        self.states, self.number = [start], {start: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.pairs.clear()

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at the left (0) or right (1) end of a token while it is built, up to which rank."""
        known = self.edges[side].get(token)
        if known is None:
            known, at, until = [], token, NEVER
            while True:
                known.append((at, until))
                if at not in self.parts:
                    break
                until = self.parts[at][2]
                at = self.parts[at][side]
            self.edges[side][token] = known = known[::-1]
        return known

    def _stays(self, left: bytes, right: bytes) -> bool:
        """Whether merging the joined bytes ends with just these two tokens.

        Follows both sides of the border through time: it falls when the parts
        that meet there merge before either is merged into its own token. Of
        equal ranks the leftmost merge comes first.
        """
        known = self.pairs.get((left, right))
        if known is None:
            a, b = self._edge(left, 1), self._edge(right, 0)
            i = j = 0
            known = True
            while True:
                (x, x_until), (y, y_until) = a[i], b[j]
                rank = self.merges.get((x, y), NEVER)
                if rank < x_until and rank <= y_until and rank < NEVER:
                    known = False
                    break
                if x_until == y_until == NEVER:
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            self.pairs[left, right] = known
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, marks = self.states[state]
        longer = suffix + bytes([byte])
        for size in range(len(longer), 0, -1):
            token = longer[-size:]
            last, count = marks[size - 1]
            if token in self.tokens and (last is None or self._stays(last, token)):
                break
        else:
            raise ValueError("a byte is not in the vocabulary")
        change = count + 1
        keep = len(longer)
        while keep and longer[-keep:] not in self.begins:
            keep -= 1
        held = [(token, 0)] + [(t, c - change) for t, c in marks[:keep]]
        after = (longer[len(longer) - keep :], tuple(held))
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
        move = self.moves[state << 8 | byte] = (self.number[after], change)
        return move

    def count(self, piece: bytes) -> int:
        """Tokens of a piece: the sum of the outputs along its path."""
        if len(self.moves) > MOST:
            self.clear()
        state = total = 0
        moves = self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte) or self._compile(state, byte)
            state = move[0]
            total += move[1]
        return total


@functools.cache
def load(path: str) -> tuple[CountTransducer, list[str]]:
    """The count transducer and the special strings of a byte-level BPE file."""
    found = byte_level(path)
    if found is None:
        raise ValueError("only byte-level BPE without prefix space or normaliser can be compiled")
    vocab, merges, special = found
    return CountTransducer(set(vocab), {m: rank for rank, m in enumerate(merges)}), special


class _Counts:
    """Counts of the pieces met so far."""

    def __init__(self, path: str):
        self.machine, self.special = load(path)
        self.known, self.value = Known(), np.empty(0, np.int32)

    def of_texts(self, texts: list[str]) -> np.ndarray:
        codes, ends = code_points(texts)
        if not len(codes):
            return np.zeros(len(texts), np.int64)
        begin = np.flatnonzero(piece_starts(codes))
        end = np.append(begin[1:], len(codes))
        if self.known.full():
            self.known.clear()
            self.value = np.empty(0, np.int32)
        number, new = self.known.numbers(codes, begin, end)
        flat, count = codes.astype("<u4"), self.machine.count
        made = [
            0 if codes[begin[k]] == STOP else count(flat[begin[k] : end[k]].tobytes().decode("utf-32-le").encode())
            for k in new.tolist()
        ]
        self.value = np.append(self.value, np.array(made, dtype=np.int32))
        owner = np.searchsorted(ends, begin, side="right")
        return np.bincount(owner, weights=self.value[number], minlength=len(texts)).astype(np.int64)[: len(texts)]

    def of(self, texts: list[str]) -> list[int]:
        """Counts of whole texts; a special string is one token and divides its text."""
        parts, owner, extra = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            pieces = [text]
            for s in self.special:
                split = [p.split(s) for p in pieces]
                extra[i] += sum(len(p) - 1 for p in split)
                pieces = [x for p in split for x in p]
            parts += pieces
            owner += [i] * len(pieces)
        sums = np.bincount(owner, weights=self.of_texts(parts), minlength=len(texts)).astype(np.int64)
        return (sums + np.array(extra, dtype=np.int64)).tolist() if texts else []


@functools.cache
def _counts(path: str) -> _Counts:
    return _Counts(path)


def _run(path: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(path)
        for whole in batches:
            for batch in slices(whole, ["text"]):
                made = counts.of([t or "" for t in batch["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["n_bytes"], pa.array(made, pa.int64())], ["id", "n_bytes", "n_tokens"]
                )

    return run


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """The id, n_bytes, n_tokens and over_limit of every row.

    Null text counts as empty: no bytes, no tokens. Special strings of the
    tokenizer inside a text are one token each. Null ids and repeated rows give
    rows as they are; other columns are not read.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    text = F.coalesce(column(text_col), F.lit(""))
    raw = docs.select(
        column(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    kind = raw.schema["id"].dataType.simpleString()
    counted = raw.mapInArrow(_run(path), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
