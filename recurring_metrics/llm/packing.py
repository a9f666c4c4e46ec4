"""Packing documents into token windows online, with a fixed number of open windows.

Each partition reads its documents once. A document's ids are cut into full windows;
what remains goes to the open window that it fills best. When none has room, the
fullest open window is topped up with the head of the rest and leaves (or leaves as it
is when it lacks fewer than `MIN_CUT` ids). What is still open at the end of the
partitions is written with its ids; the open windows of `MERGE` partitions at a time are
packed again in the same way, and at last filled one after the other.

The pieces of the first step are written to the shared folder and read back, so that
both parts of the result come from the same run of each task.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurring_metrics.llm.common import column, slices, tokenizer_path
from recurring_metrics.llm.pieces import PieceTable, rank_encoder
from recurring_metrics.llm.vocabulary import byte_ranks
from recurring_metrics.sources.io import materialize

LENGTH, END_ID, OPEN, MERGE, MIN_CUT = 2048, 1, 64, 64, 16
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
HELD = PIECE + ", held boolean, ids array<int>"


@functools.cache
def _library(path: str) -> object:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _pieces(path: str) -> tuple[PieceTable, list[str]] | None:
    """A table of pieces and the special strings of a byte-level BPE file; None for other kinds."""
    import public_tokenizers

    found = byte_ranks(path)
    if found is None:
        return None
    return PieceTable(rank_encoder(found[0], public_tokenizers.PATTERN)), found[1]


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids as the tokenizer of `path` gives them, without added special tokens.

    Texts with special strings, and all texts of other kinds of tokenizers, go
    through the library, which is only loaded for them.
    """
    known = _pieces(path)
    plain = [i for i, t in enumerate(texts) if known and not any(s in t for s in known[1])]
    out: list = [None] * len(texts)
    if plain:
        for i, ids in zip(plain, known[0].encode_texts([texts[i] for i in plain])):
            out[i] = ids
    for i, ids in enumerate(out):
        if ids is None:
            out[i] = np.array(_library(path).encode(texts[i], add_special_tokens=False).ids, dtype=np.int32)
    return out


class Windows:
    """Open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int, most: int, min_cut: int):
        self.length, self.most, self.min_cut = length, most, min_cut
        self.room: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.made = 0

    def place(self, doc, start: int, ids: np.ndarray, total: int) -> Iterator[list]:
        """Takes a piece; yields the windows that leave."""
        while len(ids) >= self.length:
            yield [(doc, start, ids[: self.length], total)]
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            at = bisect_left(self.room, (len(ids), -1))
            if at < len(self.room):
                room, key = self.room.pop(at)
            elif len(self.room) < self.most:
                room, key = self.length, self.made
                self.made += 1
                self.held[key] = []
            else:
                room, key = self.room.pop(0)
                if room < self.min_cut:
                    yield self.held.pop(key)
                    continue
            head = ids[:room]
            self.held[key].append((doc, start, head, total))
            start, ids = start + len(head), ids[len(head) :]
            if len(head) == room:
                yield self.held.pop(key)
            else:
                insort(self.room, (room - len(head), key))

    def rest(self) -> list[list]:
        """The windows still open, the fullest first."""
        return [self.held[key] for _, key in self.room]


def _rows(window: list, sequence: int, held: bool) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total in window:
        data = np.ascontiguousarray(ids, dtype="<u4")
        yield (
            doc, start, len(ids), zlib.crc32(data.tobytes()), total, sequence, offset, held,
            data.astype(np.int32) if held else None,
        )
        offset += len(ids)


_ARROW = pa.schema(
    [(c.split()[0], pa.int64()) for c in PIECE.split(", ")]
    + [("held", pa.bool_()), ("ids", pa.list_(pa.int32()))]
)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _fill(path: str, length: int, end_id: int, most: int, min_cut: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        windows, sent = Windows(length, most, min_cut), 0
        for whole in batches:
            for batch in slices(whole, ["text"]):
                rows: list[tuple] = []
                texts = [t or "" for t in batch["text"].to_pylist()]
                for doc, ids in zip(batch["id"].to_pylist(), encode(texts, path)):
                    ids = np.append(ids, np.int32(end_id))
                    for full in windows.place(doc, 0, ids, len(ids)):
                        rows += _rows(full, base + sent, False)
                        sent += 1
                yield _table(rows)
        rows = []
        for part in windows.rest():
            rows += _rows(part, base + sent, True)
            sent += 1
        yield _table(rows)

    return run


def _merge(length: int, most: int, min_cut: int) -> object:
    def run(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        base = (1 << 62) + (int(key[0]) << 32)
        windows, full = Windows(length, most, min_cut), []
        held = held.sort_values(["sequence_id", "offset"])
        ids_of = [None if pd.isna(d) else int(d) for d in held["doc_id"]]
        for doc, start, ids, total in zip(ids_of, held["start"], held["ids"], held["doc_tokens"]):
            full += windows.place(doc, int(start), np.asarray(ids, dtype=np.int32), int(total))
        room, last = length, []
        for doc, start, ids, total in (piece for window in windows.rest() for piece in window):
            while len(ids):
                head = ids[:room]
                last.append((doc, start, head, total))
                start, ids, room = start + len(head), ids[len(head) :], room - len(head)
                if not room:
                    full.append(last)
                    room, last = length, []
        if last:
            full.append(last)
        rows = [r[:7] for i, window in enumerate(full) for r in _rows(window, base + i, False)]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")])
        return out.astype({"doc_id": "Int64"})

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    length: int = LENGTH,
    end_id: int = END_ID,
    open_windows: int = OPEN,
    min_cut: int = MIN_CUT,
) -> DataFrame:
    """One row per piece: where in its document it lies, and in which window.

    Every document gives its ids and `end_id` once (null text: `end_id` alone);
    every id lies in one piece. Pieces of a window are gapless from offset 0.
    Rows that repeat are packed again; null ids stay null. An empty table gives no
    rows. Other columns are not read.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    raw = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    first = materialize(raw.mapInArrow(_fill(path, length, end_id, open_windows, min_cut), HELD))
    names = [c.split()[0] for c in PIECE.split(", ")]
    batch = F.shiftright("sequence_id", 32) / MERGE
    merged = (
        first.where("held")
        .withColumn("batch", F.floor(batch))
        .groupBy("batch")
        .applyInPandas(_merge(length, open_windows, min_cut), PIECE)
    )
    out = first.where("NOT held").select(*names).union(merged)
    return out.withColumnRenamed("doc_id", id_col)
