"""Byte-level BPE encoding in overlapping chunks, and decoding.

Texts are cut into chunks that overlap. All chunks of a batch are pre-tokenised at once,
each as if its text began there. Where a chunk and the next both begin a piece at the same
place of their overlap, their readings agree from there on: the next chunk takes over.
Chunks without such a place (one piece longer than the overlap) are read again as one. The
pieces are then encoded by rank, each distinct piece once per worker. Decoding joins the
tokens' bytes.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recurring_metrics.llm.common import column, slices, tokenizer_path
from recurring_metrics.llm.pieces import PieceTable, rank_encoder
from recurring_metrics.llm.pretoken import STOP, code_points, starts

CHUNK, OVERLAP = 8192, 256
# A piece's first character is certain once this many characters after it are known.
AHEAD = 4


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@functools.cache
def _table(path: str) -> PieceTable:
    import public_tokenizers

    return PieceTable(rank_encoder(ranks(path), public_tokenizers.PATTERN))


def _chunk_starts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Piece starts of every chunk, read on its own."""
    stop = np.array([STOP], dtype=np.uint32)
    joined = np.concatenate([x for t in texts for x in (t, stop)])
    begin, at, out = starts(joined), 0, []
    for t in texts:
        out.append(np.flatnonzero(begin[at : at + len(t)]))
        at += len(t) + 1
    return out


def stitched_starts(codes: list[np.ndarray], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[np.ndarray]:
    """Piece starts of every text, from overlapping chunks."""
    spans = [
        [(at, min(at + chunk + overlap, len(text))) for at in range(0, max(len(text), 1), chunk)]
        for text in codes
    ]
    read = iter(_chunk_starts([text[a:b] for text, own in zip(codes, spans) for a, b in own]))
    out = []
    for text, own in zip(codes, spans):
        (first, end), found = own[0], next(read)
        done: list[np.ndarray] = []
        here = found + first
        for a, b in own[1:]:
            there = next(read) + a
            # Starts that both chunks see in the overlap, where the first can look ahead.
            both = np.intersect1d(
                here[(here > a) & (here < end - AHEAD)], there[there > a], assume_unique=True
            )
            if len(both):
                done.append(here[here < both[0]])
                first, here = int(both[0]), there[there >= both[0]]
            else:
                here = np.flatnonzero(starts(np.append(text[first:b], np.uint32(STOP)))[:-1]) + first
            end = b
        done.append(here)
        out.append(np.concatenate(done))
    return out


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of every text."""
    codes, ends = code_points(texts)
    own = [codes[a : b - 1] for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist())]
    begins = stitched_starts(own)
    counts = np.array([len(b) for b in begins])
    if not counts.sum():
        return [np.empty(0, np.int32) for _ in texts]
    offsets = np.concatenate(([0], np.cumsum([len(o) for o in own])[:-1]))
    begin = np.concatenate([b + o for b, o in zip(begins, offsets)])
    flat = codes[codes != STOP]
    ids, sizes = _table(path).encode_codes(flat, begin, np.append(begin[1:], len(flat)))
    per_text = np.bincount(np.repeat(np.arange(len(texts)), counts), weights=sizes, minlength=len(texts))
    return np.split(ids, np.cumsum(per_text.astype(np.int64))[:-1])


def _encode(path: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ["text"]):
                made = encode_texts([t or "" for t in batch["text"].to_pylist()], path)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"],
                        pa.array([len(m) for m in made], pa.int64()),
                        pa.array([m.astype("<u4").tobytes() for m in made], pa.binary()),
                    ],
                    ["id", "n_tokens", "ids"],
                )

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The id, n_tokens and ids (binary: little-endian unsigned 32-bit) of every row.

    Null text is empty and has no ids. No string is special. Null ids and
    repeated rows are encoded as they are; other columns are not read.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.tiktoken")
    raw = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    kind = raw.schema["id"].dataType.simpleString()
    return raw.mapInArrow(_encode(path), f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


@functools.cache
def _bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, with the first byte and the length of each."""
    by_id = {i: t for t, i in ranks(path).items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    size = np.array([len(t) for t in tokens], dtype=np.int64)
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(size) - size, size


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    data, first, size = _bytes(path)
    count = size[ids]
    out = np.cumsum(count) - count
    return data[np.repeat(first[ids] - out, count) + np.arange(int(count.sum()))].tobytes()


def _decode(path: str, column_name: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                None if not v.is_valid else decode_ids(np.frombuffer(v.as_buffer(), dtype="<u4"), path)
                for v in batch[column_name]
            ]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [batch[n] for n in names] + [pa.array(made, pa.binary())], [*names, "decoded"]
            )

    return run


def decode(encoded: DataFrame, ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """The table with the column `decoded`: the bytes of the ids; null ids give null."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.tiktoken")
    if "decoded" in encoded.columns:
        raise ValueError("the table already has a column decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(_decode(path, ids_col), schema)
