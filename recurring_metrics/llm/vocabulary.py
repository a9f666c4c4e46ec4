"""Byte-level BPE vocabularies from the tokenizers' JSON files."""

from __future__ import annotations

import json


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], list[str]] | None:
    """Tokens with their ids, merges in order, special strings; None for another kind of file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not spec.get("normalizer") and not before.get("add_prefix_space") and before.get("use_regex", True)
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or not plain or model.get("ignore_merges"):
        return None
    special = [t["content"] for t in spec.get("added_tokens", [])]
    sign = byte_signs()

    def raw(token: str) -> bytes:
        return bytes(sign[c] for c in token)

    merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    return {raw(t): i for t, i in model["vocab"].items() if t not in special}, merges, special


def byte_ranks(path: str) -> tuple[dict[bytes, int], list[str]] | None:
    """Tokens with ids that also rank their merges, and special strings; None if the ids do not."""
    found = byte_level(path)
    if found is None:
        return None
    vocab, merges, special = found
    ids = [vocab[a + b] for a, b in merges]
    return (vocab, special) if ids == sorted(set(ids)) else None
