"""Byte-level vocabularies of public tokenizer files, and per-batch access to texts in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

CHUNK_BYTES = 1 << 20
"""Texts are worked on in chunks of about this size, so memory does not grow with an Arrow batch."""


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable Latin-1,
    else the next character from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merges as id pairs, and the library's tokenizer, of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table, model = byte_symbols(), spec["model"]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {token: i for token, i in model["vocab"].items() if token not in self.special}
        self.bytes_of = {i: bytes(table[c] for c in token) for token, i in ids.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.size = max(self.bytes_of) + 1
        end = model.get("end_of_word_suffix") or ""
        in_order = [c for c, _ in sorted(table.items(), key=lambda x: x[1])]
        self.id_of_byte = np.array([ids[c] for c in in_order], dtype=np.int32)
        self.id_of_last_byte = np.array([ids[c + end] for c in in_order], dtype=np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in merges], dtype=np.int64)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One instance per worker and file."""
    return Vocabulary(path)


def chunks(batch: pa.RecordBatch, text: str, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive row ranges of a batch with their texts (null: empty), of about `size` bytes each or one text."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    start = 0
    while start < batch.num_rows:
        ends = np.cumsum(sizes[start:], dtype=np.int64)
        stop = start + max(1, int(np.searchsorted(ends, size, side="right")))
        yield batch.slice(start, stop - start), [x or "" for x in column.slice(start, stop - start).to_pylist()]
        start = stop
