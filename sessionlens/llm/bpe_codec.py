"""Byte-pair encoding and decoding by forced-boundary splitting.

Two bytes that are neighbours in no token of the vocabulary can never lie in one token, so a text may be cut between them,
each fragment encoded on its own, and the ids concatenated. The pre-tokenizer must not see the cut either: of these
pairs, those are used at which it always ends a pre-token whatever stands around, namely white space after any other
character, and changes between ASCII letters, digits and punctuation. The fragments repeat, so a worker encodes
each once (with the library) and remembers its ids and decoded bytes in a memo of bounded bytes; long fragments pass through.

Defined cases: null counts as empty (no ids); strings of special tokens inside a text become their ids, as the library
does by default; an empty table gives an empty result; input
columns with the names of new ones are replaced; very long texts are cut like others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sessionlens.llm.catalog import documents, query
from sessionlens.llm.memo import Memo
from sessionlens.llm.vocab import chunks, vocabulary
from sessionlens.session import spread

#: Last two bytes of the white space characters beyond ASCII.
WIDE_BLANKS = [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), *((0x80, b) for b in range(0x80, 0x8B)),
               (0x80, 0xA8), (0x80, 0xA9), (0x80, 0xAF), (0x81, 0x9F), (0x80, 0x80)]


def inner_pairs(tokens: list[bytes]) -> np.ndarray:
    """[a, b]: bytes a and b are neighbours inside some token."""
    inside = np.zeros((256, 256), bool)
    for token in tokens:
        if len(token) > 1:
            raw = np.frombuffer(token, np.uint8)
            inside[raw[:-1], raw[1:]] = True
    return inside


def forced_pairs(tokens: list[bytes]) -> np.ndarray:
    """[a, b]: a cut between bytes a and b is certain: no token holds them together, and a pre-token ends there."""
    byte = np.arange(256)
    blank = np.isin(byte, [*range(9, 14), 32])
    digit, letter = (byte >= 48) & (byte < 58), ((byte | 32) >= 97) & ((byte | 32) < 123)
    ascii_ = byte < 128
    mark = ascii_ & ~blank & ~digit & ~letter & (byte > 32) & (byte < 127)
    ends = ~blank[:, None] & blank[None, :]
    changes = sum((a[:, None] & b[None, :]) for a in (digit, letter, mark) for b in (digit, letter, mark) if a is not b) > 0
    return (ends | changes) & ~inner_pairs(tokens)


class Codec:
    """Encodes texts by their fragments, and decodes the ids of the fragments."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.forced = forced_pairs(list(self.vocab.bytes_of.values())).ravel()
        self.wide = np.zeros((256, 256), bool)
        self.wide[tuple(zip(*WIDE_BLANKS, strict=True))] = True
        self.wide = self.wide.ravel()
        self.special = re.compile(b"(" + b"|".join(re.escape(s.encode()) for s in self.vocab.special) + b")")
        self.memo = Memo()

    def fragments(self, texts: list[bytes]) -> list[list[bytes]]:
        """The fragments of each text between its forced cuts."""
        whole = b"".join(texts)
        raw = np.frombuffer(whole, np.uint8).astype(np.int32)
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw) > 1:
            pair = raw[:-1] * 256 + raw[1:]
            cut[1:-1] = self.forced[pair]
            cut[2:-1] &= ~self.wide[pair[:-1]]
        ends = np.cumsum([len(t) for t in texts])
        cut[ends] = True
        cut[0] = True
        places = np.flatnonzero(cut)
        index = np.searchsorted(places, ends)
        places, out, first = places.tolist(), [], 0
        for stop in index.tolist():
            out.append([whole[a:b] for a, b in zip(places[first:stop], places[first + 1: stop + 1], strict=True)])
            first = stop
        return out

    def learn(self, pieces: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Ids and decoded bytes of pieces."""
        encoded = self.vocab.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        token, out = self.vocab.bytes_of, {}
        for piece, e in zip(pieces, encoded, strict=True):
            ids = e.ids
            out[piece] = (np.array(ids, "<u4").tobytes(), b"".join(map(token.__getitem__, ids)))
        return out

    def __call__(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        cut = []
        raw = [t.encode() for t in texts]
        plain = [i for i, t in enumerate(raw) if not self.special.search(t)]
        simple = dict(zip(plain, self.fragments([raw[i] for i in plain]), strict=True)) if plain else {}
        for i, t in enumerate(raw):
            if i in simple:
                cut.append(simple[i])
            else:  # special strings are fragments of their own
                parts = self.special.split(t)
                cut.append([f for k, p in enumerate(parts) for f in ([p] if k % 2 else self.fragments([p])[0])])
        known = self.memo.fetch(chain.from_iterable(cut), self.learn)
        out = []
        for pieces in cut:
            both = [known[f] for f in pieces]
            out.append((b"".join([x[0] for x in both]), b"".join([x[1] for x in both]).decode("utf-8", "replace")))
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(df: DataFrame, path: str, text: str = "text", digests: bool = False) -> DataFrame:
    """`df` without its text, with `ids` and `decoded`; or with their digests (`n_tokens`, `ids_sha256`, `decoded_sha256`)."""
    added = T.StructType()
    if digests:
        added = added.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    else:
        added = added.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    kept = [c for c in df.columns if c not in (text, *added.names)]
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(path)
        for batch in batches:
            for part, texts in chunks(batch, text):
                done = both(texts)
                if digests:
                    new = [
                        pa.array([len(i) // 4 for i, _ in done], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i, _ in done], pa.string()),
                        pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in done], pa.string()),
                    ]
                else:
                    new = [pa.array([np.frombuffer(i, "<i4") for i, _ in done], pa.list_(pa.int32())),
                           pa.array([d for _, d in done], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new], names)

    return spread(df).mapInArrow(run, schema)


@query("op8_bpe_round_trip")
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return encode_decode(documents(spark, sf_dir, "doc_id", "text"), path, digests=True)
