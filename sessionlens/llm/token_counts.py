"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch of texts lie in one ragged numpy array of symbols, one symbol per byte at first. In every round
each pre-token applies its own lowest-ranked adjacent pair, at all places at once; pre-tokens without a ranked pair leave
the array, and the symbols they have left are counted. Equal pre-tokens are merged once per worker and remembered in a
memo of bounded bytes; long pieces pass through.

Texts are cut before white space that follows other characters: a pre-token never spans such a place, and no rule of the
pre-tokenizer looks across it. Pieces of plain Latin letters are pre-tokens as they are; others are split by the
tokenizer file's own pre-tokenizer.

Defined cases: null counts as empty (0 bytes, 0 tokens); strings of special tokens inside a text count as one token each,
as the library does by default; an empty table gives an empty result;
input columns with the names of new ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.catalog import documents, query
from sessionlens.llm.memo import Memo
from sessionlens.llm.vocab import Vocabulary, byte_symbols, chunks, vocabulary
from sessionlens.session import spread

LIMIT = 512
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
LATIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ſ]+")
NONE = np.iinfo(np.int64).max


class Merger:
    """Merges ragged arrays of symbols by the ranks of a vocabulary."""

    def __init__(self, vocab: Vocabulary):
        left, right, new = vocab.merges.T
        keys = left * vocab.size + right
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.rank, self.new = vocab.size, keys[order], order, new.astype(np.int32)
        self.base, self.last = vocab.id_of_byte, vocab.id_of_last_byte

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols left of each word (none of them empty)."""
        return self.merge(words, False)[0]

    def merge(self, words: list[bytes], keep: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The number of symbols left of each word, and with `keep` the symbols of all words in a row."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        result = sizes.copy()
        raw = np.frombuffer(b"".join(words), np.uint8)
        which = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        last = np.zeros(len(raw), bool)
        last[np.cumsum(sizes) - 1] = True
        symbols = np.where(last, self.last[raw], self.base[raw])
        ranks = np.full(len(raw), NONE)
        at = np.flatnonzero(~last)
        ranks[at] = self.look_up(symbols[at].astype(np.int64) * self.size + symbols[at + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
            lowest = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            result[which[starts]] = lengths
            alive = np.repeat(lowest != NONE, lengths)
            if not alive.all():
                if keep:
                    done.append((which[~alive], symbols[~alive]))
                symbols, which, last, ranks = symbols[alive], which[alive], last[alive], ranks[alive]
                lowest, lengths = lowest[lowest != NONE], lengths[lowest != NONE]
            if not len(symbols):
                break
            hit = ranks == np.repeat(lowest, lengths)
            run = hit & np.concatenate(([False], hit[:-1]))
            if run.any():  # overlapping places, as in "aaa": every second one of a run, from its start
                at = np.arange(len(hit))
                begun = np.maximum.accumulate(np.where(hit & ~run, at, 0))
                hit &= (at - begun) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.new[ranks[at]]
            last[at] = last[at + 1]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            symbols, which, last, ranks, changed = symbols[stay], which[stay], last[stay], ranks[stay], changed[stay]
            at = np.flatnonzero(changed)
            ranks[at] = NONE
            at = at[~last[at]]
            ranks[at] = self.look_up(symbols[at].astype(np.int64) * self.size + symbols[at + 1])
        if not done:
            return result, symbols
        which, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        return result, symbols[np.argsort(which, kind="stable")]


class Counter:
    """Counts tokens of texts; remembers the counts of pieces."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.merger = Merger(self.vocab)
        self.symbol = byte_symbols()
        self.special = re.compile("|".join(map(re.escape, self.vocab.special))) if self.vocab.special else None
        self.memo = Memo(content=lambda n: 0)

    def pre_tokens(self, piece: str) -> list[bytes]:
        if LATIN.fullmatch(piece):
            return [piece.encode()]
        parts = self.vocab.tokenizer.pre_tokenizer.pre_tokenize_str(piece)
        return [bytes(map(self.symbol.__getitem__, p)) for p, _ in parts]

    def learn(self, pieces: list[str]) -> dict[str, int]:
        split = [self.pre_tokens(p) for p in pieces]
        flat = [w for words in split for w in words]
        counts = iter(self.merger.counts(flat).tolist() if flat else [])
        return {piece: sum(next(counts) for _ in words) for piece, words in zip(pieces, split, strict=True)}

    def __call__(self, texts: list[str]) -> list[int]:
        cut, extra = [], []
        for text in texts:
            n = 0
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                n = len(parts) - 1
                cut.append([x for part in parts for x in PIECES.findall(part)])
            else:
                cut.append(PIECES.findall(text))
            extra.append(n)
        value = self.memo.fetch(chain.from_iterable(cut), self.learn).__getitem__
        return [sum(map(value, pieces)) + n for pieces, n in zip(cut, extra, strict=True)]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(df: DataFrame, path: str, text: str = "text", column: str = "n_tokens") -> DataFrame:
    """`df` without its text, with the number of its tokens and UTF-8 bytes (`n_bytes`)."""
    kept = [c for c in df.columns if c not in (text, "n_bytes", column)]
    schema = T.StructType([df.schema[c] for c in kept]).add("n_bytes", "long").add(column, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            for part, texts in chunks(batch, text):
                n = pa.array(tokens(texts), pa.int64())
                size = pa.array([len(x.encode()) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), size, n], schema.names)

    return spread(df).mapInArrow(count, schema)


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and whether they exceed 512 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_counts(documents(spark, sf_dir, "doc_id", "text"), path)
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
