"""Best-fit packing with certified bin counts.

Documents become token pieces of at most one sequence each. Pieces are dealt into groups of bounded size by a hash; every
group is packed best-fit decreasing, and a lower bound from dual-feasible functions certifies its number of sequences. A
group that meets its bound is done. In a group with a gap the sequences filled to `SETTLED` stay, and the documents of
the others go into the pool of the next round, where they meet documents of other groups. Rounds end when no gap is left,
when the pool was one group already, after `ROUNDS` rounds, or when a round saves no sequence; one that would add sequences
is dropped.

Only piece lengths move in the rounds, never texts or ids. Groups are of about `GROUP` pieces whatever the table's size.

Defined cases: null text counts as empty (one piece that holds only the end id); only documents longer than a sequence
are cut; repeated rows are packed like any others; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.catalog import documents, query
from sessionlens.llm.memo import LONGEST, Memo
from sessionlens.llm.token_counts import Merger
from sessionlens.llm.vocab import chunks, vocabulary
from sessionlens.session import drop_scratch, scratch_path, spread

CAPACITY = 2048
GROUP = 20_000
ROUNDS = 6
SETTLED = 0.995
END_ID = 0


MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_BYTES = np.arange(256, dtype=np.uint8)
_LETTER = ((_BYTES | 32) >= ord("a")) & ((_BYTES | 32) <= ord("z"))
_MARK = np.isin(_BYTES, np.frombuffer(MARKS.encode(), np.uint8))
_LOWER = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES + 32, _BYTES).astype(np.uint8)


def parted(texts: list[bytes]) -> list[bytes]:
    """Texts in lower-case ASCII letters, with a blank between a letter and the punctuation mark behind it.

    The tokenizer lower-cases, drops blanks and always splits at such places. Texts that may hold special tokens, which
    are told by their capitals, stay as they are.
    """
    plain = [i for i, t in enumerate(texts) if b"<|" not in t]
    if not plain:
        return texts
    ends = np.cumsum([len(texts[i]) + 1 for i in plain])
    raw = _LOWER[np.frombuffer(b"\n".join([*(texts[i] for i in plain), b""]), np.uint8)]
    cut = np.zeros(len(raw), bool)
    cut[1:] = _LETTER[raw[:-1]] & _MARK[raw[1:]]
    shift = np.cumsum(cut)
    out = np.full(len(raw) + int(shift[-1]), 32, np.uint8)
    out[np.arange(len(raw)) + shift] = raw
    data, places = out.tobytes(), [0, *(ends + shift[ends - 1]).tolist()]
    done = list(texts)
    for k, i in enumerate(plain):
        done[i] = data[places[k]: places[k + 1] - 1]
    return done


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and case: every word is encoded once and remembered.

    A word of Latin letters, in any capitals and with or without punctuation marks behind it, is put together from
    its lower-case letters and its marks, between which the tokenizer always splits. Such letters are normalised and one
    pre-token already, so their bytes are merged as arrays; all else goes to the library.
    """

    def __init__(self, path: str):
        self.tokenizer, self.merger = vocabulary(path).tokenizer, Merger(vocabulary(path))
        self.memo = Memo(content=len)

    def letters(self, words: set[bytes]) -> dict[bytes, bytes]:
        if not words:
            return {}
        words = list(words)
        counts, ids = self.merger.merge(words)
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return dict(zip(words, (raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))

    def others(self, words: set[str]) -> dict[bytes, bytes]:
        words = list(words)
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w.encode(): np.array(e.ids, "<u4").tobytes() for w, e in zip(words, encoded, strict=True)}

    def learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words, and of those stems and marks behind them that are short."""
        known = self.memo.store
        latin, others, made = set(), set(), []
        for raw in missing:
            if raw.isalpha() and raw.islower():
                latin.add(raw)
                continue
            word = raw.decode()
            stem = word.rstrip(MARKS)
            if LATIN.fullmatch(stem):
                marks, low = word[len(stem):], stem.lower().encode()
                latin.add(low)
                if marks:
                    others.add(marks)
                made.append((raw, low, marks.encode()))
            else:
                others.add(word)
        new = {w: known[w] for w in [*latin, *(x.encode() for x in others)] if w in known}
        new |= self.letters({w for w in latin if w not in new}) | self.others({w for w in others if w.encode() not in new})
        for raw, stem, marks in made:
            new[raw] = new[stem] + new[marks] if marks else new[stem]
        asked = set(missing)
        return {w: ids for w, ids in new.items() if w in asked or (len(w) <= LONGEST and w not in known)}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [t.split() for t in parted([t.encode() for t in texts])]
        known = self.memo.fetch(chain.from_iterable(cut), self.learn)
        return [b"".join(map(known.__getitem__, words)) for words in cut]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document's ids with the end id: doc_id, piece, start, length, ids_crc32."""
    schema = T.StructType([
        T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part, texts in chunks(batch, text):
                rows, out = [], ([], [], [], [])
                for row, ids in enumerate(encode(texts)):
                    ids = memoryview(ids + end)
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[start: start + 4 * capacity]
                        rows.append(row)
                        for column, v in zip(out, (k, start // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(doc_id).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()),
                     *(pa.array(c, pa.int64()) for c in out[1:])], schema.names)

    return spread(df.select(doc_id, text)).mapInArrow(cut, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The least number of sequences that lengths 1..capacity need, by two families of dual-feasible functions.

    First family, for e up to half the capacity: lengths over capacity - e count as a whole sequence, lengths below e as
    nothing. Second family, for k from 1: a length x counts as x where (k+1)x is a multiple of the capacity, else as
    floor((k+1)x / capacity) * capacity / k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    rows, total = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(0, capacity // 2 + 1)
    large = rows[-1] - rows[capacity - e]
    middle = total[capacity - e] - np.where(e > 0, total[np.maximum(e - 1, 0)], 0)
    best = int(np.max(-(-(large * capacity + middle) // capacity)))
    for k in range(1, 65):
        whole, rest = np.divmod((k + 1) * size, capacity)
        scaled = np.where(rest == 0, size * k, whole * capacity)  # times k
        best = max(best, int(-(-int((scaled * count).sum()) // (capacity * k))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (sequence, offset) of each length. Sequences with equal room are held in one list, and a bit
    mask of the rooms that occur finds the tightest one."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - need
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return bins, offsets


def pack_group(pdf: pd.DataFrame, capacity: int, level: int, last: bool) -> pd.DataFrame:
    """Pack one group; `_open` marks the rows of sequences to dissolve and pack again with those of other groups."""
    lengths = pdf["length"].to_numpy()
    bins, offsets = best_fit(lengths, capacity)
    n = int(bins.max()) + 1
    fill = np.bincount(bins, weights=lengths, minlength=n)
    gap = 0 if last else n - lower_bound(lengths, capacity)
    group = int(pdf["_group"].iloc[0])
    return pdf.assign(sequence_id=(level << 56) + (group << 20) + bins, offset=offsets,
                      _open=(fill[bins] < SETTLED * capacity) & (gap > 0))


def packer(capacity: int, level: int, last: bool, names: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: pack_group(pdf, capacity, level, last)[names]


def pack(spark: SparkSession, items: DataFrame, capacity: int = CAPACITY, group: int = GROUP,
         rounds: int = ROUNDS) -> DataFrame:
    """`items` (with `length`, 1 to capacity) with `sequence_id` and `offset`."""
    first = scratch_path(spark, "pack-items")
    items.write.parquet(first)
    pool = spark.read.schema(items.schema).parquet(first)
    done, kept, before = [], None, 0
    for level in range(rounds):
        groups = max(1, -(-pool.count() // group))
        last = groups == 1 or level == rounds - 1
        dealt = pool.withColumn(
            "_group", F.pmod(F.xxhash64(F.lit(level), F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
        schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()),
                               T.StructField("offset", T.LongType()), T.StructField("_open", T.BooleanType())])
        run = packer(capacity, level, last, schema.names)
        path = scratch_path(spark, "pack-round")
        dealt.groupBy("_group").applyInPandas(run, schema).write.partitionBy("_open").parquet(path)
        table = spark.read.schema(schema).parquet(path)
        starts = table.filter("offset = 0").agg(F.count("*").alias("n"), F.count_if("_open").alias("open")).first()
        if kept is not None and starts["n"] >= before:  # no better than the sequences it took apart
            done.append(kept)
            break
        if not starts["open"]:
            done.append(table)
            break
        done.append(table.filter("NOT _open"))
        kept, before = table.filter("_open"), starts["open"]
        pool = kept.select(*items.columns)
    drop_scratch(spark, first)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("_group", "_open")


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in pieces of at most 2048 tokens, packed into sequences of 2048 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(spark, pieces(documents(spark, sf_dir, "doc_id", "text"), path))
