"""Alignment of two tokenizers by galloping intersection of their token ends.

Both tokenizers cut the bytes of one string, a space and the text. Each document has two increasing lists of token ends; the
shorter one drives: every end of it looks for its place in the longer one by steps of 1, 2, 4, ... from where it should be,
and by halving the bracket found. Ends that both lists have cut the document into groups. The difference of two neighbouring
ranks is the range of tokens that a token of the shorter list overlaps, so links are counted without comparing tokens.

A byte-level BPE file (A) and a sentencepiece model (B) never put a blank behind another character into one token, so both
encode the pieces between such places alone; pieces come back often, and a worker's memo, bounded in bytes, keeps their ids.

Counts of id pairs are sums over the whole corpus, combined before the shuffle. A pair's row exists once per id pair that
ever overlaps, so the table is bounded by the vocabularies and not by the corpus; documents look their pairs up in slices of
at most `slice_rows` of them, each broadcast once, and add up what the slices give.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte by byte (such as those with
U+2581), have no tokens: zeros and an empty digest; strings of special tokens inside texts are plain text; ties for the
highest count of a B id all count as best; repeated rows are documents of their own; an empty table gives an empty result;
input columns with the names of new ones are replaced. A text is worked on in sections of some megabytes between pieces, so
memory follows the longest run without a blank.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sessionlens.llm.catalog import documents, query
from sessionlens.llm.memo import Memo
from sessionlens.llm.rows import ROW, quoted, unpacked
from sessionlens.llm.token_counts import WHITE
from sessionlens.llm.vocab import byte_symbols, chunks
from sessionlens.session import scratch_path, spread

SECTION_BYTES = 1 << 22
SLICE_ROWS = 1_000_000
PIECES = re.compile(f" (?:[^ ]+|(?<=[{WHITE}]) +)*")
"""A space and what follows, up to the next space behind a character that is not white."""

JOINED = 1 << 15
"""Characters of pieces that are encoded as one text."""

BLANKS = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))
LINK = T.StructType().add("pair", "long").add("n", "long")
OUT = (
    T.StructType().add("n_a", "long").add("n_b", "long").add("n_groups", "long").add("n_links", "long")
    .add("groups_sha256", "string").add("_links", T.ArrayType(LINK))
)


def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many entries of the increasing list `long` are below each value of `short`, looked for from `start` on."""
    n = len(long)
    at = np.clip(start, 0, n - 1)
    right = long[at] < short
    low, high = np.where(right, at, -1), np.where(right, n, at)
    for side, sign in ((np.flatnonzero(right), 1), (np.flatnonzero(~right), -1)):
        step = 1
        while len(side):
            probe = at[side] + sign * step
            inside = (probe < n) & (probe >= 0)
            below = long[np.clip(probe, 0, n - 1)] < short[side]
            on = inside & (below if sign > 0 else ~below)
            near, far = (low, high) if sign > 0 else (high, low)
            stop = inside & ~on
            far[side[stop]] = probe[stop]
            side, probe = side[on], probe[on]
            near[side] = probe
            step *= 2
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        below = long[mid] < short[open_]
        low[open_[below]] = mid[below]
        high[open_[~below]] = mid[~below]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


def ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] of them), then those of the next place."""
    stops = np.cumsum(counts)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(first - (stops - counts), counts)


def intersect(short: np.ndarray, long: np.ndarray, short_sizes: np.ndarray, long_sizes: np.ndarray):
    """Ranks of the short lists' ends in the long ones, the ends both have, and the links, for sections laid end to end.

    Returns (common ends of `short`, common ends of `long`, short side of links, long side of links)."""
    base_s, base_l = np.cumsum(short_sizes) - short_sizes, np.cumsum(long_sizes) - long_sizes
    which = np.repeat(np.arange(len(short_sizes)), short_sizes)
    inside = np.arange(len(short)) - base_s[which]
    rank = gallop(short, long, base_l[which] + inside * long_sizes[which] // short_sizes[which])
    common = long[rank] == short
    first = np.concatenate(([0], (rank + common)[:-1]))
    counts = rank - first + 1
    met = np.zeros(len(long), bool)
    met[rank[common]] = True
    return common, met, np.repeat(np.arange(len(short)), counts), ragged(first, counts)


def digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 .. size - 1 with room for a sign behind, and their numbers."""
    width = len(str(size))
    table = np.array([str(i).encode() for i in range(size)], f"S{width + 1}")
    return table.view(np.uint8).reshape(size, width + 1), np.char.str_len(table).astype(np.int64)


def spelled(a: np.ndarray, b: np.ndarray, met_a: np.ndarray, met_b: np.ndarray, tables, last: np.ndarray):
    """Groups as bytes `a1,a2|b1;a3|b2,b3`, of sections laid end to end; `last` marks the B tokens with nothing behind.

    Returns the bytes and, for each B token, where they are complete up to it."""
    group_a, group_b = np.cumsum(met_a) - met_a, np.cumsum(met_b) - met_b
    n = int(met_a.sum())
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    at_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
    at_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
    (cells_a, len_a), (cells_b, len_b) = tables
    width = max(cells_a.shape[1], cells_b.shape[1])
    out = np.zeros((len(a) + len(b), width), np.uint8)
    out[at_a, : cells_a.shape[1]] = cells_a[a]
    out[at_b, : cells_b.shape[1]] = cells_b[b]
    out[at_a, len_a[a]] = np.where(met_a, ord("|"), ord(","))
    out[at_b, len_b[b]] = np.where(last, 0, np.where(met_b, ord(";"), ord(",")))
    flat = out.ravel()
    used = np.zeros(len(out), np.int64)
    used[at_a], used[at_b] = len_a[a] + 1, len_b[b] + ~last
    return flat[flat != 0], np.cumsum(used)[at_b]


class Aligner:
    """Encodes with both tokenizers and aligns their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = byte_symbols()
        vocab = self.a.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = token.encode() if token in special else bytes(byte[c] for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode()
                        for x in names]
        self.long_a, self.long_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.tables = digits(len(self.bytes_a)), digits(len(self.bytes_b))
        self.blank = [self.b.piece_to_id("▁")]
        self.memo = Memo()

    def learn(self, pieces: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids of A and of B of pieces, as bytes; both empty where either does not give the piece back.

        Pieces that end in a character that is not white are encoded as one text, as they would stand in a document."""
        out, alone, block, size = {}, [], [], 0
        for piece in pieces:
            if piece[-1] in BLANKS:
                alone.append(piece)
                continue
            block.append(piece)
            size += len(piece)
            if size >= JOINED:
                alone += self.learn_joined(block, out)
                block, size = [], 0
        for piece in alone + self.learn_joined(block, out):
            a, b = self.encoded(piece)
            raw = piece.encode()
            same = b"".join([self.bytes_a[i] for i in a.tolist()]) == raw == b"".join([self.bytes_b[i] for i in b.tolist()])
            out[piece] = (a.tobytes(), b.tobytes()) if same else (b"", b"")
        return out

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B of a text that begins with a blank."""
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:], num_threads=1)
        return np.array(a, np.int32), np.array(b or self.blank, np.int32)

    def learn_joined(self, pieces: list[str], out: dict) -> list[str]:
        """Pieces as one text; returns them where that text is not given back byte by byte."""
        if not pieces:
            return []
        text = "".join(pieces)
        raw = text.encode()
        stops, sides = np.cumsum([len(p.encode()) for p in pieces]), []
        for ids, table, long in zip(self.encoded(text), (self.bytes_a, self.bytes_b), (self.long_a, self.long_b), strict=True):
            ends = np.cumsum(long[ids])
            place = np.searchsorted(ends, stops)
            if b"".join([table[i] for i in ids.tolist()]) != raw or (ends[place] != stops).any():
                return pieces
            data, cuts = ids.tobytes(), [0, *(4 * (place + 1)).tolist()]
            sides.append([data[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
        out.update(zip(pieces, zip(*sides, strict=True), strict=True))
        return []

    def sections(self, texts: list[str]) -> Iterator[list[tuple[int, list[str], bool]]]:
        """Lists of (document, pieces, whether they close it) of about SECTION_BYTES; a long document comes in several."""
        batch, size = [], 0
        for i, text in enumerate(texts):
            pieces, begin = PIECES.findall(" " + text) if text else [], 0
            if size + len(text) >= SECTION_BYTES:
                for k, piece in enumerate(pieces, 1):
                    size += len(piece)
                    if size >= SECTION_BYTES:
                        yield [*batch, (i, pieces[begin:k], k == len(pieces))]
                        batch, size, begin = [], 0, k
            else:
                size += len(text)
            if begin < len(pieces):
                batch.append((i, pieces[begin:] if begin else pieces, True))
        if batch:
            yield batch

    def __call__(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, id pairs, their numbers) of each text."""
        hashes = [hashlib.sha256() for _ in texts]
        numbers = np.zeros((len(texts), 4), np.int64)
        pairs: list[list] = [[] for _ in texts]
        bad = {i for i, text in enumerate(texts) if not text}
        for part in self.sections(texts):
            found = self.memo.fetch(chain.from_iterable([pieces for _, pieces, _ in part]), self.learn)
            ids = [(i, *zip(*map(found.__getitem__, pieces), strict=True), closes) for i, pieces, closes in part]
            bad.update(i for i, a, _, _ in ids if b"" in a)
            ids = [x for x in ids if x[0] not in bad]
            if ids:
                self.align(ids, hashes, numbers, pairs)
        out = []
        for i in range(len(texts)):
            if i in bad:
                out.append((0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            keys, counts = (np.concatenate(x) for x in zip(*pairs[i], strict=True))
            if len(pairs[i]) > 1:
                keys, place = np.unique(keys, return_inverse=True)
                counts = np.bincount(place, counts).astype(np.int64)
            out.append((*numbers[i].tolist(), hashes[i].hexdigest(), keys, counts))
        return out

    def align(self, part, hashes, numbers, pairs) -> None:
        """One batch of sections (document, ids of A and of B by pieces, whether they close it): adds to the digests, numbers
        and pairs of their documents."""
        raw_a, raw_b = [b"".join(x) for _, x, _, _ in part], [b"".join(x) for _, _, x, _ in part]
        size_a, size_b = (np.array([len(x) // 4 for x in raw]) for raw in (raw_a, raw_b))
        a, b = (np.frombuffer(b"".join(raw), np.int32) for raw in (raw_a, raw_b))
        end_a, end_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        met_a, met_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        link_a, link_b = [], []
        a_drives = size_a <= size_b
        for drives in (True, False):  # the shorter list drives
            chosen = a_drives == drives
            if not chosen.any():
                continue
            at_a, at_b = (np.flatnonzero(np.repeat(chosen, size)) for size in (size_a, size_b))
            if drives:
                one, two, left, right = intersect(end_a[at_a], end_b[at_b], size_a[chosen], size_b[chosen])
            else:
                two, one, right, left = intersect(end_b[at_b], end_a[at_a], size_b[chosen], size_a[chosen])
            met_a[at_a], met_b[at_b] = one, two
            link_a.append(at_a[left])
            link_b.append(at_b[right])
        link_a, link_b = np.concatenate(link_a), np.concatenate(link_b)
        section_of_a = np.repeat(np.arange(len(part)), size_a)
        last = np.zeros(len(b), bool)
        stop_b = np.cumsum(size_b) - 1
        last[stop_b] = [x[-1] for x in part]
        spelt, upto = spelled(a, b, met_a, met_b, self.tables, last)
        spelt, cuts = spelt.tobytes(), [0, *upto[stop_b].tolist()]
        groups = np.bincount(section_of_a[met_a], minlength=len(part))
        links = np.bincount(section_of_a[link_a], minlength=len(part))
        room = len(self.bytes_a) * len(self.bytes_b)
        pair = a[link_a].astype(np.int64) * len(self.bytes_b) + b[link_b]
        keys, counts = np.unique(section_of_a[link_a] * room + pair, return_counts=True)
        bounds = np.searchsorted(keys, np.arange(len(part) + 1) * room)
        for k, (i, *_) in enumerate(part):
            hashes[i].update(spelt[cuts[k]: cuts[k + 1]])
            numbers[i] += (size_a[k], size_b[k], groups[k], links[k])
            own = slice(bounds[k], bounds[k + 1])
            pairs[i].append((keys[own] - k * room, counts[own]))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker and pair of files."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def aligned(df: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """Per row the numbers of tokens, groups and links, the digest of the groups, and `_links`: id pairs (id of A times the
    size of B, plus id of B) with the number of their links. The other columns lie in one struct."""
    rest = [F.col(quoted(c)) for c in df.columns if c != text]
    row = F.struct(*rest) if rest else F.struct(F.lit(None).cast("long").alias("_none"))
    packed = spread(df.select(row.alias(ROW), F.monotonically_increasing_id().alias("_id"), F.col(quoted(text)).alias("_text")))
    schema = T.StructType([packed.schema[ROW], packed.schema["_id"], *OUT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            for part, texts in chunks(batch, "_text"):
                *columns, digest, keys, counts = zip(*both(texts), strict=True)
                offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                links = pa.StructArray.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))], ["pair", "n"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in columns), pa.array(digest, pa.string()),
                     pa.ListArray.from_arrays(pa.array(offsets), links)], schema.names)

    return packed.mapInArrow(run, schema)


def link_counts(links: DataFrame, size_b: int) -> DataFrame:
    """Links of each id pair over the corpus (`count`), and whether no other pair of its B id has more (`best`)."""
    counts = links.groupBy("pair").agg(F.sum("n").alias("count"))
    of_b = Window.partitionBy("_b")  # at most as many rows as A has ids
    return (
        counts.withColumn("_b", F.col("pair") % size_b)
        .select("pair", "count", (F.col("count") == F.max("count").over(of_b)).alias("best"))
    )


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """`df` without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    spark = df.sparkSession
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    first, counted = scratch_path(spark, "aligned"), scratch_path(spark, "link-counts")
    made = aligned(df, path_a, path_b, text)
    made.write.parquet(first)
    rows = spark.read.schema(made.schema).parquet(first)
    links = rows.select("_id", F.inline("_links"))
    link_counts(links, size_b).write.parquet(counted)
    counts = spark.read.parquet(counted).withColumnRenamed("pair", "_pair")
    slices = -(-max(counts.count(), 1) // slice_rows)
    sums = None
    for k in range(slices):
        in_slice = F.pmod(F.hash("_pair"), F.lit(slices)) == k
        found = links.join(F.broadcast(counts.filter(in_slice)), F.col("pair") == F.col("_pair")).groupBy("_id").agg(
            F.sum(F.when(F.col("best"), F.col("n"))).alias("_best"), F.sum(F.col("n") * F.col("count")).alias("_sum"))
        sums = found if sums is None else sums.unionByName(found)
    sums = sums.groupBy(F.col("_id").alias("_i")).agg(F.sum("_best").alias("_best"), F.sum("_sum").alias("_sum"))
    done = rows.drop("_links").join(sums, F.col("_id") == F.col("_i"), "left")
    new = {c: F.col(c) for c in ("n_a", "n_b", "n_groups", "n_links")}
    new |= {"n_best": F.coalesce("_best", F.lit(0)), "count_sum": F.coalesce("_sum", F.lit(0)), "groups_sha256": F.col("groups_sha256")}
    return unpacked(done, [c for c in df.columns if c != text], new)


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the groups and links of their tokens by two vocabularies."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align(documents(spark, sf_dir, "doc_id", "text"), *paths)
