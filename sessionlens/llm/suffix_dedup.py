"""Removal of repeated passages by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in its own document or another.

Where equal strings meet: every window of `length` bytes has a key, the smallest hash of its `gram`-byte substrings. Equal
windows have equal keys, so windows are compared with those of their key only. Neighbouring windows mostly share their key
and travel as one run. Three steps, none of which moves a text that has no partner:
1. keys are counted over the corpus; runs whose key occurs once (and once within the run) have no repeated window;
2. the other runs are counted by a 128-bit digest of their bytes: all windows of a run that occurs twice are repeated;
3. one copy of each different run is cut out of its document, and runs of the same keys form blocks of bounded bytes.

In a block: the suffixes of the runs laid end to end are ordered as far as `length`, which gives the Burrows-Wheeler
transform. Starting from the whole range, each round extends all open intervals backward by every character in them. An
interval's end that no shorter string had reached is a border with a common prefix as long as the round's number, and only
those intervals stay open (the rounds are the levels of a breadth-first search). After `length` rounds, neighbours without
a border between them share at least `length` bytes. Common prefixes come by increasing value, and longer ones are never worked out.

A key whose different runs exceed `block_bytes` (a passage in a third of all documents, in ever new surroundings) is split
into parts. Each part is a block; of every string that has no partner within its part the digest goes into a count over all
parts, of the strings with partners one digest per part, so hot keys are pre-aggregated and never gathered.

Defined cases: null counts as empty (0 bytes, nothing removed, digest of nothing); texts shorter than `length` stay; long
texts are read in sections that overlap; repeated rows and rows without or with equal ids are documents of their own (a
numbered copy is written first); an empty table gives an empty result; input columns with the names of new ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.alignment import ragged
from sessionlens.llm.catalog import documents, query
from sessionlens.llm.rows import ROW, quoted, unpacked
from sessionlens.llm.shingles import mixed
from sessionlens.llm.vocab import chunks
from sessionlens.session import drop_scratch, scratch_path, spread

LENGTH = 200
GRAM = 32
BLOCK_BYTES = 1 << 21
SECTION = 1 << 20
LONGEST_RUN = 4096

_random = np.random.default_rng(77)
_CELL = _random.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, for i below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SECTION + LENGTH)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b % 2**64, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def window_keys(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of the window that starts at each byte, and the hashes of all grams."""
    up, down = powers(len(raw))
    total = np.r_[np.uint64(0), np.cumsum(_CELL[raw] * up)]
    grams = mixed((total[gram:] - total[:-gram]) * down[: len(raw) - gram + 1])
    width = length - gram + 1
    blocks = -(-len(grams) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[: len(grams)] = grams
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(raw) - length + 1
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n]), grams


def runs(raw: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Runs of windows with one key in texts laid end to end: text, first window, number of windows, key, and whether the
    key's gram stands in the run twice (only then can a run repeat a window of its own)."""
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    keys, grams = window_keys(raw, length, gram)
    at = np.arange(len(keys))
    text = np.searchsorted(ends, at, side="right")
    inside = at + length <= ends[text]
    at, text, keys = at[inside], text[inside], keys[inside]
    if not len(at):
        return at, at, at, keys, np.zeros(0, bool)
    new = np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)]
    begun = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - begun) % LONGEST_RUN == 0
    first = np.flatnonzero(new)
    windows = np.diff(np.r_[first, len(at)])
    start, key = at[first], keys[first]
    reach = windows + length - gram
    hits = grams[ragged(start, reach)] == np.repeat(key, reach)
    twice = np.add.reduceat(hits, np.r_[0, np.cumsum(reach)[:-1]], dtype=np.int64) > 1
    return text[first], start, windows, key, twice


def sections(texts: list[str], length: int) -> Iterator[tuple[bytes, np.ndarray, list[int], list[int]]]:
    """Bytes laid end to end, where each part ends, the text of each part and the part's place in it."""
    raw, which, place = [], [], []
    for i, text in enumerate(texts):
        data = text.encode()
        for at in range(0, max(len(data) - length + 1, 0), SECTION):
            raw.append(data[at: at + SECTION + length - 1])
            which.append(i)
            place.append(at)
            if sum(map(len, raw[-1:])) >= SECTION:
                yield b"".join(raw), np.cumsum([len(x) for x in raw]), which, place
                raw, which, place = [], [], []
    if raw:
        yield b"".join(raw), np.cumsum([len(x) for x in raw]), which, place


def key_counts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Keys of more than one run, or of a run that holds its key twice; `twice` tells whether there is one of the latter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch, "_text"):
                for raw, ends, _, _ in sections(texts, length):
                    *_, key, twice = runs(np.frombuffer(raw, np.uint8), ends, length, gram)
                    key, place, n = np.unique(key.view(np.int64), return_inverse=True, return_counts=True)
                    own = np.bincount(place, twice, len(key)) > 0
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(own)], ["key", "n", "twice"])

    found = docs.select("_text").mapInArrow(run, "key long, n long, twice boolean").groupBy("key")
    return found.agg(F.sum("n").alias("n"), F.max("twice").alias("twice")).filter("n > 1 OR twice").select(
        F.col("key").alias("_key"), "twice")


def all_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Every run: _id, start, windows, key and the digest of its bytes as two numbers."""
    schema = T.StructType([docs.schema["_id"]]).add("start", "long").add("windows", "integer").add("key", "long").add("d1", "long").add("d2", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "_text"):
                for raw, ends, which, place in sections(texts, length):
                    text, start, windows, key, _ = runs(np.frombuffer(raw, np.uint8), ends, length, gram)
                    digest = np.frombuffer(b"".join(
                        [hashlib.blake2b(raw[a: a + n], digest_size=16).digest()
                         for a, n in zip(start.tolist(), (windows + length - 1).tolist(), strict=True)]), np.int64).reshape(-1, 2)
                    began = np.r_[0, ends[:-1]]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(np.array(which, np.int64)[text])), pa.array(start - began[text] + np.array(place, np.int64)[text]),
                         pa.array(windows.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1])],
                        schema.names)

    return docs.select("_id", "_text").mapInArrow(run, schema)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes, ordered by at least their first `depth` symbols; suffixes equal so far by place.

    Symbols are below 512, the last one occurs nowhere else. Sorted by 7 symbols, then by twice as many in each round."""
    n, width = len(symbols), 7
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= 9
        key[: n - k] |= symbols[k:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    while width < depth:
        open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(open_):
            break
        place = order[open_]
        behind = place + width
        key = group[open_] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, order[open_] = key[by], place[by]
        new[open_] = np.r_[True, key[1:] != key[:-1]]
        group[open_] = np.maximum.accumulate(np.where(new[open_], open_, 0))
        rank[order[open_]] = group[open_]
        width *= 2
    return order


def borders(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each row of the suffix order, whether it shares fewer than `length` symbols with the row before."""
    n = len(order)
    last = symbols[order - 1]
    by_symbol = np.argsort(last.astype(np.uint16), kind="stable")
    back = np.empty(n, np.int64)  # the row of the suffix that is one symbol longer
    back[by_symbol] = np.arange(n)
    same = last[by_symbol[1:]] == last[by_symbol[:-1]]
    before, after = np.full(n, -1), np.full(n, n)  # rows with the same symbol in front
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    border = np.zeros(n + 1, bool)
    border[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        sizes = high - low
        rows = ragged(low, sizes)
        high = np.sort(back[rows[after[rows] >= np.repeat(high, sizes)]]) + 1
        low = np.sort(back[rows[before[rows] < np.repeat(low, sizes)]])
        fresh = ~border[high]
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        border[high] = True
    return border[:n]


def repeats(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of runs laid end to end with one byte between them: whether each place starts a window, whether the window
    stands elsewhere too, and a number shared by equal windows."""
    sizes = np.array([len(b) for b in bodies])
    text = np.frombuffer(b"\0".join([*bodies, b""]), np.uint8)
    symbols = np.r_[text.astype(np.int64) + 2, 0]
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = 1
    order = suffix_order(symbols, length)
    border = borders(symbols, order, length)
    again = ~border | ~np.r_[border[1:], True]
    found, kind = np.zeros(len(symbols), bool), np.empty(len(symbols), np.int64)
    found[order] = again
    kind[order] = np.cumsum(border)
    at = np.arange(len(text))
    starts = at + length <= np.repeat(ends, sizes + 1)
    return starts, found[:-1] & starts, kind[:-1]


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of flags."""
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


FOUND = "_id {id}, start long, stop long, d1 long, d2 long"


def compared(bodies: DataFrame, length: int, id_type: str) -> DataFrame:
    """Bytes of a document to remove (`_id`, start, stop), found in the blocks; and of split keys the digests of windows, with
    the place of those that have no partner in their part (start, without stop) or none (with partners)."""
    schema = FOUND.format(id=id_type)
    names = ["_id", "start", "stop", "d1", "d2"]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts = table.column("body").to_pylist()
        starts, again, kind = repeats(texts, length)
        base = np.cumsum([0] + [len(x) + 1 for x in texts])
        offset = np.array(table.column("start").to_pylist(), np.int64) - base[:-1]
        first, last = spans(again)
        which = np.searchsorted(base, first, side="right") - 1
        row, start, stop = [which], [first + offset[which]], [last + offset[which] + length]
        d1, d2 = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        parts = [(row[0], start[0], stop[0], d1, d2, np.ones(len(which), bool))]
        if table.column("part")[0].as_py() >= 0:
            alone = np.flatnonzero(starts & ~again)
            shared = np.flatnonzero(again)
            shared = shared[np.unique(kind[shared], return_index=True)[1]]
            at = np.r_[alone, shared]
            which = np.searchsorted(base, at, side="right") - 1
            digest = np.frombuffer(b"".join([
                hashlib.blake2b(texts[w][a: a + length], digest_size=16).digest()
                for w, a in zip(which.tolist(), (at - base[which]).tolist(), strict=True)]), np.int64).reshape(-1, 2)
            single = np.r_[np.ones(len(alone), bool), np.zeros(len(shared), bool)]
            parts.append((which, at + offset[which], np.full(len(at), -1), digest[:, 0], digest[:, 1], single))
        row, start, stop, d1, d2, placed = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids = table.column("_id").combine_chunks().take(pa.array(np.where(placed, row, 0)))
        return pa.table([ids, pa.array(start, mask=~placed), pa.array(stop, mask=stop < 0), pa.array(d1), pa.array(d2)], names)

    return bodies.groupBy("block", "part").applyInArrow(run, schema)


def cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted runs (_id, start, windows, block, part)."""
    lists = wanted.groupBy(F.col("_id").alias("_i")).agg(F.collect_list(F.struct("start", "windows", "block", "part")).alias("_runs"))
    schema = T.StructType([docs.schema["_id"]]).add("start", "long").add("block", "long").add("part", "integer").add("body", "binary")
    joined = docs.select("_id", "_text").join(lists.hint("merge"), F.col("_id") == F.col("_i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "_text"):
                for i, (text, own) in enumerate(zip(texts, part.column("_runs").to_pylist(), strict=True)):
                    data = text.encode()
                    for at in range(0, len(own), 4096):
                        some = own[at: at + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).slice(i, 1).take(pa.array([0] * len(some))), pa.array([r["start"] for r in some], pa.int64()),
                             pa.array([r["block"] for r in some], pa.int64()), pa.array([r["part"] for r in some], pa.int32()),
                             pa.array([data[r["start"]: r["start"] + r["windows"] + length - 1] for r in some], pa.binary())], schema.names)

    return joined.select("_id", "_text", "_runs").mapInArrow(run, schema)


def marked(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The byte ranges to remove (_id, start, stop; they may overlap) of documents with unique `_id`."""
    spark = docs.sparkSession
    id_type = docs.schema["_id"].dataType.simpleString()
    digest = ["key", "d1", "d2"]

    def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    keys, keys_path = written(key_counts(docs, length, gram), "repeat-keys")
    every = all_runs(docs, length, gram)
    shared, _ = written(every.join(keys.hint("merge"), F.col("key") == F.col("_key")).drop("_key"), "shared-runs")
    drop_scratch(spark, keys_path)
    kinds, _ = written(shared.groupBy(*digest).agg(
        F.count("*").alias("n"), F.max("twice").alias("twice"), F.min(F.struct("_id", "start", "windows")).alias("at")), "run-kinds")
    size = F.col("at.windows") + (length - 1)
    groups, groups_path = written(
        kinds.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_kinds"), F.sum(size).alias("_bytes"), F.max("twice").alias("_twice"))
        .filter("_kinds > 1 OR _twice"), "run-groups")
    total = groups.filter(F.col("_bytes") <= block_bytes).agg(F.sum("_bytes")).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    parts = F.ceil(F.col("_bytes") / F.lit(block_bytes)).cast("long")
    wanted = kinds.join(groups.hint("merge"), F.col("key") == F.col("_key")).select(
        "at._id", "at.start", "at.windows",
        F.when(F.col("_bytes") > block_bytes, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(blocks))).alias("block"),
        F.when(F.col("_bytes") > block_bytes, F.pmod(F.xxhash64("d1", "d2"), parts)).otherwise(-1).cast("int").alias("part"))
    bodies, bodies_path = written(cut_out(docs, wanted, length), "run-bodies")
    drop_scratch(spark, groups_path)
    found, _ = written(compared(bodies, length, id_type), "block-repeats")
    drop_scratch(spark, bodies_path)
    inside = found.filter("stop IS NOT NULL").select("_id", "start", "stop")
    digests = found.filter("stop IS NULL")
    across = digests.groupBy(F.col("d1").alias("_d1"), F.col("d2").alias("_d2")).agg(F.count("*").alias("_n")).filter("_n > 1")
    split = digests.filter("start IS NOT NULL").join(across.hint("merge"), (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2"))).select(
        "_id", "start", (F.col("start") + length).alias("stop"))
    copied = kinds.filter("n > 1").select(*(F.col(c).alias(f"_{c}") for c in digest))
    same = [F.col(c) == F.col(f"_{c}") for c in digest]
    whole = shared.join(copied.hint("merge"), same[0] & same[1] & same[2], "left_semi").select(
        "_id", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("stop"))
    return inside.unionByName(split).unionByName(whole)


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in ranges):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], stop)
        else:
            out.append((start, stop))
    return out


def suffix_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM,
                 block_bytes: int = BLOCK_BYTES, keep: bool = False) -> DataFrame:
    """`df` without its text, with n_bytes, n_removed, n_spans and kept_sha256; with `keep` the bytes that stay (`kept_bytes`)."""
    spark = df.sparkSession
    rest = [F.col(quoted(c)) for c in df.columns if c != text]
    row = F.struct(*rest) if rest else F.struct(F.lit(None).cast("long").alias("_none"))
    docs = df.select(row.alias(ROW), F.col(quoted(text)).alias("_text"))
    docs = docs.withColumn("_id", F.col(f"{ROW}.{quoted(doc_id)}") if doc_id in df.columns else F.lit(None).cast("long"))
    counts = docs.agg(F.count("*").alias("n"), F.count_distinct("_id").alias("ids")).first()
    if counts.n != counts.ids:
        path = scratch_path(spark, "numbered-documents")
        docs.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
        docs = spark.read.parquet(path)
    docs = spread(docs)
    ranges = marked(docs, length, gram, block_bytes).groupBy(F.col("_id").alias("_i")).agg(
        F.collect_list(F.struct("start", "stop")).alias("_ranges"))
    joined = docs.join(ranges.hint("merge"), F.col("_id") == F.col("_i"), "left").select(ROW, "_text", "_ranges")
    schema = T.StructType([joined.schema[ROW]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    schema = schema.add("kept_bytes", "binary") if keep else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "_text"):
                sizes, removed, numbers, digests, bodies = [], [], [], [], []
                for text, own in zip(texts, part.column("_ranges").to_pylist(), strict=True):
                    data, cuts = text.encode(), merged(own or [])
                    stay = b"".join([data[a:b] for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(data)], strict=True)])
                    sizes.append(len(data))
                    removed.append(len(data) - len(stay))
                    numbers.append(len(cuts))
                    digests.append(hashlib.sha256(stay).hexdigest())
                    bodies.append(stay)
                columns = [part.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, numbers)), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bodies, pa.binary())] if keep else columns, schema.names)

    out = joined.mapInArrow(run, schema)
    return unpacked(out, [c for c in df.columns if c != text], {c: F.col(c) for c in schema.names[1:]})


@query("op13_suffix_dedup")
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages of 200 bytes and more, as digests."""
    return suffix_dedup(documents(spark, sf_dir, "doc_id", "text"))
