r"""Ranked lexical search over hashed max-sketches.

The index holds one sketch per document: terms are hashed to 65,536 coordinates, and a coordinate keeps the largest count
of the terms that fall on it (one byte; 255 stands for any larger count). A term's impact grows with its count, whatever the
corpus statistics turn out to be, so the impact of a coordinate's count is at least that of each of its terms, and the
weighted sum over a query's coordinates is an upper bound of the document's score. Sketches store their filled coordinates
only; they depend on the document alone and serve any later set of queries.

Queries are looked up in blocks: one scan of the index bounds all documents for all items of a block. The documents of the
highest bounds are scored exactly from their texts, which gives each item a threshold, the score of its 20th best so far; a
second scan takes every document whose bound reaches the threshold, in whatever number, and those are scored exactly too.
No document left out can be among the best. All numbers are integers below 2^53, so sums in doubles are exact.

Blocks of items have at most `BLOCK_ITEMS` rows and `BLOCK_BYTES` of text, whatever the number of items; only a block, its
thresholds and the document frequencies of its terms reach the driver. The best of an item are picked in salted parts first.

Terms are the maximal matches of `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`, with A-Z lower-cased. Defined cases: null and
empty texts have no terms and are never found; items without terms find nothing; equal scores go by doc_id, null last; rows
that repeat are found as often as they occur; long texts are read in sections; an empty table of documents or items gives an
empty result; other columns of the tables are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.alignment import ragged
from sessionlens.llm.catalog import documents, query
from sessionlens.llm.rows import quoted
from sessionlens.llm.vocab import chunks
from sessionlens.session import scratch_path, spread

WIDTH = 1 << 16
MOST = 255
BEST = 20
FIRST = 64
"""Documents of the highest bounds that are scored for an item's threshold."""

BLOCK_ITEMS = 1024
BLOCK_BYTES = 1 << 20
CELLS = 1 << 21
"""Bounds that are worked out at a time, documents times items."""

SHARED = 16
"""Coordinates of more items than this are multiplied as a matrix, the others added one by one."""

SECTION_BYTES = 1 << 22
SALTS = 64
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> Counter:
    """How often each term occurs in a text."""
    raw = (text or "").encode().translate(LETTERS)
    if len(raw) <= SECTION_BYTES:
        return Counter(raw.split())
    out, start = Counter(), 0
    while start < len(raw):
        stop = raw.find(b" ", start + SECTION_BYTES)
        stop = len(raw) if stop < 0 else stop
        out.update(raw[start:stop].split())
        start = stop
    return out


def coordinates(names, width: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, names), np.int64) % width


def sketch(counts: Counter, width: int = WIDTH) -> tuple[bytes, bytes]:
    """The filled coordinates of a document and their largest counts."""
    most = np.minimum(np.fromiter(counts.values(), np.int64), MOST)
    key = np.sort(coordinates(counts, width) << 8 | most)
    last = np.append(key[1:] >> 8 != key[:-1] >> 8, True)
    return (key[last] >> 8).astype("<u2").tobytes(), (key[last] & MOST).astype(np.uint8).tobytes()


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document with terms: doc_id, n_terms (with repeats), coordinates and largest counts."""
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("_text"))
    schema = T.StructType([rows.schema["doc_id"]]).add("n_terms", "long").add("coordinates", "binary").add("counts", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "_text"):
                found = [terms(t) for t in texts]
                full = [i for i, c in enumerate(found) if c]
                made = [sketch(found[i], width) for i in full]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(full, pa.int32())), pa.array([found[i].total() for i in full], pa.int64()),
                     pa.array([c for c, _ in made], pa.binary()), pa.array([n for _, n in made], pa.binary())], schema.names)

    return spread(rows).mapInArrow(run, schema)


@dataclass
class Block:
    """Items of one pass over the index, with the statistics their scores need."""

    items: list[Counter]
    n_docs: int
    n_terms: int
    weight: dict[bytes, int]
    width: int = WIDTH
    first: int = FIRST

    def length_factor(self, n: int) -> int:
        return 75 + 25 * n * self.n_docs // self.n_terms

    def lookup(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slot of each coordinate (-1: none), and per slot the first of its entries, the entries' items and weights."""
        cells: Counter = Counter()
        for k, item in enumerate(self.items):
            known = [t for t in item if t in self.weight]
            for t, c in zip(known, coordinates(known, self.width).tolist(), strict=True):
                cells[c, k] += item[t] * self.weight[t]
        table = np.array([(c, k, w) for (c, k), w in sorted(cells.items())], np.int64).reshape(-1, 3)
        places, first = np.unique(table[:, 0], return_index=True)
        slots = np.full(self.width, -1, np.int64)
        slots[places] = np.arange(len(places))
        return slots, np.append(first, len(table)), table[:, 1], table[:, 2]

    def scores(self, counts: Counter, wanted: list[int]) -> list[int]:
        """The exact scores of a document for some items."""
        m = 12 * self.length_factor(counts.total())
        return [sum(n * self.weight[t] * (1_000_000_000 * counts[t] // (1000 * counts[t] + m))
                    for t, n in self.items[k].items() if t in counts) for k in wanted]


class Bounds:
    """Upper bounds of the scores of indexed documents for all items of a block."""

    def __init__(self, block: Block):
        self.block = block
        self.slots, first, self.item, self.gain = block.lookup()
        self.first, self.size = first[:-1], np.diff(first)
        dense = np.flatnonzero(self.size > SHARED)
        self.row = np.full(len(self.size), -1)
        self.row[dense] = np.arange(len(dense))
        self.matrix = np.zeros((len(dense), len(block.items)))
        for r, s in enumerate(dense.tolist()):
            own = slice(first[s], first[s + 1])
            self.matrix[r, self.item[own]] = self.gain[own]

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        """One row per document of the batch, one column per item."""
        kept = [np.frombuffer(x, "<u2") for x in batch.column("coordinates").to_pylist()]
        sizes = list(map(len, kept))
        slot = self.slots[np.concatenate(kept)]
        count = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint8)
        hit = np.flatnonzero(slot >= 0)
        doc, slot, count = np.repeat(np.arange(len(kept)), sizes)[hit], slot[hit], count[hit].astype(np.int64)
        m = np.array([12 * self.block.length_factor(n) for n in batch.column("n_terms").to_pylist()], np.int64)[doc]
        impact = np.where(count == MOST, 1_000_000, 1_000_000_000 * count // (1000 * count + m)).astype(np.float64)
        width = len(self.block.items)
        dense = np.zeros((len(kept), len(self.matrix)))
        row = self.row[slot]
        dense[doc[row >= 0], row[row >= 0]] = impact[row >= 0]
        rest = np.flatnonzero(row < 0)
        entries = ragged(self.first[slot[rest]], self.size[slot[rest]])
        of = np.repeat(rest, self.size[slot[rest]])
        added = np.bincount(doc[of] * width + self.item[entries], impact[of] * self.gain[entries], len(kept) * width)
        return dense @ self.matrix + added.reshape(len(kept), width)


def bounded(index: DataFrame, block: Block, threshold: list[int] | None) -> DataFrame:
    """item (its place in the block), doc_id and bound: of every document whose bound reaches the item's threshold, or
    without thresholds of the `first` highest bounds of each task."""
    first = block.first
    schema = T.StructType().add("item", "integer").add(index.schema["doc_id"]).add("bound", "long")
    width = len(block.items)
    rows = max(1, CELLS // width)

    def out(item, ids, bound):
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(bound.astype(np.int64))], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(block)
        least = None if threshold is None else np.maximum(np.array(threshold), 1)
        ids, seen = [], 0
        top = np.zeros((0, width)), np.zeros((0, width), np.int64)  # bounds, and rows counted over the task
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = bounds(part)
                if least is not None:
                    doc, item = np.nonzero(found >= least)
                    if len(doc):
                        yield out(item, part.column("doc_id").take(pa.array(doc)), found[doc, item])
                    continue
                ids.append(part.column("doc_id"))
                place = np.broadcast_to(np.arange(seen, seen + len(found))[:, None], found.shape)
                value, place = np.concatenate([top[0], found]), np.concatenate([top[1], place])
                if len(value) > first:
                    pick = np.argpartition(value, len(value) - first, axis=0)[-first:]
                    value, place = np.take_along_axis(value, pick, 0), np.take_along_axis(place, pick, 0)
                top, seen = (value, place), seen + len(found)
        if ids:
            r, item = np.nonzero(top[0] > 0)
            yield out(item, pa.concat_arrays(ids).take(pa.array(top[1][r, item])), top[0][r, item])

    return index.mapInArrow(run, schema)


def highest(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n rows of each item with the highest `by`, with their `rank`; equal ones by doc_id."""
    order = [F.desc(by), F.asc_nulls_last("doc_id")]
    salted = df.withColumn("_salt", F.pmod(F.hash("doc_id", by), F.lit(SALTS)))
    part = salted.withColumn("_r", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).filter(F.col("_r") <= n)
    whole = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return whole.filter(F.col("rank") <= n).drop("_salt", "_r")


def rescored(docs: DataFrame, candidates: DataFrame, block: Block) -> DataFrame:
    """The exact scores above 0 of candidates (item, doc_id), from the texts of their documents."""
    spark = docs.sparkSession
    path = scratch_path(spark, "search-candidates")
    candidates.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("item").alias("_items")).write.parquet(path)
    wanted = docs.join(spark.read.parquet(path), F.col("doc_id").eqNullSafe(F.col("_id")))
    schema = T.StructType().add("item", "integer").add(docs.schema["doc_id"]).add("score", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "_text"):
                place, items, scores = [], [], []
                for i, (text, own) in enumerate(zip(texts, part.column("_items").to_pylist(), strict=True)):
                    counts = terms(text)
                    for k, score in zip(own, block.scores(counts, own) if counts else [], strict=bool(counts)):
                        if score > 0:
                            place.append(i)
                            items.append(k)
                            scores.append(score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items, pa.int32()), part.column("doc_id").take(pa.array(place, pa.int32())), pa.array(scores, pa.int64())],
                    schema.names)

    return wanted.select("doc_id", "_text", "_items").mapInArrow(run, schema)


def frequencies(docs: DataFrame, names: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each of some terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = set(names), Counter()
        for batch in batches:
            for _, texts in chunks(batch, "_text"):
                for text in texts:
                    total.update(known.intersection(terms(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    found = spread(docs.select("_text")).mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r.term): r.n for r in found.collect()}


def blocks(items: DataFrame) -> Iterator[list[Row]]:
    """Rows of (item_id, _text) in blocks of bounded size."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append(row)
        size += len(row[1] or "")
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, best: int = BEST, index: DataFrame | None = None,
           doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           width: int = WIDTH, first: int = FIRST) -> DataFrame:
    """item_id, rank, doc_id and score of the `best` documents of each item. Without an index, one is built and written;
    an index that is given must have the same width."""
    spark = docs.sparkSession
    if index is None:
        path = scratch_path(spark, "search-index")
        build_index(docs, doc_id, text, width).write.parquet(path)
        index = spark.read.parquet(path)
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("_text"))
    asked = items.select(F.col(quoted(item_id)).alias("item_id"), F.col(quoted(text)).alias("_text"))
    total = index.agg(F.count("*").alias("n"), F.sum("n_terms").alias("terms")).first()
    names = T.StructType([asked.schema["item_id"], T.StructField("_item", T.IntegerType())])
    out = spark.createDataFrame([], T.StructType([asked.schema["item_id"]]).add("rank", "integer").add(rows.schema["doc_id"]).add("score", "long"))
    if not total.n:
        return out
    for group in blocks(asked):
        wanted = [terms(r[1]) for r in group]
        held = frequencies(rows, sorted(set().union(*wanted)))
        weight = {t: math.floor(1000 * math.log((2 * total.n + 2) / (2 * n + 1))) for t, n in held.items()}
        block = Block([Counter({t: n for t, n in c.items() if t in weight}) for c in wanted], total.n, total.terms, weight, width, max(first, best))
        scored = rescored(rows, highest(bounded(index, block, None), "bound", block.first), block)
        threshold = [0] * len(group)
        for r in highest(scored, "score", best).filter(F.col("rank") == best).collect():  # one row per item of the block
            threshold[r.item] = r.score
        done = highest(rescored(rows, bounded(index, block, threshold), block), "score", best)
        own = spark.createDataFrame([(r[0], k) for k, r in enumerate(group)], names)
        out = out.unionByName(done.join(F.broadcast(own), F.col("item") == F.col("_item")).select("item_id", "rank", "doc_id", "score"))
    return out


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query("op12_lexical_search", rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), total AS (
  SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_terms FROM words
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs
), lengths AS (
  SELECT doc_id, 100 - 25 + (25 * count(*) * any_value(n_docs)) // any_value(n_terms) AS m FROM words, total GROUP BY doc_id
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id) GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return search(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
