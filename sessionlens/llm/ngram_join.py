"""Jaccard self-join of documents on word shingles by chosen paths.

Texts with the same sequence of words form one class; classes are joined. Each class has a signature of 64 minwise
coordinates, which agree between two classes as often as their shingle sets are similar. A run splits all classes by the
value of a randomly chosen coordinate (a shared sampled token), and splits every bucket above `BUCKET` classes again by
further coordinates, 1 / similarity of them on average per bucket. No two runs start with the same coordinate. Runs are
added until a pair at the threshold that has to survive as many splits as the most split bucket went through is found with
probability `RECALL`; `runs()` gives the number.

Buckets of at most `BUCKET` classes are compared pair by pair. So are, exactly and in blocks of `BUCKET` classes, larger
buckets whose classes are alike on average (splitting does not shrink them) and those left after `LEVELS` splits; no
bucket is cut short. Pairs whose signatures agree are verified on their full shingle sets. A pair that meets in several
buckets counts in the one with the smallest id only, so links are counted right without a list of all pairs: tasks
return one row per class and bucket, with its links and the smallest class it hangs together with.

Groups are the connected components of the links, found by rounds of star contraction over written tables.

Defined cases: null text counts as empty; texts without words are equal to each other and have no links; a text of one
to four words has one shingle, all its words; rows that repeat a doc_id and text are copies of one class; of each group the row
with the smallest doc_id stays (null last, then the first written); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.catalog import documents, query
from sessionlens.llm.shingles import COORDINATES, Words, mixed, sets, signatures
from sessionlens.llm.vocab import chunks
from sessionlens.session import scratch_path, spread

SIMILARITY = 0.8
RECALL = 0.999
BUCKET = 1000
LEVELS = 8
DENSE = 0.6
"""Buckets in which two classes agree on a coordinate this often are compared in blocks instead of split."""

SLACK = 5.4
"""Signatures may fall short of the threshold by this many standard deviations before a pair is passed over."""

RUN = np.uint64(0x9E3779B97F4A7C15)
CHILD = (np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7))
"""Salts of the runs' nodes and of a node's children."""

CHUNK = 1 << 20
SIGNED = "doc_id {id}, text_key long, d1 long, d2 long, shingles long, signature binary"
MEMBER = "parent long, coordinate int, node long, used long, class long"


def recall_of(starts: int, splits: int, similarity: float = SIMILARITY) -> float:
    """Probability that a pair of this similarity stays together through `splits` splits in one of `starts` runs.

    Given the m coordinates in which the pair agrees, first coordinates are drawn without replacement, those further down
    without replacement along each path.
    """
    second, total = min(1.0, 1 / similarity - 1), 0.0
    for m in range(COORDINATES + 1):
        meets = 1.0
        for used in range(splits - 1, 0, -1):
            one = max(0, m - used) / (COORDINATES - used) * meets
            meets = 1 - (1 - one) * (1 - second * one)
        missed = sum(comb(m, k) * comb(COORDINATES - m, starts - k) * (1 - meets)**k for k in range(starts + 1))
        total += comb(COORDINATES, m) * similarity**m * (1 - similarity)**(COORDINATES - m) * (
            1 - missed / comb(COORDINATES, starts))
    return total


def runs(recall: float = RECALL, similarity: float = SIMILARITY, splits: int = 2) -> int:
    """Runs after which a pair at the threshold that must survive the splits has been found with this probability; all
    coordinates start one where that is not enough."""
    return next((n for n in range(1, COORDINATES) if recall_of(n, splits, similarity) >= recall), COORDINATES)


def agreeing(similarity: float) -> int:
    """Coordinates that signatures must share at least for their pair to be verified."""
    spare = SLACK * (similarity * (1 - similarity) / COORDINATES) ** 0.5
    return max(1, ceil(COORDINATES * (similarity - spare)))


def signed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per document: digest of its words, number of shingles with repeats, signature."""
    kind = df.schema[doc_id].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text", CHUNK):
                words = Words(texts)
                hashes, counts = words.shingles()
                digests = np.frombuffer(b"".join(words.digests()), np.int64).reshape(-1, 2)
                signature = signatures(hashes, counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                     pa.array(counts.astype(np.int64)), pa.array([s.tobytes() for s in signature], pa.binary())],
                    ["doc_id", "text_key", "d1", "d2", "shingles", "signature"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(sign, SIGNED.format(id=kind))


def begun(run: int, signature: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, coordinate, child node, coordinates used) of each row's child in a run; each run has its own coordinate."""
    at = np.full(len(signature), np.argsort(mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)))[run], np.int64)
    seed = mixed(np.full(len(signature), run + 1, np.uint64) * RUN)
    child = mixed(seed + signature[np.arange(len(at)), at].astype(np.uint64))
    return np.arange(len(at)), at, child.view(np.int64), np.int64(1) << at


def children(node: np.ndarray, used: np.ndarray, signature: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """(row, coordinate, child node, coordinates used) of each row's children: per node one coordinate that is still
    unused, and with the probability that makes 1 / similarity on average a second one."""
    out, gone = [], used.copy()
    for k in range(2):
        draw = mixed(node.view(np.uint64) ^ CHILD[k])
        rows = np.arange(len(node))
        if k:
            rows = rows[(draw % np.uint64(1000)).astype(np.float64) < 1000 * (1 / similarity - 1)]
        first = (draw[rows] >> np.uint64(40)).astype(np.int64) % COORDINATES
        at = first.copy()
        for _ in range(COORDINATES):
            taken = (gone[rows] >> at) & 1 == 1
            if not taken.any():
                break
            at = np.where(taken, (at + 1) % COORDINATES, at)
        value = signature[rows, at].astype(np.uint64)
        child = mixed(mixed(node[rows].view(np.uint64) + at.astype(np.uint64)) + value)
        out.append((rows, at, child.view(np.int64), used[rows] | (np.int64(1) << at)))
        gone[rows] |= np.int64(1) << at
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def split(members: DataFrame, similarity: float, started: range | None = None) -> DataFrame:
    """The children of members (node, used, class, signature); with `started`, of classes that begin these runs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            name = batch.column("class").to_numpy(zero_copy_only=False)
            if started is not None:
                nodes = [(np.full(len(name), r + 1, np.int64), begun(r, signature)) for r in started]
            else:
                node = batch.column("node").to_numpy(zero_copy_only=False)
                used = batch.column("used").to_numpy(zero_copy_only=False)
                nodes = [(node, children(node, used, signature, similarity))]
            for node, (rows, at, child, mask) in nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[rows]), pa.array(at.astype(np.int32)), pa.array(child), pa.array(mask), pa.array(name[rows])],
                    ["parent", "coordinate", "node", "used", "class"])

    return members.mapInArrow(cut, MEMBER)


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grown(signs: DataFrame, similarity: float, started: range) -> tuple[list[DataFrame], int]:
    """Parts of (leaf, class, blocks) of the buckets of some runs, and the splits that the most split bucket went through."""
    members = written(split(signs, similarity, started), "join-members")
    found, splits = [], 1
    for level in range(LEVELS + 1):
        if level and not members.isEmpty():
            splits = level + 1
        sizes = written(members.groupBy("node").agg(F.count("*").alias("n"), F.first("parent").alias("parent"),
                                                    F.first("coordinate").alias("coordinate")).filter("n > 1"), "join-sizes")
        small = sizes.filter(F.col("n") <= BUCKET).select("node", F.lit(1).alias("blocks"))
        large = sizes.filter(F.col("n") > BUCKET)
        found.append(members.join(small, "node").select(F.col("node").alias("leaf"), "class", "blocks"))
        if large.isEmpty():
            break
        blocks = F.ceil(F.col("n") / BUCKET).cast("int")
        held = members.join(large.select("node", "n"), "node")
        if level == LEVELS:
            found.append(held.select(F.col("node").alias("leaf"), "class", blocks.alias("blocks")))
            break
        next_members = written(split(held.select("node", "used", "class").join(signs, "class"), similarity), "join-members")
        shares = next_members.groupBy("parent", "coordinate", "node").agg(F.count("*").alias("c"))
        alike = shares.groupBy("parent", "coordinate").agg(
            F.sum(F.col("c").cast("double") * F.col("c")).alias("same"), F.sum("c").cast("double").alias("all"),
        ).groupBy("parent").agg(F.avg(F.col("same") / (F.col("all") * F.col("all"))).alias("share"))
        dense = written(alike.filter(F.col("share") >= DENSE).select("parent"), "join-dense")
        apart = dense.select(F.col("parent").alias("node"))
        found.append(held.join(apart, "node", "left_semi").select(
            F.col("node").alias("leaf"), "class", blocks.alias("blocks")))
        members = next_members.join(dense, "parent", "left_anti")
    return found, splits


def leaves_of(classes: DataFrame, similarity: float, recall: float = RECALL) -> DataFrame:
    """(leaf, class, blocks) of all buckets with two or more classes; `blocks` over 1 for those compared in blocks."""
    signs = classes.filter("shingles > 0").select("class", "signature")
    found, done, splits = [], 0, 2
    while (needed := runs(recall, similarity, splits)) > done:
        parts, deepest = grown(signs, similarity, range(done, needed))
        found += parts
        done, splits = needed, max(splits, deepest)
    return written(reduce(DataFrame.unionByName, found), "join-leaves")


def bucket_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket of batches sorted by (leaf, a, b)."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows - 1, bool)
        for c in ("leaf", "a", "b"):
            v = table.column(c).to_numpy()
            change |= v[1:] != v[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist()]
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            yield table.slice(x, y - x)
        held = table.slice(bounds[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def candidates(bucket: pa.Table, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of a bucket whose signatures agree enough and whose smallest common bucket is this one."""
    signature = np.frombuffer(b"".join(bucket.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
    name, own = bucket.column("class").to_numpy(), bucket.column("own").to_numpy()
    a, b, leaf = bucket.column("a")[0].as_py(), bucket.column("b")[0].as_py(), bucket.column("leaf")[0].as_py()
    left = np.flatnonzero(own == a)
    right = left if a == b else np.flatnonzero(own == b)
    same = np.zeros((len(left), len(right)), np.uint8)
    for k in range(COORDINATES):
        same += signature[left, k][:, None] == signature[right, k][None, :]
    i, j = np.nonzero(same >= need)
    i, j = left[i], right[j]
    stay = (i < j) if a == b else np.ones(len(i), bool)
    stay &= name[i] != name[j]
    i, j = i[stay], j[stay]
    if len(i):
        column = bucket.column("leaves").combine_chunks()
        values, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
        rows = np.repeat(np.arange(len(name)), np.diff(ends, prepend=0))
        lower = values < leaf
        ids, place = np.unique(values[lower], return_inverse=True)
        if len(ids):
            earlier = np.zeros((len(name), len(ids)), np.float32)
            earlier[rows[lower], place] = 1
            if len(i) > 50:
                met = (earlier @ earlier.T)[i, j] > 0
            else:
                met = (earlier[i] * earlier[j]).any(axis=1)
            i, j = i[~met], j[~met]
    return i, j


def overlaps(i: np.ndarray, j: np.ndarray, items: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common part of the sorted sets items[i] and items[j]."""
    if len(i) <= 200:
        return np.array([len(np.intersect1d(items[x], items[y], assume_unique=True)) for x, y in
                         zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    rows = np.repeat(np.arange(len(items)), [len(x) for x in items])
    ids, place, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    total = np.zeros((len(items), len(items)), np.float32)
    shared = count > 1
    number = np.cumsum(shared) - 1
    rows, place = rows[shared[place]], number[place[shared[place]]]
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    width = 4096
    for x in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(place, [x, x + width])
        dense = np.zeros((len(items), width), np.float32)
        dense[rows[lo:hi], place[lo:hi] - x] = 1
        total += dense @ dense.T
    return total[i, j].astype(np.int64)


def links(bucket: pa.Table, need: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, its verified links, smallest class it hangs together with) of the linked classes of a bucket."""
    i, j = candidates(bucket, need)
    name = bucket.column("class").to_numpy()
    if not len(i):
        return name[:0], name[:0], name[:0]
    there = np.unique(np.concatenate([i, j]))
    items = sets([x or "" for x in bucket.column("text").take(pa.array(there)).to_pylist()])
    size = np.array([len(x) for x in items])
    i, j = np.searchsorted(there, i), np.searchsorted(there, j)
    common = overlaps(i, j, items)
    linked = common >= similarity * (size[i] + size[j] - common) - 1e-9
    i, j, name = i[linked], j[linked], name[there]
    number = np.bincount(np.concatenate([i, j]), minlength=len(name))
    label = name.copy()
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        if (low == label).all():
            break
        label = low
    some = number > 0
    return name[some], number[some], label[some]


def near(classes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(class, links, label) per class and bucket in which it has links."""
    leaves = leaves_of(classes, similarity)
    mine = leaves.groupBy("class").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    known = mine.join(classes.select("class", "signature", "doc_id", "text_key"), "class")
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = (
        leaves.withColumn("own", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("leaf", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "class")
        .join(known, "class")
    )
    need = agreeing(similarity)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in bucket_runs(batches):
            i, j = candidates(bucket, need)
            if len(i):
                yield from bucket.take(pa.array(np.unique(np.concatenate([i, j])))).combine_chunks().to_batches()

    key = ["leaf", "a", "b"]
    sifted = written(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(sift, dealt.schema), "join-sifted")
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "text")
    full = sifted.join(
        texts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")),
    ).drop("_doc", "_key", "doc_id", "text_key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in bucket_runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in links(bucket, need, similarity)],
                                             ["class", "links", "label"])

    return full.repartition(*key).sortWithinPartitions(*key).mapInArrow(verify, "class long, links long, label long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for edges (node, label), the smallest node each node is connected with; nodes without edges are left out.

    Each round points the neighbours of a node to the smallest of them, first those above it, then those below it.
    """
    pairs = written(edges.filter("node != label").select(
        F.greatest("node", "label").alias("u"), F.least("node", "label").alias("v")).distinct(), "stars")
    before = None
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        up = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        up = written(up.distinct(), "stars")
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u")
        pairs = written(
            down.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state


def ngram_join(df: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key (xxhash64 of its text), class_id (smallest doc_id of its group of linked texts),
    copy_id (smallest doc_id with the same words), n_copies, n_links (other texts of at least this similarity), kept."""
    rows = written(signed(df, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "join-signed")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    picked = rows.groupBy("d1", "d2").agg(
        F.min(first).alias("first"), F.count("*").alias("n_copies"),
        F.min_by(F.struct("signature", "text_key", "shingles"), first).alias("of"))
    classes = written(picked.select(
        F.monotonically_increasing_id().alias("class"), "d1", "d2", "n_copies", "first", F.col("first.id").alias("doc_id"),
        F.col("of.signature").alias("signature"), F.col("of.text_key").alias("text_key"),
        F.col("of.shingles").alias("shingles")), "join-classes")
    docs = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    found = written(near(classes, docs, similarity), "join-links")
    number = found.groupBy("class").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("class").alias("node"), "label"))
    grouped = (
        classes.drop("signature").join(roots.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("root", F.coalesce("root", "class")).join(number, "class", "left")
    )
    grouped = written(grouped, "join-grouped")
    heads = grouped.groupBy("root").agg(F.min("first").alias("head"))
    named = written(grouped.join(heads, "root").select(
        F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("head.id").alias("class_id"),
        F.col("first.id").alias("copy_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("head.row").alias("_head")), "join-named")
    return rows.join(named.hint("merge"), (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2"))).select(
        "doc_id", "text_key", "class_id", "copy_id", "n_copies", "n_links", (F.col("row") == F.col("_head")).alias("kept"))


@query("op4_ngram_jaccard")
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their group of texts that share 80 % of their five-word shingles."""
    return ngram_join(documents(spark, sf_dir, "doc_id", "text")).drop("text_key")
