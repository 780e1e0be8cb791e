"""Density in several dimensions: clusters of points, nearest vectors, and how far a vector lies outside its neighbourhood.

Clusters come from grid cells, not from point pairs. Neighbours of vectors come from a forest of hyperplane cuts whose full
buckets are cut further, so no bucket beyond `leaf` rows is ever compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.session import cut_lineage, drop_scratch, scratch_path

PARTS = 4
KEYED = 3
BITS = 48
SEED = 1811


def components(edges: DataFrame) -> DataFrame:
    """The smallest node of each node's connected component, for edges of two ids `a` and `b`: (node, component).

    Alternating star contraction over written tables: links of a node go to the smallest node around it, first from its
    larger neighbours, then from its smaller ones, until nothing changes. Both steps are joins with minima per node that are
    combined before the shuffle, so a node with any number of links is never gathered.
    """
    spark = edges.sparkSession
    now = scratch_path(spark, "star")
    edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().write.parquet(now)
    schema, state = spark.read.parquet(now).schema, None
    while True:
        links = spark.read.schema(schema).parquet(now)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.filter("a <> b").distinct())
        small = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = large.join(small, F.col("a") == F.col("u"))
        after = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b")))
        path = scratch_path(spark, "star")
        after.filter("a <> b").distinct().write.parquet(path)
        drop_scratch(spark, now)
        now = path
        found = spark.read.schema(schema).parquet(now)
        mark = found.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(mark) == state:
            break
        state = tuple(mark)
    stars = spark.read.schema(schema).parquet(now)
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _squares(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _gap(a: Column, b: Column, side: float, more: int) -> Column:
    """Squared distance that points of two grid cells have at least (`more` = -1) or at most (1)."""
    step = F.zip_with(a, b, lambda x, y: F.greatest(F.abs(x - y) + more, F.lit(0)).cast("double") * side)
    return F.aggregate(step, F.lit(0.0), lambda s, x: s + x * x)


def _cells(point: Column, side: float) -> Column:
    return F.transform(point, lambda x: F.floor(x / side))


def neighbour_cells(cells: DataFrame, eps: float, side: float, dims: int) -> DataFrame:
    """Pairs of different occupied cells (cell, other) that may hold points within `eps` of each other.

    Cells meet by an equi-join on up to three of their coordinates; the others are checked on the pair."""
    keyed, reach = min(dims, KEYED), ceil(eps / side)
    offsets = F.array(*[F.array(*[F.lit(x).cast("long") for x in step]) for step in product(range(-reach, reach + 1), repeat=keyed)])
    left = cells.select("cell", F.explode(offsets).alias("_o")).select(
        "cell", F.zip_with(F.slice("cell", 1, keyed), "_o", lambda x, o: x + o).alias("_key"))
    right = cells.select(F.col("cell").alias("other"), F.slice("cell", 1, keyed).alias("_at"))
    near = _gap(F.col("cell"), F.col("other"), side, -1) <= eps * eps
    return left.join(right, F.col("_key") == F.col("_at")).filter(near & (F.col("cell") != F.col("other"))).select("cell", "other")


def density_clusters(df: DataFrame, id_col: str, features: list[str], eps: float, min_points: int) -> DataFrame:
    """`df` with is_core and cluster_id: the smallest id among the core points of the point's cluster, NULL for noise.

    A point is a core point if at least `min_points` points, itself included, lie within `eps`. Core points within `eps` of
    each other share a cluster; other points within `eps` of core points belong to the cluster with the smallest id.

    Cells have a diagonal of `eps`, so a cell with `min_points` points has core points only, which are one cluster, without
    any distance. Distances are worked out for the points of thinner cells. Whether two cells are linked is decided on their
    occupied parts, 4 per dimension, and on points only where two parts neither surely are nor surely are not within `eps`.
    Clusters are the connected components of the cells. Equal points are one point with a weight.

    Rows with a NULL or NaN feature are noise. An empty table gives an empty result.
    """
    side, dims = eps / len(features) ** 0.5 * (1 - 1e-12), len(features)
    values = F.array(*[F.col(c).cast("double") for c in features])
    sound = ~F.exists(values, lambda x: x.isNull() | F.isnan(x))
    rows = df.withColumn("_p", F.when(sound, F.transform(values, lambda x: x + F.lit(0.0))))
    points = cut_lineage(
        rows.filter("_p IS NOT NULL").groupBy("_p").agg(F.count("*").alias("n"), F.min(id_col).alias("id"))
        .select("id", "n", F.col("_p").alias("p"), _cells(F.col("_p"), side).alias("cell")))
    weight = cut_lineage(points.groupBy("cell").agg(F.sum("n").alias("w")))
    pairs = cut_lineage(neighbour_cells(weight, eps, side, dims))
    weighed = points.join(weight, "cell")
    thin = weighed.filter(F.col("w") < min_points)

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        """Points of `left` with those of neighbouring cells within eps."""
        other = right.select(F.col("cell").alias("other"), *(F.col(c).alias(f"o_{c}") for c in right.columns if c != "cell"))
        return left.join(pairs, "cell").join(other, "other").filter(_squares(F.col("p"), F.col("o_p")) <= eps * eps)

    around = near(thin.select("id", "p", "cell"), points).groupBy("id").agg(F.sum("o_n").alias("more"))
    judged = cut_lineage(
        weighed.join(around, "id", "left")
        .withColumn("is_core", F.col("w") + F.coalesce("more", F.lit(0)) >= min_points)
        .select("id", "n", "p", "cell", "is_core"))
    cores = judged.filter("is_core")
    heads = cut_lineage(cores.groupBy("cell").agg(F.min("id").alias("head")))
    other = heads.select(F.col("cell").alias("other"), F.col("head").alias("o_head"))
    maybe = cut_lineage(pairs.filter("cell < other").join(heads, "cell").join(other, "other"))
    part = side / PARTS
    parts = cut_lineage(cores.select("cell", _cells(F.col("p"), part).alias("part")).distinct())
    met = (
        maybe.join(parts, "cell").join(parts.select(F.col("cell").alias("other"), F.col("part").alias("o_part")), "other")
        .withColumn("_sure", _gap(F.col("part"), F.col("o_part"), part, 1) <= eps * eps * (1 - 1e-9))
        .filter(_gap(F.col("part"), F.col("o_part"), part, -1) <= eps * eps * (1 + 1e-9))
    )
    met = cut_lineage(met)
    sure = cut_lineage(met.groupBy("head", "o_head").agg(F.max("_sure").alias("_linked")))
    doubt = met.join(sure.filter("NOT _linked"), ["head", "o_head"]).select("head", "o_head", "cell", "part", "other", "o_part")
    placed = cores.select("cell", _cells(F.col("p"), part).alias("part"), "p")
    exact = doubt.join(placed, ["cell", "part"]).join(
        placed.select(F.col("cell").alias("other"), F.col("part").alias("o_part"), F.col("p").alias("o_p")), ["other", "o_part"])
    exact = exact.filter(_squares(F.col("p"), F.col("o_p")) <= eps * eps).select("head", "o_head").distinct()
    edges = sure.filter("_linked").select("head", "o_head").unionByName(exact)
    label = components(edges.select(F.col("head").alias("a"), F.col("o_head").alias("b")))
    clusters = cut_lineage(heads.join(label, F.col("head") == F.col("node"), "left").select("cell", F.coalesce("component", "head").alias("cluster_id")))
    held = cores.join(clusters, "cell").select("id", "p", "cell", "cluster_id")
    edge = judged.filter("NOT is_core").select("id", "p", "cell")
    border = near(edge, held).select("id", F.col("o_cluster_id").alias("cluster_id")).unionByName(
        edge.join(clusters, "cell").select("id", "cluster_id")).groupBy("id").agg(F.min("cluster_id").alias("cluster_id"))
    settled = held.select(F.col("p").alias("_q"), F.lit(True).alias("is_core"), "cluster_id").unionByName(
        edge.join(border, "id", "left").select(F.col("p").alias("_q"), F.lit(False).alias("is_core"), "cluster_id"))
    return rows.join(cut_lineage(settled), F.col("_p") == F.col("_q"), "left").select(
        *df.columns, F.coalesce("is_core", F.lit(False)).alias("is_core"), "cluster_id")


# --- nearest vectors -----------------------------------------------------------------------------------


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def hyperplane_codes(vectors: DataFrame, centre: np.ndarray, trees: range) -> DataFrame:
    """Per vector and tree, on which side of 48 random hyperplanes through the centre it lies: (vid, tree, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("vec")) - centre
            for tree in trees:
                planes = np.random.default_rng((SEED, tree)).standard_normal((rows.shape[1], BITS))
                code = (rows @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vid"), pa.array(np.full(len(rows), tree, np.int32)), pa.array(code.astype(np.int64))], ["vid", "tree", "code"])

    return vectors.select("vid", "vec").mapInArrow(run, "vid long, tree int, code long")


def buckets(codes: DataFrame, leaf: int) -> DataFrame:
    """Buckets (vid, tree, bits, bucket) of at most about `leaf` rows: codes cut after as many bits as that takes.

    Codes alone are counted, level by level, and only in buckets still full. What 48 bits do not tell apart is dealt out by hash.
    """
    open_, done = codes, []
    for bits in range(BITS + 1):
        key = F.shiftright("code", BITS - bits)
        sizes = open_.groupBy("tree", key.alias("bucket")).agg(F.count("*").alias("_n"))
        marked = cut_lineage(open_.withColumn("bucket", key).join(sizes, ["tree", "bucket"]))
        deal = F.pmod(F.xxhash64("vid"), F.ceil(F.col("_n") / leaf)) if bits == BITS else F.lit(0).cast("long")
        fits = (F.col("_n") <= leaf) | F.lit(bits == BITS)
        done.append(marked.filter(fits).select("vid", "tree", F.lit(bits).alias("bits"), "bucket", deal.alias("part")))
        open_ = marked.filter(~fits).select("vid", "tree", "code")
        if open_.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    flat = (left * left).sum(1)[:, None] + (right * right).sum(1)[None, :] - 2 * (left @ right.T)
    return np.maximum(flat, 0)


def _closest(square: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the k smallest of each row, and their distances from the differences themselves."""
    k = min(k, square.shape[1])
    pick = np.argpartition(square, k - 1, axis=1)[:, :k]
    return pick, np.sqrt(((left[:, None, :] - right[pick]) ** 2).sum(-1))


def _within_buckets(vectors: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """The k nearest of each vector among those of its buckets: (vid, other, distance)."""

    def run(table: pa.Table) -> pa.Table:
        vid, rows = table.column("vid").to_numpy(), _matrix(table.column("vec"))
        out = []
        for at in range(0, len(vid), 512):
            part = rows[at: at + 512]
            square = distances(part, rows)
            square[np.arange(len(part)), at + np.arange(len(part))] = np.inf
            pick, far = _closest(square, part, rows, min(k, max(len(vid) - 1, 1)))
            out.append((np.repeat(vid[at: at + 512], pick.shape[1]), vid[pick.ravel()], far.ravel()))
        a, b, d = (np.concatenate(x) for x in zip(*out, strict=True))
        other = a != b
        return pa.table([pa.array(a[other]), pa.array(b[other]), pa.array(d[other])], ["vid", "other", "distance"])

    joined = placed.join(vectors.select(F.col("vid").alias("_v"), "vec"), F.col("vid") == F.col("_v"))
    return joined.select("vid", "vec", "tree", "bits", "bucket", "part").groupBy("tree", "bits", "bucket", "part").applyInArrow(
        run, "vid long, other long, distance double")


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each vector, as rows; lists per vector stay short because each bucket gives k at most."""
    best = F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct("distance", "other")))), 1, k)
    return pairs.groupBy("vid").agg(best.alias("_l")).select("vid", F.explode("_l").alias("_n")).select("vid", "_n.other", "_n.distance")


def _true_reach(vectors: DataFrame, probes: list, k: int) -> dict[int, float]:
    """The exact distance of the k-th nearest vector of some probes, found by one scan."""
    ids, rows = np.array([p.vid for p in probes]), np.array([p.vec for p in probes], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vid, held = batch.column("vid").to_numpy(), _matrix(batch.column("vec"))
                square = distances(rows, held)
                square[ids[:, None] == vid[None, :]] = np.inf
                pick, far = _closest(square, rows, held, k)
                own = vid[pick] != ids[:, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, pick.shape[1])[own.ravel()]), pa.array(vid[pick][own]), pa.array(far[own])], ["vid", "other", "distance"])

    found = _nearest(vectors.select("vid", "vec").mapInArrow(run, "vid long, other long, distance double"), k)
    return {r.vid: r.far for r in found.groupBy("vid").agg(F.max("distance").alias("far")).collect()}


def nearest_vectors(
    df: DataFrame, id_col: str, vector: str, k: int, leaf: int = 1024, recall: float = 0.97, trees: int = 4, most_trees: int = 64, probes: int = 100,
) -> tuple[DataFrame, float]:
    """The k nearest other vectors of each different vector (vid, other, distance), and the share found of the true ones.

    Trees are added four at a time until the neighbours of `probes` vectors, taken by hash and compared with all rows in one
    scan, are found to the share `recall`, or `most_trees` have been used; the share reached is returned either way. Tables
    that fit into one leaf are compared exactly by the first tree. Equal vectors are one (`vid`: the smallest id); rows
    without a vector, or with NULL or NaN in it, are left out.
    """
    vec = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.col(vector).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x))
    vectors = cut_lineage(df.filter(sound).groupBy(vec.alias("vec")).agg(F.min(id_col).cast("long").alias("vid"), F.count("*").alias("n")))
    means = vectors.select(F.posexplode("vec")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()  # one row per dimension
    if not means:
        return df.sparkSession.createDataFrame([], "vid long, other long, distance double"), 1.0
    centre = np.array([r.m for r in means])
    wanted = min(k, vectors.count() - 1)
    asked = vectors.select("vid", "vec").orderBy(F.xxhash64("vid"), "vid").limit(probes).collect()
    truth = _true_reach(vectors, asked, k)
    found, used, share = None, 0, 0.0
    while True:
        placed = buckets(hyperplane_codes(vectors, centre, range(used, used + trees)), leaf)
        pairs = _within_buckets(vectors, cut_lineage(placed), k)
        found = cut_lineage(_nearest(pairs if found is None else found.unionByName(pairs), k))
        used += trees
        hits = found.filter(F.col("vid").isin([int(v) for v in truth])).collect()  # k rows per probe
        share = sum(h.distance <= truth[h.vid] * (1 + 1e-12) for h in hits) / (wanted * len(truth)) if truth else 1.0
        if share >= recall or used >= most_trees:
            return found, share


def local_outliers(neighbours: DataFrame, k: int) -> DataFrame:
    """Per vector: k_distance, the mean reachability distance to its neighbours, and the ratio of its neighbours' density to
    its own (`outlier_factor`, 1 where all are alike). A neighbour's own k_distance is the least it can be reached from."""
    reach = neighbours.groupBy("vid").agg(F.max("distance").alias("k_distance"))
    other = reach.select(F.col("vid").alias("other"), F.col("k_distance").alias("_far"))
    seen = neighbours.join(other, "other").withColumn("_reach", F.greatest("distance", "_far"))
    mean = cut_lineage(seen.groupBy("vid").agg(F.avg("_reach").alias("reachability")))
    theirs = mean.select(F.col("vid").alias("other"), (1 / F.col("reachability")).alias("_density"))
    factor = neighbours.join(theirs, "other").groupBy("vid").agg(F.avg("_density").alias("_around"))
    return reach.join(mean, "vid").join(factor, "vid").select(
        "vid", "k_distance", "reachability", (F.col("_around") * F.col("reachability")).alias("outlier_factor"))
