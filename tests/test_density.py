"""Density clusters and nearest vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from sessionlens.operators import density as D


def brute_clusters(points, eps, min_points):
    """(is_core, cluster) of each point, all pairs compared."""
    xs = np.array([p[1:] for p in points], float)
    near = ((xs[:, None] - xs[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= min_points
    label = {}
    for i in np.argsort([p[0] for p in points]):
        if core[i] and i not in label:
            stack = [i]
            label[i] = points[i][0]
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if j not in label:
                        label[j] = points[i][0]
                        stack.append(j)
    out = {}
    for i, p in enumerate(points):
        around = [label[j] for j in np.flatnonzero(near[i] & core)]
        out[p[0]] = bool(core[i]), label[i] if core[i] else min(around, default=None)
    return out


@pytest.mark.parametrize("dims", [2, 5])
def test_clusters_against_brute_force(spark, dims):
    r = random.Random(dims)
    centres = [[r.uniform(-3, 3) for _ in range(dims)] for _ in range(6)]
    points = [(i, *(c + r.gauss(0, 0.25) for c in r.choice(centres))) for i in range(260)]
    points += [(300 + i, *(r.uniform(-4, 4) for _ in range(dims))) for i in range(60)]
    points += [(400 + i, *points[7][1:]) for i in range(30)]  # a third of the rows may be one point
    names = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame(points, ["id", *names])
    got = {r.id: (r.is_core, r.cluster_id) for r in D.density_clusters(df, "id", names, 0.5, 5).collect()}
    assert got == brute_clusters(points, 0.5, 5)


def test_cells_linked_through_single_points(spark):
    """Two crowded cells whose nearest points are just within eps, and two just beyond it."""
    left = [(i, 0.001 * i, 0.0) for i in range(40)]
    for gap, linked in ((0.4999, True), (0.5001, False)):
        points = left + [(100 + i, 0.039 + gap + 0.001 * i, 0.0) for i in range(40)]
        df = spark.createDataFrame(points, "id long, x double, y double")
        ids = {r.cluster_id for r in D.density_clusters(df, "id", ["x", "y"], 0.5, 5).collect()}
        assert ids == ({0} if linked else {0, 100})


def test_clusters_of_odd_rows(spark):
    rows = [(1, 0.0, None), (2, float("nan"), 1.0), (3, 0.0, -0.0), (4, -0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: r.cluster_id for r in D.density_clusters(df, "id", ["x", "y"], 0.5, 2).collect()}
    assert got == {1: None, 2: None, 3: 3, 4: 3}
    assert D.density_clusters(df.limit(0), "id", ["x", "y"], 0.5, 2).isEmpty()


def test_components_of_a_star_a_path_and_a_ring(spark):
    path = [(i, i + 1) for i in range(1000, 1150)]
    ring = [(2000 + i, 2000 + (i * 7 + 7) % 91) for i in range(91)]
    star = [(5, i) for i in range(3000, 3400)]
    found = D.components(spark.createDataFrame(path + ring + star + [(8, 8)], "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    parent = {}
    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in path + ring + star:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for x in list(parent)}


def test_small_leaves_reach_the_recall(spark):
    """Leaves of 64 over 500 nearly independent vectors: buckets are cut, none larger is compared, and nine tenths are found."""
    table = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    xs = np.array([r.embedding for r in rows], float)
    far = D.distances(xs, xs)
    np.fill_diagonal(far, np.inf)
    want = {r.vec_id: {rows[j].vec_id for j in np.argsort(far[i])[:5]} for i, r in enumerate(rows)}
    found, share = D.nearest_vectors(table, "vec_id", "embedding", 5, leaf=64, recall=0.95)
    got = {}
    for r in found.collect():
        got.setdefault(r.vid, set()).add(r.other)
    recall = sum(len(want[i] & got[i]) for i in want) / (5 * len(want))
    assert recall >= 0.9 and share >= 0.95
    codes = D.hyperplane_codes(table.select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec")), np.zeros(64), range(2))
    sizes = D.buckets(codes, 64).groupBy("tree", "bits", "bucket", "part").count()
    assert sizes.agg(F.max("count"), F.sum("count")).first() == (sizes.agg(F.max("count")).first()[0], 2 * len(rows))
    assert sizes.agg(F.max("count")).first()[0] <= 64


def test_vectors_with_an_outlier_copies_and_gaps(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(0, 1, 4)).tolist()) for i in range(80)] + [(100, [30.0, 0.0, 0.0, 0.0]), (101, None), (102, [1.0, None, 2.0, 3.0])]
    rows += [(200 + i, rows[0][1]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found, share = D.nearest_vectors(df, "id", "v", 4)
    out = {r.vid: r.outlier_factor for r in D.local_outliers(found, 4).collect()}
    assert share == 1.0 and set(out) == {*range(80), 100}
    assert max(out, key=out.get) == 100 and out[100] > 5
    assert D.nearest_vectors(df.limit(0), "id", "v", 4)[0].isEmpty()
