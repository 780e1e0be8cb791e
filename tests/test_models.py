"""Model jobs: planted outliers are found, and explanations add up."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from sessionlens.operators import explain, forest, joins
from sessionlens.operators import learning as L
from sessionlens.plans.models import DOC_FEATURES, cross_fitted, document_rows, labelled, quality_forest, scorer
from sessionlens.plans.models import calibrate, soft_vote, supervised_anomaly


@pytest.fixture(scope="module")
def planted(spark):
    """A cloud of 400 points with 8 far ones (ids from 400)."""
    rng = np.random.default_rng(1)
    cloud = np.vstack([rng.normal(0, 1, (400, 6)), rng.normal(0, 1, (8, 6)) + 9])
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(cloud)]
    return spark.createDataFrame(rows, "id LONG, v ARRAY<DOUBLE>").cache()


def top_ids(df, column, n=8):
    return {r.id for r in df.orderBy(F.desc(column)).limit(n).collect()}


FAR = set(range(400, 408))


def test_isolation_forest_finds_planted_points(planted):
    nodes = forest.fit(planted, "id", "v", trees=50, sample_size=128)
    assert nodes.groupBy("tree").count().count() == 50
    scored = forest.score(planted, "v", nodes, 128)
    assert top_ids(scored, "anomaly_score") == FAR
    limit = forest.cutoff(scored, "anomaly_score", 0.02)
    assert {r.id for r in scored.filter(F.col("anomaly_score") > limit).collect()} <= FAR


def test_sample_does_not_grow_with_the_table(spark):
    big = spark.range(200_000).withColumn("v", F.array(F.col("id").cast("double")))
    sample = forest.sample_for_trees(big, "id", 10, 64, 42)
    assert 300 < sample.count() < 1000


def test_kernel_distance_finds_planted_points(planted):
    # Points that are far together are near each other, so they only have to be among the highest tenth.
    assert FAR <= top_ids(L.kernel_distance(planted, "v"), "distance", 40)


def test_reconstruction_error_finds_points_off_the_plane(spark):
    rng = np.random.default_rng(2)
    flat = rng.normal(0, 1, (300, 2)) @ rng.normal(0, 1, (2, 6))
    flat[:5] += rng.normal(0, 2, (5, 6))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(flat)], "id LONG, v ARRAY<DOUBLE>")
    projected, _ = L.principal(L.standardise(df, "id", "v"), keep=0.9)
    scored = projected.withColumn("e", L.reconstruction_error(projected))
    assert len(top_ids(scored, "e", 5) & set(range(5))) >= 4


def test_neighbour_distance_is_exact(spark, sliced):
    rng = np.random.default_rng(4)
    values = np.round(rng.exponential(20, 150), 2)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(values)], "g LONG, id LONG, x DOUBLE")
    got = {r.id: r.k_distance for r in L.neighbour_distance(df, ["g"], "x", "id", k=3).collect()}
    for i, x in enumerate(values):
        want = np.sort(np.abs(np.delete(values, i) - x))[2]
        assert abs(got[i] - want) < 1e-9


def test_density_points_match_brute_force(spark):
    rng = np.random.default_rng(5)
    points = np.round(np.vstack([rng.normal(0, 0.4, (150, 2)), rng.uniform(-4, 4, (40, 2))]), 3)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in points], "x DOUBLE, y DOUBLE").groupBy("x", "y").agg(
        F.count(F.lit(1)).alias("n")
    )
    got = {(r.x, r.y): (r.is_core, r.is_noise) for r in joins.density_points(df, 0.5, 5).collect()}
    near = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2) <= 0.25
    core = near.sum(axis=1) >= 5
    for i, p in enumerate(points):
        assert got[tuple(p)] == (bool(core[i]), bool(not core[i] and not (near[i] & core).any()))


def test_each_run_permutes_one_feature(spark):
    df = spark.range(500).select("id", (F.col("id") * 10).alias("v"), (F.col("id") * 3).alias("w"))
    out = explain.permuted(df, "id", ["v", "w"], 2, 7, block=100).collect()
    assert len(out) == 2000
    for feature in ("v", "w"):
        for repeat in (0, 1):
            run = [r for r in out if (r.feature, r.repeat) == (feature, repeat)]
            assert sorted(r.v for r in run) == [10 * i for i in range(500)] and sorted(r.w for r in run) == [3 * i for i in range(500)]
            assert sum(r.v == 10 * r.id for r in run) == (0 if feature == "v" else 500)
            assert sum(r.w == 3 * r.id for r in run) == (0 if feature == "w" else 500)


def test_only_the_used_feature_is_important(spark):
    df = spark.range(400).select("id", F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("label", F.col("a"))
    score = lambda rows: rows.withColumn("p", F.col("a"))
    fit = -F.avg((F.col("p") - F.col("label")) * (F.col("p") - F.col("label")))
    got = {r.feature: r.importance for r in explain.permutation_importance(df, "id", ["a", "b"], score, fit, 3).collect()}
    assert abs(got["b"]) < 1e-12 and got["a"] > 0.05


def test_shapley_values_add_up_to_the_difference(spark):
    rows = document_rows(spark, SMALL).cache()
    model = quality_forest(rows)
    few = rows.orderBy("doc_id").limit(5)
    background = rows.orderBy(F.desc("doc_id")).limit(1)
    values = explain.shapley(few, background, "doc_id", DOC_FEATURES, scorer(model), permutations=4)
    total = {r.doc_id: r.s for r in values.groupBy("doc_id").agg(F.sum("value").alias("s")).collect()}
    p = {r.doc_id: r.p for r in scorer(model)(L.assembled(few.unionByName(background), DOC_FEATURES)).collect()}
    start = p[background.first().doc_id]
    assert all(abs(total[d] - (p[d] - start)) < 1e-9 for d in total)


def test_decision_paths_end_at_the_models_prediction(spark):
    rows = document_rows(spark, SMALL)
    vectors = L.assembled(rows, DOC_FEATURES)
    tree = DecisionTreeClassifier(labelCol="label", maxDepth=4, seed=1).fit(vectors)
    paths = explain.decision_paths(rows, "doc_id", DOC_FEATURES, explain.tree_nodes(tree, spark), 4)
    joined = paths.withColumnRenamed("prediction", "walked").join(tree.transform(vectors).select("doc_id", "prediction"), "doc_id")
    assert joined.filter(F.col("walked") != F.col("prediction")).count() == 0
    assert paths.filter(F.size("path") > 0).count() > 0


def test_local_surrogate_recovers_a_linear_model(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, -1.0)], "id LONG, a DOUBLE, b DOUBLE")

    def linear(rows):
        return rows.withColumn("p", 3 * F.col("a") - 2 * F.col("b") + 1)

    got = {(r.id, r.feature): r.weight for r in explain.local_surrogate(df, "id", ["a", "b"], linear, {"a": 1.0, "b": 0.5}).collect()}
    assert abs(got[1, "a"] - 3) < 1e-3 and abs(got[2, "b"] + 1) < 1e-3  # b moves by half a unit per draw


def test_calibration_is_monotone(spark):
    rows = spark.range(400).select((F.col("id") / 400).alias("p"), (F.rand(3) < F.col("id") / 400).cast("double").alias("label"))
    out = L.calibrate(rows, "p").orderBy("p").collect()
    assert all(a.isotonic <= b.isotonic + 1e-12 and a.sigmoid <= b.sigmoid + 1e-12 for a, b in zip(out, out[1:]))


@pytest.mark.parametrize("query", [supervised_anomaly, soft_vote, calibrate])
def test_every_labelled_document_is_answered(spark, query):
    got = [r.doc_id for r in query(spark, SMALL).collect()]
    assert sorted(got) == sorted(r.doc_id for r in labelled(spark, SMALL).select("doc_id").collect())


def test_each_half_is_scored_by_the_other(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    calls = []

    def score(half, train):
        calls.append(({r.doc_id for r in half.collect()}, {r.doc_id for r in train.collect()}))
        return half

    assert cross_fitted(rows, score).count() == 200
    assert calls[0] == calls[1][::-1] and calls[0][0].isdisjoint(calls[0][1])


def test_private_counts_stay_near_the_clipped_totals(spark):
    rows = spark.range(5000).select((F.col("id") % 100).alias("u"), (F.col("id") % 4).alias("c"))
    out = {r.c: r.noisy_count for r in L.private_counts(rows, "u", "c", epsilon=5.0, per_user=3, seed=1).collect()}
    assert all(abs(n - 75) < 25 for n in out.values())


def test_a_user_adds_a_bounded_total(spark):
    """One user in all of 50 categories: the counts add up to the bound, but for the noise."""
    rows = spark.range(5000).select(F.lit(1).alias("u"), (F.col("id") % 50).alias("c"))
    total = L.private_counts(rows, "u", "c", epsilon=1e6, per_user=7, seed=1).agg(F.sum("noisy_count")).first()[0]
    assert abs(total - 7) < 1e-2
    a, b = (L.private_counts(rows, "u", "c").agg(F.sum("noisy_count")).first()[0] for _ in range(2))
    assert a != b


def test_flat_export_has_no_cap(spark):
    from sessionlens.sources import export

    df = spark.range(3).select("id", F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(1200)), lambda i: F.struct(
        F.concat(F.lit("k"), i.cast("string")).alias("k"), i.cast("string").alias("v")))).alias("metadata"))
    assert len(export.flat_rows(df).columns) == 1201
    assert export.flat_rows(df, ["k7"]).columns == ["id", "metadata_k7"]
    assert export.long_rows(df, "id").count() == 3600


def test_kernel_distance_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(L, "WAVE_ROWS", 7)
    values = np.random.default_rng(5).normal(size=(60, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "id long, v array<double>").repartition(4)
    scored = L.kernel_distance(rows, "v", features=4096)
    got = np.array([r.distance for r in scored.orderBy("id").collect()])
    exact = 1 - np.exp(-((values[:, None] - values[None]) ** 2).sum(-1) / 3).mean(axis=1)
    assert np.abs(got - exact).max() < 0.1
    # Python hands back one number per row, never its features
    assert "array<double>" not in scored.drop("v").schema.simpleString() and "zip_with" not in scored._jdf.queryExecution().toString()


def test_frequent_terms(spark):
    usual = spark.conf.get(L.SHUFFLE_KEY)
    rows = spark.createDataFrame([(["b", "a"],), (["b", "c"],), (["a", "d"],), ([],), (None,)], "t array<string>")
    assert L.frequent_terms(rows, "t", 3) == ["a", "b", "c"]
    assert spark.conf.get(L.SHUFFLE_KEY) == usual
