"""Scaling, outlier and classifier jobs on MLlib and column expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (
    IDF,
    PCA,
    CountVectorizerModel,
    NGram,
    UnivariateFeatureSelector,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.functions.levels import array_sum
from sessionlens.operators.sequence import attach, framed, quantiles, settled
from sessionlens.operators.validation import margin_rows, refitted, sigmoid_fits, with_probabilities
from sessionlens.session import cut_lineage, setting

SEED = 42

# Rows whose random features are held at once.
WAVE_ROWS = 1024

# Shuffle partitions of term counts for each partition of texts: pairs of words make counts larger than their texts.
SHUFFLE_KEY, TERM_PARTS = "spark.sql.shuffle.partitions", 4


def finite(x: Column) -> Column:
    """NaN and NULL become 0; infinite values are cut at a million."""
    clean = F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(-1e6), F.least(F.lit(1e6), clean))


def standardise(df: DataFrame, id_column: str, values: str) -> DataFrame:
    """Scale each position of an array column to mean 0 and population deviation 1 (constant positions to 0).

    The statistics are one row of two vectors, computed by tree aggregation.
    """
    cleaned = df.withColumn("_v", array_to_vector(F.transform(F.col(values).cast("array<double>"), finite)))
    stats = cleaned.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).select(
        vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"), F.col("s.count").alias("n")
    )
    population = stats.select(
        "m", F.transform("v", lambda v: F.sqrt(v * (F.col("n") - 1) / F.col("n"))).alias("sd")
    )
    mean, std = population.select("m").scalar(), population.select("sd").scalar()
    held = cleaned.withColumns({"_m": mean, "_sd": std})
    centred = F.zip_with(vector_to_array("_v"), "_m", lambda x, m: x - m)
    scaled = F.zip_with(centred, "_sd", lambda x, s: F.when(s > 0, x / s).otherwise(0.0))
    return held.withColumn("scaled", scaled).drop("_v", "_m", "_sd")


def principal(df: DataFrame, values: str = "scaled", keep: float = 0.95):
    """Principal components that explain `keep` of the variance: the frame with `components`, and their number."""
    vectors = df.withColumn("_x", array_to_vector(values))
    size = len(vectors.select("_x").first()[0])
    model = PCA(k=size, inputCol="_x", outputCol="_y").fit(vectors)
    k = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), keep) + 1)
    k = min(k, size)
    projected = model.transform(vectors).withColumn("components", F.slice(vector_to_array("_y"), 1, k))
    return projected.drop("_x", "_y"), k


def reconstruction_error(df: DataFrame, values: str = "scaled", components: str = "components") -> Column:
    """Mean squared error after projecting and projecting back.

    The components are orthonormal, so the part lost is the difference of the squared lengths.
    """
    squared = lambda c: array_sum(F.transform(c, lambda x: x * x))
    return F.greatest(F.lit(0.0), squared(F.col(values)) - squared(F.col(components))) / F.size(values)


def robust_and_minmax(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(x - median) / interquartile range, and min-max scaling, per group and fitted on the whole group."""
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    fitted = quantiles(df, keys, value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}).join(span, list(keys))
    x, iqr, width = F.col(value), F.col("_q3") - F.col("_q1"), F.col("_hi") - F.col("_lo")
    return attach(df, fitted, keys).withColumns(
        {
            "robust": F.when(iqr > 0, (x - F.col("_q2")) / iqr).otherwise(x - F.col("_q2")),
            "minmax": F.when(width > 0, (x - F.col("_lo")) / width).otherwise(0.0),
        }
    ).drop("_lo", "_hi", "_q1", "_q2", "_q3")


def kernel_distance(df: DataFrame, values: str, features: int = 512, gamma: float | None = None, seed: int = SEED) -> DataFrame:
    """1 - similarity to the table's mean in the feature space of an RBF kernel (random Fourier features).

    Features stay in Python, a few rows at a time: a task gives their sums, then a number per row; the mean is `features` numbers.
    """
    size = df.select(F.size(values)).first()[0]
    gamma = 1.0 / size if gamma is None else gamma
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, np.sqrt(2.0 * gamma), (size, features))
    shift = rng.uniform(0.0, 2.0 * np.pi, features)

    def waves(batch: pd.Series) -> Iterator[np.ndarray]:
        for at in range(0, len(batch), WAVE_ROWS):
            points = np.stack(batch.iloc[at : at + WAVE_ROWS].to_numpy()).astype(float)
            yield np.sqrt(2.0 / features) * np.cos(points @ weights + shift)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(features), 0
        for batch in batches:
            total += sum(z.sum(axis=0) for z in waves(batch["_v"]))
            n += len(batch)
        yield pd.DataFrame({"total": [total], "n": [n]})

    parts = df.select(F.col(values).alias("_v")).mapInPandas(sums, "total array<double>, n long")
    whole = parts.agg(vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"), F.sum("n").alias("n")).first()
    mean = np.array(whole.total) / max(whole.n, 1)

    @F.pandas_udf("double")
    def distance(batch: pd.Series) -> pd.Series:
        return pd.Series([x for z in waves(batch) for x in 1.0 - z @ mean], dtype=float)

    return df.withColumn("distance", distance(F.col(values)))


def neighbour_distance(df: DataFrame, keys: Sequence[str], value: str, tie: str, k: int = 5) -> DataFrame:
    """Exact distance to the k-th nearest value of the group, and its ratio to the group's mean.

    In sorted order the k nearest lie among the k before and the k after, so 2k neighbours per row suffice.
    """
    rows, w = framed(df, keys, back=k, ahead=k, order=[value, tie], by=F.col(value))
    reach = []
    for below in range(k + 1):
        left = F.col(value) - F.lag(value, below).over(w)
        right = F.lead(value, k - below).over(w) - F.col(value)
        far = left if below == k else right if below == 0 else F.when(left.isNotNull() & right.isNotNull(), F.greatest(left, right))
        reach.append(far)
    distances = settled(rows.withColumn("k_distance", F.least(*reach)))
    mean = distances.groupBy(*keys).agg(F.avg("k_distance").alias("_mean"))
    return attach(distances, mean, keys).withColumn(
        "outlier_score", F.coalesce(F.try_divide("k_distance", "_mean"), F.lit(0.0))
    ).drop("_mean")


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep").transform(df)


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Weights that give both classes the same total."""
    total = df.agg(F.count(F.lit(1))).scalar()
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(F.broadcast(sizes), label).withColumn("weight", total / (2.0 * F.col("_n"))).drop("_n")


def probability_of_one(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


def supervised(df: DataFrame, trees: int = 100, train: DataFrame | None = None) -> DataFrame:
    """Random forest on balanced weights; `p` is the probability of an anomaly. Give `train` to score other rows than it learns."""
    rows = balanced(df if train is None else train)
    model = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, seed=SEED).fit(rows)
    return model.transform(df).withColumn("p", probability_of_one())


def drawn(key: Column) -> Column:
    """A standard normal number that depends on the key alone, so a task that runs again draws the same one."""
    unit = [(F.pmod(F.xxhash64(key, F.lit(i)), F.lit(2**40)) + 0.5) / 2**40 for i in (0, 1)]
    return F.sqrt(-2 * F.ln(unit[0])) * F.cos(2 * np.pi * unit[1])


def with_noise_positives(
    df: DataFrame, columns: Sequence[str], least: int = 5, most: int = 10, part: int = 10, deviation: float = 0.5, seed: int = SEED
) -> DataFrame:
    """Where positives are rarer than `least`, add noisy copies of rows as positives.

    The copies are `most` rows, or one in `part` of all rows if that is fewer; the noise has the given deviation.
    """
    if df.filter("label = 1").limit(least).count() >= least:
        return df
    noisy = df.orderBy(F.xxhash64(*columns)).limit(max(1, min(most, df.count() // part)))
    return df.unionByName(
        noisy.withColumns({c: F.col(c) + deviation * drawn(F.xxhash64(*columns, F.lit(seed + i))) for i, c in enumerate(columns)} | {"label": F.lit(1)})
    )


def privilege_model(df: DataFrame, trees: int = 100):
    """A forest on weights that balance the classes."""
    return RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, seed=SEED).fit(balanced(df))


def transfer_model(df: DataFrame, rounds: int = 10):
    """A boosted classifier on weights that balance the classes."""
    return GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=3, seed=SEED).fit(balanced(df))


def stratified_split(df: DataFrame, label: str, id_column: str | Column, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """A split by hash of (label, id): stable over reruns, and even within each label."""
    draw = F.pmod(F.xxhash64(label, id_column), F.lit(1000))
    return df.filter(draw < int(share * 1000)), df.filter(draw >= int(share * 1000))


def identity_models(train: DataFrame, inputs: int, classes: int, trees: int = 30) -> dict[str, object]:
    """Classifiers of who is typing that give probabilities: a forest and a small network."""
    return {
        "forest": RandomForestClassifier(labelCol="label", numTrees=trees, seed=SEED).fit(train),
        "network": MultilayerPerceptronClassifier(labelCol="label", layers=[inputs, 100, 50, classes], maxIter=40, seed=SEED).fit(train),
    }


def identity_scores(train: DataFrame, held_out: DataFrame, inputs: int, classes: int, folds: int = 2) -> dict[str, DataFrame]:
    """Held-out rows scored by the classifiers of who is typing, each with `prediction` and `probabilities` that sum to 1.

    Linear SVMs, one per person, are fitted once for each fold on the rows of the other folds. A sigmoid per person turns
    margins into probabilities; it is fitted to margins of rows that the SVM has not learned. Held-out rows get the mean of
    the folds' probabilities, so no further fit is needed."""
    svm = OneVsRest(classifier=LinearSVC(maxIter=10), labelCol="label", parallelism=classes)
    models = []

    def fit(rows: DataFrame):
        models.append(svm.fit(rows))
        return models[-1]

    unseen = refitted(train, fit, F.pmod(F.xxhash64("features"), F.lit(folds)), folds, parallelism=folds)
    fits = sigmoid_fits(cut_lineage(margin_rows(unseen, "label")), "person", "margin", "hit")
    fits = {k: fits.get(k, (1.0, 0.0)) for k in range(classes)}
    mean = None
    scored = held_out
    for model in models:
        scored = with_probabilities(model.transform(scored), fits).drop("rawPrediction", "prediction")
        own = F.col("probabilities") if mean is None else F.zip_with("_mean", "probabilities", lambda x, y: x + y)
        scored, mean = scored.withColumn("_mean", own).drop("probabilities"), True
    scored = scored.withColumn("probabilities", F.transform("_mean", lambda x: x / folds)).drop("_mean")
    best = F.array_position("probabilities", F.array_max("probabilities")) - 1
    out = {"svm": scored.withColumn("prediction", best.cast("double"))}
    for name, model in identity_models(train, inputs, classes).items():
        out[name] = model.transform(held_out).withColumn("probabilities", vector_to_array("probability"))
    return out


def risk_models(train: DataFrame, trees: int = 30) -> dict[str, object]:
    return {
        "forest": RandomForestRegressor(labelCol="label", numTrees=trees, maxDepth=10, seed=SEED).fit(train),
        "boosted": GBTRegressor(labelCol="label", maxIter=10, seed=SEED).fit(train),
        "ridge": LinearRegression(labelCol="label", regParam=1.0, elasticNetParam=0.0).fit(train),
    }


def mean_prediction(df: DataFrame, models: dict[str, object]) -> DataFrame:
    """The mean of the predictions, each cut to 0..1."""
    out = df
    for name, model in models.items():
        out = model.setPredictionCol(f"_p_{name}").transform(out)
    parts = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"_p_{n}"))) for n in models]
    return out.withColumn("prediction", sum(parts[1:], parts[0]) / len(parts))


def soft_vote(df: DataFrame, models: Sequence[object]) -> DataFrame:
    """The mean class probability of several classifiers."""
    out = df
    for i, model in enumerate(models):
        named = model.setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_c{i}")
        out = named.transform(out).drop(f"_r{i}", f"_c{i}")
    parts = [vector_to_array(f"_p{i}")[1] for i in range(len(models))]
    return out.withColumn("p", sum(parts[1:], parts[0]) / len(parts)).drop(*[f"_p{i}" for i in range(len(models))])


def grid_search(df: DataFrame, folds: int = 3, parallelism: int = 4):
    """Cross-validated grids for three kinds of classifier: (kind, parameters, score) rows."""
    kinds = {
        "forest": (RandomForestClassifier(labelCol="label", seed=SEED), "numTrees", [10, 20]),
        "svm": (LinearSVC(labelCol="label", maxIter=10), "regParam", [0.01, 0.1]),
        "boosted": (GBTClassifier(labelCol="label", maxIter=5, seed=SEED), "maxDepth", [2, 3]),
    }
    rows = []
    for kind, (estimator, name, choices) in kinds.items():
        grid = ParamGridBuilder().addGrid(getattr(estimator, name), choices).build()
        search = CrossValidator(
            estimator=estimator, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="label"),
            numFolds=folds, parallelism=parallelism, seed=SEED,
        ).fit(df)
        rows += [(kind, f"{name}={choice}", float(s)) for choice, s in zip(choices, search.avgMetrics)]
    return rows


def calibrate(df: DataFrame, score: str, label: str = "label", train: DataFrame | None = None) -> DataFrame:
    """Isotonic and sigmoid calibration of a score, fitted on `train` (default: the rows themselves)."""
    learned = df if train is None else train
    isotonic = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="isotonic").fit(learned)
    vectors = assembled(df, [score])
    logistic = LogisticRegression(labelCol=label, featuresCol="features").fit(assembled(learned, [score]))
    out = logistic.transform(isotonic.transform(vectors))
    return out.withColumn("sigmoid", probability_of_one()).drop("features", "rawPrediction", "probability", "prediction")


def select_features(df: DataFrame, count: int) -> DataFrame:
    """Keep the features that separate the labels best (analysis of variance)."""
    selector = UnivariateFeatureSelector(
        featuresCol="features", labelCol="label", outputCol="selected", selectionMode="numTopFeatures"
    ).setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(count)
    return selector.fit(df).transform(df)


def frequent_terms(df: DataFrame, terms: str, size: int) -> list[str]:
    """The terms that occur most often, ties by the term.

    The counts are spread over partitions in proportion to those of the table, so what a task reads does not grow with it.
    """
    spark = df.sparkSession
    counts = df.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    usual = setting(spark, SHUFFLE_KEY, 200)
    spark.conf.set(SHUFFLE_KEY, str(max(usual, TERM_PARTS * df.rdd.getNumPartitions())))
    try:
        return [r.term for r in counts.orderBy(F.desc("n"), "term").limit(size).collect()]
    finally:
        spark.conf.set(SHUFFLE_KEY, str(usual))


def term_weights(df: DataFrame, words: str, size: int = 100) -> DataFrame:
    """TF-IDF over words and pairs of words, for the `size` most frequent terms."""
    paired = NGram(n=2, inputCol=words, outputCol="_pairs").transform(df)
    terms = paired.withColumn("_terms", F.concat(words, "_pairs"))
    vocabulary = frequent_terms(terms, "_terms", size)
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_terms", outputCol="_counts").transform(terms)
    return IDF(inputCol="_counts", outputCol="tfidf").fit(counted).transform(counted).drop("_pairs", "_terms", "_counts")


def private_counts(
    df: DataFrame, user: str, category: str, epsilon: float = 1.0, per_user: int = 5, seed: int | None = None
) -> DataFrame:
    """Counts per category with Laplace noise, differentially private for users: a user adds at most `per_user` to all counts
    together, so noise of scale per_user / epsilon costs epsilon in all.

    A user's share is taken from their categories in the order of a hash. Without a seed the noise cannot be repeated,
    and so not be removed; give one in tests only.
    """
    own = df.groupBy(user, category).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(user).orderBy(F.xxhash64(user, category)).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), per_user - F.coalesce(F.sum("_n").over(order), F.lit(0)))
    clipped = own.withColumn("_n", F.least("_n", left))
    totals = clipped.groupBy(category).agg(F.sum("_n").alias("_t"))
    u = (F.rand() if seed is None else F.rand(seed)) - 0.5
    noise = -F.lit(per_user / epsilon) * F.signum(F.col("_u")) * F.ln(1 - 2 * F.abs("_u"))
    return totals.withColumn("_u", u).withColumn("noisy_count", F.col("_t") + noise).drop("_t", "_u")
