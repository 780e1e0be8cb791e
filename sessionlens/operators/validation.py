"""Validation with refitted fold models, and class probabilities from margins.

Feature tables are written once; every fold model reads the same files, and the folds are fitted side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import hypot
from multiprocessing.pool import ThreadPool

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.session import checked_broadcast, cut_lineage

VARIANCE_FLOOR = 1e-9


def refitted(df: DataFrame, fit: Callable[[DataFrame], object], fold: Column, folds: int, parallelism: int = 4) -> DataFrame:
    """Every row scored by the model that `fit` made of the other folds, with its `fold`. Written, so nothing is fitted twice.

    `fold` numbers the rows from 0 to folds - 1; a model is anything with `transform`.
    """
    rows = cut_lineage(df.withColumn("fold", fold.cast("int")))

    def one(k: int) -> DataFrame:
        return cut_lineage(fit(rows.filter(F.col("fold") != k)).transform(rows.filter(F.col("fold") == k)))

    with ThreadPool(min(parallelism, folds)) as pool:
        parts = pool.map(one, range(folds))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gaussian_refits(df: DataFrame, features: Sequence[str], label: str, fold: Column) -> DataFrame:
    """Every row predicted by a Gaussian naive Bayes model of the other folds: `fold` and `prediction`.

    All refits come from one aggregation: the moments of the other folds are those of all rows less those of the fold. Ties go
    to the smallest class; a class that the other folds lack is never predicted.
    """
    rows = cut_lineage(df.withColumn("fold", fold.cast("int")))
    sums = [a for f in features for a in (F.sum(f).alias(f"_s_{f}"), F.sum(F.col(f) * F.col(f)).alias(f"_q_{f}"))]
    names = ["_n", *(f"_{m}_{f}" for f in features for m in "sq")]
    own = cut_lineage(rows.groupBy("fold", F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"), *sums))
    total = own.groupBy("_class").agg(*[F.sum(c).alias(f"_all{c}") for c in names])
    pairs = own.select("fold").distinct().withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one")
    mine = own.withColumnRenamed("fold", "_f").withColumnRenamed("_class", "_c")
    rest = pairs.join(mine, (F.col("fold") == F.col("_f")) & (F.col("_class") == F.col("_c")), "left").select(
        "fold", "_class", *[(F.col(f"_all{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in names]).filter("_n > 0")
    moments = [F.struct((F.col(f"_s_{f}") / F.col("_n")).alias("mean"),
                        (F.col(f"_q_{f}") / F.col("_n") - F.pow(F.col(f"_s_{f}") / F.col("_n"), 2) + VARIANCE_FLOOR).alias("var")) for f in features]
    model = F.struct("_class", F.ln("_n").alias("prior"), F.array(*moments).alias("m"))
    models = rest.groupBy(F.col("fold").alias("_fold")).agg(F.array_sort(F.collect_list(model)).alias("_models"))  # one entry per class

    def score(m: Column) -> Column:
        parts = [F.ln(m["m"][i]["var"]) + F.pow(F.col(f) - m["m"][i]["mean"], 2) / m["m"][i]["var"] for i, f in enumerate(features)]
        return F.struct((sum(parts[1:], parts[0]) / 2 - m["prior"]).alias("loss"), m["_class"].alias("c"))

    joined = rows.join(checked_broadcast(models), F.col("fold") == F.col("_fold"))
    return joined.withColumn("prediction", F.array_min(F.transform("_models", score))["c"]).drop("_fold", "_models")


def fold_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per fold: n, accuracy, and precision, recall and F1 weighted by class; then their mean and deviation over the folds.

    From the confusion matrix of each fold. A class never predicted has precision 0. Columns: fold (number, `mean`, `std`)."""
    cells = cut_lineage(predictions.groupBy("fold", F.col(label).alias("_l"), F.col(prediction).alias("_p")).agg(F.count(F.lit(1)).alias("_n")))
    claimed = cells.groupBy(F.col("fold").alias("_f"), F.col("_p").alias("_c")).agg(F.sum("_n").alias("_claimed"))
    held = cells.groupBy("fold", "_l").agg(F.sum("_n").alias("_support"), F.sum(F.when(F.col("_l") == F.col("_p"), F.col("_n")).otherwise(0)).alias("_hits"))
    each = held.join(claimed, (F.col("fold") == F.col("_f")) & (F.col("_l") == F.col("_c")), "left")
    precision = F.coalesce(F.try_divide("_hits", "_claimed"), F.lit(0.0))
    recall = F.col("_hits") / F.col("_support")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))

    def weighted(c: Column) -> Column:
        return F.sum(c * F.col("_support")) / F.sum("_support")

    metrics = ["accuracy", "precision", "recall", "f1"]
    folds = each.groupBy("fold").agg(
        F.sum("_support").alias("n"), (F.sum("_hits") / F.sum("_support")).alias("accuracy"),
        weighted(precision).alias("precision"), weighted(recall).alias("recall"), weighted(f1).alias("f1"))
    folds = cut_lineage(folds.withColumn("fold", F.col("fold").cast("string")))
    mean = folds.agg(F.lit("mean").alias("fold"), F.sum("n").alias("n"), *[F.avg(m).alias(m) for m in metrics])
    deviation = folds.agg(F.lit("std").alias("fold"), F.sum("n").alias("n"), *[F.stddev_pop(m).alias(m) for m in metrics])
    return folds.unionByName(mean).unionByName(deviation)


def sigmoid_fits(margins: DataFrame, key: str, margin: str, hit: str, rounds: int = 30) -> dict:
    """Slope and offset per key of the probability 1 / (1 + exp(-(slope * margin + offset))) that a margin means a hit.

    Newton steps; gradient and curvature are sums over the margins, one aggregation of a row per key in each round. Targets
    are drawn in by one pseudo-count each, so separable margins keep a finite slope. Keys without both kinds of rows keep
    the slope 1 and the offset at the logit of their share.
    """
    sizes = margins.groupBy(key).agg(F.count_if(F.col(hit)).alias("p"), F.count_if(~F.col(hit)).alias("n")).collect()
    high = {r[key]: (r.p + 1) / (r.p + 2) for r in sizes}
    low = {r[key]: 1 / (r.n + 2) for r in sizes}
    fits = {r[key]: (1.0, 0.0) for r in sizes}
    active = {r[key] for r in sizes}
    if not active:
        return {}

    def of(table: dict) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for k in sorted(fits) for x in (k, float(table[k]))]), F.col(key))

    target = F.when(F.col(hit), of(high)).otherwise(of(low))
    m = F.col(margin)
    for _ in range(rounds):
        z = of({k: a for k, (a, _) in fits.items()}) * m + of({k: b for k, (_, b) in fits.items()})
        p = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
        rows = margins.select(key, m.alias("m"), (p - target).alias("g"), (p * (1 - p)).alias("h"))
        sums = rows.groupBy(key).agg(
            F.sum(F.col("g") * F.col("m")).alias("ga"), F.sum("g").alias("gb"), F.sum(F.col("h") * F.col("m") * F.col("m")).alias("aa"),
            F.sum(F.col("h") * F.col("m")).alias("ab"), F.sum("h").alias("bb"), F.count(F.lit(1)).alias("n")).collect()
        for r in sums:
            if r[key] not in active:
                continue
            aa, bb = r.aa + 1e-9 * r.n, r.bb + 1e-9 * r.n
            det = aa * bb - r.ab * r.ab
            da, db = (bb * r.ga - r.ab * r.gb) / det, (aa * r.gb - r.ab * r.ga) / det
            size = max(1.0, hypot(da, db) / 2)  # no step longer than 2
            a, b = fits[r[key]]
            fits[r[key]] = a - da / size, b - db / size
            if hypot(da, db) < 1e-9 * (1 + hypot(a, b)):
                active.discard(r[key])
        if not active:
            break
    return fits


def margin_rows(scored: DataFrame, label: str, raw: str = "rawPrediction") -> DataFrame:
    """One row per class of each scored row: person, margin, hit."""
    return scored.select(F.col(label).cast("int").alias("_y"), F.posexplode(vector_to_array(raw)).alias("person", "margin")).select(
        "person", "margin", (F.col("person") == F.col("_y")).alias("hit"))


def with_probabilities(scored: DataFrame, fits: dict, raw: str = "rawPrediction") -> DataFrame:
    """`scored` with `probabilities` of all classes that sum to 1, from its margins and their fits."""
    slopes, offsets = (F.array(*[F.lit(float(fits[k][i])) for k in sorted(fits)]) for i in (0, 1))
    z = F.zip_with(F.zip_with(slopes, vector_to_array(raw), lambda a, m: a * m), offsets, lambda x, b: x + b)
    each = F.transform(z, lambda v: F.greatest(F.when(v >= 0, 1 / (1 + F.exp(-v))).otherwise(F.exp(v) / (1 + F.exp(v))), F.lit(1e-12)))
    return scored.withColumn("_p", each).withColumn(
        "probabilities", F.transform("_p", lambda p: p / F.aggregate(F.col("_p"), F.lit(0.0), lambda s, x: s + x))).drop("_p")
