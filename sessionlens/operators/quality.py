"""Model evaluation, registry, drift and confidence, from tables of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.distributions import student_p
from sessionlens.operators.sequence import running


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    cells = df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.when(F.col(label) == F.col(prediction), F.col("_n")).otherwise(0)
    actual = cells.groupBy(F.col(label).alias("class")).agg(F.sum("_n").alias("support"), F.sum(hit).alias("_hits"))
    claimed = cells.groupBy(F.col(prediction).alias("class")).agg(F.sum("_n").alias("_claimed"))
    precision = F.coalesce(F.try_divide("_hits", "_claimed"), F.lit(0.0))
    recall = F.try_divide("_hits", "support")
    return (
        actual.join(claimed, "class", "left")
        .withColumns({"precision": precision, "recall": recall})
        .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
        .drop("_hits", "_claimed")
    )


def weighted_report(report: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; accuracy equals the weighted recall."""
    total = F.sum("support")
    means = [(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in ("precision", "recall", "f1")]
    return report.agg(*means, total.alias("n")).withColumn("accuracy", F.col("recall"))


def fold_accuracy(df: DataFrame, fold: Column, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean and deviation of the accuracy over folds."""
    hit = (F.col(label) == F.col(prediction)).cast("double")
    folds = df.groupBy(fold.alias("_fold")).agg(F.avg(hit).alias("_a"))
    return folds.agg(F.avg("_a").alias("cv_mean"), F.stddev_pop("_a").alias("cv_std"), F.count(F.lit(1)).alias("folds"))


def registry_summary(registry: DataFrame, model: str = "model", version: str = "version", metric: str = "metric") -> DataFrame:
    """Per model: number of versions, active (latest) and best version, and the change from first to latest."""
    return registry.groupBy(model).agg(
        F.count(F.lit(1)).alias("versions"),
        F.max(version).alias("active_version"),
        F.max_by(metric, version).alias("active_metric"),
        F.min_by(version, F.struct(-F.col(metric), F.col(version))).alias("best_version"),
        F.max(metric).alias("best_metric"),
        (F.max_by(metric, version) - F.min_by(metric, version)).alias("change"),
        F.max_by("checksum", version).alias("checksum"),
    )


def performance_drift(runs: DataFrame, model: str = "model", version: str = "version", metric: str = "metric", tail: int = 3, least: int = 5, limit: float = 0.05) -> DataFrame:
    """Mean metric of all but the last runs minus the mean of the last ones."""
    size = runs.groupBy(model).agg(F.count(F.lit(1)).alias("runs"))
    ranked = running(runs, [model], {"_rn": F.lit(1).cast("long")}, order=[version], by=F.col(version)).join(size, model)
    recent = F.col("_rn") > F.col("runs") - tail
    out = ranked.filter(F.col("runs") >= least).groupBy(model).agg(
        F.max("runs").alias("runs"), (F.avg(F.when(~recent, F.col(metric))) - F.avg(F.when(recent, F.col(metric)))).alias("drop")
    )
    return out.withColumn("drifted", F.col("drop") > limit)


def kolmogorov_tail(x: Column, terms: int = 100) -> Column:
    """P(K > x) of the Kolmogorov distribution by its alternating series."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda a, j: a + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * x * x),
    )
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


def ks_drift(long: DataFrame, in_second: Column, alpha: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per feature, with its asymptotic p-value.

    Equal values are counted per sample first; the two distribution functions are then running sums. With an empty
    sample there is nothing to compare: no statistic, and no drift.
    """
    counts = long.groupBy("feature", "x").agg(
        F.count_if(~in_second).alias("_a"), F.count_if(in_second).alias("_b")
    )
    sizes = counts.groupBy("feature").agg(F.sum("_a").alias("n"), F.sum("_b").alias("m"))
    upto = running(counts, ["feature"], {"_ca": F.col("_a"), "_cb": F.col("_b")}, order=["x"], by=F.col("x"))
    gap = F.abs(F.try_divide("_ca", "n") - F.try_divide("_cb", "m"))
    out = upto.join(F.broadcast(sizes), "feature").groupBy("feature", "n", "m").agg(F.max(gap).alias("statistic"))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    scale = F.sqrt(n * m / (n + m))
    tail = F.when(F.col("statistic").isNotNull(), kolmogorov_tail(scale * F.col("statistic")))
    return out.withColumn("p_value", tail).withColumn("drifted", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def retrain_due(models: DataFrame, as_of: Column, interval_days: int = 7, least: int = 100) -> DataFrame:
    """Models whose interval has passed and that have enough new samples, or that drifted; with the reason.

    Columns: model, trained_at (microseconds), samples, drifted.
    """
    elapsed = (as_of - F.col("trained_at")) / 86_400_000_000 >= interval_days
    enough = F.col("samples") >= least
    reason = F.when(F.col("drifted") & enough, "drift").when(elapsed & enough, "interval")
    return models.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def calibration(df: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """Brier score, log loss and expected calibration error; bins are (low, high]."""
    p, y = F.col(probability), F.col(label)
    eps = 1e-15
    safe = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    loss = -(y * F.ln(safe) + (1 - y) * F.ln(1 - safe))
    right = ((p > 0.5).cast("int") == y).cast("double")
    # A probability of exactly 0 lies in no bin.
    per_bin = df.groupBy(F.ceil(p * bins).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(p).alias("_conf"), F.avg(right).alias("_acc"),
        F.sum((p - y) * (p - y)).alias("_sq"), F.sum(loss).alias("_loss"),
    )
    total = F.sum("_n")
    gap = F.when(F.col("_bin") > 0, F.abs(F.col("_conf") - F.col("_acc")) * F.col("_n")).otherwise(0.0)
    return per_bin.agg(
        total.alias("n"), (F.sum("_sq") / total).alias("brier"), (F.sum("_loss") / total).alias("log_loss"), (F.sum(gap) / total).alias("ece")
    )


def uncertainty(long: DataFrame, key: str = "event_id") -> DataFrame:
    """Uncertainty of an ensemble from (key, model, class, p) rows.

    The number of models and classes is fixed, so a key has a handful of rows whatever the data size.
    """
    eps = 1e-10
    own = -F.col("p") * F.ln(F.col("p") + eps)
    per_class = long.groupBy(key, "class").agg(
        F.avg("p").alias("_mean"), F.var_pop("p").alias("_var"), F.sum(own).alias("_own"), F.count(F.lit(1)).alias("_models")
    )
    mean_entropy = F.sum(-F.col("_mean") * F.ln(F.col("_mean") + eps))
    spread = per_class.groupBy(key).agg(
        F.avg("_var").alias("epistemic"), mean_entropy.alias("aleatoric"),
        (mean_entropy - F.sum("_own") / F.max("_models")).alias("mutual_information"),
        (1 - F.max("_mean")).alias("predictive"),
    )
    choice = long.groupBy(key, "model").agg(F.min_by("class", F.struct(-F.col("p"), F.col("class"))).alias("_choice"))
    agreement = choice.groupBy(key).agg(
        (1 - F.var_pop("_choice") / F.countDistinct("_choice")).alias("agreement")
    )
    return spread.withColumn("total", F.col("aleatoric") + F.col("epistemic")).join(agreement, key)


def confidence_levels(df: DataFrame, level: str, score: str) -> DataFrame:
    """Predictions and mean score per level, with the share of each level."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(level).agg(F.count(F.lit(1)).alias("predictions"), F.avg(score).alias("mean_score")).withColumn(
        "share", F.col("predictions") / total
    )


def confidence_drift(df: DataFrame, score: str, order: Sequence[str] = ("ts", "event_id"), window: int = 100) -> DataFrame:
    """The newest `window` scores against the `window` before: moments, t statistic with its p-value, and severity, as one row.

    With fewer scores than both windows take, severity and direction are `insufficient_data`.
    """
    recent = df.orderBy(*[F.desc(c) for c in order]).limit(2 * window)
    listed = recent.agg(F.reverse(F.array_sort(F.collect_list(F.struct(*order, score)))).alias("_l"))
    rows = listed.select(F.posexplode("_l").alias("_i", "_r"))
    value = F.col("_r")[score]
    new, old = F.when(F.col("_i") < window, value), F.when(F.col("_i") >= window, value)
    moments = rows.agg(
        F.avg(new).alias("recent_mean"), F.avg(old).alias("older_mean"),
        F.stddev_pop(new).alias("recent_std"), F.stddev_pop(old).alias("older_std"),
        F.median(new).alias("recent_median"), F.median(old).alias("older_median"),
        F.count(new).alias("_n"), F.count(old).alias("_m"), F.var_samp(new).alias("_vn"), F.var_samp(old).alias("_vm"),
    )
    n, m = F.col("_n"), F.col("_m")
    pooled = F.try_divide((n - 1) * F.col("_vn") + (m - 1) * F.col("_vm"), n + m - 2)
    few = (n < window) | (m < window)
    drift = F.col("recent_mean") - F.col("older_mean")
    return (
        moments.withColumn("mean_drift", drift)
        .withColumn("t_statistic", F.try_divide(-drift, F.sqrt(pooled * (F.try_divide(F.lit(1), n) + F.try_divide(F.lit(1), m)))))
        .withColumn("severity", F.when(few, "insufficient_data").when(F.abs(drift) > 0.1, "high").when(F.abs(drift) > 0.05, "medium").otherwise("low"))
        .withColumn("direction", F.when(few, "insufficient_data").when(drift > 0, "increasing").otherwise("decreasing"))
        .withColumn("p_value", student_p(F.col("t_statistic"), (n + m - 2).cast("double")))
        .drop("_n", "_m", "_vn", "_vm")
    )


def recalibration(df: DataFrame) -> DataFrame:
    """Whether to recalibrate, why, and how urgent; columns: severity, significant, days_since, low_share."""
    reasons = F.filter(
        F.array(
            F.when(F.col("severity") == "high", "High confidence drift detected"),
            F.when(F.col("significant"), "Statistically significant confidence change"),
            F.when(F.col("days_since") > 30, F.concat(F.lit("Last calibration was "), F.col("days_since").cast("string"), F.lit(" days ago"))),
            F.when(F.col("low_share") > 0.3, "High ratio of low-confidence predictions"),
        ),
        lambda r: r.isNotNull(),
    )
    high, low = F.col("severity") == "high", F.col("low_share") > 0.3
    needed = high | F.col("significant") | low
    priority = (
        F.when(high | low, "high").when(F.col("significant"), "medium").when(F.col("days_since") > 30, "medium").otherwise("low")
    )
    sure = F.when(needed, F.least(F.lit(1.0), F.size(reasons) * 0.3)).otherwise(0.8)
    return df.withColumns({"needed": needed, "reasons": reasons, "priority": priority, "certainty": sure})


