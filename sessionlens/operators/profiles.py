"""Per-user baselines, profiles and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.operators.sequence import newest


def feature_profile(df: DataFrame, keys: Sequence[str], features: dict[str, Column]) -> DataFrame:
    """Mean and deviation per feature over all rows of a group; a missing value counts as 0."""
    wide = df.select(*keys, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in features.items()])
    aggs = [a for n in features for a in (F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_std"))]
    stats = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{n}_mean").alias("mean"), F.col(f"{n}_std").alias("std")) for n in features])
    return stats.select(*keys, "n", F.inline(rows))


def baseline_summary(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    )


def behaviour_drift(df: DataFrame, group: str, features: Sequence[str], recent: int = 50, base: int = 200, limit: float = 0.8) -> DataFrame:
    """Mean over the features of |recent mean - base mean| / (base deviation + 1e-6).

    Recent are the newest rows of a group, base are the rows before them.
    """
    rows = newest(df, [group], recent + base)
    is_recent = F.col("rn") <= recent
    aggs = []
    for f in features:
        old, new = F.when(~is_recent, F.col(f)), F.when(is_recent, F.col(f))
        aggs.append(F.abs(F.avg(new) - F.avg(old)) / (F.stddev_pop(old) + 1e-6))
    total = sum(aggs[1:], aggs[0])
    drift = rows.groupBy(group).agg((total / len(features)).alias("drift"))
    return drift.filter("drift IS NOT NULL").withColumn("adapt", F.col("drift") > limit)


def initial_risk(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Mean feature variance / 10, at most 1; 0.1 for a group with a single row."""
    total = sum([F.var_pop(f) for f in features[1:]], F.var_pop(features[0]))
    risk = F.when(F.count(F.lit(1)) > 1, F.least(total / len(features) / 10.0, F.lit(1.0))).otherwise(0.1)
    return df.groupBy(group).agg(risk.alias("initial_risk"))


def severity_counts(df: DataFrame, keys: Sequence[str], severity: str, recent: Column) -> DataFrame:
    """Totals, the recent ones, and the recent ones by severity, zero-filled."""
    by = [F.count_if(recent & (F.col(severity) == s)).alias(s) for s in ("critical", "high", "medium", "low")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(recent).alias("recent"), *by)


def risk_band(score: Column) -> Column:
    return F.when(score < 0.3, "low").when(score < 0.6, "medium").when(score < 0.8, "high").otherwise("critical")


def weekly_level(anomalies: Column) -> Column:
    return F.when(anomalies >= 5, "high").when(anomalies >= 2, "medium").otherwise("low")


def health(users: Column, response_enabled: Column, engine: Column) -> Column:
    """error / degraded / healthy from the engine's state and the number of open issues."""
    issues = (users == 0).cast("int") + (~response_enabled).cast("int")
    return (
        F.when((engine == "error") | (issues > 2), "error")
        .when((engine == "degraded") | (issues > 0), "degraded")
        .when(engine == "healthy", "healthy")
        .otherwise("unknown")
    )
