"""Top-k, paging and set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.operators.sequence import framed, settled


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of an order: each task keeps n rows, the driver's plan merges them."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of an order with the totals. Spark takes the first number * size rows and skips the rest."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / size))


def with_share(df: DataFrame, value: str) -> DataFrame:
    """Each row's percentage of the total."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn("percentage", F.col(value) / total * 100)


def leading_factors(scores: dict[str, Column], n: int = 3, above: float | None = None) -> Column:
    """The names of the n highest scores, highest first; ties in the given order."""
    pairs = F.array(
        *[
            F.struct((-score).alias("neg"), F.lit(i).alias("at"), F.lit(name).alias("name"))
            for i, (name, score) in enumerate(scores.items())
        ]
    )
    ranked = F.array_sort(pairs)
    if above is not None:
        ranked = F.filter(ranked, lambda p: p["neg"] < -above)
    return F.transform(F.slice(ranked, 1, n), lambda p: p["name"])


def rank_named(values: DataFrame, by: Column) -> DataFrame:
    """Rank the rows of a table that has one row per feature name."""
    ranked = values.agg(F.array_sort(F.collect_list(F.struct((-by).alias("neg"), *values.columns))).alias("all"))
    rows = ranked.select(F.posexplode("all").alias("pos", "row"))
    return rows.select((F.col("pos") + 1).alias("rank"), *[F.col("row")[c].alias(c) for c in values.columns])


def snapshot_diff(snapshots: DataFrame, group: str, at: str, members: str) -> DataFrame:
    """What appeared and what went between consecutive snapshots (arrays) of a group."""
    rows, w = framed(snapshots, [group], back=1, order=[at], by=F.unix_date(at))
    nothing = F.array().cast(snapshots.schema[members].dataType)
    diffed = rows.withColumn("_before", F.coalesce(F.lag(members).over(w), nothing))
    return settled(diffed).select(
        group,
        at,
        F.array_except(members, "_before").alias("connected"),
        F.array_except("_before", members).alias("disconnected"),
    )


def first_seen_order(df: DataFrame, keys: Sequence[str], value: str, order: Column) -> DataFrame:
    """The distinct values of a group in the order they first appeared."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("_at"))
    return first.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda r: r[value]).alias("seen")
    )
