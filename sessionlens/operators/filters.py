"""Row filters over event tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.functions import patterns as P
from sessionlens.functions import text
from sessionlens.functions.clock import parse_period
from sessionlens.operators.sequence import attach


def time_range(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "ts") -> DataFrame:
    """Keep start <= ts <= end; an empty bound is open. Literal bounds are pushed to the scan."""
    kind = df.schema[column].dataType.simpleString()
    if start:
        df = df.filter(F.col(column) >= F.lit(start).cast(kind))
    if end:
        df = df.filter(F.col(column) <= F.lit(end).cast(kind))
    return df


def search(df: DataFrame, **needles: str) -> DataFrame:
    """Case-insensitive substring search; all given columns must match."""
    for column, needle in needles.items():
        if needle.strip():
            df = df.filter(F.contains(F.lower(column), F.lit(needle.strip().lower())))
    return df


def exclude_apps(df: DataFrame, excluded: Sequence[str], column: str = "app") -> DataFrame:
    return df.filter(~text.contains_any(F.col(column), [e.lower() for e in excluded]))


def within(df: DataFrame, period: str, as_of: Column, column: str = "ts") -> DataFrame:
    """Rows of the last '24h', '7d' or '30m' before `as_of`."""
    span: timedelta = parse_period(period)
    return df.filter(F.col(column) >= as_of - F.lit(span))


def canonical_kind(label: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in P.LABEL_KINDS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, label), label)


def min_samples(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of groups with at least `n` rows.

    A count and a join: no group has to fit into one task, as `count() over (group)` would ask.
    """
    enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).drop("_n")
    return attach(df, enough, keys)


def metric_alerts(df: DataFrame, ids: Sequence[str], limits: dict[str, float]) -> DataFrame:
    """One row per metric above its limit."""
    long = df.unpivot(list(ids), list(limits), "metric", "metric_value")
    table = F.create_map(*[F.lit(v) for pair in limits.items() for v in pair])
    return long.withColumn("threshold", table[F.col("metric")]).filter(F.col("metric_value") > F.col("threshold"))


def with_holidays(df: DataFrame, calendar: DataFrame, column: str = "ts") -> DataFrame:
    """Flag rows whose date is in the supplied calendar; an unknown date is no holiday."""
    days = F.broadcast(calendar.select(F.col("day"), F.lit(True).alias("is_holiday")).distinct())
    joined = df.withColumn("day", F.to_date(column)).join(days, "day", "left")
    return joined.withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False)))
