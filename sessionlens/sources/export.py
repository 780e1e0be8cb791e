"""Exports of parsed events, and retention of stored ones."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.operators.sequence import matched
from sessionlens.session import checked_broadcast, cut_lineage, drop_scratch
from sessionlens.sources.logs import time_range

# The export column order.
CSV_COLUMNS = ["timestamp", "datetime", "event_type", "window_name", "content", "processed_content", "tags", "metadata"]


def stamp(column: str = "timestamp") -> Column:
    return F.date_format(F.timestamp_micros((F.col(column) * 1e6).cast("long")), "yyyy-MM-dd HH:mm:ss")


def csv_rows(df: DataFrame) -> DataFrame:
    """The fixed eight export columns; tags joined, metadata as JSON."""
    return df.withColumns(
        {"datetime": stamp(), "tags": F.array_join("tags", ","), "metadata": F.to_json("metadata")}
    ).select(*CSV_COLUMNS)


def flat_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One `metadata_<key>` column per key: the given keys, else all keys found.

    A table needs its columns before it is written, so without `keys` the distinct keys are read first. For maps that are
    data and not a record, name the wide keys and write `long_rows` beside them.
    """
    if keys is None:
        found = df.select(F.explode(F.map_keys("metadata")).alias("k")).distinct().orderBy("k")
        keys = [row.k for row in found.collect()]
    kept = [c for c in df.columns if c != "metadata"]
    return df.select(*kept, *[F.col("metadata").getItem(k).alias(f"metadata_{k}") for k in keys])


def long_rows(df: DataFrame, *ids: str) -> DataFrame:
    """One row per event and metadata key: the id columns, key, value."""
    return df.select(*ids, F.explode("metadata").alias("key", "value"))


def text_blocks(df: DataFrame) -> DataFrame:
    return df.select(
        F.concat(
            F.lit("Timestamp: "), stamp(), F.lit("\nEvent Type: "), F.col("event_type"),
            F.lit("\nWindow: "), F.col("window_name"), F.lit("\nData: "), F.col("content"), F.lit("\n"),
        ).alias("value")
    )


def statistics(df: DataFrame) -> DataFrame:
    """The one-row summary that goes with an export."""
    return df.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.countDistinct("event_type").alias("event_types"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )


def export(df: DataFrame, fmt: str, path: str, start: float | None = None, end: float | None = None) -> bool:
    """Write events as json, csv, csv_flat or text; False when the range holds no event."""
    chosen = time_range(df, "timestamp", start, end)
    if chosen.isEmpty():
        return False
    if fmt == "json":
        chosen.withColumn("datetime", stamp()).write.json(f"{path}/events")
        statistics(chosen).write.json(f"{path}/statistics")
    elif fmt == "csv":
        csv_rows(chosen).write.option("header", True).option("escape", '"').csv(path)
    elif fmt == "csv_flat":
        flat_rows(chosen).write.option("header", True).option("escape", '"').csv(path)
    elif fmt == "text":
        text_blocks(chosen).write.text(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return True


def dealt_by_day(df: DataFrame, rows_per_task: int = 1_000_000) -> DataFrame:
    """Rows dealt out by day, a day of more rows than `rows_per_task` to as many tasks as it takes."""
    sizes = df.groupBy("day").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / rows_per_task)
    salted = matched(df, checked_broadcast(sizes), ["day"]).withColumn("_salt", F.pmod(F.xxhash64(*df.columns), parts))
    return salted.repartition("day", "_salt").select(df.columns)


def write_rolling(df: DataFrame, path: str, max_records: int = 1_000_000) -> None:
    """Store events by day, with a bound on the rows of one file."""
    df.write.mode("append").option("maxRecordsPerFile", max_records).partitionBy("day").parquet(path)


def day_folders(spark: SparkSession, path: str) -> dict[str, str]:
    """The day folders of a store: day -> path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    paths = [str(f.getPath().toString()) for f in listed if f.isDirectory()]
    return {p.rsplit("day=", 1)[1]: p for p in sorted(paths) if "day=" in p}


def expire_old_days(spark: SparkSession, path: str, days: int) -> list[str]:
    """Delete all but the newest `days` day folders of a store; returns the days deleted."""
    folders = day_folders(spark, path)
    old = sorted(folders)[:-days] if days else sorted(folders)
    for day in old:
        drop_scratch(spark, folders[day])
    return old


def expire_before(spark: SparkSession, path: str, schema: str, as_of: datetime, days: int = 90, ts: str = "ts") -> None:
    """Remove rows older than `days` days before `as_of` from a store: older day folders go, the day of the limit is rewritten."""
    limit = as_of - timedelta(days=days)
    for day, folder in day_folders(spark, path).items():
        if day < limit.date().isoformat():
            drop_scratch(spark, folder)
        elif day == limit.date().isoformat():
            rest = cut_lineage(spark.read.schema(schema).parquet(folder).filter(F.col(ts) >= F.lit(limit)))
            rest.write.mode("overwrite").parquet(folder)
