"""Structured Streaming jobs over event files.

Outputs and checkpoints go below the shared folder. `run` drains what is there (availableNow); the same
frames run continuously with a processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.schema import EVENTS_TABLE
from sessionlens.session import scratch_path

LATENESS = "10 minutes"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, bytes_per_trigger: int | None = None) -> DataFrame:
    """The events table as a stream of files; the trigger limits bound each micro-batch.

    A file source wants a folder or a pattern. The pattern below matches exactly the given name, be it
    one file or a folder of part files.
    """
    reader = spark.readStream.schema(EVENTS_TABLE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    elif bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run(stream: DataFrame, name: str, mode: str = "append") -> tuple[DataFrame, list]:
    """Drain a stream into a table; returns the table and the progress of its batches."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table"), query.recentProgress


def run_timed(stream: DataFrame, name: str, interval: str, mode: str = "append") -> tuple[DataFrame, list]:
    """Run a stream by the clock, a micro-batch each `interval`, until all that is there now has been processed."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(processingTime=interval).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/table"), query.recentProgress


def run_batches(stream: DataFrame, name: str, handle: Callable[[DataFrame, int, str], None], mode: str = "append") -> str:
    """Drain a stream through a function per micro-batch, which gets the frame, the batch id and the output path."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(lambda df, batch: handle(df, batch, f"{path}/table"))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return f"{path}/table"


def write_batch(df: DataFrame, batch: int, path: str) -> None:
    """Write one micro-batch into its own folder, so a repeated batch replaces its first attempt."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def tumbling(stream: DataFrame, width: str, *keys: str) -> DataFrame:
    """Counts per fixed window; rows later than the watermark are dropped."""
    return (
        stream.withWatermark("ts", LATENESS)
        .groupBy(F.window("ts", width).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), *keys, "n", "total")
    )


def sliding(stream: DataFrame, width: str, step: str) -> DataFrame:
    return (
        stream.withWatermark("ts", LATENESS)
        .groupBy(F.window("ts", width, step).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")
    )


def sessions(stream: DataFrame, gap: str, key: str = "user_id") -> DataFrame:
    """Sessions that end after `gap` without an event."""
    return (
        stream.withWatermark("ts", LATENESS)
        .groupBy(F.session_window("ts", gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")
    )


def alerts(stream: DataFrame, score: Column, limit: float) -> DataFrame:
    return stream.withColumn("score", score).filter(F.col("score") > limit)
