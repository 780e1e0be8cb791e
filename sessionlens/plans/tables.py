"""Readers for the given tables and the roles their columns play.

`activity` gives the events table the shape of an activity log: `event_type` plays the event
kind, `props.k` the key / position / device / application, `value` the dwell time or size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.session import spread

# What the five event types and the numbers in props stand for.
KINDS = {"signup": "keyboard", "click": "mouse", "purchase": "clipboard", "view": "window", "error": "usb"}
APPS = [
    "chrome.exe", "notepad.exe", "cmd.exe", "services.exe", "security center",
    "vscode", "outlook.exe", "explorer.exe", "admin console", "git bash",
]
CONTENTS = [
    "sudo apt update", "copy report.docx", "download file via ftp", "password: hunter2",
    "hello world", "git status", "upload to dropbox", "whoami", "meeting notes",
    "open admin panel", "api_key=abc123", "ping host", "C:\\temp\\out.log",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of long texts, spread over the cores."""
    return spread(read(spark, sf_dir, name))


def lookup(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def with_roles(events: DataFrame) -> DataFrame:
    """Add the activity roles to rows of the events table (batch or stream)."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.coalesce(
        *[F.when(F.col("event_type") == t, F.lit(v)) for t, v in KINDS.items()], F.lit("other")
    )
    step = F.col("event_id") % 4
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("us", F.unix_micros("ts"))
        .withColumn("k", k)
        .withColumn("kind", kind)
        .withColumn("key", F.char(F.lit(97) + F.col("k") % 26))
        .withColumn(
            "action",
            F.when(step == 0, "press").when(step == 1, "release").when(step == 2, "click").otherwise("move"),
        )
        .withColumn("x", F.col("k") * 19)
        .withColumn("y", (F.floor(F.col("value") * 2) % 1080).cast("int"))
        .withColumn("app", lookup(F.col("k") % len(APPS), APPS))
        .withColumn("content", lookup(F.col("k") % len(CONTENTS), CONTENTS))
        .withColumn("device", F.concat(F.lit("dev"), (F.col("k") % 9).cast("string")))
        .withColumn("size", F.floor(F.col("value") * 30).cast("int"))
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_roles(read(spark, sf_dir, "events"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


# The same roles for the oracle: `WITH act AS (...)`, to be continued with `, more AS (...)`.
ACT = f"""
WITH raw AS (
  SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k, epoch_us(ts) AS us FROM events
), act AS (
  SELECT *,
    CASE event_type {" ".join(f"WHEN '{t}' THEN '{v}'" for t, v in KINDS.items())} ELSE 'other' END AS kind,
    chr(97 + k % 26) AS key,
    CASE event_id % 4 WHEN 0 THEN 'press' WHEN 1 THEN 'release' WHEN 2 THEN 'click' ELSE 'move' END AS action,
    k * 19 AS x,
    CAST(floor(value * 2) AS INTEGER) % 1080 AS y,
    ({_sql_list(APPS)})[k % {len(APPS)} + 1] AS app,
    ({_sql_list(CONTENTS)})[k % {len(CONTENTS)} + 1] AS content,
    'dev' || CAST(k % 9 AS VARCHAR) AS device,
    CAST(floor(value * 30) AS INTEGER) AS size
  FROM raw
)"""
