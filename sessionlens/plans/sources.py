"""Sources and sinks. Log lines are rendered from the events table, so the source row is the expected value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.functions import text
from sessionlens.plans.catalog import query
from sessionlens.plans.tables import ACT, activity
from sessionlens.session import scratch_path, spread
from sessionlens.sources import export, rolling, logs, sealed

AS_OF = 1704067200.0
SEAL_KEY = "000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f"


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the stored form."""
    return spread(activity(spark, sf)).select(
        "event_id",
        (F.col("us") / 1e6).alias("timestamp"),
        F.col("kind").alias("event_type"),
        "content",
        F.col("app").alias("window_name"),
        F.create_map(F.lit("device"), "device", F.lit("k"), F.col("k").cast("string")).alias("metadata"),
        F.concat_ws("-", F.lit("s"), "user_id").alias("session_id"),
    )


def _json_line(*names: str):
    return F.to_json(F.struct(*names))


@query(
    "scan_jsonl",
    ACT + """
SELECT round(us / 1e6, 6) AS timestamp, kind AS event_type, content, app AS window_name,
       's-' || user_id AS session_id
FROM act WHERE event_id % 50 <> 0 AND us / 1e6 >= 1704067200 AND us / 1e6 <= 1705900000""",
)
def scan_jsonl(spark, sf):
    rows = _stored(spark, sf)
    whole = _json_line("timestamp", "event_type", "content", "window_name", "metadata", "session_id")
    broken = F.concat(F.lit('{"timestamp": '), F.col("event_id").cast("string"))
    lines = rows.select(F.when(F.col("event_id") % 50 == 0, broken).otherwise(whole).alias("value"))
    path = scratch_path(spark, "jsonl")
    lines.union(lines.select(F.lit("").alias("value"))).write.text(path)
    return logs.scan_jsonl(spark, path, AS_OF, 1705900000.0).select(
        F.round("timestamp", 6).alias("timestamp"), "event_type", "content", "window_name", "session_id"
    )


@query(
    "parse_json_events",
    ACT + f"""
SELECT event_id, round(CASE WHEN k % 7 = 0 THEN {AS_OF} ELSE us / 1e6 END, 6) AS timestamp,
       CASE WHEN k % 5 = 0 THEN 'Unknown' ELSE kind END AS event_type,
       CASE WHEN k % 3 = 0 THEN '' ELSE content END AS content, app AS window_name
FROM act""",
)
def parse_json_events(spark, sf):
    k = F.col("k")
    lines = activity(spark, sf).select(
        "event_id",
        F.to_json(
            F.struct(
                F.when(k % 7 != 0, F.col("us") / 1e6).alias("timestamp"),
                F.when(k % 5 != 0, F.col("kind")).alias("event_type"),
                F.when(k % 3 != 0, F.col("content")).alias("content"),
                F.col("app").alias("window_name"),
            )
        ).alias("line"),
    )
    return logs.parse_json(lines, F.lit(AS_OF)).withColumn("timestamp", F.round("timestamp", 6))


def _bracket_lines(df: DataFrame) -> DataFrame:
    when = F.when(F.col("k") % 11 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    head = F.concat(F.lit("["), when, F.lit("] "), F.col("kind"), F.lit(": "), F.col("content"))
    line = F.when(F.col("k") % 3 == 0, head).otherwise(F.concat(head, F.lit(" (window: "), F.col("app"), F.lit(")")))
    return df.withColumn("line", F.when(F.col("k") % 13 == 0, F.col("content")).otherwise(line))


BRACKET_SQL = f"""
  CASE WHEN k % 11 = 0 THEN {AS_OF} ELSE CAST(us // 1000000 AS DOUBLE) END AS timestamp,
  kind AS event_type, content, CASE WHEN k % 3 = 0 THEN 'Unknown' ELSE app END AS window_name"""


@query("parse_bracket_log", ACT + f" SELECT event_id, {BRACKET_SQL} FROM act WHERE k % 13 <> 0")
def parse_bracket_log(spark, sf):
    lines = _bracket_lines(activity(spark, sf)).select("event_id", "line")
    return logs.parse_bracket(lines, F.lit(AS_OF))


@query(
    "parse_v1_log",
    ACT + """
SELECT event_id,
  CASE WHEN k % 10 = 9 OR k % 6 = 5 THEN NULL ELSE CAST(us // 1000 AS DOUBLE) / 1000 END AS timestamp,
  CASE WHEN k % 6 = 5 THEN 'Unknown' ELSE CASE k % 5 WHEN 0 THEN 'KeyPress' WHEN 1 THEN 'WindowChange'
    WHEN 2 THEN 'MouseActivity' WHEN 3 THEN 'ClipboardChange' ELSE 'Screenshot' END END AS event_type,
  CASE WHEN k % 6 = 5 THEN 'free line ' || k ELSE CASE k % 5 WHEN 0 THEN
      (CASE WHEN k % 4 = 0 THEN '[SHIFT]' WHEN k % 4 = 1 THEN ' ' ELSE key END)
    WHEN 1 THEN NULL WHEN 2 THEN 'Mouse pressed at ' || k WHEN 3 THEN content
    ELSE 'shot' || k || '.png' END END AS detail,
  CASE WHEN k % 6 = 5 THEN 'Unknown Application' ELSE app END AS app
FROM act""",
)
def parse_v1_log(spark, sf):
    k = F.col("k")
    number = k.cast("string")
    key = F.when(k % 4 == 0, "Key.shift").when(k % 4 == 1, "Key.space").otherwise(F.concat(F.lit("'"), F.col("key"), F.lit("'")))
    what = (
        F.when(k % 5 == 0, F.concat(F.lit("Key pressed: "), key))
        .when(k % 5 == 1, F.concat(F.lit("Active window: "), F.col("app")))
        .when(k % 5 == 2, F.concat(F.lit("Mouse pressed at "), number))
        .when(k % 5 == 3, F.concat(F.lit("Clipboard changed: "), F.col("content")))
        .otherwise(F.concat(F.lit("Screenshot captured: shot"), number, F.lit(".png")))
    )
    stamp = F.when(k % 10 == 9, "").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(": ")))
    line = F.concat(stamp, what, F.lit(" in "), F.col("app"), F.lit(" - some title"))
    lines = activity(spark, sf).select(
        "event_id", F.when(k % 6 == 5, F.concat(F.lit("free line "), number)).otherwise(line).alias("line")
    )
    return logs.parse_v1(lines)


def _mixed_lines(df: DataFrame) -> DataFrame:
    as_json = F.to_json(
        F.struct(
            F.floor(F.col("us") / 1_000_000).cast("double").alias("timestamp"),
            F.col("kind").alias("event_type"), "content", F.col("app").alias("window_name"),
        )
    )
    cut = F.concat(F.lit('{"timestamp": '), F.col("event_id").cast("string"))
    odd = F.col("event_id") % 2 == 1
    return _bracket_lines(df).withColumn(
        "line", F.when(odd & (F.col("event_id") % 17 == 0), cut).when(odd, as_json).otherwise(F.col("line"))
    )


MIXED_SQL = ACT + f""", mixed AS (
  SELECT *, CASE WHEN event_id % 2 = 1 THEN event_id % 17 = 0 ELSE k % 13 = 0 END AS bad,
    CASE WHEN event_id % 2 = 1 THEN CAST(us // 1000000 AS DOUBLE) WHEN k % 11 = 0 THEN {AS_OF}
         ELSE CAST(us // 1000000 AS DOUBLE) END AS timestamp,
    CASE WHEN event_id % 2 = 1 THEN app WHEN k % 3 = 0 THEN 'Unknown' ELSE app END AS window_name
  FROM act)"""


@query(
    "parse_dispatch",
    MIXED_SQL + """
SELECT coalesce(kind_or_null, '(unparsed)') AS event_type, count(*) AS lines,
       CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS errors, coalesce(max(timestamp), 0) AS newest
FROM (SELECT CASE WHEN bad THEN NULL ELSE kind END AS kind_or_null, bad,
             CASE WHEN bad THEN NULL ELSE timestamp END AS timestamp FROM mixed) GROUP BY 1""",
)
def parse_dispatch(spark, sf):
    """Parsed lines and the number of unparsable ones, counted and not raised."""
    parsed = logs.parse_any(_mixed_lines(spread(activity(spark, sf))).select("event_id", "line"), F.lit(AS_OF))
    return parsed.groupBy(F.coalesce("event_type", F.lit("(unparsed)")).alias("event_type")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(logs.CORRUPT).alias("errors"),
        F.coalesce(F.max("timestamp"), F.lit(0.0)).alias("newest"),
    )


@query(
    "union_formats",
    MIXED_SQL + " SELECT event_id, timestamp, kind AS event_type, content, window_name FROM mixed WHERE NOT bad",
)
def union_formats(spark, sf):
    """A mixed-format log as one event list."""
    parsed = logs.parse_any(_mixed_lines(spread(activity(spark, sf))).select("event_id", "line"), F.lit(AS_OF))
    return parsed.filter(~F.col(logs.CORRUPT)).drop(logs.CORRUPT)


@query(
    "parse_synonym_json",
    ACT + """
SELECT event_id,
  CASE WHEN k % 4 = 3 AND k % 8 = 7 THEN 'now' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp,
  CASE WHEN k % 4 = 3 AND k % 8 = 7 THEN 'Log' WHEN k % 4 = 2 THEN 'Log' ELSE kind END AS type,
  content AS message, CASE WHEN k % 4 < 3 THEN app ELSE '' END AS "window"
FROM act""",
)
def parse_synonym_json(spark, sf):
    k = F.col("k")
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    a = F.to_json(F.struct(when.alias("timestamp"), F.col("kind").alias("type"), F.col("content").alias("message"), F.col("app").alias("window")))
    b = F.to_json(F.struct(when.alias("time"), F.col("kind").alias("event_type"), F.col("content").alias("data"), F.col("app").alias("application")))
    c = F.to_json(F.struct(when.alias("time"), F.lit("").alias("message"), F.col("content").alias("data"), F.col("app").alias("window_title")))
    plain = F.when(k % 8 == 7, F.regexp_replace("content", ": ", ": ")).otherwise(
        F.concat(when, F.lit(": "), F.col("kind"), F.lit(": "), F.col("content"))
    )
    lines = activity(spark, sf).select(
        "event_id",
        F.when(k % 4 == 0, a).when(k % 4 == 1, b).when(k % 4 == 2, c).otherwise(plain).alias("line"),
    )
    return logs.parse_synonyms(lines, F.lit("now"))


SEALED_SQL = ACT + """
SELECT event_id, round(us / 1e6, 6) AS timestamp, kind AS event_type, content, app AS window_name
FROM act WHERE event_id % 40 <> 0"""


def _sealed_lines(spark, sf):
    key = F.unhex(F.lit(SEAL_KEY))
    line = _json_line("event_id", "timestamp", "event_type", "content", "window_name")
    lines = _stored(spark, sf).select("event_id", line.alias("line"))
    return sealed.seal(lines, "line", key, sealed.row_nonce("event_id", "line"))


def _unsealed(lines: DataFrame) -> DataFrame:
    plain = sealed.unseal(lines, "line", F.unhex(F.lit(SEAL_KEY)))
    schema = "event_id LONG, timestamp DOUBLE, event_type STRING, content STRING, window_name STRING"
    # Exploding drops the lines that stayed sealed; a filter would be pushed below and decrypt twice.
    opened = plain.select(F.explode(F.array_compact(F.array("line"))).alias("json"))
    parsed = opened.select(F.from_json("json", schema).alias("e")).select("e.*")
    return parsed.withColumn("timestamp", F.round("timestamp", 6))


@query("decrypt_scan", SEALED_SQL)
def decrypt_scan(spark, sf):
    """Encrypted lines, some of them damaged; what cannot be decrypted is skipped."""
    lines = _sealed_lines(spark, sf)
    damaged = F.concat(F.lit("ENC:AAAA"), F.substring("line", 9, 4000))
    return _unsealed(lines.withColumn("line", F.when(F.col("event_id") % 40 == 0, damaged).otherwise(F.col("line"))))


@query("encrypt_sink", SEALED_SQL.replace("WHERE event_id % 40 <> 0", ""))
def encrypt_sink(spark, sf):
    path = scratch_path(spark, "sealed")
    _sealed_lines(spark, sf).select("line").write.text(path)
    return _unsealed(spark.read.text(path).withColumnRenamed("value", "line"))


def _parsed(spark, sf):
    rows = _stored(spark, sf).drop("event_id", "session_id")
    return logs.with_content_analysis(rows)


@query(
    "export_json",
    ACT + """
SELECT kind AS event_type, app AS window_name, count(*) AS n, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS first_datetime
FROM act GROUP BY 1, 2""",
)
def export_json(spark, sf):
    path = scratch_path(spark, "export")
    export.export(_stored(spark, sf), "json", path)
    back = spark.read.schema("event_type STRING, window_name STRING, datetime STRING").json(f"{path}/events")
    return back.groupBy("event_type", "window_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first_datetime")
    )


CSV_SQL = ACT + """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime, kind AS event_type, app AS window_name, content,
       '{"device":"' || device || '","k":"' || k || '"}' AS metadata
FROM act"""


@query("export_csv", CSV_SQL)
def export_csv(spark, sf):
    path = scratch_path(spark, "export")
    export.export(_parsed(spark, sf), "csv", path)
    schema = ", ".join(f"{c} STRING" for c in export.CSV_COLUMNS)
    back = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return back.select("datetime", "event_type", "window_name", "content", "metadata")


@query(
    "export_csv_flat",
    ACT + """
SELECT kind AS event_type, content, device AS metadata_device, CAST(k AS VARCHAR) AS metadata_k FROM act""",
)
def export_csv_flat(spark, sf):
    return export.flat_rows(_stored(spark, sf)).select("event_type", "content", "metadata_device", "metadata_k")


@query(
    "export_text",
    ACT + """
SELECT 'Timestamp: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || 'Event Type: ' || kind || chr(10)
  || 'Window: ' || app || chr(10) || 'Data: ' || content || chr(10) AS value FROM act""",
)
def export_text(spark, sf):
    return export.text_blocks(_stored(spark, sf))


@query(
    "export_router",
    ACT + """, n AS (SELECT count(*) AS n FROM act WHERE us / 1e6 <= 1704200000)
SELECT f.fmt, CASE WHEN f.fmt = 'csv' THEN 0 ELSE n.n END AS written, f.fmt <> 'csv' AS exported
FROM (VALUES ('json'), ('text'), ('csv')) AS f(fmt), n""",
)
def export_router(spark, sf):
    """The same range in two formats, and an empty range, which writes nothing."""
    rows = _stored(spark, sf).cache()
    results = []
    for fmt, end in (("json", 1704200000.0), ("text", 1704200000.0), ("csv", 1.0)):
        path = scratch_path(spark, "export")
        written = export.export(rows, fmt, path, end=end)
        if not written:
            count = spark.range(1).select(F.lit(0).cast("long").alias("written"))
        elif fmt == "json":
            count = spark.read.schema("event_type STRING").json(f"{path}/events").agg(F.count(F.lit(1)).alias("written"))
        else:
            text_lines = spark.read.text(path).filter(F.col("value").startswith("Timestamp: "))
            count = text_lines.agg(F.count(F.lit(1)).alias("written"))
        results.append(count.select(F.lit(fmt).alias("fmt"), "written", F.lit(written).alias("exported")))
    rows.unpersist()
    return results[0].union(results[1]).union(results[2])


@query(
    "rolling_store",
    ACT + """, days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM act ORDER BY d DESC LIMIT 7)
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM act
WHERE CAST(ts AS DATE) IN (SELECT d FROM days) GROUP BY 1""",
)
def rolling_store(spark, sf):
    path = scratch_path(spark, "store")
    rows = activity(spark, sf).select("event_id", "kind", F.to_date("ts").alias("day"))
    export.write_rolling(export.dealt_by_day(rows), path)
    export.expire_old_days(spark, path, 7)
    stored = spark.read.schema("event_id LONG, kind STRING, day DATE").parquet(path)
    return (
        stored.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


SEGMENT_BYTES, BACKUPS = 40_000, 3


@query(
    "rolling_segments",
    ACT + f""", l AS (SELECT us, event_id, us || ' ' || kind || ' ' || content AS line, us < (SELECT quantile_disc(us, 0.5) FROM act) AS old FROM act),
c AS (SELECT *, (sum(octet_length(encode(line)) + 1) OVER (PARTITION BY old ORDER BY us, event_id) - octet_length(encode(line)) - 1) // {SEGMENT_BYTES} AS seg FROM l),
r AS (SELECT *, dense_rank() OVER (ORDER BY old::INT, seg DESC) AS rank FROM c)
SELECT CAST(least({BACKUPS + 1}, (SELECT max(rank) FROM r)) - rank AS INTEGER) AS place, count(*) AS n, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes FROM r WHERE rank <= {BACKUPS + 1} GROUP BY 1""",
)
def rolling_segments(spark, sf):
    """Two appends to a store of segments of 40,000 bytes, the newest and three backups; what is left of it."""
    path = scratch_path(spark, "segments")
    rows = activity(spark, sf)
    line = F.concat_ws(" ", F.col("us").cast("string"), "kind", "content")
    middle = rows.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY us)")).first()[0]
    for part in (F.col("us") < middle, F.col("us") >= middle):
        rolling.append(spark, rows.filter(part), path, line, SEGMENT_BYTES, BACKUPS)
    return rolling.read(spark, path).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line") + 1).cast("long").alias("bytes"))


@query(
    "retention",
    ACT + """
SELECT kind, count(*) AS n FROM act WHERE ts >= (SELECT max(ts) FROM act) - INTERVAL 14 DAY GROUP BY 1""",
)
def retention(spark, sf):
    """A store by day from which rows older than two weeks are removed."""
    path = scratch_path(spark, "kept")
    rows = activity(spark, sf).select("event_id", "kind", "ts", F.to_date("ts").alias("day"))
    export.write_rolling(export.dealt_by_day(rows), path)
    export.expire_before(spark, path, "event_id LONG, kind STRING, ts TIMESTAMP", rows.agg(F.max("ts")).first()[0], days=14)
    stored = spark.read.schema("event_id LONG, kind STRING, ts TIMESTAMP, day DATE").parquet(path)
    return stored.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "export_components",
    ACT + """
SELECT kind AS component, '{"events":' || count(*) || ',"users":' || count(DISTINCT user_id) || ',"largest":'
  || max(size) || '}' AS statistics FROM act GROUP BY 1""",
)
def export_components(spark, sf):
    """A statistics bundle per component, written as JSON and read back."""
    stats = activity(spark, sf).groupBy(F.col("kind").alias("component")).agg(
        F.to_json(
            F.struct(
                F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"), F.max("size").alias("largest")
            )
        ).alias("statistics")
    )
    path = scratch_path(spark, "components")
    stats.write.json(path)
    return spark.read.schema("component STRING, statistics STRING").json(path)
