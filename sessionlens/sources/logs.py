"""Log line formats as DataFrame parsers. Each takes a frame with a `line` column and keeps the other columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.functions import text
from sessionlens.schema import PARSED_EVENT, STORED_EVENT

CORRUPT = "_bad"
PARSED_WITH_CORRUPT = T.StructType(PARSED_EVENT.fields + [T.StructField(CORRUPT, T.StringType())])
# Field names and line forms of the formats.
SYNONYMS = {
    "timestamp": ["timestamp", "time"],
    "type": ["type", "event_type"],
    "message": ["message", "data"],
    "window": ["window", "application", "window_title"],
}
V1_STAMP = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}): "
WINDOW_PART = r"\(window: (.+?)\)$"
BRACKET_TIME = "yyyy-MM-dd HH:mm:ss"
V1_TIME = "yyyy-MM-dd HH:mm:ss,SSS"
UNKNOWN_APP = "Unknown Application"


def time_range(df: DataFrame, column: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """Keep start <= column <= end; 0 or None leaves a side open."""
    if start:
        df = df.filter(F.col(column) >= F.lit(start))
    if end:
        df = df.filter(F.col(column) <= F.lit(end))
    return df


def scan_jsonl(spark: SparkSession, path: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """Stored events from JSON lines; blank and broken lines are skipped."""
    schema = T.StructType(STORED_EVENT.fields + [T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    good = rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return time_range(good, "timestamp", start, end)


def _epoch(stamp: Column, pattern: str) -> Column:
    return F.unix_micros(F.try_to_timestamp(stamp, F.lit(pattern))) / F.lit(1e6)


def parse_any(df: DataFrame, as_of: Column, forms: tuple[str, ...] = ("json", "bracket")) -> DataFrame:
    """JSON and bracket lines in one pass; lines of no accepted form get `_bad` = true and NULL fields.

    Each step is its own projection, so a line is decoded once however many fields it feeds.
    """
    kept = [c for c in df.columns if c != "line"]
    is_json = F.col("_line").startswith("{") if "json" in forms else F.lit(False)
    is_bracket = F.col("_line").rlike(r"^\[.*?\]") if "bracket" in forms else F.lit(False)
    js, body = F.col("_js"), F.col("_body")
    parts = F.col("_parts")
    typed = F.size(parts) > 1
    stamp = F.regexp_extract("_line", r"^\[(.*?)\]", 1)
    named = F.col("_rest").rlike(WINDOW_PART)
    steps = (
        df.withColumn("_line", F.trim("line"))
        .filter(F.col("_line") != "")
        .withColumn("_js", F.when(is_json, F.from_json("_line", PARSED_WITH_CORRUPT, {"columnNameOfCorruptRecord": CORRUPT})))
        .withColumn("_rest", F.when(is_bracket, F.trim(F.regexp_replace("_line", r"^\[.*?\]", ""))))
        .withColumn("_body", F.trim(F.regexp_replace("_rest", WINDOW_PART, "")))
        .withColumn("_parts", F.split(body, ":", 2))
    )
    whole = js.isNotNull() & js[CORRUPT].isNull()
    bracketed = F.col("_rest").isNotNull()

    def field(from_json: Column, from_bracket: Column) -> Column:
        return F.when(whole, from_json).when(bracketed, from_bracket)

    return steps.select(
        *kept,
        (~(whole | bracketed)).alias(CORRUPT),
        field(F.coalesce(js["timestamp"], as_of), F.coalesce(_epoch(stamp, BRACKET_TIME), as_of)).alias("timestamp"),
        field(
            F.coalesce(js["event_type"], F.lit("Unknown")), F.when(typed, F.trim(parts[0])).otherwise("Unknown")
        ).alias("event_type"),
        field(
            F.coalesce(js["content"], F.lit("")), F.when(typed, F.trim(F.get(parts, F.lit(1)))).otherwise(body)
        ).alias("content"),
        field(
            F.coalesce(js["window_name"], F.lit("Unknown")),
            F.when(named, F.regexp_extract("_rest", WINDOW_PART, 1)).otherwise("Unknown"),
        ).alias("window_name"),
    )


def parse_json(df: DataFrame, as_of: Column) -> DataFrame:
    """JSON lines; others are dropped."""
    return parse_any(df, as_of, ("json",)).filter(~F.col(CORRUPT)).drop(CORRUPT)


def parse_bracket(df: DataFrame, as_of: Column) -> DataFrame:
    """Bracket lines; others are dropped."""
    return parse_any(df, as_of, ("bracket",)).filter(~F.col(CORRUPT)).drop(CORRUPT)


def with_content_analysis(df: DataFrame) -> DataFrame:
    """Redact and clean the content, and tag it."""
    redacted = text.redact_pii(df, "content", "processed_content")
    return redacted.withColumn("processed_content", text.clean(F.col("processed_content"))).withColumn(
        "tags", text.content_tags(F.col("content"))
    )


def parse_v1(df: DataFrame) -> DataFrame:
    """`time: description in App - title` lines of the first log version."""
    kept = [c for c in df.columns if c != "line"]
    steps = (
        df.withColumn("_line", F.trim("line"))
        .withColumn("_rest", F.regexp_replace("_line", V1_STAMP, ""))
        .withColumn("_what", F.when(F.col("_rest").rlike("^.*? in "), F.regexp_extract("_rest", "^(.*?) in ", 1)))
        .withColumn("_app", F.split(F.regexp_replace("_rest", "^.*? in ", ""), " - ", 2)[0])
        .withColumn("_key", F.trim(F.get(F.split("_what", "Key pressed: "), F.lit(1))))
    )
    line, what, app, key = F.col("_line"), F.col("_what"), F.col("_app"), F.col("_key")
    nothing = F.lit(None).cast("string")
    key_detail = (
        F.when(key.startswith("'\\x"), nothing)
        .when(key == "Key.space", " ")
        .when(key == "Key.enter", "\n")
        .when(key == "Key.backspace", "[BACKSPACE]")
        .when(key.startswith("Key."), F.concat(F.lit("["), F.upper(F.substring_index(key, ".", -1)), F.lit("]")))
        .otherwise(F.regexp_replace(key, "^'+|'+$", ""))
    )

    def after(mark: str) -> Column:
        return F.coalesce(F.get(F.split(what, mark + " "), F.lit(1)), F.lit(""))

    # Description marks and the event type of each.
    kinds = [
        ("Key pressed:", "KeyPress", key_detail),
        ("Active window:", "WindowChange", nothing),
        ("Mouse pressed", "MouseActivity", what),
        ("Mouse released", "MouseActivity", what),
        ("Clipboard changed:", "ClipboardChange", after("Clipboard changed:")),
        ("Screenshot captured:", "Screenshot", after("Screenshot captured:")),
    ]
    kind = F.coalesce(*[F.when(what.contains(mark), name) for mark, name, _ in kinds], F.lit("Unknown"))
    detail = F.when(F.col("event_type") == "Unknown", line)
    for mark, _, value in kinds:
        detail = detail.when(what.contains(mark), value)
    known = F.col("event_type") != "Unknown"
    return steps.withColumn("event_type", kind).select(
        *kept,
        F.when(known, _epoch(F.regexp_extract(line, V1_STAMP, 1), V1_TIME)).alias("timestamp"),
        "event_type",
        detail.alias("detail"),
        F.when(known & (app != ""), app).otherwise(UNKNOWN_APP).alias("app"),
    )


def parse_synonyms(df: DataFrame, as_of_label: Column) -> DataFrame:
    """JSON lines with alternative field names, else `time: type: message`, else the whole line as message."""
    line = F.col("line")
    is_json = F.try_parse_json(line).isNotNull() & line.startswith("{")
    pieces = F.split(line, ": ", 3)
    three = F.size(pieces) >= 3
    plain = {
        "timestamp": F.when(three, pieces[0]).otherwise(as_of_label),
        "type": F.when(three, F.get(pieces, F.lit(1))).otherwise("Log"),
        "message": F.when(three, F.get(pieces, F.lit(2))).otherwise(line),
        "window": F.lit(""),
    }
    defaults = {"timestamp": "", "type": "Log", "message": "", "window": ""}
    fields = {}
    for name, names in SYNONYMS.items():
        given = [F.nullif(F.get_json_object(line, f"$.{n}"), F.lit("")) for n in names]
        fields[name] = F.when(is_json, F.coalesce(*given, F.lit(defaults[name]))).otherwise(plain[name])
    return df.select(*[c for c in df.columns if c != "line"], *[c.alias(n) for n, c in fields.items()])
