"""Fixed schemas of the event data model. Open-ended parts are maps."""

from __future__ import annotations

from pyspark.sql import types as T

# An event as stored by the collector, one JSON object per line.
STORED_EVENT = T.StructType(
    [
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("window_name", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("datetime", T.StringType()),
        T.StructField("session_id", T.StringType()),
    ]
)

# The part of a stored event the line parsers produce.
PARSED_EVENT = T.StructType(
    [
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("window_name", T.StringType()),
    ]
)

# The driver's events table, as a stream source.
EVENTS_TABLE = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
