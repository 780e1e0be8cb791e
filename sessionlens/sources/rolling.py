"""A log store that rotates by bytes: segments of lines, a manifest that is switched at once, and a number of backups.

Lines are cut into segments by their running bytes in the order of time, so a hot day is written by as many tasks as it has
segments, and no segment is larger than `max_bytes` (unless one line is). A new manifest names the files that make up the store;
readers follow the newest manifest only, so they see the store before or after an append, never between. The oldest
segments beyond `backups` leave with the manifest, and their files are deleted after it stands.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.operators.sequence import running
from sessionlens.session import cut_lineage, drop_scratch
from sessionlens.sources import claims


def segments(df: DataFrame, line: Column, max_bytes: int, order: Sequence[str], us: str = "us") -> DataFrame:
    """`line`, and the number of its `segment` counted from 0: the running bytes before it over `max_bytes`.

    A line end counts as a byte. NULL lines are left out. A line that would cross the limit begins where it falls: each segment
    holds the lines that begin in its range of bytes.
    """
    lines = df.select(*dict.fromkeys([*order, us]), line.alias("line")).filter("line IS NOT NULL")
    sized = lines.withColumns({"_bytes": F.octet_length("line").cast("long") + 1, "_all": F.lit(0)})
    upto = running(sized, ["_all"], {"_upto": F.col("_bytes")}, order=order, by=F.col(us))
    return upto.withColumn("segment", F.floor((F.col("_upto") - F.col("_bytes")) / max_bytes)).drop("_upto", "_all")


def append(spark: SparkSession, df: DataFrame, root: str, line: Column, max_bytes: int, backups: int, order: Sequence[str] = ("us", "event_id"), us: str = "us") -> dict:
    """Append rows as new segments and rotate; returns the new manifest."""
    rows = cut_lineage(segments(df, line, max_bytes, order, us))
    stats = rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_bytes").alias("bytes"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))
    newest = stats.orderBy(F.desc("segment")).limit(backups + 1).collect()  # only so many segments can stay
    written = {}

    def manifest(before: list[dict]) -> dict:
        held = before[-1]["segments"] if before else []
        if not written:
            folder = f"{root}/data/{uuid.uuid4().hex}"
            stay = rows.filter(F.col("segment") >= (newest[-1].segment if newest else 0))
            # the lines of a segment stay in order
            (stay.repartition(max(1, len(newest)), "segment").sortWithinPartitions("segment", *order)
             .select("segment", "line").write.partitionBy("segment").text(folder))
            written["folder"] = folder
        new = [{"path": f"{written['folder']}/segment={s.segment}", "rows": s.rows, "bytes": s.bytes, "first_us": s.first_us, "last_us": s.last_us}
               for s in reversed(newest)]
        keep = (held + new)[-(backups + 1):]
        return {"segments": keep, "dropped": [s["path"] for s in held + new if s not in keep]}

    entry = claims.append(spark, f"{root}/manifest", manifest)
    for path in entry["dropped"]:
        drop_scratch(spark, path)
    return entry


def read(spark: SparkSession, root: str) -> DataFrame:
    """The lines of the store as its newest manifest names them, with their segment's place in it (0: oldest)."""
    found = claims.entries(spark, f"{root}/manifest")
    held = found[-1]["segments"] if found else []
    if not held:
        return spark.createDataFrame([], "line string, place int")
    places = F.create_map(*[F.lit(x) for i, s in enumerate(held) for x in (s["path"].rsplit("/data/", 1)[1], i)])
    folder = F.regexp_extract(F.input_file_name(), r"/data/(.+)/[^/]+$", 1)
    return spark.read.text([s["path"] for s in held]).select(F.col("value").alias("line"), F.element_at(places, F.url_decode(folder)).alias("place"))
