"""Streaming jobs, drained over the given tables and compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlens.functions import patterns as P
from sessionlens.functions.levels import level
from sessionlens.operators.aggregates import r6
from sessionlens.operators.joins import recommended_actions
from sessionlens.plans.catalog import ORACLES, query
from sessionlens.plans.joins import KIND_ANOMALIES, SCORE, lists_sql, score
from sessionlens.plans.rows import level_sql
from sessionlens.plans.tables import ACT, activity, read, with_roles
from sessionlens.plans.windows import ALERTS_SQL
from sessionlens.schema import EVENTS_TABLE
from sessionlens.session import checked_broadcast, scratch_path
from sessionlens.streaming import jobs, state

# Bounds a micro-batch; results do not depend on it.
BATCH_BYTES = 2**30
LAST = "(SELECT max(us) - 600000000 FROM act)"


def passed_sql(sql: str, column: str = "event_id") -> str:
    """The rows of a batch twin that a drained stream has released."""
    return f"SELECT o.* FROM ({sql}) o JOIN events e USING ({column}) WHERE epoch_us(e.ts) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM events)"


def events(spark, sf, **limits):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return with_roles(jobs.event_stream(spark, f"{sf}/events.parquet", **limits))


@query("stream_ingest", "SELECT event_id, user_id, event_type, value, props FROM events")
def stream_ingest(spark, sf):
    """JSON files appended to a table, micro-batch by micro-batch."""
    path = scratch_path(spark, "incoming")
    read(spark, sf, "events").write.json(path)
    stream = spark.readStream.schema(EVENTS_TABLE).json(path)
    table, _ = jobs.run(stream, "ingest")
    return table.select("event_id", "user_id", "event_type", "value", "props")


@query(
    "alert_sink",
    ACT + f" SELECT event_id, kind, {level_sql(SCORE, 'alert')} AS severity FROM act WHERE {SCORE} > 0.8",
)
def alert_sink(spark, sf):
    found = jobs.alerts(events(spark, sf), score(), 0.8)
    rows = found.select("event_id", "kind", level(F.col("score"), "alert").alias("severity"))
    path = jobs.run_batches(rows, "alerts", jobs.write_batch)
    return spark.read.schema(rows.schema).parquet(path).select("event_id", "kind", "severity")


@query("micro_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def micro_batch(spark, sf):
    """Several files, one per micro-batch; counts per batch, summed."""
    path = scratch_path(spark, "files")
    read(spark, sf, "events").repartition(4, "event_id").write.parquet(path)
    stream = jobs.event_stream(spark, path, files_per_trigger=1)

    def count(df, batch, out):
        jobs.write_batch(df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), batch, out)

    counted = spark.read.schema("event_type STRING, n LONG").parquet(jobs.run_batches(stream, "micro", count))
    return counted.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("micro_batch_timed", ACT + " SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS total FROM act GROUP BY 1")
def micro_batch_timed(spark, sf):
    """Files in turn by the clock, twice a second; what the batches wrote, summed."""
    path = scratch_path(spark, "files")
    read(spark, sf, "events").repartition(3, "event_id").write.parquet(path)
    rows = with_roles(jobs.event_stream(spark, path, files_per_trigger=1)).select("kind", "size")
    table, _ = jobs.run_timed(rows, "timed", "500 milliseconds")
    return table.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("total"))


@query(
    "tumbling_counts",
    ACT + f""", w AS (SELECT us // 3600000000 * 3600000000 AS start_us, kind, value FROM act)
SELECT start_us, start_us + 3600000000 AS end_us, kind, count(*) AS n, round(sum(value), 4) AS total FROM w
WHERE start_us + 3600000000 <= {LAST} GROUP BY 1, 2, 3""",
)
def tumbling_counts(spark, sf):
    table, _ = jobs.run(jobs.tumbling(events(spark, sf), "1 hour", "kind"), "tumbling")
    return table.withColumn("total", F.round("total", 4))


@query(
    "sliding_rate",
    ACT + f""", w AS (SELECT unnest(range(us // 60000000 * 60000000 - 540000000, us // 60000000 * 60000000 + 1, 60000000)) AS start_us FROM act)
SELECT start_us, start_us + 600000000 AS end_us, count(*) AS n FROM w WHERE start_us + 600000000 <= {LAST} GROUP BY 1, 2""",
)
def sliding_rate(spark, sf):
    return jobs.run(jobs.sliding(events(spark, sf), "10 minutes", "1 minute"), "sliding")[0]


@query(
    "session_windows",
    ACT + f""", g AS (SELECT user_id, us, event_id, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) >= 7200000000, true)::INT AS fresh FROM act),
s AS (SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM g)
SELECT user_id, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, session HAVING max(us) + 7200000000 <= {LAST}""",
)
def session_windows(spark, sf):
    return jobs.run(jobs.sessions(events(spark, sf), "2 hours"), "sessions")[0]


@query("stateful_risk", passed_sql(ORACLES["risk_feedback"]))
def stateful_risk(spark, sf):
    base = F.least(F.col("value") / 100, F.lit(1.0))
    rows = events(spark, sf, bytes_per_trigger=BATCH_BYTES).select("user_id", "event_id", "ts", "us", "kind", base.alias("base"))
    table, _ = jobs.run(state.stateful_risk(rows, cold_start=20, same_kind=6), "risk")
    return table.select("event_id", r6("risk").alias("risk"))


def baseline_sql(window: int, limit: float) -> str:
    """The baseline's life cycle, row by row."""

    def part(f: str) -> str:
        held = f"list_transform(s, lambda t: t.{f})"
        return f"CASE WHEN list_var_pop({held}) > 1e-8 THEN least(1, abs(p.{f} - list_avg({held})) / sqrt(list_var_pop({held})) / 5) END"

    return ACT.replace("WITH raw", "WITH RECURSIVE raw") + f""", o AS (SELECT event_id, user_id, value AS v, x::DOUBLE AS x, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM act),
r AS (SELECT user_id, event_id, rn, [{{'v': v, 'x': x}}] AS s, false AS est, NULL::DOUBLE AS drift, false AS refreshed FROM o WHERE rn = 1
  UNION ALL SELECT user_id, event_id, rn, CASE WHEN NOT was THEN list_append(s, {{'v': v, 'x': x}}) WHEN d > {limit} THEN s[-{window // 5}:] ELSE s END,
    was OR len(s) + 1 >= {max(10, window // 4)}, d, coalesce(d > {limit}, false)
  FROM (SELECT p.user_id, p.event_id, p.rn, p.v, p.x, r.s, r.est AS was, CASE WHEN r.est THEN list_avg(list_filter([{part('v')}, {part('x')}], lambda z: z IS NOT NULL)) END AS d
    FROM r JOIN o p ON p.user_id = r.user_id AND p.rn = r.rn + 1))
SELECT event_id, est AS established, round(drift, 6) AS drift, refreshed FROM r"""


@query("stateful_baseline", passed_sql(baseline_sql(40, 0.3)))
def stateful_baseline(spark, sf):
    rows = events(spark, sf, bytes_per_trigger=BATCH_BYTES).select("user_id", "event_id", "ts", "us", "value", F.col("x").cast("double").alias("x"))
    table, _ = jobs.run(state.stateful_baseline(rows, ["value", "x"], window=40, limit=0.3), "baseline")
    return table.select("event_id", "established", r6("drift").alias("drift"), "refreshed")


@query(
    "stream_alert_dedup",
    ALERTS_SQL + " SELECT event_id, user_id, kind, band, us FROM sent WHERE us <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM a)",
)
def stream_alert_dedup(spark, sf):
    found = jobs.alerts(events(spark, sf, bytes_per_trigger=BATCH_BYTES), score(), 0.0).filter("score >= 0.5")
    rows = found.select("user_id", "kind", F.floor(F.col("score") * 10).alias("band"), "event_id", "ts", "us")
    return jobs.run(state.suppress_alerts(rows, 14_400_000_000), "dedup")[0].select("event_id", "user_id", "kind", "band", "us")


@query(
    "late_policy",
    ACT + """, f AS (SELECT us, us // 3600000000 * 3600000000 + 3600000000 AS fin, CASE event_id % 10 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS file FROM act),
m AS (SELECT max(us) FILTER (WHERE file = 1) - 600000000 AS known, max(us) - 600000000 AS last FROM f)
SELECT count(*) FILTER (WHERE fin <= last AND (file < 3 OR fin > known)) AS counted, count(DISTINCT fin) FILTER (WHERE file = 3 AND fin <= known) AS dropped_groups FROM f, m""",
)
def late_policy(spark, sf):
    """Three files in turn, the last one with late rows: what was counted, and what the watermark dropped.

    Rows are held against the watermark of the batch before, so the third file is the first to lose any.
    Dropped rows are counted by Spark after its partial aggregation, that is as window groups.
    """
    path = scratch_path(spark, "late")
    rows = read(spark, sf, "events")
    turn = F.col("event_id") % 10
    for part in (turn > 1, turn == 1, turn == 0):
        rows.filter(part).coalesce(1).write.mode("append").parquet(path)
    stream = with_roles(jobs.event_stream(spark, path, files_per_trigger=1))
    table, progress = jobs.run(jobs.tumbling(stream, "1 hour"), "late")
    dropped = sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
    return table.agg(F.sum("n").alias("counted")).withColumn("dropped_groups", F.lit(dropped))


@query(
    "stream_static_enrich",
    ACT + f""", p AS (SELECT user_id, round(avg(value), 6) AS usual FROM act GROUP BY 1),
f AS (SELECT event_id, user_id, {level_sql(SCORE, 'threat')} AS level, CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND_ANOMALIES.items())} END AS kind FROM act)
SELECT event_id, level, usual, array_to_string(list_concat({lists_sql(P.LEVEL_RECOMMENDATIONS, 'level')}, {lists_sql(P.TYPE_RECOMMENDATIONS, 'kind')}), ',') AS actions FROM f LEFT JOIN p USING (user_id)""",
)
def stream_static_enrich(spark, sf):
    """Each streamed event with its user's profile, if there is one yet, and the recommended actions."""
    profile = activity(spark, sf).groupBy("user_id").agg(r6(F.avg("value")).alias("usual"))
    table = F.create_map(*[F.lit(v) for pair in KIND_ANOMALIES.items() for v in pair])
    rows = events(spark, sf).select("event_id", "user_id", level(score(), "threat").alias("level"), table[F.col("kind")].alias("kind"))
    joined = rows.join(checked_broadcast(profile), "user_id", "left").select(
        "event_id", "level", "usual", F.array_join(recommended_actions(F.col("level"), F.col("kind")), ",").alias("actions")
    )
    return jobs.run(joined, "enriched")[0]
