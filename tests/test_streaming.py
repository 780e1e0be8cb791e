"""Streams over several micro-batches against their batch twins."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sessionlens.operators.thinning import thin
from sessionlens.plans.tables import read, with_roles
from sessionlens.session import scratch_path
from sessionlens.streaming import jobs, state
from sessionlens.streaming.state import baseline_steps
from test_sequences import brute_feedback


CLOSING = 10**9  # the user of a last event that lets the watermark pass all others
SPAN = "4000 days"


@pytest.fixture(scope="module", params=[1, 4, 16])
def arrivals(spark, request):
    """The events shuffled over some files, one micro-batch each, and one event long after."""
    path = scratch_path(spark, "arrivals")
    rows = read(spark, SMALL, "events").cache()
    for part in range(request.param):
        mine = F.pmod(F.xxhash64("event_id"), F.lit(request.param)) == part
        rows.filter(mine).coalesce(1).write.mode("append").parquet(path)
    late = rows.limit(1).withColumns({"user_id": F.lit(CLOSING).cast("long"), "event_id": F.lit(CLOSING).cast("long"),
                                      "ts": F.expr("ts + INTERVAL 9000 DAYS")})
    late.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return with_roles(jobs.event_stream(spark, path, files_per_trigger=1))


def events(spark):
    return with_roles(read(spark, SMALL, "events"))


def test_risk_does_not_depend_on_batches(spark, arrivals):
    base = F.least(F.col("value") / 60, F.lit(1.0))
    columns = ["user_id", "event_id", "ts", "us", "kind", base.alias("base")]
    table, progress = jobs.run(
        state.stateful_risk(stream(spark, arrivals).select(*columns), cold_start=15, same_kind=6, lateness=SPAN), "risk")
    got = {r.event_id: r.risk for r in table.collect()}
    want = brute_feedback(events(spark).select(*columns).drop("ts").toPandas(), 15, 6)
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-12 for e in want)


def test_alert_suppression_does_not_depend_on_batches(spark, arrivals):
    band = F.floor(F.least(F.col("value") / 60, F.lit(1.0)) * 10).alias("band")
    columns = ["user_id", "kind", band, "event_id", "ts", "us"]
    got, progress = jobs.run(
        state.suppress_alerts(stream(spark, arrivals).select(*columns), 7_200_000_000, lateness=SPAN), "dedup")
    want = thin(events(spark).select(*columns), ["user_id", "kind", "band"], 7_200_000_000).collect()
    key = lambda r: (r.user_id, r.kind, r.band, r.event_id, r.us)
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 1  # all keys but the closing one are forgotten


def test_one_user_does_not_silence_another(spark):
    rows = spark.createDataFrame(
        [(u, "mouse", 9, 10 * u + i, 1000 * i + u) for u in (1, 2) for i in range(3)],
        "user_id long, kind string, band long, event_id long, us long",
    ).withColumn("ts", F.timestamp_micros("us"))
    got = thin(rows, ["user_id", "kind", "band"], 10**9)
    assert sorted(r.user_id for r in got.collect()) == [1, 2]


def test_baseline_does_not_depend_on_batches(spark, arrivals):
    columns = ["user_id", "event_id", "ts", "us", "value", F.col("x").cast("double").alias("x")]
    table, _ = jobs.run(
        state.stateful_baseline(stream(spark, arrivals).select(*columns), ["value", "x"], 40, 0.3, lateness=SPAN), "baseline")
    got = {r.event_id: (r.established, r.refreshed) for r in table.collect()}
    pdf = events(spark).select("user_id", "event_id", "us", "value", "x").toPandas()
    for _, part in pdf.sort_values(["us", "event_id"]).groupby("user_id"):
        steps, _, _ = baseline_steps(part[["value", "x"]].to_numpy(dtype=float), [], False, 40, 0.3)
        assert [got[e] for e in part["event_id"]] == [(s[0], s[2]) for s in steps]


def test_late_rows_are_dropped_and_reported(spark):
    path = scratch_path(spark, "late")
    rows = read(spark, SMALL, "events")
    turn = F.when(F.col("event_id") < 5, 3).when(F.col("event_id") < 20, 2).otherwise(1)
    for part in (1, 2, 3):
        rows.filter(turn == part).coalesce(1).write.mode("append").parquet(path)
    table, progress = jobs.run(jobs.tumbling(stream(spark, path), "1 hour"), "late")
    assert sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"]) > 0
    newest = rows.agg(F.max("ts")).first()[0]
    closed = rows.filter(turn < 3).filter(F.date_trunc("hour", "ts") + F.expr("INTERVAL 70 MINUTES") <= F.lit(newest)).count()
    assert table.agg(F.sum("n")).first()[0] == closed


def test_state_calls_grow_with_parts_not_with_keys(spark):
    path = scratch_path(spark, "many-users")
    rows = spark.range(3 * state.PARTS).select(
        F.col("id").alias("event_id"), F.timestamp_millis(F.col("id") + 1_700_000_000_000).alias("ts"),
        F.when(F.col("id") > 1, F.col("id") + 2**60).alias("user_id"), F.lit("view").alias("event_type"), F.lit(90.0).alias("value"),
        F.lit('{"k": 1}').alias("props"))
    rows.coalesce(1).write.parquet(path)
    late = rows.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "ts": F.expr("ts + INTERVAL 9 DAYS")})
    late.coalesce(1).write.mode("append").parquet(path)
    columns = ["user_id", "kind", F.lit(9).cast("long").alias("band"), "event_id", "ts", "us"]
    got, progress = jobs.run(state.suppress_alerts(stream(spark, path).select(*columns), 10**9, lateness="1 hour"), "many")
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= state.PARTS + 1
    # two alerts of no user: the second is suppressed; numbers beyond 2**53 stay as they are
    want = [(None if e == 0 else e + 2**60, e) for e in range(3 * state.PARTS) if e != 1]
    assert sorted((r.user_id or 0, r.event_id) for r in got.collect()) == sorted((u or 0, e) for u, e in want)
    assert all(r.user_id is None for r in got.collect() if r.event_id < 2)
