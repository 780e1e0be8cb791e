"""Stores with one writer per entry: rotation by bytes, a privacy budget, and the caller's own extractors and policies."""

from math import sqrt, log

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sessionlens.functions import patterns as P
from sessionlens.operators import extractors, joins, learning
from sessionlens.plans.tables import activity
from sessionlens.session import scratch_path
from sessionlens.sources import claims, ledger, rolling


def lines(spark, first, n, day_us=0):
    return spark.range(first, first + n).select(F.col("id").alias("event_id"), (F.col("id") * 10 + day_us).alias("us"), F.repeat(F.lit("x"), 20).alias("text"))


def test_segments_keep_to_their_bytes_and_the_newest_stay(spark):
    """A single hot day is cut into many segments; each holds whole lines in order, and old files are gone."""
    root = scratch_path(spark, "rolling")
    line = F.concat_ws(" ", F.lpad(F.col("event_id").cast("string"), 6, "0"), "text")
    entry = rolling.append(spark, lines(spark, 0, 2000), root, line, 1000, 9)
    assert len(entry["segments"]) == 10 and all(s["bytes"] <= 1000 + 28 for s in entry["segments"])
    held = rolling.read(spark, root).orderBy("line").collect()
    assert [int(r.line[:6]) for r in held] == list(range(2000 - len(held), 2000))
    assert [r.place for r in held] == sorted(r.place for r in held) and {r.place for r in held} == set(range(10))
    before = [s["path"] for s in entry["segments"]]
    entry = rolling.append(spark, lines(spark, 2000, 100), root, line, 1000, 9)
    assert [s["path"] for s in entry["segments"]][:7] == before[3:] and entry["dropped"] == before[:3]
    assert not any(claims.exists(spark, p) for p in before[:3]) and all(claims.exists(spark, p) for p in before[3:])
    assert rolling.append(spark, lines(spark, 0, 0), root, line, 1000, 9)["segments"] == entry["segments"]
    assert rolling.read(spark, scratch_path(spark, "none")).isEmpty()


def test_readers_follow_the_manifest_only(spark):
    root = scratch_path(spark, "rolling")
    rolling.append(spark, lines(spark, 0, 50), root, F.col("text"), 500, 3)
    n = rolling.read(spark, root).count()
    lines(spark, 0, 50).select("text").write.text(f"{root}/data/unfinished/segment=0")  # an append that failed before its manifest
    assert rolling.read(spark, root).count() == n == 50


def test_one_writer_takes_a_number(spark):
    folder = scratch_path(spark, "claims")
    assert claims.create_once(spark, f"{folder}/00000001.json", '{"entry": 1}')
    assert not claims.create_once(spark, f"{folder}/00000001.json", '{"entry": 1, "by": "other"}')
    calls = []

    def make(before):  # another writer is faster once
        if not calls:
            claims.create_once(spark, f"{folder}/00000002.json", '{"entry": 2, "by": "other"}')
        calls.append(len(before))
        return {"by": "me"}

    assert claims.append(spark, folder, make) == {"by": "me", "entry": 3} and calls == [1, 2]


def test_budget_is_spent_once_and_refused_beyond(spark):
    rows = spark.createDataFrame([(u, f"c{u % 3}") for u in range(60)], "user_id long, kind string")
    make = lambda: learning.private_counts(rows, "user_id", "kind", 0.6)
    root = scratch_path(spark, "budget")
    book = ledger.Ledger(spark, root, epsilon=1.0)
    first = sorted(map(tuple, book.release("daily", 0.6, make).collect()))
    assert sorted(map(tuple, book.release("daily", 0.6, make).collect())) == first and book.spent() == (0.6, 0)
    with pytest.raises(ledger.BudgetExceeded):
        book.release("again", 0.6, make)
    with pytest.raises(ValueError):
        book.release("daily", 0.3, make)
    assert len(ledger.Ledger(spark, root, epsilon=1.0).releases()) == 1  # another session sees the same ledger
    assert not claims.exists(spark, f"{root}/releases/again")
    book.release("rest", 0.4, lambda: rows.limit(1))
    assert book.spent()[0] == pytest.approx(1.0)


def test_a_release_that_failed_is_made_without_paying_twice(spark):
    book = ledger.Ledger(spark, scratch_path(spark, "budget"), epsilon=1.0)

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        book.release("counts", 0.7, broken)
    assert book.release("counts", 0.7, lambda: spark.range(3)).count() == 3 and book.spent()[0] == 0.7


def test_composition(spark):
    assert ledger.composed([(0.5, 0), (0.25, 1e-6)], 0) == (0.75, 1e-6)
    many, delta = ledger.composed([(0.01, 0)] * 1000, 1e-5)
    assert many == pytest.approx(sqrt(2 * 1000 * 1e-4 * log(1e5)) + 1000 * 0.01 * 0.005, rel=0.01) and many < 10 and delta == 1e-5
    assert ledger.composed([(0.5, 0)], 1e-5) == (0.5, 0)  # the plain sum is less
    assert ledger.composed([], 1e-5) == (0, 0)


def test_an_extractor_adds_no_scan(spark):
    rows = activity(spark, SMALL)
    own = extractors.standard_extractors()
    plain = own.profile(rows, ["user_id"])
    own.register("caller", lambda: {"loud": F.max(F.col("value") * F.col("twice"))}, lambda df: df.withColumn("twice", F.lit(2)))
    more = own.profile(rows, ["user_id"])
    assert set(more.columns) == {*plain.columns, "loud"}

    def plan(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        return text.count("Scan parquet"), text.count("Exchange hashpartitioning")

    assert plan(more) == plan(plain) and plan(more)[0] == 1
    assert more.agg(F.max("loud")).first()[0] == 2 * rows.agg(F.max("value")).first()[0]
    with pytest.raises(ValueError):
        own.register("caller", dict)
    own.register("clash", lambda: {"events": F.count(F.lit(1))})
    with pytest.raises(ValueError):
        own.profile(rows, ["user_id"])
    assert own.profile(rows, ["user_id"], ["contextual"]).columns == ["user_id", "applications", "devices"]


def test_a_policy_table_gives_what_the_built_in_policy_gives(spark):
    found = spark.createDataFrame(
        [(1, "high", "insider_threat", 0.9, 0.9), (2, "low", "timing_anomaly", 0.2, 0.1), (3, "odd", None, 0.9, 0.9), (4, None, "account_takeover", None, None)],
        "id long, level string, kind string, confidence double, risk double")
    built_in = joins.response_actions(F.col("level"), F.col("kind"), F.col("confidence"), F.col("risk"))
    want = {r.id: r.a for r in found.select("id", built_in.alias("a")).collect()}
    policy = extractors.default_policy(spark)
    assert {r.id: r.actions for r in extractors.respond(found, policy).collect()} == want
    changes = spark.createDataFrame([("level", "high", ["a", "b", "a"]), ("evidence", "", None)], extractors.POLICY)
    got = {r.id: r.actions for r in extractors.respond(found, extractors.overridden(policy, changes)).collect()}
    assert got[1][:3] == ["a", "b", *P.TYPE_ACTIONS["insider_threat"][:1]] and got[2] == want[2] and got[3] == []
