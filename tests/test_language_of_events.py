"""Back-off sequence models, nested ranges and the t distribution against plain computations."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlens.functions.distributions import incomplete_beta, student_p
from sessionlens.operators import joins, windows


def test_probabilities_after_each_context_sum_to_one(spark):
    r = random.Random(4)
    rows, t = [], 0
    for user in range(6):
        for _ in range(120):
            t += 1
            rows.append((user, t, t, r.choice("aaabbcd") if user else r.choice("abab")))
    rows.append((7, t + 1, t + 1, "once"))
    df = spark.createDataFrame(rows, "user_id long, event_id long, us long, event_type string").withColumn("ts", F.timestamp_micros("us"))
    stepped = df.withColumn("_p1", F.lag("event_type").over(windows.Window.partitionBy("user_id").orderBy("ts"))).withColumn(
        "_p2", F.lag("event_type", 2).over(windows.Window.partitionBy("user_id").orderBy("ts")))
    tables = windows.ngram_tables(stepped, "event_type", 2)
    kinds = [*"abcd", "once", None, "never"]
    asked = spark.createDataFrame([(p2, p1, w) for p2 in kinds for p1 in kinds for w in kinds[:5]], "_p2 string, _p1 string, event_type string")
    out = windows.ngram_probabilities(asked, tables, "event_type", 0.75)
    sums = out.groupBy("_p2", "_p1").agg(*(F.sum(f"p{i}").alias(f"p{i}") for i in (1, 2, 3))).collect()
    assert len(sums) == 49 and all(abs(s[f"p{i}"] - 1) < 1e-9 for s in sums for i in (1, 2, 3))
    assert out.filter("p1 <= 0 OR p2 <= 0 OR p3 <= 0").isEmpty()  # unseen transitions are scored too
    usual = windows.sequence_ngrams(df.filter("user_id = 0")).orderBy("ts").collect()[-1]
    mixed = windows.sequence_ngrams(df.filter("user_id = 1")).orderBy("ts").collect()[-1]
    assert usual.likelihood_3 > mixed.likelihood_3 - 2 and usual.likelihood_1 > mixed.likelihood_1


def test_narrowest_of_nested_and_overlapping_ranges(spark):
    r = random.Random(9)
    ranges = [("all", 0, 2**16 - 1), ("half", 0, 2**15 - 1), ("one", 77, 77), ("none", 9, 3), ("null", None, 5), ("same", 100, 199), ("again", 100, 199)]
    for i in range(120):
        low = r.randrange(2**16)
        ranges.append((f"r{i}", low, min(2**16 - 1, low + r.choice([0, 1, 7, 300, 20000]))))
    table = spark.createDataFrame(ranges[1:], "place string, low long, high long")
    points = [(i, p) for i, p in enumerate([*range(70, 210), *(r.randrange(2**16) for _ in range(600)), 0, 2**16 - 1, None])]
    got = {x.id: x.place for x in joins.narrowest_range(
        spark.createDataFrame(points, "id long, ip long"), "ip", table, "low", "high", bits=16).collect()}
    for i, p in points:
        held = [(h - l, l, n) for n, l, h in ranges[1:] if p is not None and l is not None and l <= p <= h]
        assert got[i] == (min(held)[2] if held else None)
    blocks = spark.createDataFrame([(0, 2**31), (1, 2**32 - 2)], "low long, high long").select(
        F.size(joins.aligned_blocks(F.col("low"), F.col("high"), 32)).alias("n")).collect()
    assert blocks[0].n == 2 and blocks[1].n <= 64
    assert joins.narrowest_range(spark.createDataFrame([(1, 5)], "id long, ip long"), "ip", table.limit(0), "low", "high").first().place is None


# t, degrees of freedom, two-sided p: of printed tables, and closed forms for 1 and 2 degrees
TABLE = [(12.706204736432095, 1, 0.05), (4.302652729911275, 2, 0.05), (2.5705818366147395, 5, 0.05), (2.2281388519649385, 10, 0.05),
         (1.9720174778363073, 198, 0.05), (2.585697835, 500, 0.01), (1.0, 1, 0.5), (0.0, 7, 1.0), (-2.2281388519649385, 10, 0.05), (1.4142135623730951, 2, 0.2928932188134524)]


def test_p_values_of_t(spark):
    df = spark.createDataFrame([(t, float(v), p) for t, v, p in TABLE], "t double, v double, p double")
    for r in df.select("p", student_p(F.col("t"), F.col("v")).alias("q")).collect():
        assert r.q == pytest.approx(r.p, abs=1e-6)
    odd = spark.createDataFrame([(None, 3.0), (float("nan"), 3.0), (1.0, 0.0), (80.0, 300.0)], "t double, v double")
    assert [r[0] for r in odd.select(student_p(F.col("t"), F.col("v"))).collect()][:3] == [None, None, None]


def test_incomplete_beta_is_symmetric(spark):
    rows = [(a, b, x / 20) for a in (0.5, 1.0, 3.0, 60.0, 250.0) for b in (0.5, 2.0, 40.0) for x in range(21)]
    df = spark.createDataFrame(rows, "a double, b double, x double")
    a, b, x = F.col("a"), F.col("b"), F.col("x")
    for r in df.select("x", "a", "b", incomplete_beta(a, b, x).alias("l"), incomplete_beta(b, a, 1 - x).alias("r")).collect():
        assert r.l + r.r == pytest.approx(1, abs=1e-9) and 0 <= r.l <= 1
        if r.a == 1.0:
            assert r.l == pytest.approx(1 - (1 - r.x) ** r.b, abs=1e-9)
