"""Ordered operators: hand-made sequences, and sliced groups against plain ones on skewed data."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionlens.operators import sequence as Q
from sessionlens.operators import windows as W
from sessionlens.operators.feedback import risk_with_feedback
from sessionlens.operators.thinning import FREE, chain, keep_from, step_function, thin
from sessionlens.plans.tables import activity
from sessionlens.streaming.state import feedback_step


@pytest.fixture(scope="module")
def skewed(spark):
    """Events where user 1 holds half of all rows."""
    rows = activity(spark, SMALL)
    hot = F.when(F.col("event_id") % 2 == 0, F.lit(1)).otherwise(F.col("user_id")).cast("long")
    return rows.withColumn("user_id", hot).select("user_id", "event_id", "ts", "us", "kind", "k", "value").cache()


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_group_is_really_sliced(skewed, sliced):
    cut = Q.slices(skewed, ["user_id"])
    sizes = cut.groupBy("user_id", Q.SLICE).count()
    assert sizes.filter("user_id = 1").count() > 10
    assert sizes.agg(F.max("count")).first()[0] <= 2 * 20
    assert cut.count() == skewed.count()


def test_crowded_minutes_are_cut_finer(skewed, sliced):
    dense = skewed.withColumn("ts", F.timestamp_micros(F.floor(F.col("us") / 20_000)))
    cut = Q.slices(dense, ["user_id"])
    assert cut.groupBy("user_id", Q.SLICE).count().agg(F.max("count")).first()[0] <= 2 * 20
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    rows, sw = Q.framed(dense, ["user_id"], back=3)
    got = Q.settled(rows.withColumn("l", F.collect_list("k").over(sw.rowsBetween(-3, 0)))).select("event_id", "l")
    assert rows_of(got) == rows_of(dense.select("event_id", F.collect_list("k").over(w).alias("l")))


@pytest.mark.parametrize(("back", "ahead"), [(1, 0), (7, 0), (60, 0), (0, 5), (3, 3)])
def test_framed(skewed, sliced, back, ahead):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-back, ahead)
    want = skewed.select("event_id", F.collect_list("k").over(w).alias("l"))
    rows, sw = Q.framed(skewed, ["user_id"], back=back, ahead=ahead)
    got = Q.settled(rows.withColumn("l", F.collect_list("k").over(sw.rowsBetween(-back, ahead)))).select("event_id", "l")
    assert rows_of(got) == rows_of(want)


def test_running(skewed, sliced):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("event_id", F.sum("k").over(w).alias("s"))
    sums = Q.running(skewed, ["user_id"], {"s": F.col("k")})
    assert rows_of(sums.select("event_id", "s")) == rows_of(want)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_last_known(skewed, sliced, forward, inclusive):
    value = F.when(F.col("k") % 40 == 0, F.col("k"))
    step = 0 if inclusive else 1
    bounds = (step, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, -step)
    pick = F.first if forward else F.last
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(*bounds)
    want = skewed.select("event_id", pick(value, ignorenulls=True).over(w).alias("v"))
    got = Q.last_known(skewed, ["user_id"], {"v": value}, inclusive=inclusive, forward=forward).select("event_id", "v")
    assert rows_of(got) == rows_of(want)


def test_quantiles(skewed, sliced):
    got = {r.user_id: r for r in Q.quantiles(skewed, ["user_id"], "value", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    pdf = skewed.toPandas()
    for user, part in pdf.groupby("user_id"):
        want = np.percentile(part["value"], [25, 50, 90])
        assert np.allclose([got[user].a, got[user].b, got[user].c], want)


def test_newest(skewed):
    got = {(r.user_id, r.event_id) for r in Q.newest(skewed, ["user_id"], 5).collect()}
    pdf = skewed.toPandas().sort_values(["ts", "event_id"])
    want = {(u, e) for u, part in pdf.groupby("user_id") for e in part["event_id"].tail(5)}
    assert got == want


def brute_thin(times, gap):
    kept, blocked = [], FREE
    for t in times:
        if t >= blocked:
            kept.append(t)
            blocked = t + gap
    return kept


def test_keep_from_and_chained_pieces():
    rng = np.random.default_rng(3)
    for _ in range(50):
        times = np.sort(rng.integers(0, 400, 120))
        gap = int(rng.integers(1, 40))
        assert times[keep_from(times, gap, FREE)].tolist() == brute_thin(times, gap)
        cuts = np.sort(rng.integers(0, 120, 6))
        parts = [p for p in np.split(times, cuts) if len(p)]
        entries = dict(chain([(i, *step_function(p, gap)) for i, p in enumerate(parts)]))
        kept = [t for i, p in enumerate(parts) for t in p[keep_from(p, gap, entries[i])]]
        assert kept == brute_thin(times, gap)


@pytest.mark.parametrize("hours", [1, 30])
def test_thin_sliced(skewed, sliced, hours):
    gap = hours * 3_600_000_000
    got = sorted((r.user_id, r.us) for r in thin(skewed, ["user_id"], gap).collect())
    pdf = skewed.toPandas().sort_values(["us", "event_id"])
    want = sorted((u, t) for u, part in pdf.groupby("user_id") for t in brute_thin(part["us"], gap))
    assert got == want


def brute_feedback(pdf, cold_start, same_kind):
    out = {}
    for _, part in pdf.sort_values(["us", "event_id"]).groupby("user_id"):
        finals, kinds = [], []
        for seen, (event, base, kind) in enumerate(zip(part["event_id"], part["base"], part["kind"])):
            out[event] = feedback_step(base, kind, finals, kinds, seen, cold_start, same_kind, 0.95)
    return out


@pytest.mark.parametrize("bound", ["20", "1000000"])
def test_risk_feedback(spark, skewed, bound):
    spark.conf.set(Q.GROUP_ROWS_KEY, bound)
    try:
        rows = skewed.withColumn("base", F.least(F.col("value") / 60, F.lit(1.0)))
        got = {r.event_id: r.risk for r in risk_with_feedback(rows, cold_start=15, same_kind=6).collect()}
    finally:
        spark.conf.unset(Q.GROUP_ROWS_KEY)
    want = brute_feedback(rows.toPandas(), 15, 6)
    assert got.keys() == want.keys()
    assert all(abs(got[e] - want[e]) < 1e-12 for e in want)


def test_text_segments_by_hand(spark):
    # a b < c | d < < e (a line end after c; '<' removes the last character)
    keys = ["a", "b", "<", "c", "\n", "d", "<", "<", "e"]
    rows = [(1, i, i * 500_000, key) for i, key in enumerate(keys)]
    df = spark.createDataFrame(rows, "user_id LONG, event_id LONG, us LONG, key STRING").withColumn("ts", F.timestamp_micros("us"))
    out = W.text_segments(df, F.col("key") == "\n", F.col("key") == "<", idle=2.0).orderBy("segment").collect()
    assert [(r["keys"], r["edits"], r["net_length"]) for r in out] == [(5, 1, 2), (4, 2, 1)]
    assert "key" not in out[0].asDict()


def test_ema_matches_the_recurrence(spark, skewed):
    got = {r.user_id: r.ema for r in W.moving_average(skewed, "value", 0.1, 5.0).collect()}
    for user, part in skewed.toPandas().sort_values(["ts", "event_id"]).groupby("user_id"):
        m = 5.0
        for x in part["value"]:
            m = 0.1 * x + 0.9 * m
        assert abs(got[user] - m) < 1e-9


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach(skewed, sliced, how):
    means = skewed.groupBy("user_id").agg(F.avg("value").alias("mean")).filter("user_id <> 2")
    got = Q.attach(skewed, means, ["user_id"], how).select("event_id", "mean")
    assert rows_of(got) == rows_of(skewed.join(means, "user_id", how).select("event_id", "mean"))
