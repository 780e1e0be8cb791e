"""Plain and sliced plans on rows with NULL keys, NULL times, NaN and narrow ranges; operators on empty samples."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sessionlens.operators import sequence as Q
from sessionlens.operators import windows as W
from sessionlens.operators.quality import confidence_drift, ks_drift
from sessionlens.operators.scoring import outlier_guard
from sessionlens.plans.tables import activity
from sessionlens.session import GROUP_ROWS_KEY


@pytest.fixture(scope="module")
def dirty(spark):
    """A hot user, rows without user, time or value, NaN, and scores between 0 and 1."""
    rows = activity(spark, SMALL).select("user_id", "event_id", "ts", "us", "k", "value")
    turn = F.col("event_id") % 10
    user = F.when(turn == 0, None).when(turn < 6, F.lit(1)).otherwise(F.col("user_id")).cast("long")
    time = F.when(F.col("event_id") % 17 == 3, None).otherwise(F.col("ts"))
    value = F.when(turn == 3, F.lit(float("nan"))).when(turn == 4, None).otherwise(F.col("value") / 1000)
    return rows.withColumns({"user_id": user, "ts": time, "value": value}).cache()


def both(spark, make):
    """The rows of an operator by the plain and by the sliced plan."""
    out = []
    for bound in (None, "20"):
        if bound:
            spark.conf.set(GROUP_ROWS_KEY, bound)
        try:
            out.append(sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in make().collect()))
        finally:
            spark.conf.unset(GROUP_ROWS_KEY)
    return out


def framed_list(df):
    rows, w = Q.framed(df, ["user_id"], back=3, ahead=2)
    return Q.settled(rows.withColumn("l", F.collect_list("event_id").over(w.rowsBetween(-3, 2)))).select("event_id", "l")


@pytest.mark.parametrize("make", [
    framed_list,
    lambda df: Q.running(df, ["user_id"], {"s": F.col("k")}).select("event_id", "s"),
    lambda df: Q.last_known(df, ["user_id"], {"v": F.when(F.col("k") % 7 == 0, F.col("k"))}).select("event_id", "v"),
    lambda df: Q.quantiles(df, ["user_id"], "value", {"a": 0.25, "b": 0.5, "c": 0.95}),
    lambda df: Q.attach(df, df.groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"]).select("event_id", "n"),
    lambda df: W.baseline_drift(df.filter("value IS NOT NULL AND NOT isnan(value)"), ["value", "k"], window=30, cold_start=5).select(
        "event_id", F.round("drift", 6).alias("drift"), "drifted"),
], ids=["framed", "running", "last_known", "quantiles", "attach", "baseline_drift"])
def test_both_plans_agree(spark, dirty, make):
    plain, cut = both(spark, lambda: make(dirty))
    assert plain == cut and plain


def test_rows_without_user_stay(dirty, sliced):
    got = Q.running(dirty, ["user_id"], {"s": F.lit(1)})
    assert got.count() == dirty.count()
    assert got.filter("user_id IS NULL").count() == dirty.filter("user_id IS NULL").count() > 20


def test_slices_of_narrow_values_stay_small(dirty, sliced):
    cut = Q.slices(dirty.filter("value IS NOT NULL AND NOT isnan(value)"), ["user_id"], F.col("value"))
    sizes = cut.filter(f"{Q.SLICE} >= 0").groupBy("user_id", Q.SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * 20


def test_baseline_drift_of_first_rows(dirty):
    got = W.baseline_drift(dirty.filter("value IS NOT NULL AND NOT isnan(value)"), ["value"], cold_start=10**6)
    assert got.filter("drift IS NOT NULL").isEmpty() and got.filter("drifted").isEmpty()


def test_empty_sample_has_no_drift(spark):
    rows = spark.createDataFrame([("f", 1.0), ("f", 2.0)], "feature string, x double")
    r = ks_drift(rows, F.lit(False)).first()
    assert r.statistic is None and r.p_value is None and r.drifted is False


def test_few_scores_are_insufficient(spark):
    rows = spark.range(60).select(F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"), F.lit(0.5).alias("s"))
    r = confidence_drift(rows, "s").first()
    assert r.severity == r.direction == "insufficient_data"


def test_outlier_guard_takes_nan_and_large_numbers(spark):
    rows = spark.createDataFrame([("a", float("nan")), ("a", 1.0e10), ("a", 2.5)], "k string, x double")
    assert outlier_guard(rows, ["k"], "x").first().mean_decimals == 1.0
