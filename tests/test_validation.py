"""Refitted folds and calibrated margins against plain computations, and planted typists."""

import random
from collections import Counter
from math import exp, log

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sessionlens.operators import learning as L
from sessionlens.operators import validation as V


def test_gaussian_refits_see_other_folds_only(spark):
    r = random.Random(5)
    rows = [(i, i % 3, r.gauss(i % 2 * 1.5, 1), r.gauss(0, 1 + i % 2), i % 2) for i in range(240)] + [(300, 1, 9.0, 9.0, 7)]  # a class of one row
    df = spark.createDataFrame(rows, "id long, fold int, a double, b double, label int")
    got = {x.id: x.prediction for x in V.gaussian_refits(df, ["a", "b"], "label", F.col("fold")).collect()}
    for i, fold, *x, _ in rows:
        best = None
        for c in sorted({o[4] for o in rows if o[1] != fold}):
            other = [o for o in rows if o[1] != fold and o[4] == c]
            loss = -log(len(other))
            for k, v in enumerate(x):
                mean = sum(o[2 + k] for o in other) / len(other)
                var = sum((o[2 + k] - mean) ** 2 for o in other) / len(other) + 1e-9
                loss += (log(var) + (v - mean) ** 2 / var) / 2
            best = min(best or (1e300, c), (loss, c))
        assert got[i] == best[1]
    report = {x.fold: x for x in V.fold_report(V.gaussian_refits(df, ["a", "b"], "label", F.col("fold"))).collect()}
    label = {o[0]: (o[1], o[4]) for o in rows}
    for fold in range(3):
        mine = [(label[i][1], p) for i, p in got.items() if label[i][0] == fold]
        assert report[str(fold)].n == len(mine) and report[str(fold)].accuracy == pytest.approx(sum(a == b for a, b in mine) / len(mine))
        claimed, held, hits = Counter(p for _, p in mine), Counter(a for a, _ in mine), Counter(a for a, b in mine if a == b)
        assert report[str(fold)].precision == pytest.approx(sum(held[c] * (hits[c] / claimed[c] if claimed[c] else 0) for c in held) / len(mine))
    mean = sum(report[str(k)].accuracy for k in range(3)) / 3
    assert report["mean"].accuracy == pytest.approx(mean)
    assert report["std"].accuracy == pytest.approx((sum((report[str(k)].accuracy - mean) ** 2 for k in range(3)) / 3) ** 0.5)


def test_refits_never_score_rows_they_learned(spark):
    class Seen:
        def __init__(self, ids):
            self.ids = ids

        def transform(self, df):
            return df.withColumn("learned", F.col("id").isin(self.ids))

    out = V.refitted(spark.range(40), lambda train: Seen([x.id for x in train.collect()]), F.col("id") % 4, 4)
    assert out.count() == 40 and out.filter("learned").isEmpty() and out.select("fold").distinct().count() == 4


def test_sigmoids_are_the_best_ones(spark):
    r = random.Random(2)
    rows = []
    for person, (a, b) in enumerate(((2.0, -1.0), (0.7, 0.5), (30.0, 0.0))):
        for _ in range(400):
            m = r.gauss(0, 1.5)
            rows.append((person, m, r.random() < 1 / (1 + exp(-(a * m + b)))))
    rows += [(3, float(m), m > 0) for m in range(-20, 21)]  # separable
    df = spark.createDataFrame(rows, "person int, margin double, hit boolean")
    fits = V.sigmoid_fits(df, "person", "margin", "hit")
    assert fits[0][0] == pytest.approx(2.0, abs=0.5) and fits[1][1] == pytest.approx(0.5, abs=0.3) and fits[3][0] < 100
    for person, (a, b) in fits.items():
        own = [(m, h) for p, m, h in rows if p == person]
        up = sum(h for _, h in own)
        high, low = (up + 1) / (up + 2), 1 / (len(own) - up + 2)
        gap = [1 / (1 + exp(-max(-700, min(700, a * m + b)))) - (high if h else low) for m, h in own]
        assert abs(sum(gap)) < 1e-4 and abs(sum(g * m for g, (m, _) in zip(gap, own, strict=True))) < 1e-4
    assert V.sigmoid_fits(df.limit(0), "person", "margin", "hit") == {}


def test_planted_typists_are_told_apart(spark):
    r = random.Random(1)
    rows = [(i, i % 4, [r.gauss(80 + 40 * (i % 2), 8), r.gauss(200 + 90 * (i % 4 // 2), 15), r.gauss(0, 1)]) for i in range(320)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>").withColumn("features", array_to_vector("v"))
    train, held_out = L.stratified_split(df, "label", "id")
    found = L.identity_scores(train, held_out, 3, 4)
    assert set(found) == {"forest", "svm", "network"}
    for name, scored in found.items():
        got = scored.select("label", "prediction", "probabilities").collect()
        assert all(abs(sum(x.probabilities) - 1) < 1e-9 and len(x.probabilities) == 4 for x in got)
        right = sum(x.label == x.probabilities.index(max(x.probabilities)) for x in got) / len(got)
        assert right > (0.6 if name == "network" else 0.9), (name, right)


def test_draws_depend_on_their_key_only(spark):
    df = spark.range(20_000).select("id", L.drawn(F.xxhash64("id", F.lit(3))).alias("z"))
    again = {r.id: r.z for r in df.repartition(7).collect()}
    values = [again[i] for i in range(20_000)]
    assert {r.id: r.z for r in df.collect()} == again
    mean = sum(values) / len(values)
    assert abs(mean) < 0.03 and abs(sum((v - mean) ** 2 for v in values) / len(values) - 1) < 0.05
    assert 0.65 < sum(abs(v) < 1 for v in values) / len(values) < 0.72


def test_threats_are_told_from_the_day_before(spark):
    """Targets lie a day ahead, and each row is scored by a model of other users."""
    from conftest import SMALL

    from sessionlens.plans import models

    days, columns = models.daily_indicators(spark, SMALL)
    rows = {(r.user_id, r.day): r for r in days.collect()}
    assert not {"privilege", "transfer"} & set(columns)
    for (user, day), r in rows.items():
        later = min((d for u, d in rows if u == user and d > day), default=None)
        if later:
            after = rows[user, later]
            assert r.privilege == int(after.admin_elevation + after.sudo_usage > 0)
            assert r.transfer == int(after.file_transfer + after.cloud_services + after.network_upload > 0)
    scored = models.threat_classifiers(spark, SMALL).collect()
    assert len(scored) == len(rows) and all(0 <= r.p_privilege <= 1 and 0 <= r.p_transfer <= 1 for r in scored)
