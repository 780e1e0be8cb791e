"""Model evaluation, confidence, drift, and the models themselves."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionlens.functions import levels, text
from sessionlens.operators import explain, forest
from sessionlens.operators import learning as L
from sessionlens.operators import quality as Q
from sessionlens.operators import validation as V
from sessionlens.operators.aggregates import r6, share
from sessionlens.operators.joins import long_features
from sessionlens.operators.sequence import framed, settled
from sessionlens.plans.catalog import query
from sessionlens.plans.joins import SCORE, score
from sessionlens.plans.rows import level_sql
from sessionlens.plans.tables import ACT, activity, read, texts
from sessionlens.plans.windows import rows_sql
from sessionlens.session import cut_lineage

LABELLED_SQL = """WITH l AS (SELECT doc_id, n_chars, quality AS label, CASE WHEN n_chars BETWEEN 300 AND 6000 THEN 1 ELSE 0 END AS prediction,
  least(0.99, n_chars / 3000.0) AS p FROM documents JOIN labels USING (doc_id))"""


def labelled(spark, sf):
    """Documents with their label and a plain rule's prediction, standing in for a model's output."""
    documents = read(spark, sf, "documents").select("doc_id", "n_chars")
    joined = documents.join(read(spark, sf, "labels"), "doc_id")
    return joined.select(
        "doc_id", "n_chars", F.col("quality").alias("label"), F.col("n_chars").between(300, 6000).cast("int").alias("prediction"),
        F.least(F.lit(0.99), F.col("n_chars") / 3000).alias("p"),
    )


CLASS_SQL = LABELLED_SQL + """, c AS (SELECT label AS class, count(*) AS support, count(*) FILTER (WHERE label = prediction) AS hits FROM l GROUP BY 1),
q AS (SELECT prediction AS class, count(*) AS claimed FROM l GROUP BY 1), r AS (SELECT class, support, coalesce(hits / nullif(claimed, 0), 0) AS precision, hits / support AS recall FROM c LEFT JOIN q USING (class)),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)"""


@query(
    "class_report",
    CLASS_SQL + " SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f",
)
def class_report(spark, sf):
    report = Q.class_report(labelled(spark, sf))
    return report.select("class", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "validate_model",
    CLASS_SQL + """, w AS (SELECT CAST(sum(support) AS BIGINT) AS n, sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall,
  sum(f1 * support) / sum(support) AS f1 FROM f), v AS (SELECT avg(a) AS m, stddev_pop(a) AS s FROM (SELECT doc_id % 5 AS fold, avg((label = prediction)::INT) AS a FROM l GROUP BY 1))
SELECT n, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(recall, 6) AS accuracy, round(m, 6) AS cv_mean, round(s, 6) AS cv_std FROM w, v""",
)
def validate_model(spark, sf):
    rows = labelled(spark, sf)
    whole = Q.weighted_report(Q.class_report(rows))
    folds = Q.fold_accuracy(rows, F.col("doc_id") % 5)
    out = whole.withColumns({c: folds.select(c).scalar() for c in ("cv_mean", "cv_std")})
    return out.select("n", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy", "cv_mean", "cv_std")])


REGISTRY_SQL = """WITH g AS (SELECT event_type AS model, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) + 1 AS version, round(avg(least(value / 120, 1.0)), 6) AS metric, count(*) AS samples,
  sha256(event_type || ':' || (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1)) AS checksum, max(epoch_us(ts)) AS trained_at FROM events GROUP BY 1, 2, 5)"""


def registry(spark, sf):
    """One version per model and day."""
    version = (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).cast("long")
    return activity(spark, sf).groupBy(F.col("event_type").alias("model"), version.alias("version")).agg(
        F.round(F.avg(score()), 6).alias("metric"), F.count(F.lit(1)).alias("samples"), F.max("us").alias("trained_at")
    ).withColumn("checksum", F.sha2(F.concat_ws(":", "model", "version"), 256))


@query(
    "model_registry",
    REGISTRY_SQL + """SELECT model, count(*) AS versions, max(version) AS active_version, arg_max(metric, version) AS active_metric, first(version ORDER BY metric DESC, version) AS best_version,
  max(metric) AS best_metric, round(arg_max(metric, version) - arg_min(metric, version), 6) + 0.0 AS change, arg_max(checksum, version) AS checksum FROM g GROUP BY 1""",
)
def model_registry(spark, sf):
    return Q.registry_summary(registry(spark, sf)).withColumn("change", r6("change"))


DRIFT_SQL = """, n AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY version) AS rn, count(*) OVER (PARTITION BY model) AS runs FROM g),
d AS (SELECT model, max(runs) AS runs, avg(metric) FILTER (WHERE rn <= runs - 3) - avg(metric) FILTER (WHERE rn > runs - 3) AS drop_ FROM n WHERE runs >= 5 GROUP BY 1)"""


@query(
    "perf_drift",
    REGISTRY_SQL + DRIFT_SQL + """ SELECT model, runs, round(drop_, 6) + 0.0 AS "drop", drop_ > 0.05 AS drifted FROM d""",
)
def perf_drift(spark, sf):
    return Q.performance_drift(registry(spark, sf)).withColumn("drop", r6("drop"))


@query(
    "ks_drift",
    """WITH s AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate >= TIMESTAMP '1995-07-01' AS late FROM lineitem),
long AS (SELECT 'quantity' AS feature, l_quantity AS x, late FROM s UNION ALL SELECT 'price', l_extendedprice, late FROM s UNION ALL SELECT 'discount', l_discount, late FROM s UNION ALL SELECT 'tax', l_tax, late FROM s),
c AS (SELECT feature, x, count(*) FILTER (WHERE NOT late) AS a, count(*) FILTER (WHERE late) AS b FROM long GROUP BY 1, 2),
u AS (SELECT feature, sum(a) OVER (PARTITION BY feature ORDER BY x) AS ca, sum(b) OVER (PARTITION BY feature ORDER BY x) AS cb, sum(a) OVER (PARTITION BY feature) AS n, sum(b) OVER (PARTITION BY feature) AS m FROM c),
k AS (SELECT feature, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m, max(abs(ca / n - cb / m)) AS d FROM u GROUP BY 1),
t AS (SELECT *, sqrt(n::DOUBLE * m / (n + m)) * d AS z FROM k),
p AS (SELECT *, CASE WHEN z < 0.2 THEN 1.0 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * j * j * z * z))))) END AS pv FROM t)
SELECT feature, n, m, round(d, 6) AS statistic, round(pv, 6)::DOUBLE AS p_value, pv < 0.05 AS drifted FROM p""",
)
def ks_drift(spark, sf):
    late = F.col("l_shipdate") >= F.lit("1995-07-01").cast("timestamp")
    rows = read(spark, sf, "lineitem").withColumn("late", late)
    columns = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    long = long_features(rows, ["late"], {n: F.col(c) for n, c in columns.items()})
    out = Q.ks_drift(long, F.col("late"))
    return out.withColumns({"statistic": r6("statistic"), "p_value": r6("p_value")})


@query(
    "retrain_due",
    REGISTRY_SQL + DRIFT_SQL + """, a AS (SELECT max(epoch_us(ts)) AS now FROM events), f AS (SELECT model, min(trained_at) AS trained_at, CAST(sum(samples) AS BIGINT) AS samples FROM g GROUP BY 1)
SELECT model, samples, CASE WHEN drop_ > 0.01 THEN 'drift' ELSE 'interval' END AS reason FROM f JOIN d USING (model), a
WHERE samples >= 2000 AND (drop_ > 0.01 OR (now - trained_at) / 86400000000.0 >= 7)""",
)
def retrain_due(spark, sf):
    versions = registry(spark, sf)
    as_of = read(spark, sf, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).scalar()
    first = versions.groupBy("model").agg(F.min("trained_at").alias("trained_at"), F.sum("samples").alias("samples"))
    drift = Q.performance_drift(versions, limit=0.01).select("model", "drifted")
    return Q.retrain_due(first.join(drift, "model"), as_of, 7, 2000).select("model", "samples", "reason")


@query(
    "calibration_metrics",
    LABELLED_SQL + """, b AS (SELECT ceil(p * 10) AS bin, count(*) AS n, avg(p) AS c, avg(((p > 0.5)::INT = label)::INT) AS a, sum((p - label) ** 2) AS sq, sum(-(label * ln(p) + (1 - label) * ln(1 - p))) AS loss FROM l GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(sq) / sum(n), 6) AS brier, round(sum(loss) / sum(n), 6) AS log_loss, round(sum(abs(c - a) * n) / sum(n), 6) AS ece FROM b""",
)
def calibration_metrics(spark, sf):
    out = Q.calibration(labelled(spark, sf), "p", "label")
    return out.select("n", *[r6(c).alias(c) for c in ("brier", "log_loss", "ece")])


PROBS = "k + 1.0, value + 1.0, 40.0"
PROBS_SQL = ACT + f""", w AS (SELECT event_id, ts, user_id, us, [{PROBS}]::DOUBLE[] AS w FROM act), p AS (SELECT event_id, ts, user_id, us, list_transform(w, lambda x: x / list_sum(w)) AS p FROM w),
c AS (SELECT *, list_reverse_sort(p) AS d, list_sort(p) AS u, -list_sum(list_transform(p, lambda x: x * ln(x + 1e-10))) AS h FROM p)"""


def probabilities(spark, sf):
    """A class distribution per event."""
    weights = F.array((F.col("k") + 1).cast("double"), F.col("value") + 1, F.lit(40.0))
    rows = activity(spark, sf).select("user_id", "event_id", "ts", "us", "k", "value", weights.alias("_w"))
    return rows.withColumn("_t", levels.array_sum(F.col("_w"))).withColumn("p", F.transform("_w", lambda x: x / F.col("_t"))).drop("_w", "_t")


@query(
    "confidence_metrics",
    PROBS_SQL + """SELECT event_id, round(d[1], 6) AS confidence, round(d[1] - d[2], 6) AS margin, round((d[1] - d[2]) / d[1], 6) AS normalized_margin, round(h, 6) AS entropy, round(1 - h / ln(3), 6) + 0.0 AS entropy_confidence,
  round(2 * (u[1] + 2 * u[2] + 3 * u[3]) / (3 * list_sum(u)) - 4.0 / 3, 6) + 0.0 AS gini_coefficient, round(list_var_pop(p), 6) AS probability_variance, round(d[1] + d[2], 6) AS top_2_confidence FROM c""",
)
def confidence_metrics(spark, sf):
    measures = levels.probability_measures(F.col("p"), 3)
    measures.pop("top_3_confidence")
    return probabilities(spark, sf).select("event_id", *[r6(c).alias(n) for n, c in measures.items()])


RELIABLE_SQL = PROBS_SQL + """, rel AS (SELECT event_id, ts, user_id, us, d[1] AS confidence, greatest(0, least(1, d[1] - h / ln(10) + greatest(0, 0.1 - 0.02) + (d[1] - d[2]) / d[1] * 0.1)) AS reliability FROM c)"""


def reliable(spark, sf):
    p = F.col("p")
    measures = levels.probability_measures(p, 3)
    score_of = levels.reliability(measures["confidence"], measures["entropy"], F.lit(0.02), measures["normalized_margin"])
    return probabilities(spark, sf).select(
        "user_id", "event_id", "ts", "us", measures["confidence"].alias("confidence"), score_of.alias("reliability")
    )


@query("reliability", RELIABLE_SQL + " SELECT event_id, round(confidence, 6) AS confidence, round(reliability, 6)::DOUBLE AS reliability FROM rel")
def reliability(spark, sf):
    return reliable(spark, sf).select("event_id", r6("confidence").alias("confidence"), r6("reliability").alias("reliability"))


ENSEMBLE = [("k + 1.0", "value + 1.0", "40.0"), ("k + 20.0", "value + 1.0", "60.0"), ("100.0 - k", "value * 0.5 + 1", "50.0")]


@query(
    "uncertainty_metrics",
    ACT + ", raw_w AS (" + " UNION ALL ".join(
        f"SELECT event_id, {m} AS model, {c} AS class, (({w}) / ({' + '.join(f'({x})' for x in ws)}))::DOUBLE AS p FROM act" for m, ws in enumerate(ENSEMBLE) for c, w in enumerate(ws)
    ) + """), pc AS (SELECT event_id, class, avg(p) AS m, var_pop(p) AS v, sum(-p * ln(p + 1e-10)) AS own FROM raw_w GROUP BY 1, 2),
s AS (SELECT event_id, avg(v) AS epistemic, sum(-m * ln(m + 1e-10)) AS aleatoric, sum(-m * ln(m + 1e-10)) - sum(own) / 3 AS mi, 1 - max(m) AS predictive FROM pc GROUP BY 1),
ch AS (SELECT event_id, model, first(class ORDER BY p DESC, class) AS choice FROM raw_w GROUP BY 1, 2), ag AS (SELECT event_id, 1 - var_pop(choice) / count(DISTINCT choice) AS agreement FROM ch GROUP BY 1)
SELECT event_id, round(epistemic, 6) AS epistemic, round(aleatoric, 6) AS aleatoric, round(mi, 6) + 0.0 AS mutual_information, round(predictive, 6) AS predictive, round(aleatoric + epistemic, 6) AS total,
  round(agreement, 6) AS agreement FROM s JOIN ag USING (event_id)""",
)
def uncertainty_metrics(spark, sf):
    rows = activity(spark, sf)
    structs = []
    for m, weights in enumerate(ENSEMBLE):
        exprs = [F.expr(w.replace(".0", ".0D").replace("0.5", "0.5D")).cast("double") for w in weights]
        total = exprs[0] + exprs[1] + exprs[2]
        structs += [F.struct(F.lit(m).alias("model"), F.lit(c).alias("class"), (e / total).alias("p")) for c, e in enumerate(exprs)]
    long = rows.select("event_id", F.inline(F.array(*structs)))
    out = Q.uncertainty(long)
    names = ["epistemic", "aleatoric", "mutual_information", "predictive", "total", "agreement"]
    return out.select("event_id", *[r6(n).alias(n) for n in names])


@query(
    "confidence_stats",
    RELIABLE_SQL + f"""SELECT {level_sql('confidence', 'confidence')} AS level, count(*) AS predictions, round(avg(reliability), 6) AS mean_score, round(count(*) / (SELECT count(*) FROM rel), 6) AS share FROM rel GROUP BY 1""",
)
def confidence_stats(spark, sf):
    rows = reliable(spark, sf).withColumn("level", levels.level(F.col("confidence"), "confidence"))
    out = Q.confidence_levels(rows, "level", "reliability")
    return out.withColumns({"mean_score": r6("mean_score"), "share": r6("share")})


@query(
    "confidence_trend",
    RELIABLE_SQL + f"""SELECT event_id, round(avg(reliability) OVER w, 6) AS recent_mean, round(stddev_pop(reliability) OVER w, 6) AS recent_std FROM rel WINDOW w AS {rows_sql(99)}""",
)
def confidence_trend(spark, sf):
    """Mean and deviation of the last 100 scores of a user."""
    rows, w = framed(reliable(spark, sf), ["user_id"], back=100)
    frame = w.rowsBetween(-99, 0)
    out = settled(
        rows.withColumns({"recent_mean": F.avg("reliability").over(frame), "recent_std": F.stddev_pop("reliability").over(frame)})
    )
    return out.select("event_id", r6("recent_mean").alias("recent_mean"), r6("recent_std").alias("recent_std"))


CONF_DRIFT_SQL = RELIABLE_SQL + """, nn AS (SELECT reliability AS s, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM rel),
ww AS (SELECT avg(s) FILTER (WHERE rn <= 100) AS rm, avg(s) FILTER (WHERE rn > 100) AS om, stddev_pop(s) FILTER (WHERE rn <= 100) AS rs, stddev_pop(s) FILTER (WHERE rn > 100) AS os,
  median(s) FILTER (WHERE rn <= 100) AS rmed, median(s) FILTER (WHERE rn > 100) AS omed, var_samp(s) FILTER (WHERE rn <= 100) AS vn, var_samp(s) FILTER (WHERE rn > 100) AS vm FROM nn WHERE rn <= 200),
dd AS (SELECT *, rm - om AS drift, (om - rm) / sqrt((99 * vn + 99 * vm) / 198 * (2 / 100)) AS t, CASE WHEN abs(rm - om) > 0.1 THEN 'high' WHEN abs(rm - om) > 0.05 THEN 'medium' ELSE 'low' END AS severity FROM ww),
pp AS (SELECT 1 - sin(atan(abs(t) / sqrt(198))) * (SELECT sum(exp(lgamma(i + 0.5) - lgamma(i + 1) - ln(pi()) / 2 + i * ln(198 / (198 + t * t)))) FROM range(99) r(i)) AS p FROM dd)"""


@query(
    "confidence_drift",
    CONF_DRIFT_SQL + """SELECT round(rm, 6) AS recent_mean, round(om, 6) AS older_mean, round(rs, 6) AS recent_std, round(os, 6) AS older_std, round(rmed, 6) AS recent_median, round(omed, 6) AS older_median,
  round(drift, 6) + 0.0 AS mean_drift, round(t, 6) + 0.0 AS t_statistic, severity, CASE WHEN drift > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, round(p, 6) + 0.0 AS p_value FROM dd, pp""",
)
def confidence_drift(spark, sf):
    out = Q.confidence_drift(reliable(spark, sf), "reliability")
    return out.select(*[c if c in ("severity", "direction") else r6(c).alias(c) for c in out.columns])


@query(
    "recalibration",
    CONF_DRIFT_SQL + """, u AS (SELECT user_id, avg((confidence < 0.6)::INT) AS low_share, CAST(floor(((SELECT max(us) FROM rel) - min(us)) / 86400000000.0) AS BIGINT) + 5 AS days_since FROM rel GROUP BY 1),
j AS (SELECT user_id, days_since, low_share, severity = 'high' AS high, p < 0.05 AS significant, low_share > 0.3 AS low FROM u, dd, pp)
SELECT user_id, high OR significant OR low AS needed, CASE WHEN high OR low THEN 'high' WHEN significant THEN 'medium' WHEN days_since > 30 THEN 'medium' ELSE 'low' END AS priority,
  high::INT + significant::INT + (days_since > 30)::INT + low::INT AS reasons FROM j""",
)
def recalibration(spark, sf):
    rows = reliable(spark, sf)
    as_of = rows.agg(F.max("us")).scalar()
    drift = Q.confidence_drift(rows, "reliability")
    days = F.floor((as_of - F.min("us")) / 86_400_000_000.0) + 5
    users = rows.groupBy("user_id").agg(share(F.col("confidence") < 0.6).alias("low_share"), days.alias("days_since"))
    joined = users.withColumns(
        {"severity": drift.select("severity").scalar(), "significant": drift.select("p_value").scalar() < 0.05}
    )
    out = Q.recalibration(joined)
    return out.select("user_id", "needed", "priority", F.size("reasons").alias("reasons"))


@query(
    "performance_summary",
    LABELLED_SQL + """SELECT prediction, count(*) AS n, round(avg((label = prediction)::INT), 6) AS accuracy, round(avg(greatest(p, 1 - p)), 6) AS mean_confidence,
  round(stddev_pop(greatest(p, 1 - p)), 6) AS std_confidence, round(avg((greatest(p, 1 - p) < 0.7)::INT), 6) AS low_share FROM l GROUP BY 1""",
)
def performance_summary(spark, sf):
    sure = F.greatest(F.col("p"), 1 - F.col("p"))
    return labelled(spark, sf).groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"), r6(share(F.col("label") == F.col("prediction"))).alias("accuracy"), r6(F.avg(sure)).alias("mean_confidence"),
        r6(F.stddev_pop(sure)).alias("std_confidence"), r6(share(sure < 0.7)).alias("low_share"),
    )


# --- models -----------------------------------------------------------------------------------------------

DOC_FEATURES = ["n_chars", "words", "digits", "capitals", "lines"]


def document_rows(spark, sf, label: str = "quality"):
    """Labelled documents with plain text features."""
    t = F.col("text")
    documents = texts(spark, sf).select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        text.word_count(t).cast("double").alias("words"),
        text.digit_share(t).alias("digits"),
        (F.regexp_count(t, F.lit("[A-Z]")) / F.greatest(F.length(t), F.lit(1))).alias("capitals"),
        F.regexp_count(t, F.lit("\n")).cast("double").alias("lines"),
    )
    labels = read(spark, sf, "labels").select("doc_id", F.col(label).alias("label"))
    return documents.join(labels, "doc_id")


def embeddings(spark, sf):
    rows = read(spark, sf, "embeddings")
    return rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


SCALED_SQL = """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
s AS (SELECT vec_id, d, CASE WHEN stddev_pop(x) OVER (PARTITION BY d) > 0 THEN (x - avg(x) OVER (PARTITION BY d)) / stddev_pop(x) OVER (PARTITION BY d) ELSE 0 END AS z FROM e)"""


@query(
    "vectorize_scale",
    SCALED_SQL + " SELECT vec_id, round(max(CASE WHEN d = 1 THEN z END), 6) AS first_scaled, round(sqrt(sum(z * z)), 6) AS length FROM s GROUP BY 1",
)
def vectorize_scale(spark, sf):
    scaled = L.standardise(embeddings(spark, sf), "vec_id", "embedding")
    length = F.sqrt(levels.array_sum(F.transform("scaled", lambda x: x * x)))
    return scaled.select("vec_id", r6(F.get("scaled", F.lit(0))).alias("first_scaled"), r6(length).alias("length"))


@query("pca_95")
def pca_95(spark, sf):
    projected, k = L.principal(L.standardise(embeddings(spark, sf), "vec_id", "embedding"))
    kept = levels.array_sum(F.transform("components", lambda x: x * x))
    return projected.select("vec_id", F.lit(k).alias("components_kept"), r6(kept).alias("kept_square"))


@query(
    "robust_minmax_scale",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
SELECT event_id, round((value - q2) / (q3 - q1), 9) + 0.0 AS robust, round((value - lo) / (hi - lo), 9) AS minmax FROM events JOIN q USING (event_type)""",
)
def robust_minmax_scale(spark, sf):
    rows = read(spark, sf, "events").select("event_id", "event_type", "value")
    out = L.robust_and_minmax(rows, ["event_type"], "value")
    return out.select("event_id", (F.round("robust", 9) + F.lit(0.0)).alias("robust"), F.round("minmax", 9).alias("minmax"))


@query("isolation_forest")
def isolation_forest(spark, sf):
    rows = embeddings(spark, sf)
    nodes = forest.fit(rows, "vec_id", "embedding")
    scored = forest.score(rows, "embedding", nodes)
    limit = forest.cutoff(scored, "anomaly_score", 0.1)
    return scored.select("vec_id", r6("anomaly_score").alias("anomaly_score"), (F.col("anomaly_score") > limit).alias("is_anomaly"))


@query("one_class")
def one_class(spark, sf):
    scored = L.kernel_distance(embeddings(spark, sf), "embedding")
    limit = forest.cutoff(scored, "distance", 0.1)
    return scored.select("vec_id", r6("distance").alias("distance"), (F.col("distance") > limit).alias("is_anomaly"))


@query(
    "density_outlier",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn FROM events),
p AS (SELECT a.event_type, a.event_id, abs(a.value - b.value) AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.value - b.value)) AS n FROM o a JOIN o b ON a.event_type = b.event_type AND b.rn BETWEEN a.rn - 5 AND a.rn + 5 AND a.rn <> b.rn),
k AS (SELECT event_type, event_id, d FROM p WHERE n = 5), m AS (SELECT event_type, avg(d) AS m FROM k GROUP BY 1)
SELECT event_id, round(d, 6) AS k_distance, round(d / m, 6) AS outlier_score, d / m > 3 AS is_outlier FROM k JOIN m USING (event_type)""",
)
def density_outlier(spark, sf):
    rows = read(spark, sf, "events").select("event_id", "event_type", "value")
    out = L.neighbour_distance(rows, ["event_type"], "value", "event_id", k=5)
    return out.select(
        "event_id", r6("k_distance").alias("k_distance"), r6("outlier_score").alias("outlier_score"), (F.col("outlier_score") > 3).alias("is_outlier")
    )


@query("reconstruction_error")
def reconstruction_error(spark, sf):
    projected, _ = L.principal(L.standardise(embeddings(spark, sf), "vec_id", "embedding"), keep=0.8)
    error = projected.withColumn("error", L.reconstruction_error(projected))
    return error.select("vec_id", r6("error").alias("error"), r6(F.least(F.col("error") / 10, F.lit(1.0))).alias("anomaly_score"))


def cross_fitted(rows, score):
    """All rows, each hash half scored by `score(half, train)` with the other half as `train`."""
    one, two = L.stratified_split(rows, "label", "doc_id", 0.5)
    return score(one, two).unionByName(score(two, one))


@query("supervised_anomaly")
def supervised_anomaly(spark, sf):
    """Toxicity forests; each document is scored by the one that has not learned it."""
    rows = L.assembled(document_rows(spark, sf, "toxic"), DOC_FEATURES)
    scored = cross_fitted(rows, lambda half, train: L.supervised(half, train=train))
    return scored.select("doc_id", "label", r6("p").alias("p"), (F.col("p") > 0.5).alias("is_anomaly"))


PRIVILEGE, TRANSFER = ["admin_elevation", "sudo_usage"], ["file_transfer", "cloud_services", "network_upload"]


def daily_indicators(spark, sf):
    """Indicator counts of a user's day, and whether the next active day has privilege or transfer indicators."""
    flags = text.keyword_flags(PRIVILEGE + TRANSFER)
    days = activity(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(
        *[F.count_if(c).cast("double").alias(n) for n, c in flags.items()], F.avg(F.hour("ts")).alias("hour"), F.count(F.lit(1)).cast("double").alias("events"))
    by_day = Window.partitionBy("user_id").orderBy("day")  # a row per day

    def ahead(names):
        return (F.lead(sum([F.col(n) for n in names[1:]], F.col(names[0]))).over(by_day) > 0).cast("int")

    return days.withColumns({"privilege": ahead(PRIVILEGE), "transfer": ahead(TRANSFER)}).filter("privilege IS NOT NULL"), [*flags, "hour", "events"]


@query("threat_classifiers")
def threat_classifiers(spark, sf):
    """Will the user's next active day show privilege use, and will it show transfers: one model for each target.

    Every row is scored by a model of other users; rare positives get noisy copies; the features are written once."""
    days, columns = daily_indicators(spark, sf)
    out = cut_lineage(L.assembled(days, columns))
    for target, fit in {"privilege": L.privilege_model, "transfer": L.transfer_model}.items():
        def one(train, target=target, fit=fit):
            rows = train.select(*columns, F.col(target).alias("label"))
            return fit(L.assembled(L.with_noise_positives(rows, columns), columns))

        scored = V.refitted(out.drop("fold"), one, F.pmod(F.xxhash64("user_id"), F.lit(2)), 2, parallelism=2)
        out = scored.withColumn(f"p_{target}", r6(L.probability_of_one())).drop("rawPrediction", "probability", "prediction")
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "privilege", "transfer", "p_privilege", "p_transfer")


TYPISTS = 5


def typing_sessions(spark, sf):
    """How a typist typed in a session of ten days: dwell and flight times, presses, and the pairs of keys by their place.

    The typists are groups of users, as the given events are too few for a model of each user."""
    rows, w = framed(activity(spark, sf), ["user_id"], back=1)
    steps = settled(rows.withColumns({"_us": F.lag("us").over(w), "_k": F.lag("k").over(w)}))
    flight = F.ln(1 + (F.col("us") - F.col("_us")) / 1e6)
    pair = (F.col("_k") % 3) * 3 + F.col("k") % 3
    zero = F.lit(0.0)
    sessions = steps.groupBy("user_id", F.floor(F.dayofyear("ts") / 10).alias("session")).agg(
        F.avg("value").alias("dwell"), F.coalesce(F.stddev_pop("value"), zero).alias("dwell_std"),
        F.coalesce(F.avg(flight), zero).alias("flight"), F.coalesce(F.stddev_pop(flight), zero).alias("flight_std"),
        share(F.col("action") == "press").alias("presses"),
        *[F.coalesce(share(pair == i), zero).alias(f"pair{i}") for i in range(9)])
    names = [c for c in sessions.columns if c not in ("user_id", "session")]
    return L.assembled(sessions, names).select(
        "user_id", "session", (F.col("user_id") % TYPISTS).cast("int").alias("label"), "features"), len(names)


@query("typing_identity")
def typing_identity(spark, sf):
    """Who is it: accuracy of three classifiers on held-out sessions, and the share accepted at a probability of 0.8."""
    sessions, inputs = typing_sessions(spark, sf)
    rows = cut_lineage(sessions)
    train, held_out = L.stratified_split(rows, "label", F.hash("user_id", "session"))
    out = None
    for name, scored in L.identity_scores(train, held_out, inputs, TYPISTS).items():
        part = scored.agg(
            F.lit(name).alias("model"), r6(share(F.col("prediction") == F.col("label"))).alias("accuracy"),
            r6(share(F.array_max("probabilities") >= 0.8)).alias("accepted"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.union(part)
    return out


REFIT_SQL = """WITH x AS (SELECT doc_id, quality AS label, doc_id % 5 AS fold, ln(1 + n_chars) AS a, ln(1 + length(text) - length(replace(text, chr(10), ''))) AS b,
  ln(1 + length(regexp_replace(text, '[^A-Z]', '', 'g'))) AS c FROM documents JOIN labels USING (doc_id)),
o AS (SELECT f.fold, x.label AS k, count(*) AS n, avg(a) AS ma, var_pop(a) + 1e-9 AS va, avg(b) AS mb, var_pop(b) + 1e-9 AS vb, avg(c) AS mc, var_pop(c) + 1e-9 AS vc
  FROM x, (SELECT DISTINCT fold FROM x) f WHERE x.fold <> f.fold GROUP BY ALL),
p AS (SELECT x.doc_id, x.fold, x.label, o.k AS prediction FROM x JOIN o USING (fold)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (ln(va) + (a - ma) ** 2 / va + ln(vb) + (b - mb) ** 2 / vb + ln(vc) + (c - mc) ** 2 / vc) / 2 - ln(n), k) = 1),
s AS (SELECT fold, label AS k, count(*) AS support, count(*) FILTER (WHERE label = prediction) AS hits FROM p GROUP BY ALL),
q AS (SELECT fold, prediction AS k, count(*) AS claimed FROM p GROUP BY ALL),
e AS (SELECT fold, support, hits, coalesce(hits / claimed, 0) AS pr, hits / support AS re FROM s LEFT JOIN q USING (fold, k)),
f AS (SELECT fold::VARCHAR AS fold, sum(support)::BIGINT AS n, sum(hits) / sum(support) AS accuracy, sum(pr * support) / sum(support) AS precision, sum(re * support) / sum(support) AS recall,
  sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * support) / sum(support) AS f1 FROM e GROUP BY fold),
r AS (SELECT * FROM f UNION ALL SELECT 'mean', sum(n)::BIGINT, avg(accuracy), avg(precision), avg(recall), avg(f1) FROM f
  UNION ALL SELECT 'std', sum(n)::BIGINT, stddev_pop(accuracy), stddev_pop(precision), stddev_pop(recall), stddev_pop(f1) FROM f)
SELECT fold, n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r"""


@query("cross_validation", REFIT_SQL)
def cross_validation(spark, sf):
    """Five models refitted on four fifths of the labelled documents each, reported on the fifth they have not seen."""
    def grown(c):
        return F.ln(1 + c.cast("double"))

    t = F.col("text")
    rows = texts(spark, sf).select(
        "doc_id", grown(F.col("n_chars")).alias("a"), grown(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).alias("b"),
        grown(F.length(F.regexp_replace(t, "[^A-Z]", ""))).alias("c"))
    labels = read(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = V.gaussian_refits(rows.join(labels, "doc_id"), ["a", "b", "c"], "label", F.col("doc_id") % 5)
    report = V.fold_report(scored)
    return report.select("fold", "n", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("refit_report")
def refit_report(spark, sf):
    """The same five folds for a forest and a boosted model, from one written feature table."""
    rows = cut_lineage(L.assembled(document_rows(spark, sf), DOC_FEATURES).select("doc_id", "label", "features"))
    kinds = {
        "forest": lambda train: L.RandomForestClassifier(labelCol="label", numTrees=20, seed=L.SEED).fit(train),
        "boosted": lambda train: L.GBTClassifier(labelCol="label", maxIter=5, seed=L.SEED).fit(train),
    }
    out = None
    for name, fit in kinds.items():
        report = V.fold_report(V.refitted(rows, fit, F.col("doc_id") % 5, 5)).withColumn("model", F.lit(name))
        out = report if out is None else out.unionByName(report)
    return out.select("model", "fold", "n", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("risk_regressors")
def risk_regressors(spark, sf):
    """The risk of a user's next event from the one before it: error of the mean of three models on rows they have not seen."""
    rows, w = framed(activity(spark, sf), ["user_id"], ahead=1)
    ahead = settled(rows.withColumn("label", F.lead(score()).over(w))).filter("label IS NOT NULL")
    numbers = ahead.select(
        "event_id", "label", F.col("k").cast("double").alias("k"), F.hour("ts").cast("double").alias("hour"), F.weekday("ts").cast("double").alias("day"),
        F.col("size").cast("double").alias("size"), *[(F.col("kind") == kind).cast("double").alias(kind) for kind in ("keyboard", "mouse", "usb")])
    vectors = cut_lineage(L.assembled(numbers, ["k", "hour", "day", "size", "keyboard", "mouse", "usb"]).select("event_id", "label", "features"))
    train, held_out = L.stratified_split(vectors, "event_id", "event_id")
    scored = L.mean_prediction(held_out, L.risk_models(train))
    error = F.col("prediction") - F.col("label")
    spread = F.var_pop("label")
    return scored.agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(error * error)).alias("mse"), r6(1 - F.avg(error * error) / spread).alias("r2"),
        r6(F.avg("prediction")).alias("mean_prediction"),
    )


@query("soft_vote")
def soft_vote(spark, sf):
    """Votes on each document of the models that have not learned it."""
    def vote(half, train):
        forest_model = L.RandomForestClassifier(labelCol="label", numTrees=100, seed=L.SEED).fit(train)
        network = L.MultilayerPerceptronClassifier(labelCol="label", layers=[len(DOC_FEATURES), 10, 2], maxIter=50, seed=L.SEED).fit(train)
        return L.soft_vote(half, [forest_model, network])

    out = cross_fitted(L.assembled(document_rows(spark, sf), DOC_FEATURES), vote)
    return out.select("doc_id", "label", r6("p").alias("p"))


@query("grid_search")
def grid_search(spark, sf):
    rows = L.assembled(document_rows(spark, sf), DOC_FEATURES).select("features", "label").cache()
    found = L.grid_search(rows)
    return spark.createDataFrame(found, "model STRING, parameters STRING, score DOUBLE")


@query("calibrate")
def calibrate(spark, sf):
    """Calibrated scores of all documents, each by the calibration that has not seen it."""
    rows = labelled(spark, sf).select("doc_id", "p", F.col("label").cast("double").alias("label"))
    out = cross_fitted(rows, lambda half, train: L.calibrate(half, "p", train=train))
    return out.select("doc_id", "label", r6("isotonic").alias("isotonic"), r6("sigmoid").alias("sigmoid"))


def quality_forest(rows):
    return L.RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=5, seed=L.SEED).fit(L.assembled(rows, DOC_FEATURES))


def scorer(model):
    return lambda df: model.transform(df).withColumn("p", L.probability_of_one())


@query("global_importance")
def global_importance(spark, sf):
    """Built-in and permutation importance of a forest's features."""
    rows = document_rows(spark, sf).cache()
    model = quality_forest(rows)
    hit = F.avg(((F.col("p") > 0.5).cast("int") == F.col("label")).cast("double"))
    permuted = explain.permutation_importance(rows, "doc_id", DOC_FEATURES, scorer(model), hit, repeats=5)
    built_in = F.create_map(*[F.lit(v) for pair in zip(DOC_FEATURES, map(float, model.featureImportances.toArray())) for v in pair])
    return permuted.select(
        "feature", r6(built_in[F.col("feature")]).alias("built_in"), r6("importance").alias("permutation"), r6("spread").alias("spread")
    )


@query("shapley_sampled")
def shapley_sampled(spark, sf):
    rows = document_rows(spark, sf).cache()
    model = quality_forest(rows)
    values = explain.shapley(rows, rows, "doc_id", DOC_FEATURES, scorer(model))
    return values.select("doc_id", "feature", r6("value").alias("value"))


@query("local_surrogate")
def local_surrogate(spark, sf):
    rows = document_rows(spark, sf).cache()
    model = quality_forest(rows)
    stats = rows.agg(*[F.stddev_pop(c).alias(c) for c in DOC_FEATURES]).first()
    weights = explain.local_surrogate(rows, "doc_id", DOC_FEATURES, scorer(model), stats.asDict())
    return weights.select("doc_id", "feature", r6("weight").alias("weight"))


@query("decision_paths")
def decision_paths(spark, sf):
    rows = document_rows(spark, sf)
    tree = DecisionTreeClassifier(labelCol="label", maxDepth=4, seed=L.SEED).fit(L.assembled(rows, DOC_FEATURES))
    paths = explain.decision_paths(rows, "doc_id", DOC_FEATURES, explain.tree_nodes(tree, spark), depth=4)
    return paths.select("doc_id", F.array_join("path", " and ").alias("path"), "prediction")


@query("feature_select_tfidf")
def feature_select_tfidf(spark, sf):
    """The two most separating text features and the summed TF-IDF weight of each document."""
    selected = L.select_features(L.assembled(document_rows(spark, sf), DOC_FEATURES), 2)
    words = texts(spark, sf).select("doc_id", text.words(F.col("text")).alias("words"))
    weights = L.term_weights(words, "words").select("doc_id", levels.array_sum(vector_to_array("tfidf")).alias("weight"))
    return selected.join(weights, "doc_id").select(
        "doc_id", F.transform(vector_to_array("selected"), lambda x: F.round(x, 4)).cast("string").alias("selected"), F.round("weight", 4).alias("weight")
    )


@query("dp_counts")
def dp_counts(spark, sf):
    return L.private_counts(read(spark, sf, "events"), "user_id", "event_type")
