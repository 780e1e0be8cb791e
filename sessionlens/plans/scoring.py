"""Composite scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlens.functions import clock, text
from sessionlens.functions import patterns as P
from sessionlens.functions.levels import level, severity_score, squash
from sessionlens.operators import profiles
from sessionlens.operators import scoring as S
from sessionlens.operators.aggregates import r6, r12
from sessionlens.operators.sequence import running
from sessionlens.plans.catalog import query
from sessionlens.plans.joins import EVENTS_W, SCORE, score
from sessionlens.plans.rows import any_of, contains_sql, level_sql
from sessionlens.plans.tables import ACT, activity, read
from sessionlens.plans.windows import W_ORDER, rows_sql, squash_sql


def flag_sql(name: str) -> str:
    column, words = P.KEYWORD_INDICATORS[name]
    return contains_sql(column, words)


_COPIED = "kind = 'clipboard'"
FEATURES = ACT + f""", sc AS (SELECT *, {SCORE} AS score, row_number() OVER {EVENTS_W}) AS rn, CASE WHEN kind = 'keyboard' THEN us END AS typed,
  CASE WHEN kind = 'window' THEN app END AS wapp FROM act),
fw AS (SELECT *, count(*) OVER l AS n10, (max(us) OVER l - min(us) OVER l) / 1e6 AS span, list(kind) OVER l AS kl, avg(score) OVER t AS am, count(*) OVER t AS tn,
  CASE WHEN count(*) OVER l = 10 THEN regr_slope(score, rn) OVER l ELSE 0 END AS trend, count(typed) OVER t AS tc, (max(typed) OVER t - min(typed) OVER t) / 1e6 AS tsp,
  list_filter(list(wapp) OVER t, lambda a: a IS NOT NULL) AS al FROM sc WINDOW l AS {rows_sql(9)}, t AS {rows_sql(10, '1 PRECEDING')}),
feat AS (SELECT *, CASE WHEN n10 >= 5 THEN n10 / greatest(span, 1) ELSE 0 END AS intensity, CASE WHEN n10 >= 5 THEN len(list_distinct(kl)) / n10 ELSE 0 END AS diversity,
  CASE WHEN tn >= 5 THEN am ELSE 0 END AS accumulated, coalesce(tc >= 5 AND tsp > 0 AND tc / tsp > 10, false) AS rapid_typing,
  coalesce(len(al) >= 3 AND len(list_distinct(al)) > 5, false) AS rapid_app_switching FROM fw),
dim AS (SELECT *,
  least(1, CASE WHEN intensity > 10 THEN 0.3 WHEN intensity > 5 THEN 0.1 ELSE 0 END + CASE WHEN diversity > 0.8 THEN 0.2 ELSE 0 END + least(0.4, accumulated * 0.1)) AS behavioral_anomaly,
  CASE WHEN kind = 'keyboard' THEN least(1, CASE WHEN rapid_typing THEN 0.2 ELSE 0 END + CASE WHEN {flag_sql('system_commands')} THEN 0.4 ELSE 0 END
    + CASE WHEN {flag_sql('sensitive_content')} THEN 0.3 ELSE 0 END) ELSE 0 END AS keystroke_anomaly,
  least(1, CASE WHEN kind = 'keyboard' AND {flag_sql('typed_file_operations')} THEN 0.2 ELSE 0 END + CASE WHEN kind = 'keyboard' AND {flag_sql('network_activity')} THEN 0.3 ELSE 0 END
    + CASE WHEN {_COPIED} AND size > 10000 THEN 0.2 ELSE 0 END
    + CASE WHEN {_COPIED} AND {any_of('content', [P.SSN_DASHED, P.CARD_GROUPS, P.PASSWORD_PAIR, P.API_KEY_PAIR])} THEN 0.4 ELSE 0 END
    + CASE WHEN kind = 'window' AND {flag_sql('admin_application')} THEN 0.3 ELSE 0 END) AS insider_threat,
  least(1, CASE WHEN hour(ts) < 8 OR hour(ts) > 18 THEN 0.3 ELSE 0 END + CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 0.4 ELSE 0 END
    + CASE WHEN isodow(ts) >= 6 THEN 0.2 ELSE 0 END + CASE WHEN trend > 0.1 THEN 0.2 ELSE 0 END) AS temporal_risk,
  least(1, CASE WHEN kind = 'window' AND {flag_sql('system_application')} THEN 0.4 ELSE 0 END + CASE WHEN kind = 'window' AND {flag_sql('security_application')} THEN 0.3 ELSE 0 END
    + CASE WHEN kind = 'window' AND {flag_sql('browser_private_mode')} THEN 0.2 ELSE 0 END + CASE WHEN kind = 'window' AND rapid_app_switching THEN 0.2 ELSE 0 END
    + CASE WHEN {_COPIED} AND {any_of('content', [P.ANY_WINDOWS_PATH, P.ANY_UNIX_PATH], 'c')} THEN 0.2 ELSE 0 END) AS access_risk FROM feat),
base AS (SELECT *, (behavioral_anomaly * 0.25 + keystroke_anomaly * 0.20 + insider_threat * 0.30 + temporal_risk * 0.15 + access_risk * 0.10)
  * greatest(0.1, least(1, exp(-((SELECT max(us) FROM act) - us) / 1e6 / 3600))) AS base_risk FROM dim)"""

INPUTS = ["user_id", "event_id", "ts", "us", "kind", "key", "app", "content", "size"]


def features(spark, sf):
    return S.risk_features(activity(spark, sf).select(*INPUTS, score().alias("score")))


def _dimension(key: str, name: str, column):
    @query(key, FEATURES + f" SELECT event_id, round({name}, 12)::DOUBLE AS {name} FROM dim")
    def run(spark, sf):
        return features(spark, sf).select("event_id", r12(column()).alias(name))

    run.__name__ = key
    return run


dim_behavioural = _dimension("dim_behavioural", "behavioral_anomaly", S.behavioural_dimension)
dim_keystroke = _dimension("dim_keystroke", "keystroke_anomaly", S.keystroke_dimension)
dim_insider = _dimension("dim_insider", "insider_threat", S.insider_dimension)
dim_temporal = _dimension("dim_temporal", "temporal_risk", S.temporal_dimension)
dim_access = _dimension("dim_access", "access_risk", S.access_dimension)


def risked(spark, sf):
    """Events with their dimension scores and base risk."""
    rows = features(spark, sf)
    as_of = read(spark, sf, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).scalar()
    scored = rows.withColumns(S.dimensions())
    names = {n: F.col(n) for n in P.RISK_WEIGHTS}
    return scored.withColumn("base_risk", S.base_risk(names, (as_of - F.col("us")) / 1e6))


@query("base_risk", FEATURES + " SELECT event_id, round(base_risk, 12)::DOUBLE AS base_risk FROM base")
def base_risk(spark, sf):
    return risked(spark, sf).select("event_id", r12("base_risk").alias("base_risk"))


@query(
    "calibrate_score",
    f"""WITH s AS (SELECT event_id, {SCORE} * 0.9 AS s FROM events), m AS (SELECT min(s) AS lo, max(s) AS hi FROM s)
SELECT event_id, round({squash_sql('(s - lo) / (hi - lo)')}, 6) AS calibrated, round({squash_sql('s')}, 6) AS unfitted FROM s, m""",
)
def calibrate_score(spark, sf):
    scored = read(spark, sf, "events").select("event_id", (score() * 0.9).alias("s"))
    return scored.select("event_id", r6(S.calibrated(scored, "s")).alias("calibrated"), r6(squash(F.col("s"))).alias("unfitted"))


@query(
    "user_risk_summary",
    FEATURES + f""", c AS (SELECT user_id, {squash_sql('base_risk')} AS risk FROM base),
u AS (SELECT user_id, count(*) AS events, avg(risk) AS mean_risk, max(risk) AS peak_risk FROM c GROUP BY 1)
SELECT user_id, events, round(mean_risk, 6) AS mean_risk, round(peak_risk, 6) AS peak_risk, {level_sql('peak_risk', 'risk')} AS risk_level,
  {level_sql('mean_risk', 'status')} AS status FROM u""",
)
def user_risk_summary(spark, sf):
    """The flagship: features, dimension scores, base risk, calibration and levels per user."""
    scored = risked(spark, sf).select("user_id", squash(F.col("base_risk")).alias("risk"))
    users = scored.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.avg("risk").alias("mean_risk"), F.max("risk").alias("peak_risk")
    )
    return users.select(
        "user_id", "events", r6("mean_risk").alias("mean_risk"), r6("peak_risk").alias("peak_risk"),
        level(F.col("peak_risk"), "risk").alias("risk_level"), level(F.col("mean_risk"), "status").alias("status"),
    )


MODELS = {"isolation_forest": SCORE, "one_class_svm": "k / 99.0", "dbscan": "CASE WHEN k % 7 = 0 THEN 1.0 ELSE 0.0 END", "supervised": "(k * 3 % 100) / 100.0"}


@query(
    "ensemble_vote",
    ACT + ", m AS (" + " UNION ALL ".join(
        f"SELECT event_id, ({e})::DOUBLE AS s, {P.VOTE_WEIGHTS[n]}::DOUBLE AS w FROM act" for n, e in MODELS.items()
    ) + """), v AS (SELECT event_id, sum(s * w) / sum(w) AS a, sum(CASE WHEN s > 0.5 THEN w ELSE 0 END) / sum(w) AS v FROM m GROUP BY 1)
SELECT event_id, round(a, 6) AS anomaly_score, round(v, 6) AS votes, round(v, 9) > 0.5 AS is_anomaly, round(least(abs(a), 1), 6) AS confidence FROM v""",
)
def ensemble_vote(spark, sf):
    k = F.col("k")
    wide = activity(spark, sf).select(
        "event_id", score().alias("isolation_forest"), (k / 99).alias("one_class_svm"),
        F.when(k % 7 == 0, 1.0).otherwise(0.0).alias("dbscan"), ((k * 3 % 100) / 100).alias("supervised"),
    )
    long = wide.unpivot(["event_id"], list(MODELS), "model", "score").withColumn("is_anomaly", F.col("score") > 0.5)
    out = S.vote(long, ["event_id"])
    return out.select(
        "event_id", r6("anomaly_score").alias("anomaly_score"), r6("votes").alias("votes"),
        (F.round("votes", 9) > 0.5).alias("is_anomaly"), r6("confidence").alias("confidence"),
    )


_FLAGS = list(P.KEYWORD_INDICATORS)
CATEGORIES = {
    "access": [n for n in _FLAGS if "access" in n],
    "usage": [n for n in _FLAGS if "usage" in n or "commands" in n],
    "temporal": [],
    "privilege": [n for n in _FLAGS if "admin" in n],
    "exfiltration": ["file_compression", "cloud_services", "file_transfer", "network_upload", "large_file_operations"],
}


def category_columns():
    flags = text.keyword_flags()
    out = {c: sum((flags[n].cast("int") for n in names), F.lit(0)) for c, names in CATEGORIES.items()}
    out["temporal"] = clock.after_hours().cast("int") + clock.is_weekend().cast("int")
    return out


CATS_SQL = ", cat AS (SELECT *, " + ", ".join(
    (" + ".join(f"({flag_sql(n)})::INT" for n in names) if names else "(hour(ts) < 8 OR hour(ts) > 18)::INT + (isodow(ts) >= 6)::INT") + f" AS c_{c}"
    for c, names in CATEGORIES.items()
) + " FROM act)"
_PAIRS = [(a, b) for i, a in enumerate(CATEGORIES) for b in list(CATEGORIES)[i + 1 :]]
CORR_SQL = f""", cor AS (SELECT *, CASE WHEN count(*) OVER w = 10 THEN ({" + ".join(f"coalesce(CASE WHEN isnan(corr(c_{a}, c_{b}) OVER w) THEN 0 ELSE abs(corr(c_{a}, c_{b}) OVER w) END, 0)" for a, b in _PAIRS)}) / 10 ELSE 0 END AS correlation
  FROM cat WINDOW w AS {rows_sql(9)})"""


def correlated(spark, sf):
    rows = activity(spark, sf)
    counted = rows.select("user_id", "event_id", "ts", "us", "kind", "value", "k", *[c.alias(f"c_{n}") for n, c in category_columns().items()])
    return S.indicator_correlation(counted, [f"c_{n}" for n in CATEGORIES])


@query("indicator_corr", ACT + CATS_SQL + CORR_SQL + " SELECT event_id, round(correlation, 6)::DOUBLE AS correlation FROM cor")
def indicator_corr(spark, sf):
    return correlated(spark, sf).select("event_id", r6("correlation").alias("correlation"))


DIMS = dict(zip(P.THREAT_WEIGHTS, CATEGORIES))


@query(
    "threat_ensemble",
    ACT + CATS_SQL + CORR_SQL + f""", s AS (SELECT event_id, ts, correlation, c_access + c_usage + c_temporal + c_privilege + c_exfiltration AS recent,
  ({" + ".join(f"least(1, c_{c} / 3.0) * {P.THREAT_WEIGHTS[d]}" for d, c in DIMS.items())}) / 1.15 AS s FROM cor)
SELECT event_id, round(least(1, least(1, s + correlation * 0.2) * (1 + CASE WHEN recent > 10 THEN 0.3 WHEN recent > 5 THEN 0.15 ELSE 0 END
  + CASE WHEN hour(ts) < 8 OR hour(ts) > 18 THEN 0.1 ELSE 0 END + CASE WHEN isodow(ts) >= 6 THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS threat_score FROM s""",
)
def threat_ensemble(spark, sf):
    scores = {d: F.least(F.lit(1.0), F.col(f"c_{c}") / 3) for d, c in DIMS.items()}
    recent = sum((F.col(f"c_{c}") for c in CATEGORIES), F.lit(0))
    out = S.threat_score(scores, F.col("correlation"), recent)
    return correlated(spark, sf).select("event_id", r6(out).alias("threat_score"))


_SPLIT = S.dimension_columns(_FLAGS)


@query(
    "dimension_split",
    ACT + "SELECT user_id, " + ", ".join(
        "CAST(sum(" + (" + ".join(f"({flag_sql(n)})::INT" for n in names) or "0") + f") AS BIGINT) AS {d}" for d, names in _SPLIT.items()
    ) + " FROM act GROUP BY 1",
)
def dimension_split(spark, sf):
    """Indicator flags routed to threat dimensions by parts of their names, summed per user."""
    flags = text.keyword_flags()
    flagged = activity(spark, sf).select("user_id", *[c.cast("int").alias(n) for n, c in flags.items()])
    sums = {d: sum((F.col(n) for n in names), F.lit(0)) for d, names in _SPLIT.items()}
    return flagged.groupBy("user_id").agg(*[F.sum(c).alias(d) for d, c in sums.items()])


@query(
    "indicator_counters",
    ACT + f"""SELECT event_id, CAST(sum(CASE WHEN {SCORE} > 0.5 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS threats, CAST(sum(CASE WHEN k > 50 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS access,
  CAST(sum(CASE WHEN k % 10 > 5 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS deviations FROM act WINDOW w AS ({W_ORDER} ROWS UNBOUNDED PRECEDING)""",
)
def indicator_counters(spark, sf):
    rows = activity(spark, sf).select("user_id", "event_id", "ts", "k", score().alias("score"))
    counters = {
        "threats": (F.col("score") > 0.5).cast("long"), "access": (F.col("k") > 50).cast("long"), "deviations": (F.col("k") % 10 > 5).cast("long"),
    }
    return running(rows, ["user_id"], counters).select("event_id", *counters)


COMBINE_SQL = f""", m AS (SELECT event_id, k, kind, {SCORE} AS a, k / 99.0 AS b, (k * 3 % 100) / 100.0 AS c, k % 9 = 0 AS travel, k % 5 = 0 AS device, k % 11 = 0 AS adversarial FROM act),
w AS (SELECT *, (a * 0.3 + b * 0.3 + c * 0.2) / 0.8 AS s0, (b * 0.3 + c * 0.3 + a * 0.2) / 0.8 AS conf FROM m),
x AS (SELECT *, CASE WHEN travel THEN s0 * 0.7 + 0.8 * 0.3 ELSE s0 END AS s1 FROM w), y AS (SELECT *, CASE WHEN device THEN s1 * 0.7 + 0.5 * 0.3 ELSE s1 END AS s2 FROM x),
r AS (SELECT event_id, k, kind, a, b, c, travel, device, adversarial, greatest(0, least(1, CASE WHEN adversarial THEN s2 * 0.6 + 0.8 * 0.4 ELSE s2 END)) AS risk, greatest(0, least(1, conf)) AS confidence FROM y)"""


def combined(spark, sf):
    k = F.col("k")
    rows = activity(spark, sf).select(
        "event_id", "k", "kind", score().alias("a"), (k / 99).alias("b"), ((k * 3 % 100) / 100).alias("c"),
        (k % 9 == 0).alias("travel"), (k % 5 == 0).alias("device"), (k % 11 == 0).alias("adversarial"),
    )
    weights = F.array(F.lit(0.3), F.lit(0.3), F.lit(0.2))

    def severities(*found):
        return F.filter(F.array(*[F.when(F.col(c), severity_score(F.lit(s))) for c, s in found]), lambda s: s.isNotNull())

    out = S.combine(
        F.array("a", "b", "c"), F.array("b", "c", "a"), weights,
        severities(("travel", "high"), ("device", "medium")), severities(("adversarial", "high")),
    )
    return rows.withColumn("risk", out["risk_score"]).withColumn("confidence", out["confidence_score"])


@query("combine_results", ACT + COMBINE_SQL + " SELECT event_id, round(risk, 12)::DOUBLE AS risk, round(confidence, 12)::DOUBLE AS confidence FROM r")
def combine_results(spark, sf):
    return combined(spark, sf).select("event_id", r12("risk").alias("risk"), r12("confidence").alias("confidence"))


TYPED_SQL = f""", t AS (SELECT *, {level_sql('(risk * confidence + risk * 0.3)', 'threat')} AS threat, CASE WHEN adversarial THEN 'context_anomaly' WHEN travel THEN 'account_takeover'
  WHEN device THEN 'cross_platform_anomaly' WHEN k % 4 > k % 3 AND k % 4 > k % 2 THEN 'timing_anomaly' WHEN k % 3 > k % 2 THEN 'sequence_anomaly' WHEN k % 2 > 0 THEN 'frequency_anomaly'
  ELSE 'context_anomaly' END AS type FROM r)"""


def typed(spark, sf):
    k = F.col("k")
    rows = combined(spark, sf).withColumn("threat", S.threat_level(F.col("risk"), F.col("confidence")))
    kind = S.anomaly_type(F.col("adversarial"), F.col("travel"), F.col("device"), k % 4, k % 3, k % 2)
    return rows.withColumn("type", kind)


@query("threat_level_type", ACT + COMBINE_SQL + TYPED_SQL + " SELECT event_id, threat, type FROM t")
def threat_level_type(spark, sf):
    return typed(spark, sf).select("event_id", "threat", "type")


@query("threat_level", ACT + COMBINE_SQL + TYPED_SQL + " SELECT threat, count(*) AS n, round(avg(risk), 6) AS mean_risk FROM t GROUP BY 1")
def threat_level(spark, sf):
    return typed(spark, sf).groupBy("threat").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("risk")).alias("mean_risk"))


@query("anomaly_type", ACT + COMBINE_SQL + TYPED_SQL + " SELECT type, count(*) AS n, round(avg(risk), 6) AS mean_risk FROM t GROUP BY 1")
def anomaly_type(spark, sf):
    return typed(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("risk")).alias("mean_risk"))


@query(
    "evidence_rows",
    ACT + COMBINE_SQL + """, e AS (SELECT event_id, 'ml_model_detection' AS type, 'model_a' AS source, a::DOUBLE AS strength, (a * b)::DOUBLE AS contribution FROM r WHERE a > 0.6
  UNION ALL SELECT event_id, 'ml_model_detection', 'model_b', b, b * c FROM r WHERE b > 0.6 UNION ALL SELECT event_id, 'ml_model_detection', 'model_c', c, c * a FROM r WHERE c > 0.6
  UNION ALL SELECT event_id, 'cross_platform_anomaly', 'impossible_travel', 0.8, 0.8 FROM r WHERE travel UNION ALL SELECT event_id, 'cross_platform_anomaly', 'new_device', 0.5, 0.5 FROM r WHERE device
  UNION ALL SELECT event_id, 'adversarial_indicator', 'perturbation', 0.5, 0.5 FROM r WHERE adversarial)
SELECT event_id, type, source, round(strength, 12) AS strength, round(contribution, 12) AS contribution FROM e""",
)
def evidence_rows(spark, sf):
    """One row per piece of evidence; an event has at most six."""

    def piece(shown, kind, source, strength, contribution):
        return F.when(
            shown,
            F.struct(F.lit(kind).alias("type"), F.lit(source).alias("source"), strength.alias("strength"), contribution.alias("contribution")),
        )

    a, b, c = F.col("a"), F.col("b"), F.col("c")
    high, half = severity_score(F.lit("high")), F.lit(0.5)
    pieces = F.array(
        piece(a > 0.6, "ml_model_detection", "model_a", a, a * b),
        piece(b > 0.6, "ml_model_detection", "model_b", b, b * c),
        piece(c > 0.6, "ml_model_detection", "model_c", c, c * a),
        piece(F.col("travel"), "cross_platform_anomaly", "impossible_travel", high, high),
        piece(F.col("device"), "cross_platform_anomaly", "new_device", half, half),
        piece(F.col("adversarial"), "adversarial_indicator", "perturbation", half, half),
    )
    rows = combined(spark, sf).select("event_id", F.inline(F.filter(pieces, lambda p: p.isNotNull())))
    return rows.select("event_id", "type", "source", r12("strength").alias("strength"), r12("contribution").alias("contribution"))


@query(
    "explain_text",
    ACT + f""", x AS (SELECT event_id, kind, k / 99.0 AS risk, (99 - k) / 99.0 AS conf FROM act)
SELECT event_id, CASE WHEN risk > 0.7 THEN 'Anomalous behavior detected with ' || {level_sql('risk', 'threat')} || ' threat level. Primary anomaly type: ' || kind || '. Risk score: '
    || printf('%.2f', risk::DOUBLE) || ' (confidence: ' || printf('%.2f', conf::DOUBLE) || ')' ELSE 'Behavior appears normal. Risk score: ' || printf('%.2f', risk::DOUBLE) || ' (confidence: ' || printf('%.2f', conf::DOUBLE) || ')' END AS summary,
  CASE WHEN conf > 0.8 THEN 'High confidence (' || printf('%.2f', conf::DOUBLE) || ') due to strong agreement across multiple detection models and clear anomaly patterns.'
    WHEN conf > 0.6 THEN 'Medium-high confidence (' || printf('%.2f', conf::DOUBLE) || ') with good agreement among most detection components.'
    WHEN conf > 0.4 THEN 'Medium confidence (' || printf('%.2f', conf::DOUBLE) || ') with some disagreement among detection models.'
    ELSE 'Low confidence (' || printf('%.2f', conf::DOUBLE) || ') due to significant disagreement among detection components or insufficient evidence.' END AS justification,
  'High risk activity detected (score: ' || printf('%.2f', risk::DOUBLE) || ') - potential insider threat indicators' AS description FROM x""",
)
def explain_text(spark, sf):
    risk, confidence = F.col("k") / 99, (F.lit(99) - F.col("k")) / 99
    return activity(spark, sf).select(
        "event_id",
        S.summary_text(risk > 0.7, level(risk, "threat"), F.col("kind"), risk, confidence).alias("summary"),
        S.confidence_text(confidence).alias("justification"),
        S.alert_text(risk, F.lit("insider_threat")).alias("description"),
    )


@query(
    "outlier_guard",
    """WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
o AS (SELECT user_id, avg((value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1))::INT) AS s, avg(length(split_part(value::VARCHAR, '.', 2))) AS d FROM events JOIN q USING (user_id) GROUP BY 1)
SELECT user_id, round(s, 6) AS outlier_share, round(d, 6) AS mean_decimals, s > 0.1 AS unusual_distribution, d > 6 AS unusual_precision FROM o""",
)
def outlier_guard(spark, sf):
    out = S.outlier_guard(read(spark, sf, "events").select("user_id", "value"), ["user_id"], "value")
    return out.withColumns({"outlier_share": r6("outlier_share"), "mean_decimals": r6("mean_decimals")})


@query(
    "health_status",
    """WITH e AS (SELECT event_type, count(DISTINCT user_id) AS users, avg(value) AS m FROM events GROUP BY 1)
SELECT event_type, users, CASE WHEN event_type = 'error' THEN 'degraded' WHEN event_type = 'signup' THEN 'degraded' ELSE 'healthy' END AS health FROM e""",
)
def health_status(spark, sf):
    users = read(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    engine = F.when(F.col("event_type") == "error", "degraded").otherwise("healthy")
    return users.select(
        "event_type", "users", profiles.health(F.col("users"), F.col("event_type") != "signup", engine).alias("health")
    )


@query(
    "unusualness",
    f"SELECT event_id, round(least({SCORE} * 1.5, 1), 6)::DOUBLE AS unusualness, round({SCORE}, 6)::DOUBLE AS baseline_deviation FROM events",
)
def unusualness(spark, sf):
    return read(spark, sf, "events").select(
        "event_id", r6(F.least(score() * 1.5, F.lit(1.0))).alias("unusualness"), r6(score()).alias("baseline_deviation")
    )
