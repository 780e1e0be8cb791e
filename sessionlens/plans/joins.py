"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlens.functions import patterns as P
from sessionlens.functions.levels import level
from sessionlens.operators.extractors import POLICY, default_policy, overridden, respond, standard_extractors
from sessionlens.operators import joins

from sessionlens.plans.catalog import query
from sessionlens.plans.rows import level_sql
from sessionlens.plans.tables import ACT, activity, read

EVENTS_W = "(PARTITION BY user_id ORDER BY ts, event_id"
SCORE = "least(value / 120, 1.0)"


def score():
    """The event's value as a score between 0 and 1."""
    return F.least(F.col("value") / 120, F.lit(1.0))


def r6(column):
    """Rounded for comparison; adding zero turns a negative zero positive."""
    return F.round(column, 6) + F.lit(0.0)


@query(
    "press_release_asof",
    ACT + """, n AS (SELECT event_id, action, us, first_value(CASE WHEN action = 'release' THEN us END IGNORE NULLS) OVER
  (PARTITION BY user_id, key ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM act)
SELECT event_id, round((r - us) / 1e6, 6) AS dwell FROM n WHERE action = 'press' AND r IS NOT NULL""",
)
def press_release_asof(spark, sf):
    rows = activity(spark, sf).select("user_id", "event_id", "ts", "us", "key", "action")
    return joins.press_release(rows).select("event_id", F.round("dwell", 6).alias("dwell"))


@query(
    "prev_release_asof",
    ACT + f""", n AS (SELECT event_id, action, us, last_value(CASE WHEN action = 'release' THEN us END IGNORE NULLS) OVER
  {EVENTS_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM act)
SELECT event_id, round((us - r) / 1e6, 6) AS flight FROM n WHERE action = 'press' AND r IS NOT NULL""",
)
def prev_release_asof(spark, sf):
    rows = activity(spark, sf).select("user_id", "event_id", "ts", "us", "action")
    return joins.previous_release(rows).select("event_id", F.round("flight", 6).alias("flight"))


@query(
    "window_context_asof",
    ACT + f"""SELECT event_id, coalesce(last_value(CASE WHEN kind = 'window' THEN app END IGNORE NULLS) OVER
  {EVENTS_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Unknown') AS context FROM act""",
)
def window_context_asof(spark, sf):
    rows = activity(spark, sf).select("user_id", "event_id", "ts", "kind", "app")
    return joins.window_context(rows).select("event_id", F.coalesce("context", F.lit("Unknown")).alias("context"))




def features():
    return {"value": F.col("value"), "position": F.col("x"), "hour": F.hour("ts")}


LONG_SQL = """long AS (SELECT event_id, user_id, ts, us, 'value' AS feature, value AS x FROM act
  UNION ALL SELECT event_id, user_id, ts, us, 'position', x::DOUBLE FROM act
  UNION ALL SELECT event_id, user_id, ts, us, 'hour', hour(ts)::DOUBLE FROM act)"""


@query(
    "profile_similarity",
    ACT + f""", {LONG_SQL},
p AS (SELECT user_id, feature, avg(x) AS m, stddev_pop(x) AS s FROM long WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2),
c AS (SELECT user_id, feature, avg(x) AS x FROM long WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1, 2),
d AS (SELECT user_id, count(*) AS common_features, 1 / (1 + avg(CASE WHEN s > 0 THEN abs(x - m) / s ELSE abs(x - m) END)) AS sim
  FROM p JOIN c USING (user_id, feature) GROUP BY 1)
SELECT user_id, common_features, round(sim, 6) AS similarity, sim >= 0.8 AS verified FROM d""",
)
def profile_similarity(spark, sf):
    long = joins.long_features(activity(spark, sf), ["user_id", "ts"], features())
    early = F.col("ts") < F.lit("2024-01-20").cast("timestamp")
    profile = long.filter(early).groupBy("user_id", "feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    session = long.filter(~early).groupBy("user_id", "feature").agg(F.avg("x").alias("x"))
    return joins.profile_similarity(session, profile).withColumn("similarity", F.round("similarity", 6))


@query(
    "baseline_deviation",
    ACT + """, c AS (SELECT user_id, kind, sum(value) AS current FROM act WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1, 2),
b AS (SELECT user_id, kind, sum(value) AS baseline FROM act WHERE ts < TIMESTAMP '2024-01-11' GROUP BY 1, 2),
j AS (SELECT user_id, kind, current, coalesce(baseline, current) AS baseline FROM c LEFT JOIN b USING (user_id, kind))
SELECT user_id, kind, round(abs(current - baseline) / baseline, 6) AS deviation, abs(current - baseline) / baseline > 2 AS is_anomaly
FROM j WHERE baseline <> 0""",
)
def baseline_deviation(spark, sf):
    rows = activity(spark, sf)
    late, early = F.col("ts") >= F.lit("2024-01-20").cast("timestamp"), F.col("ts") < F.lit("2024-01-11").cast("timestamp")
    keys = ["user_id", "kind"]
    current = rows.filter(late).groupBy(*keys).agg(F.sum("value").alias("current"))
    baseline = rows.filter(early).groupBy(*keys).agg(F.sum("value").alias("baseline"))
    out = joins.baseline_deviation(current, baseline, keys)
    return out.select(*keys, F.round("deviation", 6).alias("deviation"), "is_anomaly")


@query(
    "component_scores",
    ACT + f"""SELECT event_id, CASE WHEN kind IN ('mouse', 'window') THEN round({SCORE}, 6) ELSE 0.0 END::DOUBLE AS behavioural,
  CASE WHEN kind = 'keyboard' THEN round(1 - k / 100.0, 6) ELSE 0.0 END::DOUBLE AS keystroke,
  CASE WHEN k > 60 THEN round({SCORE} * 0.5, 6) ELSE 0.0 END::DOUBLE AS threat, round(k / 99.0, 6)::DOUBLE AS risk FROM act""",
)
def component_scores(spark, sf):
    rows = activity(spark, sf)
    k = F.col("k")
    parts = {
        "behavioural": (F.col("kind").isin("mouse", "window"), F.round(score(), 6)),
        "keystroke": (F.col("kind") == "keyboard", F.round(1 - k / 100, 6)),
        "threat": (k > 60, F.round(score() * 0.5, 6)),
        "risk": (F.lit(True), F.round(k / 99, 6)),
    }
    tables = {n: rows.filter(cond).select("event_id", c.alias(n)) for n, (cond, c) in parts.items()}
    return joins.component_scores(rows.select("event_id"), tables)


@query(
    "enrich_history",
    ACT + """, a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j FROM act WHERE value > 100),
c AS (SELECT user_id, event_id, ts, count(*) FILTER (WHERE value > 100) OVER w AS c, avg(value) OVER w AS usual FROM act
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT c.event_id, string_agg(a.event_id::VARCHAR, ',' ORDER BY a.j DESC) AS recent, count(*) AS n, max(CASE WHEN a.j = c.c THEN a.event_type END) AS last_type,
  array_to_string(list_sort(list_distinct(list(a.event_type))), ',') AS indicators FROM c JOIN a ON a.user_id = c.user_id AND a.j BETWEEN c.c - 9 AND c.c GROUP BY 1)
SELECT event_id, user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, coalesce(recent, '') AS recent, coalesce(n, 0) AS recent_anomalies,
  coalesce(last_type, '') AS last_type, coalesce(indicators, '') AS indicators, round(usual, 9) AS usual FROM c LEFT JOIN h USING (event_id)""",
)
def enrich_history(spark, sf):
    """Each event with its user's anomalies before it."""
    rows = activity(spark, sf).select("user_id", "event_id", "ts", "event_type", "value")
    return joins.recent_history(rows, F.col("value") > 100, "value").select(
        "event_id",
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.array_join("recent", ",").alias("recent"),
        "recent_anomalies",
        F.coalesce("last_type", F.lit("")).alias("last_type"),
        F.array_join("indicators", ",").alias("indicators"),
        F.round("usual", 9).alias("usual"),
    )


# The anomaly type each kind of event stands for.
KIND_ANOMALIES = {
    "keyboard": "timing_anomaly", "mouse": "cross_platform_anomaly", "clipboard": "insider_threat",
    "window": "account_takeover", "usb": "adversarial_attack",
}
FINDINGS_SQL = f""", f AS (SELECT event_id, {level_sql(SCORE, 'threat')} AS level, {SCORE} AS risk, k / 99.0 AS confidence,
  CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND_ANOMALIES.items())} END AS kind FROM act)"""


def findings(spark, sf):
    table = F.create_map(*[F.lit(v) for pair in KIND_ANOMALIES.items() for v in pair])
    return activity(spark, sf).select(
        "event_id", level(score(), "threat").alias("level"), score().alias("risk"), (F.col("k") / 99).alias("confidence"),
        table[F.col("kind")].alias("kind"),
    )


def lists_sql(mapping: dict[str, list[str]], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + " ELSE [] END"


@query(
    "response_policy",
    ACT + FINDINGS_SQL + f""", a AS (SELECT event_id, unnest(list_concat(list_concat({lists_sql(P.LEVEL_ACTIONS, 'level')},
  {lists_sql(P.TYPE_ACTIONS, 'kind')}), CASE WHEN confidence > 0.8 AND risk >= 0.7 THEN ['preserve_evidence'] ELSE [] END)) AS action,
  generate_subscripts(list_concat(list_concat({lists_sql(P.LEVEL_ACTIONS, 'level')}, {lists_sql(P.TYPE_ACTIONS, 'kind')}),
  CASE WHEN confidence > 0.8 AND risk >= 0.7 THEN ['preserve_evidence'] ELSE [] END), 1) AS i FROM f),
u AS (SELECT event_id, action, min(i) AS i FROM a GROUP BY 1, 2)
SELECT event_id, string_agg(action, ',' ORDER BY i) AS actions FROM u GROUP BY 1""",
)
def response_policy(spark, sf):
    actions = joins.response_actions(F.col("level"), F.col("kind"), F.col("confidence"), F.col("risk"))
    return findings(spark, sf).select("event_id", F.array_join(actions, ",").alias("actions"))


@query(
    "recommend",
    ACT + FINDINGS_SQL + f""", a AS (SELECT event_id, array_to_string(list_concat({lists_sql(P.LEVEL_RECOMMENDATIONS, 'level')},
  {lists_sql(P.TYPE_RECOMMENDATIONS, 'kind')}), ',') AS actions,
  array_to_string(list_sort(list_concat(CASE WHEN risk > 0.5 THEN {P.FACTOR_ADVICE['insider_threat']} ELSE [] END,
    CASE WHEN confidence > 0.5 THEN {P.FACTOR_ADVICE['temporal_risk']} ELSE [] END)), '; ') AS advice FROM f)
SELECT event_id, actions, advice FROM a""",
)
def recommend(spark, sf):
    advice = joins.factor_advice({"insider_threat": F.col("risk"), "temporal_risk": F.col("confidence")})
    return findings(spark, sf).select(
        "event_id",
        F.array_join(joins.recommended_actions(F.col("level"), F.col("kind")), ",").alias("actions"),
        F.array_join(advice, "; ").alias("advice"),
    )


@query(
    "new_device",
    ACT + f""", s AS (SELECT *, row_number() OVER (PARTITION BY user_id, device ORDER BY ts, event_id) AS use,
  row_number() OVER {EVENTS_W}) AS rn FROM act)
SELECT user_id, device, event_id FROM s WHERE use = 1 AND rn > 1""",
)
def new_device(spark, sf):
    return joins.new_devices(activity(spark, sf).select("user_id", "device", "us", "event_id"))


@query(
    "impossible_travel",
    ACT + f""", g AS (SELECT event_id, us, (k * 37 % 180) - 90.0 AS lat, (k * 71 % 360) - 180.0 AS lon,
  lag((k * 37 % 180) - 90.0) OVER {EVENTS_W}) AS lat0, lag((k * 71 % 360) - 180.0) OVER {EVENTS_W}) AS lon0,
  (us - lag(us) OVER {EVENTS_W})) / 1e6 AS seconds FROM act),
d AS (SELECT *, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2) AS a FROM g),
t AS (SELECT event_id, seconds, 2 * 6371.0 * asin(sqrt(least(1.0, a))) AS km FROM d WHERE seconds IS NOT NULL)
SELECT event_id, round(km, 3) AS distance_km, round(seconds, 6) AS seconds FROM t WHERE km >= 1000 AND seconds <= 3600""",
)
def impossible_travel(spark, sf):
    k = F.col("k")
    places = activity(spark, sf).select(
        "user_id", "event_id", "ts", "us", (k * 37 % 180 - 90.0).alias("lat"), (k * 71 % 360 - 180.0).alias("lon")
    )
    found = joins.impossible_travel(places)
    return found.select("event_id", F.round("distance_km", 3).alias("distance_km"), F.round("seconds", 6).alias("seconds"))


POINTS_SQL = """, p AS (SELECT floor(value * 10) / 100 AS x, hour(ts)::DOUBLE / 4 AS y, count(*) AS n FROM act GROUP BY 1, 2),
c AS (SELECT a.x, a.y, a.n, sum(b.n) AS neighbours FROM p a JOIN p b ON abs(a.x - b.x) <= 0.5 AND abs(a.y - b.y) <= 0.5
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25 GROUP BY 1, 2, 3)"""


def density(spark, sf):
    points = activity(spark, sf).groupBy(
        (F.floor(F.col("value") * 10) / 100).alias("x"), (F.hour("ts").cast("double") / 4).alias("y")
    ).agg(F.count(F.lit(1)).alias("n"))
    return joins.density_points(points, eps=0.5, min_points=5)


@query("eps_neighbours", ACT + POINTS_SQL + " SELECT x, y, n, neighbours >= 5 AS is_core FROM c")
def eps_neighbours(spark, sf):
    return density(spark, sf).select("x", "y", "n", "is_core")


@query(
    "dbscan_noise",
    ACT + POINTS_SQL + """, core AS (SELECT * FROM c WHERE neighbours >= 5)
SELECT x, y, n, neighbours < 5 AND NOT EXISTS (SELECT 1 FROM core WHERE abs(core.x - c.x) <= 0.5 AND abs(core.y - c.y) <= 0.5
  AND (core.x - c.x) * (core.x - c.x) + (core.y - c.y) * (core.y - c.y) <= 0.25) AS is_noise FROM c""",
)
def dbscan_noise(spark, sf):
    return density(spark, sf).select("x", "y", "n", "is_noise")


@query(
    "label_alignment",
    "SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)",
)
def label_alignment(spark, sf):
    documents = read(spark, sf, "documents").select("doc_id", "n_chars")
    return documents.join(read(spark, sf, "labels"), "doc_id").select("doc_id", "n_chars", "quality", "toxic")


@query(
    "geo_enrich",
    """WITH r AS (SELECT n_name AS place, n_nationkey::BIGINT * 171798691 AS low, n_nationkey::BIGINT * 171798691 + 171798690 AS high FROM nation),
e AS (SELECT event_id, (event_id % 4294967296) * 1103515245 % 4294967296 AS ip FROM events)
SELECT event_id, ip, place FROM e LEFT JOIN r ON ip BETWEEN low AND high""",
)
def geo_enrich(spark, sf):
    """Addresses as numbers against a supplied table of address ranges; nothing is looked up on the web."""
    start = F.col("n_nationkey") * F.lit(171798691).cast("long")
    ranges = read(spark, sf, "nation").select(F.col("n_name").alias("place"), start.alias("low"), (start + 171798690).alias("high"))
    wrap = F.lit(4294967296).cast("long")
    ip = (F.col("event_id") % wrap) * F.lit(1103515245).cast("long") % wrap
    points = read(spark, sf, "events").select("event_id", ip.alias("ip"))
    return joins.range_lookup(points, "ip", ranges, "low", "high", 2**25).select("event_id", "ip", "place")


@query(
    "geo_enrich_nested",
    """WITH r AS (SELECT n_name AS place, n_nationkey::BIGINT * 171798691 AS low, n_nationkey::BIGINT * 171798691 + 171798690 AS high FROM nation
  UNION ALL SELECT r_name, r_regionkey::BIGINT * 400000001, 2147483648 + r_regionkey::BIGINT * 500000003 FROM region),
e AS (SELECT event_id, (event_id % 4294967296) * 1103515245 % 4294967296 AS ip FROM events)
SELECT event_id, ip, place, high - low AS width FROM e LEFT JOIN r ON ip BETWEEN low AND high
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY high - low, low, place) = 1""",
)
def geo_enrich_nested(spark, sf):
    """Addresses against ranges that nest and overlap: those of nations within those of regions, which cover half of all each."""
    n, r = F.col("n_nationkey").cast("long") * 171798691, F.col("r_regionkey").cast("long")
    ranges = read(spark, sf, "nation").select(F.col("n_name").alias("place"), n.alias("low"), (n + 171798690).alias("high")).unionByName(
        read(spark, sf, "region").select(F.col("r_name").alias("place"), (r * 400000001).alias("low"), (r * 500000003 + 2147483648).alias("high")))
    wrap = F.lit(4294967296).cast("long")
    ip = (F.col("event_id") % wrap) * F.lit(1103515245).cast("long") % wrap
    points = read(spark, sf, "events").select("event_id", ip.alias("ip"))
    out = joins.narrowest_range(points, "ip", ranges, "low", "high")
    return out.select("event_id", "ip", "place", (F.col("high") - F.col("low")).alias("width"))


@query(
    "custom_profile",
    ACT + """ SELECT user_id, count(*) AS events, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, min(value) AS value_min, max(value) AS value_max,
  round(avg((hour(ts) < 6)::INT), 6) AS night_share, round(avg((isodow(ts) >= 6)::INT), 6) AS weekend_share, count(DISTINCT app) AS applications,
  count(DISTINCT device) AS devices, round(avg((kind = 'usb')::INT), 6) AS usb_share, max(length(content)) AS longest FROM act GROUP BY 1""",
)
def custom_profile(spark, sf):
    """The standard features and those of a caller's extractor, from one scan and one aggregation."""
    extractors = standard_extractors()
    extractors.register("caller", lambda: {"usb_share": F.avg((F.col("kind") == "usb").cast("double")), "longest": F.max(F.length("content"))})
    out = extractors.profile(activity(spark, sf), ["user_id"])
    shares = [c for c in out.columns if c.endswith(("_share", "_mean", "_std"))]
    return out.withColumns({c: F.round(c, 6) for c in shares})


@query(
    "response_handlers",
    ACT + FINDINGS_SQL + f""", l AS (SELECT event_id, list_concat(list_concat(CASE level WHEN 'high' THEN ['call_owner', 'revoke_tokens'] WHEN 'low' THEN [] ELSE {lists_sql(P.LEVEL_ACTIONS, 'level')} END,
  {lists_sql(P.TYPE_ACTIONS, 'kind')}), CASE WHEN confidence > 0.8 AND risk >= 0.7 THEN ['preserve_evidence'] ELSE [] END) AS a FROM f)
SELECT event_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS actions FROM l""",
)
def response_handlers(spark, sf):
    """Recommended actions by a caller's policy: other ones for high findings, none for low ones."""
    changes = spark.createDataFrame([("level", "high", ["call_owner", "revoke_tokens"]), ("level", "low", [])], POLICY)
    out = respond(findings(spark, sf), overridden(default_policy(spark), changes))
    return out.select("event_id", F.array_join("actions", ",").alias("actions"))
