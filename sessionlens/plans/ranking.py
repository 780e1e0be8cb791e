"""Top-k, paging and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlens.functions import text
from sessionlens.functions.levels import level
from sessionlens.operators import ranking as K
from sessionlens.operators.aggregates import r6, word_frequency
from sessionlens.operators.sequence import newest
from sessionlens.plans.aggregates import WORD
from sessionlens.plans.catalog import query
from sessionlens.plans.joins import SCORE, score
from sessionlens.plans.rows import level_sql
from sessionlens.plans.tables import ACT, activity, texts
from sessionlens.plans.windows import TIME_SQL, spent


@query(
    "top_words",
    f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE length(word) >= 2 GROUP BY 1 ORDER BY n DESC, word LIMIT 20""",
)
def top_words(spark, sf):
    counts = word_frequency(texts(spark, sf), text.words(F.col("text")))
    return K.top(counts, 20, F.desc("n"), F.asc("word"))


@query("top_windows", ACT + " SELECT app, content, count(*) AS n FROM act GROUP BY 1, 2 ORDER BY n DESC, app, content LIMIT 10")
def top_windows(spark, sf):
    counts = activity(spark, sf).groupBy("app", "content").agg(F.count(F.lit(1)).alias("n"))
    return K.top(counts, 10, F.desc("n"), F.asc("app"), F.asc("content"))


@query(
    "paginate",
    ACT + """, f AS (SELECT event_id, kind, us, count(*) OVER () AS total FROM act WHERE contains(lower(content), 'file'))
SELECT event_id, kind, us, total, CAST(ceil(total / 50.0) AS BIGINT) AS pages FROM f ORDER BY us DESC, event_id DESC LIMIT 50 OFFSET 100""",
)
def paginate(spark, sf):
    found = activity(spark, sf).filter(F.lower("content").contains("file")).select("event_id", "kind", "us")
    return K.page(found, 3, 50, F.desc("us"), F.desc("event_id"))


@query("last_n", ACT + " SELECT event_id, device, us FROM act WHERE kind = 'usb' ORDER BY us DESC, event_id DESC LIMIT 25")
def last_n(spark, sf):
    devices = activity(spark, sf).filter("kind = 'usb'").select("event_id", "device", "us")
    return K.top(devices, 25, F.desc("us"), F.desc("event_id"))


@query(
    "top_apps",
    ACT + TIME_SQL + """, a AS (SELECT app, sum(seconds) AS s FROM l GROUP BY 1)
SELECT app, round(s, 3) AS seconds, round(s / (SELECT sum(s) FROM a) * 100, 6) AS percentage FROM a ORDER BY s DESC, app LIMIT 10""",
)
def top_apps(spark, sf):
    by_app = spent(spark, sf).groupBy("app").agg(F.sum("seconds").alias("seconds"))
    best = K.top(K.with_share(by_app, "seconds"), 10, F.desc("seconds"), F.asc("app"))
    return best.select("app", F.round("seconds", 3).alias("seconds"), r6("percentage").alias("percentage"))


FACTORS = {"behavioral_anomaly": "k / 99.0", "insider_threat": SCORE, "access_risk": "(k * 7 % 100) / 100.0", "temporal_risk": "hour(ts) / 24.0"}


def factor_columns():
    k = F.col("k")
    return {"behavioral_anomaly": k / 99, "insider_threat": score(), "access_risk": (k * 7 % 100) / 100, "temporal_risk": F.hour("ts") / 24}


@query(
    "primary_factors",
    ACT + ", f AS (" + " UNION ALL ".join(
        f"SELECT event_id, '{n}' AS name, ({e})::DOUBLE AS s, {i} AS i FROM act" for i, (n, e) in enumerate(FACTORS.items())
    ) + """), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s DESC, i) AS rn FROM f)
SELECT event_id, string_agg(name, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS factors,
  coalesce(string_agg(name, ',' ORDER BY rn) FILTER (WHERE rn <= 3 AND s > 0.5), '') AS high_factors FROM r GROUP BY 1""",
)
def primary_factors(spark, sf):
    scores = factor_columns()
    return activity(spark, sf).select(
        "event_id",
        F.array_join(K.leading_factors(scores), ",").alias("factors"),
        F.array_join(K.leading_factors(scores, above=0.5), ",").alias("high_factors"),
    )


@query(
    "importance_rank",
    ACT + ", f AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, abs(corr({e}, value)) AS importance FROM act"
        for n, e in (("position", "x"), ("height", "y"), ("hour", "hour(ts)"), ("size", "size"))
    ) + ") SELECT row_number() OVER (ORDER BY importance DESC) AS rank, feature, round(importance, 6) AS importance FROM f",
)
def importance_rank(spark, sf):
    columns = {"position": F.col("x"), "height": F.col("y"), "hour": F.hour("ts"), "size": F.col("size")}
    wide = activity(spark, sf).agg(*[F.abs(F.corr(c.cast("double"), F.col("value"))).alias(n) for n, c in columns.items()])
    long = wide.unpivot([], list(columns), "feature", "importance")
    return K.rank_named(long, F.col("importance")).withColumn("importance", r6("importance"))


@query(
    "latest_per_user",
    ACT + f""", r AS (SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM act WHERE {SCORE} > 0.3)
SELECT * FROM r WHERE rn <= 20""",
)
def latest_per_user(spark, sf):
    anomalies = activity(spark, sf).filter(score() > 0.3).select("user_id", "event_id", "ts", "us")
    return newest(anomalies, ["user_id"], 20).select("user_id", "event_id", "us", "rn")


@query(
    "device_diff",
    ACT + """, s AS (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list(DISTINCT device)) AS cur FROM act GROUP BY 1, 2),
l AS (SELECT *, coalesce(lag(cur) OVER (PARTITION BY user_id ORDER BY day), []) AS prev FROM s)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, array_to_string(list_filter(cur, lambda d: NOT list_contains(prev, d)), ',') AS connected,
  array_to_string(list_filter(prev, lambda d: NOT list_contains(cur, d)), ',') AS disconnected FROM l""",
)
def device_diff(spark, sf):
    daily = activity(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("device")).alias("devices"))
    out = K.snapshot_diff(daily, "user_id", "day", "devices")
    return out.select(
        "user_id", F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.array_join("connected", ",").alias("connected"), F.array_join("disconnected", ",").alias("disconnected"),
    )


def halves(spark, sf):
    rows = activity(spark, sf)
    early = F.col("ts") < F.lit("2024-01-04").cast("timestamp")
    return rows.filter(early).select("user_id", "content"), rows.filter(~early).select("user_id", "content")


EARLY, LATE = "ts < TIMESTAMP '2024-01-04'", "ts >= TIMESTAMP '2024-01-04'"


@query(
    "feature_intersect",
    ACT + f" SELECT user_id, content FROM act WHERE {EARLY} INTERSECT SELECT user_id, content FROM act WHERE {LATE}",
)
def feature_intersect(spark, sf):
    early, late = halves(spark, sf)
    return early.intersect(late)


@query(
    "feature_union",
    ACT + f""", u AS (SELECT user_id, content FROM act WHERE {EARLY} UNION SELECT user_id, content FROM act WHERE {LATE})
SELECT user_id, string_agg(content, ',' ORDER BY content) AS names, count(*) AS n FROM u GROUP BY 1""",
)
def feature_union(spark, sf):
    early, late = halves(spark, sf)
    names = early.union(late).distinct().groupBy("user_id").agg(F.array_sort(F.collect_list("content")).alias("names"))
    return names.select("user_id", F.array_join("names", ",").alias("names"), F.size("names").alias("n"))


@query(
    "distinct_indicators",
    ACT + f""", i AS (SELECT user_id, kind || '_' || {level_sql(SCORE, 'threat')} AS name, us, event_id FROM act WHERE {SCORE} > 0.4),
f AS (SELECT user_id, name, min(us) AS seen FROM i GROUP BY 1, 2) SELECT user_id, string_agg(name, ',' ORDER BY seen, name) AS indicators FROM f GROUP BY 1""",
)
def distinct_indicators(spark, sf):
    named = activity(spark, sf).filter(score() > 0.4).select(
        "user_id", "us", F.concat_ws("_", "kind", level(score(), "threat")).alias("name")
    )
    out = K.first_seen_order(named, ["user_id"], "name", F.col("us"))
    return out.select("user_id", F.array_join("seen", ",").alias("indicators"))
