"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlens.functions import clock, text
from sessionlens.functions import patterns as P
from sessionlens.functions.levels import level
from sessionlens.operators import aggregates as A
from sessionlens.operators import profiles
from sessionlens.operators.joins import long_features
from sessionlens.operators.sequence import framed, newest, settled
from sessionlens.plans.catalog import query
from sessionlens.plans.joins import EVENTS_W, LONG_SQL, SCORE, features, r6, score
from sessionlens.plans.rows import contains_sql, level_sql, tags_sql
from sessionlens.plans.tables import ACT, activity, read, texts

WORD = r"[\p{L}\p{N}_]+"
ENTROPY = "log2(sum(n)) - sum(n * log2(n)) / sum(n)"


def rounded(df, *keep):
    """Round every column but the kept ones."""
    return df.select(*keep, *[r6(c).alias(c) for c in df.columns if c not in keep])


@query(
    "event_counts",
    ACT + """SELECT CASE WHEN grouping_id(kind, app) = 3 THEN 'all' WHEN grouping_id(kind, app) = 1 THEN 'type' ELSE 'window' END AS scope,
  coalesce(kind, app, '') AS name, count(*) AS events, CAST(sum(length(content)) AS BIGINT) AS chars,
  CAST(sum(len(list_filter(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2))) AS BIGINT) AS words,
  count(*) FILTER (WHERE content = '') AS blanks
FROM act GROUP BY GROUPING SETS ((), (kind), (app))""",
)
def event_counts(spark, sf):
    return A.event_counts(activity(spark, sf), "kind", "app", "content", F.size(text.words(F.col("content"))))


@query(
    "word_freq",
    f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE length(word) >= 2 GROUP BY 1""",
)
def word_freq(spark, sf):
    return A.word_frequency(texts(spark, sf), text.words(F.col("text")))


@query(
    "pattern_counts",
    f"WITH t AS (SELECT unnest({tags_sql()}) AS tag FROM documents) SELECT tag, count(*) AS n FROM t GROUP BY 1",
)
def pattern_counts(spark, sf):
    tags = texts(spark, sf).select(F.explode(text.content_tags(F.col("text"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "hourly_activity",
    """WITH c AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, arg_min(h, -n * 100 + h) AS peak_hour, round(var_pop(n), 6) AS activity_variance, count(*) AS active_hours,
  min(h) AS first_hour, max(h) AS last_hour FROM c GROUP BY 1""",
)
def hourly_activity(spark, sf):
    out = A.hourly_activity(activity(spark, sf), ["user_id"])
    return out.withColumn("activity_variance", r6("activity_variance"))


@query("window_activity", ACT + " SELECT app, count(*) AS events, max(us) AS last_activity FROM act GROUP BY 1")
def window_activity(spark, sf):
    return activity(spark, sf).groupBy("app").agg(F.count(F.lit(1)).alias("events"), F.max("us").alias("last_activity"))


FILL_SQL = """, g AS (SELECT event_id, user_id, CASE WHEN k % 3 = 0 THEN NULL ELSE app END AS app, CASE WHEN k % 5 = 0 THEN NULL ELSE us END AS us FROM act),
filled AS (SELECT event_id, user_id, last_value(app IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS app,
  last_value(us IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS us FROM g)"""


def _filled(spark, sf):
    k = F.col("k")
    gappy = activity(spark, sf).select(
        "event_id", "user_id", F.when(k % 3 != 0, F.col("app")).alias("app"), F.when(k % 5 != 0, F.col("us")).alias("us")
    )
    return A.forward_fill(gappy, "user_id", ["app", "us"])


@query(
    "forward_fill",
    ACT + FILL_SQL + " SELECT event_id, coalesce(app, 'Unknown') AS app, coalesce(us, 0) AS us FROM filled",
)
def forward_fill(spark, sf):
    return _filled(spark, sf).select(
        "event_id", F.coalesce("app", F.lit("Unknown")).alias("app"), F.coalesce("us", F.lit(0)).alias("us")
    )


@query(
    "app_usage_span",
    ACT + FILL_SQL + """SELECT user_id, app, min(us) AS first_seen, max(us) AS last_seen, round((max(us) - min(us)) / 1e6, 6) AS duration
FROM filled WHERE app IS NOT NULL AND us IS NOT NULL GROUP BY 1, 2""",
)
def app_usage_span(spark, sf):
    known = _filled(spark, sf).filter("app IS NOT NULL AND us IS NOT NULL")
    return A.usage_span(known, ["user_id", "app"]).withColumn("duration", F.round("duration", 6))


@query(
    "daily_window_report",
    ACT + """, d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, app, kind, event_id, ts,
  CASE WHEN kind <> 'keyboard' THEN row_number() OVER (PARTITION BY CAST(ts AS DATE), app, kind <> 'keyboard' ORDER BY ts, event_id) END AS rn FROM act),
w AS (SELECT day, app, count(*) AS events, count(*) FILTER (WHERE kind <> 'keyboard') AS others,
  coalesce(string_agg(CASE WHEN rn <= 10 THEN event_id::VARCHAR END, ',' ORDER BY rn), '') AS listed FROM d GROUP BY 1, 2)
SELECT day, app, events, others, greatest(others - 10, 0) AS more, listed FROM w
UNION ALL SELECT day, '(all)', CAST(sum(events) AS BIGINT), CAST(sum(others) AS BIGINT), 0, '' FROM w GROUP BY 1""",
)
def daily_window_report(spark, sf):
    rows = activity(spark, sf).select("event_id", "ts", "app", "kind", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    other = F.col("kind") != "keyboard"
    counts = rows.rollup("day", "app").agg(
        F.grouping("app").alias("_all"), F.count(F.lit(1)).alias("events"), F.count_if(other).alias("others")
    ).filter("day IS NOT NULL")
    first = newest(
        rows.filter(other).withColumns({"nt": -F.unix_micros("ts"), "ne": -F.col("event_id")}), ["day", "app"], 10, order=["nt", "ne"]
    )
    listed = first.groupBy("day", "app").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_id"))), lambda r: r["event_id"]), ",").alias("listed")
    )
    whole_day = F.col("_all") == 1
    return counts.withColumn("app", F.when(whole_day, "(all)").otherwise(F.col("app"))).join(listed, ["day", "app"], "left").select(
        "day", "app", "events", "others",
        F.when(whole_day, 0).otherwise(F.greatest(F.col("others") - 10, F.lit(0))).alias("more"),
        F.coalesce("listed", F.lit("")).alias("listed"),
    )


KINDS = ["keyboard", "mouse", "clipboard", "window"]


@query(
    "type_ratios",
    ACT + "SELECT user_id, " + ", ".join(f"round(avg((kind = '{k}')::INT), 6) AS {k}_ratio" for k in KINDS) + " FROM act GROUP BY 1",
)
def type_ratios(spark, sf):
    return activity(spark, sf).groupBy("user_id").agg(*[r6(A.share(F.col("kind") == k)).alias(f"{k}_ratio") for k in KINDS])


@query(
    "app_switching",
    ACT + f""", w AS (SELECT user_id, app, app <> lag(app) OVER {EVENTS_W}) AS switched FROM act WHERE kind = 'window'),
c AS (SELECT user_id, app, count(*) AS n, count(*) FILTER (WHERE switched) AS s FROM w GROUP BY 1, 2)
SELECT user_id, CAST(sum(s) AS BIGINT) AS app_switches, count(*) AS unique_apps, round({ENTROPY}, 6) + 0.0 AS app_diversity FROM c GROUP BY 1""",
)
def app_switching(spark, sf):
    return A.app_switching(activity(spark, sf)).withColumn("app_diversity", r6("app_diversity"))


@query(
    "mouse_summary",
    ACT + f""", m AS (SELECT user_id, sqrt((x - lag(x) OVER {EVENTS_W})) ** 2 + (y - lag(y) OVER {EVENTS_W})) ** 2) AS d
  FROM act WHERE kind = 'mouse' AND action = 'move'),
c AS (SELECT user_id, avg((action = 'click')::INT) AS click_rate FROM act WHERE kind = 'mouse' GROUP BY 1),
v AS (SELECT user_id, avg(d) AS a, var_pop(d) AS v FROM m GROUP BY 1)
SELECT user_id, round(click_rate, 6) AS click_rate, round(a, 6) AS avg_distance, round(v, 6) AS distance_variance FROM c LEFT JOIN v USING (user_id)""",
)
def mouse_summary(spark, sf):
    return rounded(A.mouse_summary(activity(spark, sf)), "user_id")


@query(
    "clipboard_summary",
    ACT + """SELECT user_id, count(*) AS copies, round(avg(size), 6) AS avg_length, round(var_pop(size), 6) AS length_variance,
  count(*) FILTER (WHERE size < 50) AS short, count(*) FILTER (WHERE size >= 50 AND size < 500) AS medium,
  count(*) FILTER (WHERE size >= 500) AS long, count(DISTINCT hour(ts)) AS hours FROM act WHERE kind = 'clipboard' GROUP BY 1""",
)
def clipboard_summary(spark, sf):
    size = F.col("size")
    return activity(spark, sf).filter("kind = 'clipboard'").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("copies"), r6(F.avg(size)).alias("avg_length"), r6(F.var_pop(size)).alias("length_variance"),
        F.count_if(size < 50).alias("short"), F.count_if((size >= 50) & (size < 500)).alias("medium"),
        F.count_if(size >= 500).alias("long"), F.countDistinct(F.hour("ts")).alias("hours"),
    )


@query(
    "threat_counts",
    ACT + f"""SELECT user_id, count(*) FILTER (WHERE contains(lower(content), 'file')) AS file_access,
  round(avg((hour(ts) < 9 OR hour(ts) > 17)::INT), 6) AS after_hours_ratio, round(avg((isodow(ts) >= 6)::INT), 6) AS weekend_ratio,
  count(*) FILTER (WHERE kind = 'clipboard' AND size > 1000) AS large_clipboard, count(*) FILTER (WHERE kind = 'usb') AS usb_activity,
  count(*) FILTER (WHERE {contains_sql('content', P.ADMIN_WORDS)}) AS admin_activity,
  count(*) FILTER (WHERE {contains_sql('content', P.NETWORK_WORDS)}) AS network_activity FROM act GROUP BY 1""",
)
def threat_counts(spark, sf):
    content = F.col("content")
    return activity(spark, sf).groupBy("user_id").agg(
        F.count_if(text.contains_any(content, ["file"])).alias("file_access"),
        r6(A.share(clock.after_hours(first=9, last=17))).alias("after_hours_ratio"),
        r6(A.share(clock.is_weekend())).alias("weekend_ratio"),
        F.count_if((F.col("kind") == "clipboard") & (F.col("size") > 1000)).alias("large_clipboard"),
        F.count_if(F.col("kind") == "usb").alias("usb_activity"),
        F.count_if(text.contains_any(content, P.ADMIN_WORDS)).alias("admin_activity"),
        F.count_if(text.contains_any(content, P.NETWORK_WORDS)).alias("network_activity"),
    )


def moments_sql(source: str, key: str, x: str, extra: str = "") -> str:
    """Population moments by power sums of centred values."""
    return f"""SELECT {key}, avg(x) AS m, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi,
  avg((x - mu) ** 3) / nullif(stddev_pop(x), 0) ** 3 AS sk, avg((x - mu) ** 4) / nullif(stddev_pop(x), 0) ** 4 - 3 AS ku{extra}
  FROM (SELECT {key}, {x} AS x, avg({x}) OVER (PARTITION BY {key}) AS mu FROM {source}) GROUP BY 1"""


@query(
    "dwell_flight_stats",
    "WITH s AS (" + moments_sql("events", "user_id", "value", ", quantile_cont(x, 0.25) AS q1, median(x) AS q2, quantile_cont(x, 0.75) AS q3") + """)
SELECT user_id, round(m, 6) AS value_mean, round(sd, 6) AS value_std, round(lo, 6) AS value_min, round(hi, 6) AS value_max, round(sk, 6) + 0.0 AS value_skew,
  round(ku, 6) + 0.0 AS value_kurtosis, round(q1, 6) AS q25, round(q2, 6) AS median, round(q3, 6) AS q75 FROM s""",
)
def dwell_flight_stats(spark, sf):
    return rounded(A.distribution(activity(spark, sf).select("user_id", "value"), ["user_id"], "value"), "user_id")


def hist_sql(source: str, key: str, x: str) -> str:
    return f"""SELECT {key}, {ENTROPY} AS e FROM (SELECT {key}, b, count(*) AS n FROM
  (SELECT {key}, CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 10), 9) ELSE 0 END AS b FROM
    (SELECT {key}, {x} AS x, min({x}) OVER (PARTITION BY {key}) AS lo, max({x}) OVER (PARTITION BY {key}) AS hi FROM {source} WHERE {x} IS NOT NULL))
  GROUP BY 1, 2) GROUP BY 1"""


@query(
    "rhythm_session",
    ACT + f""", g AS (SELECT user_id, (us - lag(us) OVER {EVENTS_W})) / 1e3 AS gap FROM act),
s AS (SELECT user_id, count(*) AS n, stddev_pop(gap) AS sd, sum(gap) AS total FROM g GROUP BY 1), h AS ({hist_sql('g', 'user_id', 'gap')})
SELECT user_id, round(1 / (1 + sd) * 1e6, 6) AS consistency_ppm, round(n / (total / 1000) * 1e6, 6) AS speed_ppm, round(e, 6) + 0.0 AS rhythm_entropy
FROM s JOIN h USING (user_id)""",
)
def rhythm_session(spark, sf):
    out = A.rhythm(activity(spark, sf))
    return out.select(
        "user_id", r6(F.col("consistency") * 1e6).alias("consistency_ppm"), r6(F.col("speed") * 1e6).alias("speed_ppm"),
        r6("rhythm_entropy").alias("rhythm_entropy"),
    )


@query(
    "key_usage",
    ACT + f""", c AS (SELECT user_id, key, count(*) AS n FROM act WHERE kind = 'keyboard' GROUP BY 1, 2)
SELECT user_id, count(*) AS unique_keys, round(count(*) / sum(n), 6) AS key_diversity, round(max(n) / sum(n), 6) AS top_key_share,
  round(sum(CASE WHEN key IN ('a', 'e') THEN n ELSE 0 END) / sum(n), 6) AS special_key_ratio, round({ENTROPY}, 6) + 0.0 AS key_entropy FROM c GROUP BY 1""",
)
def key_usage(spark, sf):
    return rounded(A.key_usage(activity(spark, sf).filter("kind = 'keyboard'"), special=["a", "e"]), "user_id", "unique_keys")


@query(
    "activity_rate",
    ACT + """SELECT user_id, round(count(*) / ((max(us) - min(us)) / 1e6) * 1e6, 6) AS per_megasecond,
  round(count(*) / greatest((max(us) - min(us)) / 1e6 / 3600, 0.001), 6) AS per_hour FROM act GROUP BY 1""",
)
def activity_rate(spark, sf):
    out = A.activity_rate(activity(spark, sf))
    return out.select("user_id", r6(F.col("per_second") * 1e6).alias("per_megasecond"), r6("per_hour").alias("per_hour"))


@query("hist_entropy", f"WITH h AS ({hist_sql('events', 'user_id', 'value')}) SELECT user_id, round(e, 6) + 0.0 AS entropy FROM h")
def hist_entropy(spark, sf):
    return rounded(A.histogram_entropy(read(spark, sf, "events").select("user_id", "value"), ["user_id"], "value"), "user_id")


@query(
    "category_entropy",
    f"""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, round({ENTROPY}, 6) + 0.0 AS entropy FROM c GROUP BY 1""",
)
def category_entropy(spark, sf):
    return rounded(A.category_entropy(read(spark, sf, "events"), ["user_id"], "event_type"), "user_id")


@query(
    "hour_day_vectors",
    "SELECT user_id, " + ", ".join(f"round(avg((hour(ts) = {h})::INT), 6) AS h{h:02d}" for h in range(24))
    + ", " + ", ".join(f"round(avg((isodow(ts) = {d + 1})::INT), 6) AS d{d}" for d in range(7)) + " FROM events GROUP BY 1",
)
def hour_day_vectors(spark, sf):
    return rounded(A.hour_day_shares(activity(spark, sf)), "user_id")


@query(
    "activity_patterns",
    ACT + """, t AS (SELECT user_id, kind, count(*) AS n FROM act GROUP BY 1, 2), h AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM act GROUP BY 1, 2),
a AS (SELECT user_id, app, count(*) AS n FROM act GROUP BY 1, 2)
SELECT user_id, k.top AS top_kind, k.dist AS distribution, k.kinds, p.peak_hour, p.first_hour, p.last_hour, q.top AS top_app FROM
(SELECT user_id, first(kind ORDER BY n DESC, kind) AS top, count(*) AS kinds, string_agg(kind || '=' || n, ',' ORDER BY kind) AS dist FROM t GROUP BY 1) k
JOIN (SELECT user_id, first(h ORDER BY n DESC, h) AS peak_hour, min(h) AS first_hour, max(h) AS last_hour FROM h GROUP BY 1) p USING (user_id)
JOIN (SELECT user_id, first(app ORDER BY n DESC, app) AS top FROM a GROUP BY 1) q USING (user_id)""",
)
def activity_patterns(spark, sf):
    rows = activity(spark, sf)
    counts = rows.groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    spread = counts.groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit("="), F.col("n").cast("string")))), ",").alias("distribution")
    )
    kinds = A.most_common(rows, ["user_id"], "kind").select("user_id", F.col("top").alias("top_kind"), F.col("distinct").alias("kinds"))
    apps = A.most_common(rows, ["user_id"], "app").select("user_id", F.col("top").alias("top_app"))
    hours = A.hourly_activity(rows, ["user_id"]).select("user_id", "peak_hour", "first_hour", "last_hour")
    return kinds.join(spread, "user_id").join(apps, "user_id").join(hours, "user_id")


@query(
    "transitions",
    f"""WITH p AS (SELECT lag(event_type) OVER {EVENTS_W}) AS previous, event_type AS next FROM events),
c AS (SELECT previous, next, count(*) AS n FROM p WHERE previous IS NOT NULL GROUP BY 1, 2)
SELECT previous, next, n, count(*) OVER () AS diversity FROM c ORDER BY n DESC, previous, next LIMIT 5""",
)
def transitions(spark, sf):
    counts = A.transitions(activity(spark, sf))
    diversity = counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("diversity", diversity).orderBy(F.desc("n"), "previous", "next").limit(5)


@query(
    "comprehensive_stats",
    ACT + f""", s AS ({moments_sql("act", "user_id", "(us - 1704067200000000) / 1e6")}),
t AS (SELECT user_id, {ENTROPY} AS e, max(n) AS top FROM (SELECT user_id, kind, count(*) AS n FROM act GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT user_id, count(*) AS apps, max(n) / sum(n) AS primary_share FROM (SELECT user_id, app, count(*) AS n FROM act GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT user_id, avg(gap) AS gm, stddev_pop(gap) AS gs FROM (SELECT user_id, (us - lag(us) OVER {EVENTS_W})) / 1e6 AS gap FROM act) GROUP BY 1),
r AS (SELECT user_id, avg(k) AS cm, var_pop(k) AS cv, avg(value) AS mm, var_pop(value) AS mv FROM act GROUP BY 1)
SELECT user_id, round(m, 3) AS timing_mean, round(sd, 3) AS timing_std, round(sk, 6) + 0.0 AS timing_skewness, round(ku, 6) + 0.0 AS timing_kurtosis,
  round(e, 6) AS type_entropy, top AS most_frequent, round(gm, 3) AS gap_mean, round(gs, 3) AS gap_std, apps AS app_diversity,
  round(primary_share, 6) AS primary_share, round(cm, 6) AS cpu_mean, round(cv, 6) AS cpu_variance, round(mm, 6) AS memory_mean, round(mv, 6) AS memory_variance
FROM s JOIN t USING (user_id) JOIN a USING (user_id) JOIN g USING (user_id) JOIN r USING (user_id)""",
)
def comprehensive_stats(spark, sf):
    rows = activity(spark, sf)
    at = (F.col("us") - F.lit(1704067200000000)) / 1e6
    gaps = A.intervals(rows.select("user_id", "event_id", "ts", "us", "k", "value"), "user_id")
    base = gaps.groupBy("user_id").agg(
        F.round(F.avg(at), 3).alias("timing_mean"), F.round(F.stddev_pop(at), 3).alias("timing_std"),
        r6(F.skewness(at)).alias("timing_skewness"), r6(F.kurtosis(at)).alias("timing_kurtosis"),
        F.round(F.avg("gap"), 3).alias("gap_mean"), F.round(F.stddev_pop("gap"), 3).alias("gap_std"),
        r6(F.avg("k")).alias("cpu_mean"), r6(F.var_pop("k")).alias("cpu_variance"),
        r6(F.avg("value")).alias("memory_mean"), r6(F.var_pop("value")).alias("memory_variance"),
    )
    kinds = rows.groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(
        r6(A.entropy_of_counts(F.col("n"))).alias("type_entropy"), F.max("n").alias("most_frequent")
    )
    apps = A.most_common(rows, ["user_id"], "app").select(
        "user_id", F.col("distinct").alias("app_diversity"), r6(F.col("top_count") / F.col("total")).alias("primary_share")
    )
    return base.join(kinds, "user_id").join(apps, "user_id")


@query(
    "spectral_features",
    """WITH c AS (SELECT user_id, hour(ts) AS s, count(*) AS n FROM events GROUP BY 1, 2), ks AS (SELECT unnest(range(24)) AS k),
m AS (SELECT user_id, k, sqrt(pow(sum(n * cos(2 * pi() * k * s / 24)), 2) + pow(sum(n * sin(2 * pi() * k * s / 24)), 2)) AS m FROM c, ks GROUP BY 1, 2),
t AS (SELECT *, sum(m) OVER (PARTITION BY user_id) AS total, sum(m) OVER (PARTITION BY user_id ORDER BY k) AS upto FROM m)
SELECT user_id, first(k ORDER BY round(m, 6) DESC, k) AS dominant, round(max(m), 6) AS magnitude,
  round(sum(CASE WHEN k < 12 THEN k ELSE k - 24 END / 24 * m) / max(total), 6) + 0.0 AS centroid,
  round(min(CASE WHEN upto >= 0.85 * total THEN k END) / 24, 6) AS rolloff FROM t GROUP BY 1""",
)
def spectral_features(spark, sf):
    out = A.spectrum(activity(spark, sf), "user_id", F.hour("ts"), 24)
    return out.select("user_id", "dominant", r6("magnitude").alias("magnitude"), r6("centroid").alias("centroid"), r6("rolloff").alias("rolloff"))


def _profile_features():
    return {
        "dwell": F.when(F.col("kind") == "keyboard", F.col("value")),
        "size": F.when(F.col("kind") == "clipboard", F.col("size")),
        "position": F.when(F.col("kind") == "mouse", F.col("x")),
    }


@query(
    "user_profile",
    ACT + ", f AS (" + " UNION ALL ".join(
        f"SELECT user_id, '{n}' AS feature, CASE WHEN kind = '{k}' THEN {c} ELSE 0 END::DOUBLE AS x FROM act"
        for n, k, c in (("dwell", "keyboard", "value"), ("size", "clipboard", "size"), ("position", "mouse", "x"))
    ) + ") SELECT user_id, feature, count(*) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std FROM f GROUP BY 1, 2",
)
def user_profile(spark, sf):
    out = profiles.feature_profile(activity(spark, sf), ["user_id"], _profile_features())
    return out.withColumns({"mean": A.r9("mean"), "std": A.r9("std")})


@query(
    "baseline_summary",
    ACT + f", {LONG_SQL} SELECT feature, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max FROM long GROUP BY 1",
)
def baseline_summary(spark, sf):
    out = profiles.baseline_summary(long_features(activity(spark, sf), ["event_id"], features()))
    return out.withColumns({"mean": r6("mean"), "std": r6("std")})


@query(
    "behaviour_drift",
    ACT + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM act),
d AS (SELECT user_id, (abs(avg(value) FILTER (WHERE rn <= 20) - avg(value) FILTER (WHERE rn > 20)) / (stddev_pop(value) FILTER (WHERE rn > 20) + 1e-6)
  + abs(avg(x) FILTER (WHERE rn <= 20) - avg(x) FILTER (WHERE rn > 20)) / (stddev_pop(x) FILTER (WHERE rn > 20) + 1e-6)) / 2 AS drift
  FROM r WHERE rn <= 80 GROUP BY 1)
SELECT user_id, round(drift, 6) AS drift, drift > 0.2 AS adapt FROM d WHERE drift IS NOT NULL""",
)
def behaviour_drift(spark, sf):
    rows = activity(spark, sf).select("user_id", "event_id", "ts", "value", "x")
    out = profiles.behaviour_drift(rows, "user_id", ["value", "x"], recent=20, base=60, limit=0.2)
    return out.withColumn("drift", r6("drift"))


@query(
    "initial_risk",
    ACT + """, s AS (SELECT user_id, value / 100 AS a, k / 50.0 AS b FROM act)
SELECT user_id, round(CASE WHEN count(*) > 1 THEN least((var_pop(a) + var_pop(b)) / 2 / 10, 1.0) ELSE 0.1 END, 6) AS initial_risk FROM s GROUP BY 1""",
)
def initial_risk(spark, sf):
    rows = activity(spark, sf).select("user_id", (F.col("value") / 100).alias("a"), (F.col("k") / 50).alias("b"))
    return rounded(profiles.initial_risk(rows, "user_id", ["a", "b"]), "user_id")


@query(
    "threat_summary",
    ACT + f""", i AS (SELECT kind AS category, {level_sql(SCORE, 'severity')} AS severity, ts >= (SELECT max(ts) FROM act) - INTERVAL 24 HOUR AS recent
  FROM act WHERE {SCORE} >= 0.7)
SELECT category, count(*) AS total, count(*) FILTER (WHERE recent) AS recent, """
    + ", ".join(f"count(*) FILTER (WHERE recent AND severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low"))
    + " FROM i GROUP BY 1",
)
def threat_summary(spark, sf):
    rows = activity(spark, sf)
    as_of = rows.agg(F.max("ts")).scalar()
    incidents = rows.filter(score() >= 0.7).select(F.col("kind").alias("category"), level(score(), "severity").alias("severity"), "ts")
    recent = F.col("ts") >= as_of - F.expr("INTERVAL 24 HOURS")
    return profiles.severity_counts(incidents.withColumn("_recent", recent), ["category"], "severity", F.col("_recent"))


USER_RISK_SQL = ", u AS (SELECT user_id, avg(least(value / 60, 1.0)) AS risk FROM act GROUP BY 1)"
BAND_SQL = "CASE WHEN risk < 0.3 THEN 'low' WHEN risk < 0.6 THEN 'medium' WHEN risk < 0.8 THEN 'high' ELSE 'critical' END"


def _user_risk(spark, sf):
    return activity(spark, sf).groupBy("user_id").agg(F.avg(F.least(F.col("value") / 60, F.lit(1.0))).alias("risk"))


@query(
    "user_risk_distribution",
    ACT + USER_RISK_SQL + f" SELECT {BAND_SQL} AS band, count(*) AS users, round(avg(risk), 6) AS average_risk FROM u GROUP BY 1",
)
def user_risk_distribution(spark, sf):
    return _user_risk(spark, sf).groupBy(profiles.risk_band(F.col("risk")).alias("band")).agg(
        F.count(F.lit(1)).alias("users"), r6(F.avg("risk")).alias("average_risk")
    )


@query(
    "user_risk_7d",
    ACT + f""", s AS (SELECT user_id, us, {SCORE} > 0.7 AS anomalous, ts >= (SELECT max(ts) FROM act) - INTERVAL 7 DAY AS recent FROM act),
u AS (SELECT user_id, min(us) AS first_seen, max(us) AS last_seen, count(*) FILTER (WHERE anomalous) AS anomalies,
  count(*) FILTER (WHERE anomalous AND recent) AS recent_anomalies FROM s GROUP BY 1)
SELECT *, CASE WHEN recent_anomalies >= 5 THEN 'high' WHEN recent_anomalies >= 2 THEN 'medium' ELSE 'low' END AS risk_level FROM u""",
)
def user_risk_7d(spark, sf):
    rows = activity(spark, sf)
    as_of = rows.agg(F.max("ts")).scalar()
    flagged = rows.select("user_id", "us", (score() > 0.7).alias("a"), (F.col("ts") >= as_of - F.expr("INTERVAL 7 DAYS")).alias("r"))
    counted = flagged.groupBy("user_id").agg(
        F.min("us").alias("first_seen"), F.max("us").alias("last_seen"), F.count_if("a").alias("anomalies"),
        F.count_if(F.col("a") & F.col("r")).alias("recent_anomalies"),
    )
    return counted.withColumn("risk_level", profiles.weekly_level(F.col("recent_anomalies")))


@query(
    "detection_rates",
    ACT + f""", s AS (SELECT user_id, kind, k, {SCORE} > 0.7 AS anomalous, k / 99.0 > 0.7 AS confident, {SCORE} > 0.8 AS alerted FROM act)
SELECT user_id, round(avg((kind = 'keyboard' AND k % 10 <> 0)::INT) / nullif(avg((kind = 'keyboard')::INT), 0), 6) AS auth_success_rate,
  round(avg(anomalous::INT), 6) AS detection_rate, round(avg(alerted::INT), 6) AS alert_rate,
  round(count(*) FILTER (WHERE confident AND anomalous) / nullif(count(*) FILTER (WHERE confident), 0), 6) AS confident_anomaly_share FROM s GROUP BY 1""",
)
def detection_rates(spark, sf):
    k, keyboard = F.col("k"), F.col("kind") == "keyboard"
    anomalous, confident = score() > 0.7, k / 99 > 0.7
    return activity(spark, sf).groupBy("user_id").agg(
        r6(F.try_divide(A.share(keyboard & (k % 10 != 0)), A.share(keyboard))).alias("auth_success_rate"),
        r6(A.share(anomalous)).alias("detection_rate"),
        r6(A.share(score() > 0.8)).alias("alert_rate"),
        r6(F.try_divide(F.count_if(confident & anomalous), F.count_if(confident))).alias("confident_anomaly_share"),
    )


@query(
    "exec_summary",
    ACT + USER_RISK_SQL + f""", b AS (SELECT count(*) AS users, count(*) FILTER (WHERE {BAND_SQL} = 'critical') AS critical_users FROM u),
a AS (SELECT count(*) FILTER (WHERE {SCORE} > 0.7) AS anomalies FROM act)
SELECT users, anomalies, critical_users, CASE WHEN critical_users > 0 THEN critical_users || ' users are at critical risk level' ELSE '' END AS finding,
  CASE WHEN critical_users > 5 THEN 'high' WHEN critical_users > 0 THEN 'medium' ELSE 'low' END AS overall_risk FROM b, a""",
)
def exec_summary(spark, sf):
    users = _user_risk(spark, sf).agg(
        F.count(F.lit(1)).alias("users"), F.count_if(profiles.risk_band(F.col("risk")) == "critical").alias("critical_users")
    )
    anomalies = activity(spark, sf).agg(F.count_if(score() > 0.7)).scalar()
    critical = F.col("critical_users")
    return users.select(
        "users", anomalies.alias("anomalies"), "critical_users",
        F.when(critical > 0, F.concat(critical.cast("string"), F.lit(" users are at critical risk level"))).otherwise("").alias("finding"),
        F.when(critical > 5, "high").when(critical > 0, "medium").otherwise("low").alias("overall_risk"),
    )


@query(
    "resource_summary",
    ACT + """, l AS (SELECT k, value FROM act ORDER BY ts DESC, event_id DESC LIMIT 10)
SELECT round((SELECT avg(k) FROM l), 6) AS cpu_recent, round((SELECT avg(value) FROM l), 6) AS memory_recent, max(k) AS cpu_peak, max(value) AS memory_peak,
  count(*) FILTER (WHERE k > 80) + count(*) FILTER (WHERE value > 100) AS alerts FROM act""",
)
def resource_summary(spark, sf):
    rows = activity(spark, sf)
    last = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(10).agg(r6(F.avg("k")).alias("cpu"), r6(F.avg("value")).alias("memory"))
    return rows.agg(
        F.max("k").alias("cpu_peak"), F.max("value").alias("memory_peak"),
        (F.count_if(F.col("k") > 80) + F.count_if(F.col("value") > 100)).alias("alerts"),
    ).withColumns({"cpu_recent": last.select("cpu").scalar(), "memory_recent": last.select("memory").scalar()})


@query(
    "device_summary",
    ACT + """SELECT user_id, count(DISTINCT device) AS unique_devices, count(*) FILTER (WHERE action = 'press') AS connections,
  count(*) FILTER (WHERE action = 'release') AS disconnections, count(*) FILTER (WHERE k % 3 = 0) AS ext4, count(*) FILTER (WHERE k % 3 = 1) AS ntfs,
  count(*) FILTER (WHERE k % 3 = 2) AS fat32 FROM act WHERE kind = 'usb' GROUP BY 1""",
)
def device_summary(spark, sf):
    usb = activity(spark, sf).filter("kind = 'usb'").withColumn(
        "filesystem", F.element_at(F.array(F.lit("ext4"), F.lit("ntfs"), F.lit("fat32")), F.col("k") % 3 + 1)
    )
    return usb.groupBy("user_id").agg(
        F.countDistinct("device").alias("unique_devices"), F.count_if(F.col("action") == "press").alias("connections"),
        F.count_if(F.col("action") == "release").alias("disconnections"),
        *[F.count_if(F.col("filesystem") == f).alias(f) for f in ("ext4", "ntfs", "fat32")],
    )


@query(
    "click_patterns",
    ACT + f""", c AS (SELECT user_id, (us - lag(us) OVER {EVENTS_W})) / 1e6 AS gap FROM act WHERE kind = 'mouse' AND action = 'click')
SELECT user_id, count(*) AS clicks, round(avg(gap), 6) AS mean_gap, round(min(gap), 6) AS min_gap, round(max(gap), 6) AS max_gap,
  round(count(*) FILTER (WHERE gap < 3600) / count(*), 6) AS double_click_rate FROM c GROUP BY 1""",
)
def click_patterns(spark, sf):
    clicks = activity(spark, sf).filter("kind = 'mouse' AND action = 'click'").select("user_id", "event_id", "ts", "us")
    gaps = A.intervals(clicks, "user_id")
    return gaps.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("clicks"), r6(F.avg("gap")).alias("mean_gap"), r6(F.min("gap")).alias("min_gap"),
        r6(F.max("gap")).alias("max_gap"), r6(F.count_if(F.col("gap") < 3600) / F.count(F.lit(1))).alias("double_click_rate"),
    )


@query(
    "session_stats",
    ACT + """SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, min(us) AS started, round((max(us) - min(us)) / 1e6, 6) AS uptime,
  count(*) AS events, count(*) FILTER (WHERE kind = 'keyboard') AS keys, count(*) FILTER (WHERE kind = 'mouse') AS mouse,
  count(*) FILTER (WHERE kind = 'clipboard') AS copies, count(*) FILTER (WHERE kind = 'window') AS window_changes, max(us) AS last_activity FROM act GROUP BY 1""",
)
def session_stats(spark, sf):
    kind = F.col("kind")
    return activity(spark, sf).groupBy(F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("session_id")).agg(
        F.min("us").alias("started"), F.round((F.max("us") - F.min("us")) / 1e6, 6).alias("uptime"), F.count(F.lit(1)).alias("events"),
        F.count_if(kind == "keyboard").alias("keys"), F.count_if(kind == "mouse").alias("mouse"),
        F.count_if(kind == "clipboard").alias("copies"), F.count_if(kind == "window").alias("window_changes"),
        F.max("us").alias("last_activity"),
    )


@query(
    "component_activity",
    ACT + """, c AS (SELECT kind AS component, app, count(*) AS events, ((SELECT max(us) FROM act) - max(us)) / 1e6 AS age FROM act GROUP BY 1, 2)
SELECT component, app, events, CASE WHEN age < 5 THEN 'just now' WHEN age < 60 THEN floor(age)::BIGINT || 's ago' WHEN age < 3600 THEN floor(age / 60)::BIGINT || 'm ago'
  ELSE floor(age / 3600)::BIGINT || 'h ' || floor((floor(age) % 3600) / 60)::BIGINT || 'm ago' END AS last_activity FROM c""",
)
def component_activity(spark, sf):
    rows = activity(spark, sf)
    as_of = rows.agg(F.max("us")).scalar()
    last = rows.groupBy(F.col("kind").alias("component"), "app").agg(F.count(F.lit(1)).alias("events"), F.max("us").alias("_last"))
    return last.select("component", "app", "events", clock.age_label((as_of - F.col("_last")) / 1e6).alias("last_activity"))


@query(
    "clipboard_dedup_changes",
    ACT + f""", c AS (SELECT event_id, user_id, sha256(content) AS h, lag(sha256(content)) OVER {EVENTS_W}) AS p FROM act WHERE kind = 'clipboard')
SELECT event_id, user_id, h AS content_hash FROM c WHERE p IS NULL OR p <> h""",
)
def clipboard_dedup_changes(spark, sf):
    copies = activity(spark, sf).filter("kind = 'clipboard'").select("user_id", "event_id", "ts", F.sha2("content", 256).alias("content_hash"))
    rows, w = framed(copies, ["user_id"], back=1)
    changed = settled(rows.withColumn("_p", F.lag("content_hash").over(w)))
    return changed.filter(F.col("_p").isNull() | (F.col("_p") != F.col("content_hash"))).select("event_id", "user_id", "content_hash")
