"""Window functions and other ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlens.functions.levels import level
from sessionlens.functions.patterns import ESCALATE_EVERY, ESCALATE_EVERY_OTHER
from sessionlens.operators import windows as W
from sessionlens.operators.aggregates import r6, r9, running_count
from sessionlens.operators.feedback import risk_with_feedback
from sessionlens.operators.scoring import adapt_threshold
from sessionlens.operators.sequence import framed, settled
from sessionlens.operators.thinning import thin
from sessionlens.plans.catalog import query
from sessionlens.plans.joins import EVENTS_W, SCORE, score
from sessionlens.plans.rows import level_sql
from sessionlens.plans.tables import ACT, activity

GAP = f"(us - lag(us) OVER {EVENTS_W})) / 1e6"
W_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


def rows_sql(n: int, end: str = "CURRENT ROW") -> str:
    return f"({W_ORDER} ROWS BETWEEN {n} PRECEDING AND {end})"


def act(spark, sf, *columns):
    return activity(spark, sf).select("user_id", "event_id", "ts", "us", *columns)


@query(
    "intervals",
    ACT + f""", g AS (SELECT event_id, {GAP} AS gap, CASE WHEN kind = 'mouse' AND lag(kind) OVER {EVENTS_W}) = 'mouse' THEN
  sqrt((x - lag(x) OVER {EVENTS_W})) ** 2 + (y - lag(y) OVER {EVENTS_W})) ** 2) END AS d FROM act)
SELECT event_id, coalesce(round(gap, 6), -1) AS gap, coalesce(round(d, 6), -1) AS distance, coalesce(round(CASE WHEN gap > 0 THEN d / gap END, 6), -1) AS velocity FROM g""",
)
def intervals(spark, sf):
    out = W.intervals(act(spark, sf, "kind", "x", "y"))
    return out.select("event_id", *[F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(c) for c in ("gap", "distance", "velocity")])


@query(
    "last5_speed",
    ACT + f""", g AS (SELECT event_id, user_id, ts, {GAP} * 1000 AS g FROM act),
s AS (SELECT event_id, count(g) OVER w AS n, avg(g) OVER w AS a, stddev_pop(g) OVER w AS sd, sum(g) OVER w AS total FROM g WINDOW w AS {rows_sql(4)})
SELECT event_id, round(a, 3) AS avg_interval, round(sd, 3) AS std_interval, round(5 / (total / 1000) * 1e6, 3) AS speed FROM s WHERE n = 5""",
)
def last5_speed(spark, sf):
    out = W.typing_speed(act(spark, sf)).filter("avg_interval IS NOT NULL")
    return out.select(
        "event_id", F.round("avg_interval", 3).alias("avg_interval"), F.round("std_interval", 3).alias("std_interval"),
        F.round(F.col("speed") * 1e6, 3).alias("speed"),
    )


@query(
    "last10_context",
    ACT + f""", g AS (SELECT *, {GAP} AS g FROM act),
s AS (SELECT event_id, avg((kind = 'keyboard')::INT) OVER w AS kb, avg((kind = 'mouse')::INT) OVER w AS mo, avg(g) OVER i AS a, var_pop(g) OVER i AS v,
  count(*) FILTER (WHERE g < 600) OVER i AS b FROM g WINDOW w AS {rows_sql(9)}, i AS {rows_sql(8)})
SELECT event_id, round(kb, 6) AS keyboard_share, round(mo, 6) AS mouse_share, coalesce(round(a, 3), -1) AS avg_interval, b AS bursts FROM s""",
)
def last10_context(spark, sf):
    out = W.recent_context(act(spark, sf, "kind"), ["keyboard", "mouse"], burst=600.0)
    return out.select(
        "event_id", r6("keyboard_share").alias("keyboard_share"), r6("mouse_share").alias("mouse_share"),
        F.coalesce(F.round("avg_interval", 3), F.lit(-1.0)).alias("avg_interval"), "bursts",
    )


@query(
    "last10_rhythm",
    ACT + f""", g AS (SELECT event_id, user_id, ts, {GAP} * 1000 AS g FROM act),
s AS (SELECT event_id, count(*) OVER w AS n, list(g) OVER i AS l, avg(g) OVER i AS m, stddev_pop(g) OVER i AS sd FROM g WINDOW w AS {rows_sql(9)}, i AS {rows_sql(8)}),
u AS (SELECT event_id, least(floor((x - lo) / (hi - lo) * 10), 9) AS b FROM
  (SELECT event_id, unnest(l) AS x, list_min(l) AS lo, list_max(l) AS hi FROM s WHERE n = 10)),
e AS (SELECT event_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM (SELECT event_id, b, count(*) AS c FROM u GROUP BY 1, 2) GROUP BY 1)
SELECT event_id, round(m, 3) AS mean, round(sd / m, 6) AS variation, round(entropy, 6) + 0.0 AS entropy,
  len(list_filter(l, lambda x: x < m * 0.5)) AS bursts, len(list_filter(l, lambda x: x > m * 2)) AS pauses FROM s JOIN e USING (event_id)""",
)
def last10_rhythm(spark, sf):
    out = W.recent_rhythm(act(spark, sf))
    return out.select(
        "event_id", F.round("mean", 3).alias("mean"), r6("variation").alias("variation"), r6("entropy").alias("entropy"), "bursts", "pauses"
    )


@query(
    "ngram_freq",
    ACT + f""", s AS (SELECT event_id, kind AS key, list(kind) OVER {rows_sql(50, '1 PRECEDING')} AS l FROM act), n AS (SELECT *, coalesce(len(l), 0) AS n FROM s)
SELECT event_id, CASE WHEN n < 10 THEN 0 ELSE round(len(list_filter(l, lambda a: a = key)) / n, 6) END AS key_share,
  CASE WHEN n < 10 THEN 0 ELSE round(len(list_filter(range(1, n), lambda i: l[i] = l[n] AND l[i + 1] = key)) / (n - 1), 6) END AS bigram_share,
  CASE WHEN n < 10 THEN 0 ELSE round(len(list_filter(range(1, n - 1), lambda i: l[i] = l[n - 1] AND l[i + 1] = l[n] AND l[i + 2] = key)) / (n - 2), 6) END AS trigram_share FROM n""",
)
def ngram_freq(spark, sf):
    out = W.ngram_shares(act(spark, sf, "kind"), "kind")
    return out.select("event_id", *[r6(c).alias(c) for c in ("key_share", "bigram_share", "trigram_share")])


@query(
    "burst_60s",
    ACT + f""", s AS (SELECT event_id, {GAP} AS gap, count(*) OVER w AS n, (max(us) OVER w - min(us) OVER w) / 1e6 AS span FROM act WINDOW w AS {rows_sql(5)})
SELECT event_id, coalesce(gap < 60, false) AS rapid_activity, coalesce(gap > 3600, false) AS extended_gap, n = 6 AND span < 100000 AS burst_activity FROM s""",
)
def burst_60s(spark, sf):
    out = W.gaps_and_bursts(act(spark, sf), span=100000.0, rapid=60.0)
    return out.select("event_id", "rapid_activity", "extended_gap", "burst_activity")


@query(
    "recent_share",
    ACT + f""", s AS (SELECT event_id, kind, count(*) OVER h AS n, avg((kind = 'clipboard')::INT) OVER h AS c, coalesce(bool_or(kind = 'usb') OVER t, false) AS u,
  list(kind) OVER {rows_sql(19)} AS l FROM act WINDOW h AS {rows_sql(100, '1 PRECEDING')}, t AS {rows_sql(10, '1 PRECEDING')})
SELECT event_id, round(CASE WHEN n >= 10 THEN c ELSE 0 END, 6) AS clipboard_share, u AS usb_recent, len(list_filter(l, lambda a: a = kind)) AS same_kind FROM s""",
)
def recent_share(spark, sf):
    out = W.recent_shares(act(spark, sf, "kind"))
    return out.select("event_id", r6("clipboard_share").alias("clipboard_share"), "usb_recent", "same_kind")


@query(
    "behaviour_profile",
    ACT + f""", f AS (SELECT *, hour(ts) < 8 OR hour(ts) > 18 AS late FROM act),
s AS (SELECT event_id, count(*) OVER t AS n, count(*) OVER h AS m, count(*) FILTER (WHERE kind = 'clipboard') OVER t AS c,
  len(list_distinct(coalesce(list(CASE WHEN kind = 'window' THEN app END) OVER t, []))) AS a, count(*) FILTER (WHERE late) OVER t AS l,
  avg((kind = 'clipboard')::INT) OVER h AS bc, avg(late::INT) OVER h AS bl FROM f WINDOW t AS {rows_sql(10, '1 PRECEDING')}, h AS {rows_sql(100, '1 PRECEDING')})
SELECT event_id, c AS clipboard_usage, a AS application_switches, l AS after_hours_activity, CASE WHEN m >= 50 THEN round(bc, 6) ELSE -1 END AS base_clipboard,
  CASE WHEN m >= 50 THEN round(bl, 6) ELSE -1 END AS base_after_hours FROM s WHERE n = 10""",
)
def behaviour_profile(spark, sf):
    out = W.behaviour_profile(act(spark, sf, "kind", "app")).filter("clipboard_usage IS NOT NULL")
    return out.select(
        "event_id", "clipboard_usage", "application_switches", "after_hours_activity",
        *[F.coalesce(r6(c), F.lit(-1.0)).alias(c) for c in ("base_clipboard", "base_after_hours")],
    )


@query(
    "activity_context",
    ACT + f""", s AS (SELECT event_id, count(*) OVER w AS n, (max(us) OVER w - min(us) OVER w) / 1e6 AS span, list(kind) OVER w AS l FROM act WINDOW w AS {rows_sql(9)})
SELECT event_id, round(n / greatest(span, 1) * 1e6, 3) AS intensity, round(len(list_distinct(l)) / n, 6) AS diversity FROM s WHERE n >= 5""",
)
def activity_context(spark, sf):
    out = W.activity_context(act(spark, sf, "kind")).filter("intensity IS NOT NULL")
    return out.select("event_id", F.round(F.col("intensity") * 1e6, 3).alias("intensity"), r6("diversity").alias("diversity"))


TREND_SQL = f""", s AS (SELECT *, {SCORE} AS score, row_number() OVER {EVENTS_W}) AS rn FROM act),
t AS (SELECT *, avg(score) OVER w AS recent_mean, CASE WHEN count(*) OVER w = 10 THEN regr_slope(score, rn) OVER w ELSE 0 END AS trend FROM s WINDOW w AS {rows_sql(9)})"""


@query("risk_trend", ACT + TREND_SQL + " SELECT event_id, round(recent_mean, 9) AS recent_mean, round(trend, 9) + 0.0 AS trend FROM t")
def risk_trend(spark, sf):
    out = W.risk_trend(act(spark, sf, score().alias("score")))
    return out.select("event_id", r9("recent_mean").alias("recent_mean"), r9("trend").alias("trend"))


@query(
    "rapid_actions",
    ACT + f""", f AS (SELECT *, CASE WHEN kind = 'keyboard' THEN us END AS typed, CASE WHEN kind = 'mouse' AND action = 'click' THEN us END AS clicked FROM act),
s AS (SELECT event_id, count(typed) OVER t AS tn, (max(typed) OVER t - min(typed) OVER t) / 1e6 AS ts_, list_filter(list(clicked) OVER t, lambda a: a IS NOT NULL) AS cl,
  list_filter(list(CASE WHEN kind = 'window' THEN app END) OVER t, lambda a: a IS NOT NULL) AS al, count(*) FILTER (WHERE kind = 'clipboard') OVER v AS cp, count(*) OVER v AS n
  FROM f WINDOW t AS {rows_sql(10, '1 PRECEDING')}, v AS {rows_sql(20, '1 PRECEDING')})
SELECT event_id, coalesce(tn >= 5 AND ts_ > 0 AND tn / ts_ > 0.00005, false) AS rapid_typing,
  coalesce(len(cl) >= 3 AND len(list_filter(range(2, len(cl) + 1), lambda i: (cl[i] - cl[i - 1]) / 1e6 < 20000)) > 0, false) AS rapid_clicking,
  coalesce(len(al) >= 3 AND len(list_distinct(al)) > 2, false) AS rapid_app_switching, n >= 10 AND cp > 5 AS frequent_copying FROM s""",
)
def rapid_actions(spark, sf):
    out = W.rapid_actions(act(spark, sf, "kind", "action", "app"), keys_per_second=0.00005, click_gap=20000.0, apps=2)
    return out.select("event_id", "rapid_typing", "rapid_clicking", "rapid_app_switching", "frequent_copying")


@query(
    "size_zscore",
    ACT + f""", f AS (SELECT *, CASE WHEN kind = 'clipboard' THEN size END AS s FROM act),
z AS (SELECT event_id, kind, size, count(*) OVER w AS n, count(s) OVER w AS c, avg(s) OVER w AS m, stddev_pop(s) OVER w AS sd FROM f WINDOW w AS {rows_sql(20, '1 PRECEDING')})
SELECT event_id, coalesce(round(CASE WHEN n >= 10 AND c >= 3 AND sd > 0 THEN abs(size - m) / sd END, 6), -1) AS z,
  coalesce(n >= 10 AND c >= 3 AND sd > 0 AND abs(size - m) / sd > 2, false) AS size_anomaly FROM z WHERE kind = 'clipboard'""",
)
def size_zscore(spark, sf):
    out = W.size_anomaly(act(spark, sf, "kind", "size"))
    return out.select("event_id", F.coalesce(r6("z"), F.lit(-1.0)).alias("z"), "size_anomaly")


@query(
    "sliding_bursts",
    ACT + f""", s AS (SELECT user_id, count(*) OVER w AS n, (max(us) OVER w - min(us) OVER w) / 1e6 AS span FROM act
  WINDOW w AS ({W_ORDER} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)), r AS (SELECT user_id, 10 / span AS rate FROM s WHERE n = 10 AND span > 0),
m AS (SELECT user_id, avg(rate) AS mean FROM r GROUP BY 1)
SELECT user_id, round(max(mean) * 1e6, 3) AS mean_rate, count(*) FILTER (WHERE rate > 1.5 * mean) AS bursts FROM r JOIN m USING (user_id) GROUP BY 1""",
)
def sliding_bursts(spark, sf):
    out = W.sliding_bursts(act(spark, sf), factor=1.5)
    return out.select("user_id", F.round(F.col("mean_rate") * 1e6, 3).alias("mean_rate"), "bursts")


TIME_SQL = f""", l AS (SELECT user_id, app, (coalesce(lead(us) OVER {EVENTS_W}), (SELECT max(us) FROM act)) - us) / 1e6 AS seconds FROM act WHERE kind = 'window')"""


def spent(spark, sf):
    rows = act(spark, sf, "kind", "app")
    return W.time_in_app(rows, rows.agg(F.max("us")).scalar())


@query("time_in_app", ACT + TIME_SQL + " SELECT user_id, app, round(sum(seconds), 3) AS seconds FROM l GROUP BY 1, 2")
def time_in_app(spark, sf):
    return spent(spark, sf).groupBy("user_id", "app").agg(F.round(F.sum("seconds"), 3).alias("seconds"))


BUTTONS = "FROM act WHERE kind = 'mouse' AND action IN ('press', 'release')"


@query(
    "double_click",
    ACT + f""", b AS (SELECT event_id, action, coalesce(lag(action) OVER {EVENTS_W}) = 'release' AND {GAP} < 86400, false) AS double_click {BUTTONS})
SELECT event_id, double_click FROM b WHERE action = 'release'""",
)
def double_click(spark, sf):
    return W.double_clicks(act(spark, sf, "kind", "action"), limit=86400.0).select("event_id", "double_click")


@query(
    "drags",
    ACT + f""", b AS (SELECT event_id, action, lag(action) OVER {EVENTS_W}) AS prev, sqrt((x - lag(x) OVER {EVENTS_W})) ** 2 + (y - lag(y) OVER {EVENTS_W})) ** 2) AS d {BUTTONS})
SELECT event_id, round(d, 6) AS distance FROM b WHERE action = 'release' AND prev = 'press' AND d > 5""",
)
def drags(spark, sf):
    return W.drags(act(spark, sf, "kind", "action", "x", "y")).select("event_id", r6("distance").alias("distance"))


def greedy_sql(source: str, keys: str, gap: int) -> str:
    """Repeatedly the first row at least `gap` after the last one kept."""
    on = " AND ".join(f"s.{k} = c.{k}" for k in keys.split(", "))
    picked = ", ".join(f"c.{k}" for k in keys.split(", "))
    return f"""kept({keys}, us) AS (SELECT {keys}, min(us) FROM {source} GROUP BY {keys}
  UNION ALL SELECT {picked}, min(s.us) FROM kept c JOIN {source} s ON {on} AND s.us >= c.us + {gap} GROUP BY {picked})"""


@query(
    "move_throttle",
    ACT.replace("WITH raw", "WITH RECURSIVE raw") + f""", m AS (SELECT event_id, user_id, us, sqrt((x - lag(x) OVER {EVENTS_W})) ** 2 + (y - lag(y) OVER {EVENTS_W})) ** 2) AS d
  FROM act WHERE kind = 'mouse'), far AS (SELECT event_id, user_id, us FROM m WHERE d >= 50), {greedy_sql('far', 'user_id', 86_400_000_000)}
SELECT min(far.event_id) AS event_id, kept.user_id, kept.us FROM kept JOIN far USING (user_id, us) GROUP BY 2, 3""",
)
def move_throttle(spark, sf):
    """Mouse moves at least 50 px from the previous point and a day (here) after the last one kept."""
    rows, w = framed(act(spark, sf, "kind", "x", "y").filter("kind = 'mouse'"), ["user_id"], back=1)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    far = settled(rows.withColumn("step", step)).filter("step >= 50")
    return thin(far, ["user_id"], 86_400_000_000).select("event_id", "user_id", "us")


@query(
    "text_segments",
    ACT.replace("WITH raw", "WITH RECURSIVE raw") + f""", t AS (SELECT user_id, event_id, us, ts, k % 13 = 0 OR k % 17 = 0 AS fin, k % 3 = 1 AS back, lag(k % 13 = 0 OR k % 17 = 0) OVER {EVENTS_W}) AS pf, {GAP} AS gap,
  row_number() OVER {EVENTS_W}) AS rn FROM act WHERE kind = 'keyboard'),
s AS (SELECT *, sum(CASE WHEN coalesce(pf OR gap > 400000, true) THEN 1 ELSE 0 END) OVER {EVENTS_W}) AS segment FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, segment ORDER BY rn) AS i FROM s),
walk AS (SELECT user_id, segment, i, CASE WHEN back OR fin THEN 0 ELSE 1 END AS len FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.segment, o.i, greatest(0, walk.len + CASE WHEN o.back THEN -1 WHEN o.fin THEN 0 ELSE 1 END)
  FROM walk JOIN o ON o.user_id = walk.user_id AND o.segment = walk.segment AND o.i = walk.i + 1),
f AS (SELECT user_id, segment, arg_max(len, i) AS net_length FROM walk GROUP BY 1, 2)
SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS keys, count(*) FILTER (WHERE back) AS edits, CAST(max(net_length) AS BIGINT) AS net_length, min(us) AS started,
  round((max(us) - min(us)) / 1e6, 6) AS seconds FROM s JOIN f USING (user_id, segment) GROUP BY 1, 2""",
)
def text_segments(spark, sf):
    k = F.col("k")
    typed = act(spark, sf, "kind", "k").filter("kind = 'keyboard'")
    out = W.text_segments(typed, ends=(k % 13 == 0) | (k % 17 == 0), backspace=k % 3 == 1, idle=400000.0)
    return out.withColumn("seconds", F.round("seconds", 6))


@query(
    "baseline_zdrift",
    ACT + f""", b AS (SELECT event_id, value, x::DOUBLE AS x, count(*) OVER w AS n, avg(value) OVER w AS mv, var_pop(value) OVER w AS vv, avg(x) OVER w AS mx, var_pop(x) OVER w AS vx
  FROM act WINDOW w AS {rows_sql(30, '1 PRECEDING')}),
d AS (SELECT event_id, (CASE WHEN vv > 1e-8 THEN least(1, abs(value - mv) / sqrt(vv) / 5) ELSE 0 END + CASE WHEN vx > 1e-8 THEN least(1, abs(x - mx) / sqrt(vx) / 5) ELSE 0 END)
  / ((vv > 1e-8)::INT + (vx > 1e-8)::INT) AS drift FROM b WHERE n >= 20)
SELECT event_id, round(drift, 6) AS drift, drift > 0.15 AS drifted FROM d""",
)
def baseline_zdrift(spark, sf):
    out = W.baseline_drift(act(spark, sf, "value", F.col("x").cast("double").alias("x")), ["value", "x"], window=30, cold_start=20)
    return out.filter("drift IS NOT NULL").select("event_id", r6("drift").alias("drift"), "drifted")


@query(
    "trend_label",
    ACT + f""", s AS (SELECT *, {SCORE} AS s FROM act),
l AS (SELECT event_id, s, lag(s, 1) OVER o AS s1, lag(s, 2) OVER o AS s2, lag(s, 3) OVER o AS s3, lag(s, 4) OVER o AS s4, count(*) OVER {rows_sql(4)} AS n,
  count(*) FILTER (WHERE s > 0.7) OVER {rows_sql(9)} AS c, avg(s) OVER {rows_sql(9)} AS a FROM s WINDOW o AS ({W_ORDER}))
SELECT event_id, CASE WHEN n < 3 THEN 'insufficient_data'
  WHEN s1 <= s AND s2 <= s1 AND coalesce(s3 <= s2, true) AND coalesce(s4 <= s3, true) THEN 'increasing'
  WHEN s1 >= s AND s2 >= s1 AND coalesce(s3 >= s2, true) AND coalesce(s4 >= s3, true) THEN 'decreasing' ELSE 'stable' END AS trend,
  c AS anomalies_last_10, round(a, 9) AS average_last_10 FROM l""",
)
def trend_label(spark, sf):
    out = W.trend_label(act(spark, sf, score().alias("score"), (score() > 0.7).alias("is_anomalous")))
    return out.select("event_id", "trend", "anomalies_last_10", r9("average_last_10").alias("average_last_10"))


@query(
    "confidence_level",
    ACT + f""", s AS (SELECT event_id, count(*) OVER w AS n, avg((k / 99.0 > 0.7)::INT) OVER w AS c FROM act WINDOW w AS {rows_sql(9)})
SELECT event_id, round(c, 6) AS confidence_level FROM s WHERE n >= 5""",
)
def confidence_level(spark, sf):
    out = W.confidence_share(act(spark, sf, (F.col("k") / 99).alias("confidence")))
    return out.filter("confidence_level IS NOT NULL").select("event_id", r6("confidence_level").alias("confidence_level"))


@query(
    "ema",
    ACT + f""", s AS (SELECT user_id, {SCORE} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age, count(*) OVER (PARTITION BY user_id) AS n FROM act)
SELECT user_id, round(sum(0.1 * pow(0.9, age) * s) + 0.1 * pow(0.9, max(n)), 6) AS ema FROM s GROUP BY 1""",
)
def ema(spark, sf):
    out = W.moving_average(act(spark, sf, score().alias("score")), "score", alpha=0.1, start=0.1)
    return out.withColumn("ema", r6("ema"))


def squash_sql(x: str) -> str:
    return f"(1 / (1 + exp(-6 * (greatest(0, least(1, {x})) - 0.5))))"


def feedback_sql() -> str:
    final = "greatest(0, least(1, s.base * {b} * CASE WHEN s.often THEN 1.1 ELSE 1.0 END * 0.95))"
    capped = "CASE WHEN s.rn <= 20 THEN least(" + final + ", 0.4) ELSE " + final + " END"
    first = squash_sql(capped.format(b="1.0"))
    boost = "CASE WHEN s.rn > 11 AND s.base > 1.5 * list_avg(r.h) THEN 1.2 ELSE 1.0 END"
    step = squash_sql(capped.format(b=boost))
    return ACT.replace("WITH raw", "WITH RECURSIVE raw") + f""", o AS (SELECT event_id, user_id, least(value / 100, 1.0) AS base, kind, row_number() OVER {EVENTS_W}) AS rn,
  list(kind) OVER {rows_sql(19)} AS l FROM act), s AS (SELECT event_id, user_id, base, rn, len(list_filter(l, lambda a: a = kind)) > 6 AS often FROM o),
r AS (SELECT s.user_id, s.event_id, s.rn, {first}::DOUBLE AS f, [{first}]::DOUBLE[] AS h FROM s WHERE rn = 1
  UNION ALL SELECT user_id, event_id, rn, f, list_append(h, f)[-10:] FROM (SELECT s.user_id, s.event_id, s.rn, {step}::DOUBLE AS f, r.h FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1))
SELECT event_id, round(f, 6) AS risk FROM r"""


@query("risk_feedback", feedback_sql())
def risk_feedback(spark, sf):
    base = F.least(F.col("value") / 100, F.lit(1.0))
    out = risk_with_feedback(act(spark, sf, "kind", base.alias("base")), cold_start=20, same_kind=6)
    return out.select("event_id", r6("risk").alias("risk"))


ALERTS_SQL = ACT.replace("WITH raw", "WITH RECURSIVE raw") + f""", a AS (SELECT event_id, user_id, kind, CAST(floor({SCORE} * 10) AS BIGINT) AS band, {SCORE} AS score, us
  FROM act WHERE {SCORE} >= 0.5), {greedy_sql('a', 'user_id, kind, band', 14_400_000_000)},
sent AS (SELECT min(a.event_id) AS event_id, user_id, kind, band, us FROM kept JOIN a USING (user_id, kind, band, us) GROUP BY 2, 3, 4, 5)"""


def sent_alerts(spark, sf):
    """At most one alert per user, kind and score band in four hours since the last one sent."""
    alerts = act(spark, sf, "kind", F.floor(score() * 10).alias("band"), score().alias("score")).filter("score >= 0.5")
    return alerts, thin(alerts, ["user_id", "kind", "band"], 14_400_000_000)


@query("alert_suppress", ALERTS_SQL + " SELECT event_id, user_id, kind, band, us FROM sent")
def alert_suppress(spark, sf):
    return sent_alerts(spark, sf)[1].select("event_id", "user_id", "kind", "band", "us")


@query(
    "alert_escalate",
    ALERTS_SQL + f""", s AS (SELECT event_id, a.user_id, {level_sql('a.score', 'alert')} AS severity, a.us FROM sent JOIN a USING (event_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, severity ORDER BY us, event_id) AS n FROM s)
SELECT event_id, user_id, severity, n FROM n WHERE n % CASE severity WHEN 'medium' THEN 5 WHEN 'high' THEN 3 WHEN 'critical' THEN 1 ELSE 10 END = 0""",
)
def alert_escalate(spark, sf):
    """Every n-th alert sent for a user at a severity."""
    alerts, sent = sent_alerts(spark, sf)
    graded = alerts.join(sent.select("event_id"), "event_id", "left_semi").withColumn("severity", level(F.col("score"), "alert"))
    table = F.create_map(*[F.lit(v) for pair in ESCALATE_EVERY.items() for v in pair])
    counted = running_count(graded, ["user_id", "severity"])
    every = F.coalesce(F.try_element_at(table, F.col("severity")), F.lit(ESCALATE_EVERY_OTHER))
    return counted.filter(F.col("n") % every == 0).select("event_id", "user_id", "severity", "n")


@query(
    "sustained_alert",
    ACT + TREND_SQL + f""", v AS (SELECT event_id, trend, avg(score) OVER {rows_sql(19)} AS mean FROM t)
SELECT event_id, round(mean, 9) AS avg_risk, round(trend, 6) AS trend, CASE WHEN mean > 0.9 THEN 'high' ELSE 'medium' END AS severity FROM v WHERE mean > 0.4 AND trend > 0.0213137""",
)
def sustained_alert(spark, sf):
    trended = W.risk_trend(act(spark, sf, score().alias("score")))
    rows, w = framed(trended, ["user_id"], back=20)
    out = settled(rows.withColumn("avg_risk", F.avg("score").over(W.last(w, 20))))
    return out.filter("avg_risk > 0.4 AND trend > 0.0213137").select(
        "event_id", F.round("avg_risk", 9).alias("avg_risk"), r6("trend").alias("trend"),
        F.when(F.col("avg_risk") > 0.9, "high").otherwise("medium").alias("severity"),
    )


@query(
    "adaptive_threshold",
    ACT.replace("WITH raw", "WITH RECURSIVE raw") + f""", d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, avg({SCORE}) AS mean FROM act WHERE {SCORE} >= 0.5 GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::DATE AS day, 0.6::DOUBLE AS thr FROM d UNION ALL SELECT o.user_id, o.i, o.day,
  CASE WHEN o.n <= 1 THEN thr WHEN o.mean > thr + 0.1 THEN greatest(0.5, thr - 0.05)
  WHEN o.mean < thr - 0.1 THEN least(0.9, thr + 0.05) ELSE thr END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(thr, 6) AS threshold FROM f WHERE i > 0""",
)
def adaptive_threshold(spark, sf):
    """Each user's threshold after each of their days: a fold over one row per day."""
    incidents = activity(spark, sf).filter(score() >= 0.5).select("user_id", F.to_date("ts").alias("day"), score().alias("score"))
    daily = incidents.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    out = adapt_threshold(daily, ["user_id"], start=0.6, least=1)
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), r6("threshold").alias("threshold"))


@query(
    "consecutive_anomalies",
    ACT + f""", s AS (SELECT user_id, us, {SCORE} > 0.4 AS a, row_number() OVER {EVENTS_W}) AS rn, ts, event_id FROM act),
g AS (SELECT *, rn - row_number() OVER {EVENTS_W}) AS island FROM s WHERE a)
SELECT user_id, count(*) AS length, min(us) AS started, max(us) AS ended FROM g GROUP BY user_id, island HAVING count(*) >= 3""",
)
def consecutive_anomalies(spark, sf):
    return W.anomaly_runs(act(spark, sf, score().alias("score")), F.col("score") > 0.4, 3)


@query(
    "seq_likelihood",
    ACT + f""", p AS (SELECT event_id, user_id, ts, lag(event_type) OVER {EVENTS_W}) AS prev, event_type FROM act),
c AS (SELECT prev, event_type, ln(count(*) / sum(count(*)) OVER (PARTITION BY prev)) AS lp FROM p WHERE prev IS NOT NULL GROUP BY 1, 2),
j AS (SELECT p.*, lp FROM p LEFT JOIN c USING (prev, event_type)), s AS (SELECT event_id, avg(lp) OVER {rows_sql(49)} AS l FROM j)
SELECT event_id, coalesce(round(l, 6), 0) AS likelihood FROM s""",
)
def seq_likelihood(spark, sf):
    out = W.sequence_likelihood(act(spark, sf, "event_type"))
    return out.select("event_id", F.coalesce(r6("likelihood"), F.lit(0.0)).alias("likelihood"))


NGRAM_SQL = ACT + f""", p AS (SELECT event_id, user_id, ts, event_type AS w, lag(event_type) OVER {EVENTS_W}) AS p1, lag(event_type, 2) OVER {EVENTS_W}) AS p2 FROM act),
t3 AS (SELECT p2, p1, w, count(*) AS n FROM p WHERE p2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
t2 AS (SELECT p1, w, count(*) AS n FROM p WHERE p1 IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
t1 AS (SELECT w, count(*) AS n FROM p GROUP BY 1), v AS (SELECT count(*) AS v, sum(n) AS total FROM t1),
c2 AS (SELECT p1, w, count(*) AS n FROM t3 JOIN t2 USING (p1, w) GROUP BY ALL), c1 AS (SELECT w, count(*) AS n FROM t2 GROUP BY 1),
s3 AS (SELECT p2, p1, sum(n) AS s, count(*) AS k FROM t3 GROUP BY ALL), s2 AS (SELECT p1, sum(n) AS s, count(*) AS k FROM t2 GROUP BY 1),
d2 AS (SELECT p1, sum(n) AS s, count(*) AS k FROM c2 GROUP BY 1), d1 AS (SELECT sum(n) AS s, count(*) AS k FROM c1),
q AS (SELECT p.*, t1.n / v.total AS q1, CASE WHEN d1.s > 0 THEN greatest(coalesce(c1.n, 0) - 0.75, 0) / d1.s + 0.75 * d1.k / d1.s / v.v ELSE 1 / v.v END AS b1
  FROM p JOIN t1 USING (w) LEFT JOIN c1 USING (w), v, d1),
q2 AS (SELECT q.*, coalesce(greatest(coalesce(t2.n, 0) - 0.75, 0) / s2.s + 0.75 * s2.k / s2.s * b1, b1) AS qq2, coalesce(greatest(coalesce(c2.n, 0) - 0.75, 0) / d2.s + 0.75 * d2.k / d2.s * b1, b1) AS b2
  FROM q LEFT JOIN t2 USING (p1, w) LEFT JOIN s2 USING (p1) LEFT JOIN c2 USING (p1, w) LEFT JOIN d2 USING (p1)),
q3 AS (SELECT q2.*, coalesce(greatest(coalesce(t3.n, 0) - 0.75, 0) / s3.s + 0.75 * s3.k / s3.s * b2, b2) AS qq3 FROM q2 LEFT JOIN t3 USING (p2, p1, w) LEFT JOIN s3 USING (p2, p1))
SELECT event_id, round(avg(ln(q1)) OVER {rows_sql(49)}, 6) AS likelihood_1, round(avg(ln(qq2)) OVER {rows_sql(49)}, 6) AS likelihood_2, round(avg(ln(qq3)) OVER {rows_sql(49)}, 6) AS likelihood_3 FROM q3"""


@query("seq_ngrams", NGRAM_SQL)
def seq_ngrams(spark, sf):
    """Likelihood of the last 50 events under back-off models of orders 1 to 3, sequences seen once left out."""
    out = W.sequence_ngrams(act(spark, sf, "event_type"))
    return out.select("event_id", *(r6(f"likelihood_{i}").alias(f"likelihood_{i}") for i in (1, 2, 3)))


@query(
    "since_last_device",
    ACT + f""", s AS (SELECT event_id, us, last_value(CASE WHEN kind = 'usb' THEN us END IGNORE NULLS) OVER ({W_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM act)
SELECT event_id, coalesce(round((us - d) / 1e6, 6), -1) AS since_device FROM s""",
)
def since_last_device(spark, sf):
    out = W.since_last_device(act(spark, sf, "kind"))
    return out.select("event_id", F.coalesce(r6("since_device"), F.lit(-1.0)).alias("since_device"))
