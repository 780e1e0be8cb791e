"""Composite scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.functions import clock, text
from sessionlens.functions import patterns as P
from sessionlens.functions.levels import array_sum, clamp, level, points, squash, weighted_mean
from sessionlens.operators.sequence import attach, framed, quantiles, settled
from sessionlens.operators.windows import GROUP, before, last, size_of, slope, span_seconds


def adapt_threshold(daily: DataFrame, keys: Sequence[str], start: float = 0.7, least: int = 5, margin: float = 0.1, step: float = 0.05) -> DataFrame:
    """Move each key's threshold day by day towards the mean of the day's scores.

    The input has one row per key and day (day, n, mean), so an array folded here is as long as the calendar.
    """
    days = daily.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "n", "mean"))).alias("days"))

    def move(state, d):
        thr = state["thr"]
        new = (
            F.when(d["n"] <= least, thr)
            .when(d["mean"] > thr + margin, F.greatest(F.lit(0.5), thr - step))
            .when(d["mean"] < thr - margin, F.least(F.lit(0.9), thr + step))
            .otherwise(thr)
        )
        row = F.struct(d["day"].alias("day"), new.alias("threshold"))
        return F.struct(new.alias("thr"), F.concat(state["out"], F.array(row)).alias("out"))

    zero = F.struct(F.lit(start).alias("thr"), F.array().cast("array<struct<day:date,threshold:double>>").alias("out"))
    return days.select(*keys, F.inline(F.aggregate("days", zero, move, lambda s: s["out"])))


def risk_features(df: DataFrame, score: str = "score") -> DataFrame:
    """Context, text and clipboard features of each event; all frames share one window."""
    rows, w = framed(df, GROUP, back=20)
    frame, ten, twenty = last(w, 10), before(w, 10), before(w, 20)
    known = size_of(frame) >= 5
    typed = F.when(F.col("kind") == "keyboard", F.col("us"))
    app = F.when(F.col("kind") == "window", F.col("app"))
    out = rows.withColumns(
        {
            "_kinds": F.collect_list("kind").over(frame),
            "_apps": F.collect_list(app).over(ten),
            "_typed": F.count(typed).over(ten),
            "_typing": (F.max(typed).over(ten) - F.min(typed).over(ten)) / 1e6,
            "intensity": F.when(known, size_of(frame) / F.greatest(span_seconds(frame), F.lit(1.0))).otherwise(0.0),
            "accumulated": F.when(size_of(ten) >= 5, F.avg(score).over(ten)).otherwise(0.0),
            "trend": F.when(size_of(frame) == 10, slope(F.col(score), w, 10)).otherwise(0.0),
            "frequent_copying": (size_of(twenty) >= 10) & (F.count_if(F.col("kind") == "clipboard").over(twenty) > 5),
        }
    )
    kinds, apps = F.col("_kinds"), F.col("_apps")
    ready = settled(
        out.withColumns(
            {
                "diversity": F.when(F.size(kinds) >= 5, F.size(F.array_distinct(kinds)) / F.size(kinds)).otherwise(0.0),
                "rapid_typing": F.coalesce((F.col("_typed") >= 5) & (F.try_divide("_typed", "_typing") > 10), F.lit(False)),
                "rapid_app_switching": (F.size(apps) >= 3) & (F.size(F.array_distinct(apps)) > 5),
            }
        ).drop("_kinds", "_apps", "_typed", "_typing")
    )
    content = F.col("content")
    copied = F.col("kind") == "clipboard"
    return ready.withColumns(
        {n: c for n, c in text.keyword_flags(RISK_FLAGS).items()}
        | {
            "large_clipboard": copied & (F.col("size") > 10000),
            "sensitive_clipboard": copied & text.sensitive_data(content, with_email=False),
            "file_paths_clipboard": copied & text.has_file_path(content),
            "admin_key_usage": F.col("key").isin("f1", "f2", "f12") | F.col("key").contains("ctrl+alt"),
        }
    )


# Flags whose columns the risk dimensions read.
RISK_FLAGS = [
    "system_commands", "sensitive_content", "typed_file_operations", "network_activity",
    "admin_application", "system_application", "security_application", "browser_private_mode",
]


def behavioural_dimension() -> Column:
    intensity = F.when(F.col("intensity") > 10, 0.3).when(F.col("intensity") > 5, 0.1).otherwise(0.0)
    diverse = F.when(F.col("diversity") > 0.8, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), intensity + diverse + F.least(F.lit(0.4), F.col("accumulated") * 0.1))


def keystroke_dimension() -> Column:
    found = points(
        (F.col("rapid_typing"), 0.2), (F.col("admin_key_usage"), 0.2),
        (F.col("system_commands"), 0.4), (F.col("sensitive_content"), 0.3),
    )
    return F.when(F.col("kind") == "keyboard", found).otherwise(0.0)


def insider_dimension() -> Column:
    typed, window = F.col("kind") == "keyboard", F.col("kind") == "window"
    return points(
        (typed & F.col("typed_file_operations"), 0.2), (typed & F.col("network_activity"), 0.3),
        (F.col("large_clipboard"), 0.2), (F.col("sensitive_clipboard"), 0.4), (window & F.col("admin_application"), 0.3),
    )


def temporal_dimension(ts: str = "ts") -> Column:
    hour = F.hour(ts)
    return points(
        ((hour < 8) | (hour > 18), 0.3), ((hour < 6) | (hour > 22), 0.4),
        (F.weekday(ts) >= 5, 0.2), (F.col("trend") > 0.1, 0.2),
    )


def access_dimension() -> Column:
    window = F.col("kind") == "window"
    return points(
        (window & F.col("system_application"), 0.4), (window & F.col("security_application"), 0.3),
        (window & F.col("browser_private_mode"), 0.2), (window & F.col("rapid_app_switching"), 0.2),
        (F.col("file_paths_clipboard"), 0.2),
    )


def dimensions() -> dict[str, Column]:
    return {
        "behavioral_anomaly": behavioural_dimension(),
        "keystroke_anomaly": keystroke_dimension(),
        "insider_threat": insider_dimension(),
        "temporal_risk": temporal_dimension(),
        "access_risk": access_dimension(),
    }


def recency_weight(age_seconds: Column) -> Column:
    return clamp(F.exp(-age_seconds / 3600.0), 0.1, 1.0)


def base_risk(scores: dict[str, Column], age_seconds: Column) -> Column:
    return weighted_mean(scores, P.RISK_WEIGHTS) * recency_weight(age_seconds)


def calibrated(df: DataFrame, score: str) -> Column:
    """The score scaled between the table's own minimum and maximum and squashed."""
    span = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    return squash(F.col(score), span.select("lo").scalar(), span.select("hi").scalar())


def vote(df: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted vote over model results (keys, model, score, is_anomaly)."""
    weights = F.create_map(*[F.lit(v) for pair in P.VOTE_WEIGHTS.items() for v in pair])
    weight = F.coalesce(F.try_element_at(weights, F.col("model")), F.lit(0.1))
    voted = df.withColumn("_w", weight).groupBy(*keys).agg(
        (F.sum(F.col("score") * F.col("_w")) / F.sum("_w")).alias("anomaly_score"),
        (F.sum(F.when(F.col("is_anomaly"), F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("votes"),
    )
    return voted.withColumns(
        {"is_anomaly": F.col("votes") > 0.5, "confidence": F.least(F.abs("anomaly_score"), F.lit(1.0))}
    )


def threat_score(scores: dict[str, Column], correlation: Column, recent: Column, ts: str = "ts") -> Column:
    """Weighted dimensions, raised by correlated indicators, by many recent ones and by the time of the event."""
    start = F.least(F.lit(1.0), weighted_mean(scores, P.THREAT_WEIGHTS) + correlation * 0.2)
    factor = (
        1.0
        + F.when(recent > 10, 0.3).when(recent > 5, 0.15).otherwise(0.0)
        + F.when(clock.after_hours(ts), 0.1).otherwise(0.0)
        + F.when(clock.is_weekend(ts), 0.1).otherwise(0.0)
    )
    return F.least(F.lit(1.0), start * factor)


def indicator_correlation(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """Mean absolute correlation between indicator counts over the last n events; undefined ones count 0.

    The counts are whole numbers, so the sums are exact and a constant column is seen as such.
    """
    rows, w = framed(df, GROUP, back=n)
    frame = last(w, n)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = {f"_s_{a}": F.sum(a).over(frame) for a in columns}
    products = {f"_p_{a}_{b}": F.sum(F.col(a) * F.col(b)).over(frame) for a, b in pairs}
    out = settled(rows.withColumns(sums | products | {"_n": size_of(frame)}))

    def cov(a: str, b: str) -> Column:
        return F.col("_n") * F.col(f"_p_{a}_{b}") - F.col(f"_s_{a}") * F.col(f"_s_{b}")

    parts = [
        F.coalesce(F.abs(F.try_divide(cov(a, b).cast("double"), F.sqrt((cov(a, a) * cov(b, b)).cast("double")))), F.lit(0.0))
        for a, b in pairs
        if a != b
    ]
    mean = sum(parts[1:], parts[0]) / len(parts)
    full = out.withColumn("correlation", F.when(F.col("_n") == n, clamp(mean)).otherwise(0.0))
    return full.drop("_n", *sums, *products)


def dimension_columns(names: list[str]) -> dict[str, list[str]]:
    """The features each dimension takes, by parts of their names."""
    return {d: [n for n in names if any(t in n for t in terms)] for d, terms in P.DIMENSION_TERMS.items()}


def combine(models: Column, confidences: Column, weights: Column, cross: Column, adversarial: Column) -> dict[str, Column]:
    """Weighted model score, then blended with each cross-platform and each adversarial severity in turn."""
    weighed = F.zip_with(models, weights, lambda s, w: s * w)
    trusted = F.zip_with(confidences, weights, lambda s, w: s * w)
    total = array_sum(weights)
    start = array_sum(weighed) / total

    def blend(share: float):
        return lambda a, s: a * (1 - share) + s * share

    score = F.aggregate(adversarial, F.aggregate(cross, start, blend(0.3)), blend(0.4))
    return {"risk_score": clamp(score), "confidence_score": clamp(array_sum(trusted) / total)}


def threat_level(risk: Column, confidence: Column) -> Column:
    return level(risk * confidence + risk * 0.3, "threat")


def anomaly_type(adversarial: Column, travel: Column, cross: Column, timing: Column, sequence: Column, frequency: Column) -> Column:
    """The main type of an anomaly by priority; the last three are counts of models."""
    return (
        F.when(adversarial, "context_anomaly")
        .when(travel, "account_takeover")
        .when(cross, "cross_platform_anomaly")
        .when((timing > sequence) & (timing > frequency), "timing_anomaly")
        .when(sequence > frequency, "sequence_anomaly")
        .when(frequency > 0, "frequency_anomaly")
        .otherwise("context_anomaly")
    )


def two_places(x: Column) -> Column:
    return F.format_string("%.2f", x)


def summary_text(anomalous: Column, threat: Column, kind: Column, risk: Column, confidence: Column) -> Column:
    tail = F.concat(two_places(risk), F.lit(" (confidence: "), two_places(confidence), F.lit(")"))
    found = F.concat(
        F.lit("Anomalous behavior detected with "), threat, F.lit(" threat level. Primary anomaly type: "), kind,
        F.lit(". Risk score: "), tail,
    )
    return F.when(anomalous, found).otherwise(F.concat(F.lit("Behavior appears normal. Risk score: "), tail))


def confidence_text(confidence: Column) -> Column:
    """A justification of the confidence."""
    # The texts of the four bands.
    bands = [
        (0.8, "High", "due to strong agreement across multiple detection models and clear anomaly patterns."),
        (0.6, "Medium-high", "with good agreement among most detection components."),
        (0.4, "Medium", "with some disagreement among detection models."),
        (None, "Low", "due to significant disagreement among detection components or insufficient evidence."),
    ]
    texts = [
        (bound, F.concat(F.lit(f"{name} confidence ("), two_places(confidence), F.lit(f") {why}"))) for bound, name, why in bands
    ]
    return F.coalesce(*[F.when(confidence > b, t) if b is not None else t for b, t in texts])


def alert_text(risk: Column, factor: Column) -> Column:
    names = F.create_map(*[F.lit(v) for pair in P.FACTOR_NAMES.items() for v in pair])
    reason = F.coalesce(F.try_element_at(names, factor), factor)
    return F.concat(F.lit("High risk activity detected (score: "), two_places(risk), F.lit(") - "), reason)


def outlier_guard(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of values beyond three interquartile ranges, and the mean number of decimals."""
    fences = quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75})
    x, reach = F.col(value), 3 * (F.col("q3") - F.col("q1"))
    outside = (x < F.col("q1") - reach) | (x > F.col("q3") + reach)
    text = x.cast("string")
    plain = F.rtrim(F.expr(f"cast(try_cast(`{value}` AS decimal(38, 15)) AS string)"), F.lit("0"))
    written = F.when(F.contains(text, F.lit("E")), F.concat(plain, F.when(F.endswith(plain, F.lit(".")), "0").otherwise("")))
    decimals = F.length(F.get(F.split(F.coalesce(written, text), r"\."), F.lit(1)))
    out = attach(df, fences, keys).groupBy(*keys).agg(
        F.avg(outside.cast("double")).alias("outlier_share"), F.avg(decimals).alias("mean_decimals")
    )
    return out.withColumns(
        {"unusual_distribution": F.col("outlier_share") > 0.1, "unusual_precision": F.col("mean_decimals") > 6}
    )
