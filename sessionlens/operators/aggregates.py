"""Aggregates over event tables. Everything is algebraic: partial sums first, then one shuffle on the keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.operators.sequence import attach, framed, last_known, quantiles, running, settled


def r6(column: Column | str) -> Column:
    """Rounded to six places; adding zero turns a negative zero positive."""
    return F.round(column, 6) + F.lit(0.0)


def r9(column: Column | str) -> Column:
    """Rounded to nine places, for means of short decimals, which tie at six."""
    return F.round(column, 9) + F.lit(0.0)


def r12(column: Column | str) -> Column:
    """Rounded to twelve places, for products of short decimals, which tie at nine."""
    return F.round(column, 12) + F.lit(0.0)


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def moments(name: str, x: Column) -> list[Column]:
    return [
        F.avg(x).alias(f"{name}_mean"),
        F.stddev_pop(x).alias(f"{name}_std"),
        F.min(x).alias(f"{name}_min"),
        F.max(x).alias(f"{name}_max"),
        F.skewness(x).alias(f"{name}_skew"),
        F.kurtosis(x).alias(f"{name}_kurtosis"),
    ]


def entropy_of_counts(n: Column) -> Column:
    """Entropy in bits from the counts of a group: log2 N - sum(n log2 n) / N; one algebraic aggregate."""
    total = F.sum(n)
    return F.log2(total) - F.sum(n * F.log2(n)) / total


def category_entropy(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    counts = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(entropy_of_counts(F.col("_n")).alias("entropy"))


def histogram_entropy(df: DataFrame, keys: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Entropy of the equal-width histogram between each group's own minimum and maximum."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    binned = attach(df.filter(F.col(value).isNotNull()), span, keys).withColumn(
        "_bin", F.when(F.col("_hi") > F.col("_lo"), F.least(place, F.lit(bins - 1))).otherwise(0)
    )
    return category_entropy(binned, keys, "_bin")


def most_common(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """The most frequent category per group; ties go to the smallest name."""
    counts = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min_by(category, F.struct(-F.col("_n"), F.col(category))).alias("top"),
        F.max("_n").alias("top_count"),
        F.count(F.lit(1)).alias("distinct"),
        F.sum("_n").alias("total"),
    )


def event_counts(df: DataFrame, kind: str, window: str, content: str, words: Column) -> DataFrame:
    """Totals overall, by kind and by window, in one pass over the rows."""
    base = df.select(
        F.col(kind).alias("kind"), F.col(window).alias("window"), F.length(content).alias("chars"), words.alias("words"),
        (F.col(content) == "").alias("blank"),
    )
    grouped = base.groupingSets(
        [[], ["kind"], ["window"]], "kind", "window"
    ).agg(
        F.grouping_id().alias("_level"),
        F.count(F.lit(1)).alias("events"),
        F.sum("chars").alias("chars"),
        F.sum("words").alias("words"),
        F.count_if("blank").alias("blanks"),
    )
    scope = F.when(F.col("_level") == 3, "all").when(F.col("_level") == 1, "type").otherwise("window")
    return grouped.select(
        scope.alias("scope"), F.coalesce("kind", "window", F.lit("")).alias("name"), "events", "chars", "words", "blanks"
    )


def word_frequency(df: DataFrame, words: Column) -> DataFrame:
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def hourly_activity(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Peak hour (earliest on a tie) and the population variance of the counts of the hours present."""
    counts = df.groupBy(*keys, F.hour(ts).alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min_by("_hour", F.struct(-F.col("_n"), F.col("_hour"))).alias("peak_hour"),
        F.var_pop("_n").alias("activity_variance"),
        F.count(F.lit(1)).alias("active_hours"),
        F.min("_hour").alias("first_hour"),
        F.max("_hour").alias("last_hour"),
    )


def forward_fill(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Fill missing values from the last row that had one."""
    filled = last_known(df, [group], {f"_{c}": F.col(c) for c in columns}, order=["event_id"], inclusive=True, by=F.col("event_id"))
    return filled.drop(*columns).withColumnsRenamed({f"_{c}": c for c in columns})


def usage_span(df: DataFrame, keys: Sequence[str], us: str = "us") -> DataFrame:
    """First and last time seen, and the span between them in seconds."""
    return df.groupBy(*keys).agg(
        F.min(us).alias("first_seen"), F.max(us).alias("last_seen"),
        ((F.max(us) - F.min(us)) / 1e6).alias("duration"),
    )


def intervals(df: DataFrame, group: str, unit: float = 1e6) -> DataFrame:
    """The time since the previous event of the group (NULL on the first)."""
    rows, w = framed(df, [group], back=1)
    return settled(rows.withColumn("gap", (F.col("us") - F.lag("us").over(w)) / unit))


def app_switching(df: DataFrame, group: str = "user_id") -> DataFrame:
    """Switches between applications, distinct applications and the entropy of their use."""
    used = df.filter("kind = 'window'").select(group, "event_id", "ts", "app")
    rows, w = framed(used, [group], back=1)
    moved = settled(rows.withColumn("_switch", F.lag("app").over(w) != F.col("app")))
    switches = moved.groupBy(group, "app").agg(F.count_if("_switch").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return switches.groupBy(group).agg(
        F.sum("_s").alias("app_switches"),
        F.count(F.lit(1)).alias("unique_apps"),
        entropy_of_counts(F.col("_n")).alias("app_diversity"),
    )


def mouse_summary(df: DataFrame, group: str = "user_id") -> DataFrame:
    """Share of clicks among mouse events; mean and variance of the distance between moves."""
    mouse = df.filter("kind = 'mouse'").select(group, "event_id", "ts", "action", "x", "y")
    clicks = mouse.groupBy(group).agg(share(F.col("action") == "click").alias("click_rate"))
    rows, w = framed(mouse.filter("action = 'move'"), [group], back=1)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    moves = settled(rows.withColumn("_step", step)).groupBy(group).agg(
        F.avg("_step").alias("avg_distance"), F.var_pop("_step").alias("distance_variance")
    )
    return clicks.join(moves, group, "left")


def rhythm(df: DataFrame, group: str = "user_id") -> DataFrame:
    """Evenness, speed and entropy of the intervals of a group, in milliseconds."""
    gaps = intervals(df.select(group, "event_id", "ts", "us"), group, 1e3)
    stats = gaps.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("gap").alias("_sd"), F.sum("gap").alias("_total")
    )
    bins = histogram_entropy(gaps.filter("gap IS NOT NULL"), [group], "gap")
    return stats.join(bins, group).select(
        group,
        (1.0 / (1.0 + F.col("_sd"))).alias("consistency"),
        F.when(F.col("_total") > 0, F.col("n") / (F.col("_total") / 1000)).otherwise(0.0).alias("speed"),
        F.col("entropy").alias("rhythm_entropy"),
    )


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Moments and exact quartiles of a value."""
    stats = df.groupBy(*keys).agg(*moments(value, F.col(value)))
    return stats.join(quantiles(df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}), list(keys))


def key_usage(df: DataFrame, group: str = "user_id", special: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(group, "key").agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n")
    return counts.groupBy(group).agg(
        F.count(F.lit(1)).alias("unique_keys"),
        (F.count(F.lit(1)) / total).alias("key_diversity"),
        (F.max("_n") / total).alias("top_key_share"),
        (F.sum(F.when(F.col("key").isin(*special), F.col("_n")).otherwise(0)) / total).alias("special_key_ratio"),
        entropy_of_counts(F.col("_n")).alias("key_entropy"),
    )


def activity_rate(df: DataFrame, group: str = "user_id") -> DataFrame:
    span = (F.max("us") - F.min("us")) / 1e6
    return df.groupBy(group).agg(
        F.when(span > 0, F.count(F.lit(1)) / span).alias("per_second"),
        (F.count(F.lit(1)) / F.greatest(span / 3600, F.lit(0.001))).alias("per_hour"),
    )


def hour_day_shares(df: DataFrame, group: str = "user_id", ts: str = "ts") -> DataFrame:
    """The share of each hour of the day and of each weekday (Monday first)."""
    hours = [share(F.hour(ts) == h).alias(f"h{h:02d}") for h in range(24)]
    days = [share(F.weekday(ts) == d).alias(f"d{d}") for d in range(7)]
    return df.groupBy(group).agg(*hours, *days)


def transitions(df: DataFrame, group: str = "user_id", kind: str = "event_type") -> DataFrame:
    """Counts of consecutive event types."""
    rows, w = framed(df.select(group, "event_id", "ts", kind), [group], back=1)
    pairs = settled(rows.withColumn("previous", F.lag(kind).over(w))).filter("previous IS NOT NULL")
    return pairs.groupBy("previous", F.col(kind).alias("next")).agg(F.count(F.lit(1)).alias("n"))


def spectrum(df: DataFrame, group: str, slot: Column, size: int, rolloff: float = 0.85) -> DataFrame:
    """Dominant frequency, its magnitude, centroid and roll-off of the counts per time slot.

    The transform is written out as sums of cosines and sines: each count meets each frequency once, and
    the frequencies are a fixed number per group.
    """
    counts = df.groupBy(group, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    k, angle = F.col("_k"), 2 * F.pi() * F.col("_k") * F.col("_slot") / size
    waves = counts.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    spectra = waves.groupBy(group, "_k").agg(
        F.sqrt(F.pow(F.sum(F.col("_n") * F.cos(angle)), 2) + F.pow(F.sum(F.col("_n") * F.sin(angle)), 2)).alias("_m")
    )
    # Magnitudes of one group, rounded so that mirrored frequencies tie exactly.
    level = F.round("_m", 6)
    bands = spectra.groupBy(group).agg(
        F.min_by("_k", F.struct(-level, k)).alias("dominant"),
        F.max("_m").alias("magnitude"),
        F.sum("_m").alias("_total"),
        F.sum(F.when(k < (size + 1) // 2, k).otherwise(k - size) / size * F.col("_m")).alias("_moment"),
        F.array_sort(F.collect_list(F.struct("_k", "_m"))).alias("_bands"),
    )
    upto = F.aggregate(
        "_bands",
        F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("at")),
        lambda a, b: F.struct(
            (a["sum"] + b["_m"]).alias("sum"),
            F.when((a["at"] < 0) & (a["sum"] + b["_m"] >= F.col("_total") * rolloff), b["_k"]).otherwise(a["at"]).alias("at"),
        ),
    )
    return bands.select(
        group, "dominant", "magnitude", (F.col("_moment") / F.col("_total")).alias("centroid"),
        (upto["at"] / size).alias("rolloff"),
    )


def running_count(df: DataFrame, keys: Sequence[str], name: str = "n", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    return running(df, keys, {name: F.lit(1).cast("long")}, order=order)
