"""Joins over event tables: as-of, profile, policy, range and neighbourhood joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.functions import patterns as P
from sessionlens.operators.sequence import framed, last_known, running, settled
from sessionlens.session import checked_broadcast, cut_lineage


def press_release(df: DataFrame, group: str = "user_id") -> DataFrame:
    """Seconds from each press to the next release of the same key; presses never released are dropped."""
    released = F.when(F.col("action") == "release", F.col("us"))
    paired = last_known(df, [group, "key"], {"_release": released}, forward=True)
    return paired.filter((F.col("action") == "press") & F.col("_release").isNotNull()).withColumn(
        "dwell", (F.col("_release") - F.col("us")) / 1e6
    ).drop("_release")


def previous_release(df: DataFrame, group: str = "user_id") -> DataFrame:
    """Seconds from the latest earlier release of any key to each press."""
    released = F.when(F.col("action") == "release", F.col("us"))
    paired = last_known(df, [group], {"_release": released})
    return paired.filter((F.col("action") == "press") & F.col("_release").isNotNull()).withColumn(
        "flight", (F.col("us") - F.col("_release")) / 1e6
    ).drop("_release")


def window_context(df: DataFrame, group: str = "user_id") -> DataFrame:
    """Every event inherits the application of the last window event."""
    active = F.when(F.col("kind") == "window", F.col("app"))
    return last_known(df, [group], {"context": active}, inclusive=True)


def long_features(df: DataFrame, ids: Sequence[str], features: dict[str, Column]) -> DataFrame:
    """Features as (ids, feature, x) rows."""
    wide = df.select(*ids, *[c.cast("double").alias(n) for n, c in features.items()])
    return wide.unpivot(list(ids), list(features), "feature", "x")


def profile_similarity(session: DataFrame, profile: DataFrame, group: str = "user_id", accept: float = 0.8) -> DataFrame:
    """1 / (1 + mean normalised distance) over the features both sides have.

    session: (group, feature, x); profile: (group, feature, mean, std).
    """
    raw = F.abs(F.col("x") - F.col("mean"))
    distance = F.when(F.col("std") > 0, raw / F.col("std")).otherwise(raw)
    return (
        session.join(profile, [group, "feature"])
        .groupBy(group)
        .agg(F.avg(distance).alias("_d"), F.count(F.lit(1)).alias("common_features"))
        .withColumn("similarity", 1.0 / (1.0 + F.col("_d")))
        .withColumn("verified", F.col("similarity") >= accept)
        .drop("_d")
    )


def baseline_deviation(current: DataFrame, baseline: DataFrame, keys: Sequence[str], limit: float = 2.0) -> DataFrame:
    """Relative deviation of current from baseline values; a missing baseline equals the current value.

    Zero baselines are skipped. Frames: (keys, current) and (keys, baseline).
    """
    joined = current.join(baseline, list(keys), "left").withColumn("baseline", F.coalesce("baseline", "current"))
    return (
        joined.filter(F.col("baseline") != 0)
        .withColumn("deviation", F.abs(F.col("current") - F.col("baseline")) / F.col("baseline"))
        .withColumn("is_anomaly", F.col("deviation") > limit)
    )


def component_scores(events: DataFrame, scores: dict[str, DataFrame], on: str = "event_id") -> DataFrame:
    """Attach each component's score to its events; an event a component did not score gets 0."""
    joined = reduce(lambda left, right: left.join(right, on, "left"), scores.values(), events)
    return joined.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in scores})


def recent_history(df: DataFrame, anomalous: Column, value: str, n: int = 10, group: str = "user_id") -> DataFrame:
    """Each row with what was known of its group before it: the last `n` anomalies, newest first, and the usual value.

    Adds `recent` (event ids), `recent_anomalies`, `last_type`, `indicators` (distinct event types among them, sorted) and
    `usual` (mean of the value over all earlier rows, NULL for the first).
    """
    found, w = framed(df.filter(anomalous).select(group, "ts", "event_id", "event_type"), [group], back=n - 1)
    one = F.struct("event_id", "event_type")
    lists = settled(found.withColumn("_upto", F.reverse(F.collect_list(one).over(w.rowsBetween(-(n - 1), 0)))))
    marked = df.join(lists.select("event_id", "_upto"), "event_id", "left")
    known = last_known(marked, [group], {"_known": F.col("_upto")})
    totals = running(known, [group], {"_rows": F.lit(1).cast("long"), "_sum": F.col(value)})
    before = F.coalesce("_known", F.array().cast("array<struct<event_id:bigint,event_type:string>>"))
    return totals.withColumns(
        {
            "recent": F.transform(before, lambda r: r["event_id"]),
            "recent_anomalies": F.size(before),
            "last_type": F.get(F.transform(before, lambda r: r["event_type"]), F.lit(0)),
            "indicators": F.array_sort(F.array_distinct(F.transform(before, lambda r: r["event_type"]))),
            "usual": F.try_divide(F.col("_sum") - F.col(value), F.col("_rows") - 1),
        }
    ).drop("_upto", "_known", "_rows", "_sum")


def _table(mapping: dict[str, list[str]]) -> Column:
    return F.create_map(*[c for k, vs in mapping.items() for c in (F.lit(k), F.array(*[F.lit(v) for v in vs]))])


def _values(mapping: dict[str, list[str]], key: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(mapping), key), F.array().cast("array<string>"))


def response_actions(level: Column, kind: Column, confidence: Column, risk: Column) -> Column:
    """Recommended actions of a finding, in order and without repeats. They are only reported, never carried out."""
    strong = (confidence > 0.8) & (risk >= 0.7)
    extra = F.when(strong, F.array(F.lit("preserve_evidence"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(_values(P.LEVEL_ACTIONS, level), _values(P.TYPE_ACTIONS, kind), extra))


def recommended_actions(level: Column, kind: Column) -> Column:
    return F.concat(_values(P.LEVEL_RECOMMENDATIONS, level), _values(P.TYPE_RECOMMENDATIONS, kind))


def factor_advice(factors: dict[str, Column], above: float = 0.5) -> Column:
    """Advice texts of the factors above the bound, sorted and without repeats."""
    nothing = F.array().cast("array<string>")
    parts = [
        F.when(score > above, F.array(*[F.lit(t) for t in P.FACTOR_ADVICE[name]])).otherwise(nothing)
        for name, score in factors.items()
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def new_devices(df: DataFrame, group: str = "user_id", device: str = "device") -> DataFrame:
    """First use of a device by a group that had used another one before."""
    at = F.struct("us", "event_id")
    first_use = df.groupBy(group, device).agg(F.min(at).alias("_at"))
    first_event = df.groupBy(group).agg(F.min(at).alias("_first"))
    return (
        first_use.join(first_event, group)
        .filter(F.col("_at") > F.col("_first"))
        .select(group, device, F.col("_at.event_id").alias("event_id"))
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def impossible_travel(df: DataFrame, group: str = "user_id", km: float = 1000.0, seconds: float = 3600.0) -> DataFrame:
    """Consecutive places of a group further apart than `km` within `seconds`."""
    rows, w = framed(df, [group], back=1)
    prev = settled(
        rows.withColumns({f"_{c}": F.lag(c).over(w) for c in ("lat", "lon", "us")})
    ).filter(F.col("_us").isNotNull())
    return prev.withColumns(
        {
            "distance_km": haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")),
            "seconds": (F.col("us") - F.col("_us")) / 1e6,
        }
    ).filter((F.col("distance_km") >= km) & (F.col("seconds") <= seconds)).drop("_lat", "_lon", "_us")


def range_lookup(df: DataFrame, point: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Join points to the disjoint ranges that hold them; a point outside all ranges keeps NULLs.

    Both sides meet on fixed-width buckets, so the range condition is checked inside an equi-join. A bucket
    may hold many points, but the pairs stay few, since the ranges do not overlap.
    """
    buckets = ranges.withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    )
    points = df.withColumn("_bucket", F.floor(F.col(point) / width))
    held = F.col(point).between(F.col(low), F.col(high))
    inside = (F.col("_bucket") == F.col("_range_bucket")) & held
    return points.join(
        checked_broadcast(buckets.withColumnRenamed("_bucket", "_range_bucket")), inside, "left"
    ).drop("_bucket", "_range_bucket")


def aligned_blocks(low: Column, high: Column, bits: int) -> Column:
    """The fewest aligned blocks of 2^level numbers that make up the range low..high, as an array of (level, prefix).

    At each level at most one block begins the range and one ends it, so a range makes 2 * bits blocks at most."""
    blocks = []
    for level in range(bits + 1):
        first = F.shiftright(low + F.lit((1 << level) - 1).cast("long"), level)
        last = F.shiftright(high + F.lit(1).cast("long"), level) - 1
        some = first <= last
        blocks.append(F.when(some & (first % 2 == 1), F.struct(F.lit(level).alias("level"), first.alias("prefix"))))
        blocks.append(F.when(some & (last % 2 == 0), F.struct(F.lit(level).alias("level"), last.alias("prefix"))))
    return F.filter(F.array(*blocks), lambda b: b.isNotNull())


def narrowest_range(df: DataFrame, point: str, ranges: DataFrame, low: str, high: str, bits: int = 32) -> DataFrame:
    """Join points to the narrowest of the ranges that hold them; ranges may nest and overlap.

    Ranges are cut into aligned blocks, so a point lies in a block of a level exactly if its leading bits are the block's
    prefix: one equi-join per level that occurs, without any range condition, and with one block per prefix. A range over
    half of all numbers makes a few blocks, not one for each bucket. Of equally narrow ranges the one with the smallest
    low end counts, then the one whose columns come first in order.

    Numbers are from 0 to 2^bits - 1 (bits up to 61). Ranges that are empty or have a NULL end hold nothing; a NULL point, or
    one outside all ranges, keeps NULLs.
    """
    payload = ranges.columns
    rank = F.struct((F.col(high) - F.col(low)).alias("_w"), F.col(low).alias("_l"), F.struct(*payload).alias("_r"))
    blocks = cut_lineage(
        ranges.filter(F.col(low) <= F.col(high)).select(rank.alias("_rank"), F.explode(aligned_blocks(F.col(low), F.col(high), bits)).alias("_b"))
        .groupBy(F.col("_b.level").alias("_level"), F.col("_b.prefix").alias("_prefix")).agg(F.min("_rank").alias("_rank")))
    levels = [r[0] for r in blocks.select("_level").distinct().orderBy("_level").collect()]  # bits + 1 at most
    out = df
    for level in levels:
        own = blocks.filter(F.col("_level") == level).select(F.col("_prefix").alias(f"_p{level}"), F.col("_rank").alias(f"_r{level}"))
        out = out.join(checked_broadcast(own), F.shiftright(F.col(point), level) == F.col(f"_p{level}"), "left").drop(f"_p{level}")
    found = [F.col(f"_r{level}") for level in levels]
    nothing = F.lit(None).cast(blocks.schema["_rank"].dataType)
    best = F.array_min(F.array(*found)) if found else nothing
    return out.withColumn("_best", best).select(*df.columns, *(F.col("_best._r")[c].alias(c) for c in payload))


def _cells(points: DataFrame, eps: float) -> DataFrame:
    side = eps / 2**0.5
    return points.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))


def _around(cells: DataFrame) -> DataFrame:
    steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if i or j]
    return (
        cells.withColumn("_step", F.explode(F.array(*steps)))
        .withColumn("ncx", F.col("cx") + F.col("_step.i"))
        .withColumn("ncy", F.col("cy") + F.col("_step.j"))
        .drop("_step")
    )


def density_points(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """Which of the weighted points (x, y, n) are core points, and which are noise.

    The grid cells have a diagonal of `eps`: all points of a cell are neighbours. A cell that reaches
    `min_points` therefore holds only core points and needs no distances. Distances are computed for the
    points of thin cells only (fewer than `min_points` of them per cell), so a hot cell never meets itself.
    """
    placed = _cells(points, eps)
    weight = placed.groupBy("cx", "cy").agg(F.sum("n").alias("w"))
    weighed = cut_lineage(placed.join(weight, ["cx", "cy"]))
    thick, thin = weighed.filter(F.col("w") >= min_points), weighed.filter(F.col("w") < min_points)

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs within eps of thin points and the points of the cells around them."""
        other = right.select(
            F.col("cx").alias("ncx"), F.col("cy").alias("ncy"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("n").alias("on")
        )
        dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
        return _around(left).join(other, ["ncx", "ncy"]).filter(dx * dx + dy * dy <= eps * eps)

    reached = near(thin, weighed).groupBy("x", "y").agg(F.sum("on").alias("more"))
    judged = cut_lineage(
        thin.join(reached, ["x", "y"], "left")
        .withColumn("neighbours", F.col("w") + F.coalesce("more", F.lit(0)))
        .withColumn("is_core", F.col("neighbours") >= min_points)
    )
    cores = thick.select("x", "y", "n", "cx", "cy").unionByName(judged.filter("is_core").select("x", "y", "n", "cx", "cy"))
    core_cells = judged.filter("is_core").select("cx", "cy").distinct().withColumn("_own", F.lit(True))
    border = near(judged.filter("NOT is_core").select("x", "y", "cx", "cy"), cores).select("x", "y").distinct()
    rest = judged.join(border.withColumn("_near", F.lit(True)), ["x", "y"], "left").join(core_cells, ["cx", "cy"], "left")
    noise = ~(F.col("is_core") | F.coalesce("_near", F.lit(False)) | F.coalesce("_own", F.lit(False)))
    columns = ["x", "y", "n", "is_core", "is_noise"]
    return (
        thick.withColumn("is_core", F.lit(True)).withColumn("is_noise", F.lit(False)).select(*columns)
        .unionByName(rest.withColumn("is_noise", noise).select(*columns))
    )


