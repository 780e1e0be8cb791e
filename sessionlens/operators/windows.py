"""Features over the last events of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sessionlens.functions import clock
from sessionlens.operators.aggregates import transitions
from sessionlens.operators.sequence import attach, framed, last_known, matched, running, settled
from sessionlens.session import checked_broadcast, cut_lineage

GROUP = ["user_id"]


def last(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n - 1 rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def before(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current one."""
    return w.rowsBetween(-n, -1)


def size_of(w: WindowSpec) -> Column:
    return F.count(F.lit(1)).over(w)


def gap_seconds(w: WindowSpec) -> Column:
    return (F.col("us") - F.lag("us").over(w)) / 1e6


def span_seconds(w: WindowSpec) -> Column:
    return (F.max("us").over(w) - F.min("us").over(w)) / 1e6


def slope(score: Column, w: WindowSpec, n: int) -> Column:
    """Least-squares slope of the last n scores against their position."""
    middle = (n - 1) / 2
    scale = sum((i - middle) ** 2 for i in range(n))
    terms = [F.lag(score, j).over(w) * F.lit((middle - j) / scale) for j in range(n)]
    return sum(terms[1:], terms[0])


def intervals(df: DataFrame) -> DataFrame:
    """Gap to the previous event; distance and velocity where both events are mouse events."""
    rows, w = framed(df, GROUP, back=1)
    mouse = (F.col("kind") == "mouse") & (F.lag("kind").over(w) == "mouse")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    out = rows.withColumn("gap", gap_seconds(w)).withColumn("distance", F.when(mouse, step))
    return settled(out.withColumn("velocity", F.when(F.col("gap") > 0, F.col("distance") / F.col("gap"))))


def typing_speed(df: DataFrame, n: int = 5) -> DataFrame:
    """Mean, deviation and speed of the last n intervals in milliseconds; NULL before there are n."""
    rows, w = framed(df, GROUP, back=n)
    gaps = rows.withColumn("_g", gap_seconds(w) * 1000)
    full = F.count("_g").over(last(w, n)) == n
    total = F.sum("_g").over(last(w, n))
    return settled(
        gaps.withColumns(
            {
                "avg_interval": F.when(full, F.avg("_g").over(last(w, n))),
                "std_interval": F.when(full, F.stddev_pop("_g").over(last(w, n))),
                "speed": F.when(full, F.when(total > 0, n / (total / 1000)).otherwise(0.0)),
            }
        ).drop("_g")
    )


def recent_context(df: DataFrame, kinds: Sequence[str], n: int = 10, burst: float = 0.1) -> DataFrame:
    """Shares of the kinds, mean and variance of the intervals, and short intervals among the last n events."""
    rows, w = framed(df, GROUP, back=n)
    frame, inner = last(w, n), last(w, n - 1)
    gaps = rows.withColumn("_g", gap_seconds(w))
    # The interval of the oldest event leads out of the frame, so it is left to the smaller frame.
    shares = {f"{k}_share": F.avg((F.col("kind") == k).cast("double")).over(frame) for k in kinds}
    return settled(
        gaps.withColumns(
            shares
            | {
                "avg_interval": F.avg("_g").over(inner),
                "interval_variance": F.var_pop("_g").over(inner),
                "bursts": F.count_if(F.col("_g") < burst).over(inner),
            }
        ).drop("_g")
    )


def recent_rhythm(df: DataFrame, n: int = 10, bins: int = 10) -> DataFrame:
    """Mean, deviation, variation, entropy, bursts and pauses of the intervals among the last n events.

    The n - 1 intervals are plain columns, so everything stays inside generated code. The entropy follows
    from how many intervals share each interval's bin: log2 m - mean(log2 of that number).
    """
    rows, w = framed(df, GROUP, back=n)
    m = n - 1
    names = [f"_g{j}" for j in range(m)]
    gaps = rows.withColumn("_g", gap_seconds(w) * 1000)
    wide = gaps.withColumns({name: F.lag("_g", j).over(w) for j, name in enumerate(names)} | {"_n": size_of(last(w, n))})
    full = settled(wide).filter(F.col("_n") == n).drop("_g", "_n")
    values = [F.col(g) for g in names]
    mean = sum(values[1:], values[0]) / m
    lo, hi = F.least(*values), F.greatest(*values)
    stats = full.withColumns({"mean": mean, "_lo": lo, "_hi": hi})
    off = [(v - F.col("mean")) * (v - F.col("mean")) for v in values]
    width = F.col("_hi") - F.col("_lo")
    places = {
        f"_b{j}": F.when(width > 0, F.least(F.floor((v - F.col("_lo")) / width * bins), F.lit(bins - 1))).otherwise(0)
        for j, v in enumerate(values)
    }
    placed = stats.withColumns(places | {"std": F.sqrt(sum(off[1:], off[0]) / m)})

    def how_many(conditions: list[Column]) -> Column:
        ones = [F.when(c, 1).otherwise(0) for c in conditions]
        return sum(ones[1:], ones[0])

    shared = [F.log2(how_many([F.col(a) == F.col(b) for b in places])) for a in places]
    return placed.withColumns(
        {
            "variation": F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0),
            "entropy": F.log2(F.lit(float(m))) - sum(shared[1:], shared[0]) / m,
            "bursts": how_many([v < F.col("mean") * 0.5 for v in values]),
            "pauses": how_many([v > F.col("mean") * 2.0 for v in values]),
        }
    ).drop(*names, *places, "_lo", "_hi")


def ngram_shares(df: DataFrame, key: str = "key", n: int = 50, least: int = 10) -> DataFrame:
    """How often the key, and the pair and triple it ends, occur among the n keys before."""
    rows, w = framed(df, GROUP, back=n)
    seen = settled(rows.withColumn("_keys", F.collect_list(key).over(before(w, n)))).withColumn("_n", F.size("_keys"))
    keys, size = F.col("_keys"), F.col("_n")

    def share(length: int) -> Column:
        """The share of the windows of `length` keys that equal the last keys plus the current one."""
        starts = F.sequence(F.lit(0), size - length)

        def same(i: Column) -> Column:
            hit = F.get(keys, i + (length - 1)) == F.col(key)
            for j in range(length - 1):
                hit = hit & (F.get(keys, i + j) == F.get(keys, size - (length - 1) + j))
            return hit

        return F.when(size >= least, F.size(F.filter(starts, same)) / (size - (length - 1))).otherwise(0.0)

    return seen.withColumns(
        {"key_share": share(1), "bigram_share": share(2), "trigram_share": share(3)}
    ).drop("_keys", "_n")


def gaps_and_bursts(df: DataFrame, n: int = 5, span: float = 60.0, rapid: float = 1.0, long: float = 3600.0) -> DataFrame:
    """Gap flags, and whether this event and the n before it lie within `span` seconds."""
    rows, w = framed(df, GROUP, back=n)
    gap = gap_seconds(w)
    frame = last(w, n + 1)
    return settled(
        rows.withColumns(
            {
                "time_gap": gap,
                "rapid_activity": F.coalesce(gap < rapid, F.lit(False)),
                "extended_gap": F.coalesce(gap > long, F.lit(False)),
                "burst_activity": (size_of(frame) == n + 1) & (span_seconds(frame) < span),
            }
        )
    )


def recent_shares(df: DataFrame) -> DataFrame:
    """Clipboard share of the last 100 events, a device event in the last 10, same-kind events in the last 20."""
    rows, w = framed(df, GROUP, back=100)
    long, short = before(w, 100), before(w, 10)
    share = F.avg((F.col("kind") == "clipboard").cast("double")).over(long)
    kinds = F.collect_list("kind").over(last(w, 20))
    out = rows.withColumns(
        {
            "clipboard_share": F.when(size_of(long) >= 10, share).otherwise(0.0),
            "usb_recent": F.coalesce(F.max(F.col("kind") == "usb").over(short), F.lit(False)),
            "_kinds": kinds,
        }
    )
    same = F.size(F.filter("_kinds", lambda k: k == F.col("kind")))
    return settled(out.withColumn("same_kind", same).drop("_kinds"))


def behaviour_profile(df: DataFrame, recent: int = 10, base: int = 100, least: int = 50) -> DataFrame:
    """Current behaviour over the last events against the baseline of the events before."""
    rows, w = framed(df, GROUP, back=base)
    now, past = before(w, recent), before(w, base)
    late = clock.after_hours("ts")
    apps = F.size(F.array_distinct(F.collect_list(F.when(F.col("kind") == "window", F.col("app"))).over(now)))
    ready, known = size_of(now) == recent, size_of(past) >= least
    copied = F.col("kind") == "clipboard"
    return settled(
        rows.withColumns(
            {
                "clipboard_usage": F.when(ready, F.count_if(copied).over(now)),
                "application_switches": F.when(ready, apps),
                "after_hours_activity": F.when(ready, F.count_if(late).over(now)),
                "base_clipboard": F.when(known, F.avg(copied.cast("double")).over(past)),
                "base_after_hours": F.when(known, F.avg(late.cast("double")).over(past)),
            }
        )
    )


def activity_context(df: DataFrame, n: int = 10, least: int = 5) -> DataFrame:
    """Events per second and diversity of kinds among the last n events."""
    rows, w = framed(df, GROUP, back=n)
    frame = last(w, n)
    out = rows.withColumns(
        {"_n": size_of(frame), "_span": span_seconds(frame), "_kinds": F.collect_list("kind").over(frame)}
    )
    known = F.col("_n") >= least
    return settled(
        out.withColumns(
            {
                "intensity": F.when(known, F.col("_n") / F.greatest("_span", F.lit(1.0))),
                "diversity": F.when(known, F.size(F.array_distinct("_kinds")) / F.col("_n")),
            }
        ).drop("_n", "_span", "_kinds")
    )


def risk_trend(df: DataFrame, score: str = "score", n: int = 10) -> DataFrame:
    """Mean and slope of the last n scores; the slope is 0 before there are n."""
    rows, w = framed(df, GROUP, back=n)
    frame = last(w, n)
    return settled(
        rows.withColumns(
            {
                "recent_mean": F.avg(score).over(frame),
                "trend": F.when(size_of(frame) == n, slope(F.col(score), w, n)).otherwise(0.0),
            }
        )
    )


def rapid_actions(
    df: DataFrame, keys_per_second: float = 10.0, click_gap: float = 0.1, apps: int = 5, copies: int = 5
) -> DataFrame:
    """Rapid typing, clicking, application switching and copying among the last events."""
    rows, w = framed(df, GROUP, back=20)
    ten, twenty = before(w, 10), before(w, 20)
    typed = F.when(F.col("kind") == "keyboard", F.col("us"))
    clicked = F.when((F.col("kind") == "mouse") & (F.col("action") == "click"), F.col("us"))
    app = F.when(F.col("kind") == "window", F.col("app"))
    out = rows.withColumns(
        {
            "_typed": F.count(typed).over(ten),
            "_typing": (F.max(typed).over(ten) - F.min(typed).over(ten)) / 1e6,
            "_clicks": F.collect_list(clicked).over(ten),
            "_apps": F.collect_list(app).over(ten),
            "_copies": F.count_if(F.col("kind") == "clipboard").over(twenty),
            "_n": size_of(twenty),
        }
    )
    clicks = F.col("_clicks")
    gaps = F.zip_with(F.slice(clicks, 2, 20), clicks, lambda a, b: (a - b) / 1e6)
    quick = F.exists(gaps, lambda g: F.coalesce(g < click_gap, F.lit(False)))
    return settled(
        out.withColumns(
            {
                "rapid_typing": (F.col("_typed") >= 5) & (F.try_divide("_typed", "_typing") > keys_per_second),
                "rapid_clicking": (F.size(clicks) >= 3) & quick,
                "rapid_app_switching": (F.size("_apps") >= 3) & (F.size(F.array_distinct("_apps")) > apps),
                "frequent_copying": (F.col("_n") >= 10) & (F.col("_copies") > copies),
            }
        ).withColumn("rapid_typing", F.coalesce("rapid_typing", F.lit(False)))
        .drop("_typed", "_typing", "_clicks", "_apps", "_copies", "_n")
    )


def size_anomaly(df: DataFrame, n: int = 20, limit: float = 2.0) -> DataFrame:
    """Copied sizes more than `limit` deviations from the sizes among the last n events."""
    rows, w = framed(df, GROUP, back=n)
    past = before(w, n)
    sizes = F.when(F.col("kind") == "clipboard", F.col("size"))
    mean, std = F.avg(sizes).over(past), F.stddev_pop(sizes).over(past)
    known = (size_of(past) >= 10) & (F.count(sizes).over(past) >= 3) & (std > 0)
    z = F.when(known, F.abs(F.col("size") - mean) / std)
    out = settled(rows.withColumn("z", z)).filter("kind = 'clipboard'")
    return out.withColumn("size_anomaly", F.coalesce(F.col("z") > limit, F.lit(False)))


def sliding_bursts(df: DataFrame, n: int = 10, factor: float = 2.0) -> DataFrame:
    """Per group: the mean rate over all windows of n events, and how many exceed `factor` times it."""
    rows, w = framed(df, GROUP, ahead=n)
    frame = w.rowsBetween(0, n - 1)
    out = rows.withColumns({"_n": size_of(frame), "_span": span_seconds(frame)})
    rates = settled(out).filter((F.col("_n") == n) & (F.col("_span") > 0)).select(*GROUP, (n / F.col("_span")).alias("rate"))
    mean = rates.groupBy(*GROUP).agg(F.avg("rate").alias("mean_rate"))
    return attach(rates, mean, GROUP).groupBy(*GROUP).agg(
        F.max("mean_rate").alias("mean_rate"), F.count_if(F.col("rate") > factor * F.col("mean_rate")).alias("bursts")
    )


def time_in_app(df: DataFrame, as_of: Column) -> DataFrame:
    """Seconds from each window event to the next, the last one closed at `as_of` (microseconds)."""
    windows = df.filter("kind = 'window'").select(*GROUP, "event_id", "ts", "us", "app")
    rows, w = framed(windows, GROUP, ahead=1)
    spent = settled(rows.withColumn("_next", F.lead("us").over(w)))
    return spent.withColumn("seconds", (F.coalesce("_next", as_of) - F.col("us")) / 1e6).drop("_next")


def double_clicks(df: DataFrame, limit: float = 0.5) -> DataFrame:
    """Releases that follow another release within `limit` seconds."""
    buttons = df.filter("kind = 'mouse' AND action IN ('press', 'release')")
    rows, w = framed(buttons, GROUP, back=1)
    twice = (F.lag("action").over(w) == "release") & (gap_seconds(w) < limit)
    return settled(rows.withColumn("double_click", F.coalesce(twice, F.lit(False)))).filter("action = 'release'")


def drags(df: DataFrame, least: float = 5.0) -> DataFrame:
    """Press-release pairs further than `least` pixels apart."""
    buttons = df.filter("kind = 'mouse' AND action IN ('press', 'release')")
    rows, w = framed(buttons, GROUP, back=1)
    pairs = settled(
        rows.withColumns(
            {
                "_held": F.lag("action").over(w) == "press",
                "distance": F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)),
            }
        )
    )
    return pairs.filter((F.col("action") == "release") & F.col("_held") & (F.col("distance") > least)).drop("_held")


def text_segments(df: DataFrame, ends: Column, backspace: Column, idle: float = 2.0) -> DataFrame:
    """Typed segments between line ends, navigation and idle time: their length and edits, not their text.

    A backspace removes one character and never goes below an empty segment, so the final length is
    total - min(0, lowest running total), a pure aggregate of running totals.
    """
    typed = df.withColumn("_end", ends).withColumn(
        "_delta", F.when(backspace, F.lit(-1)).when(ends, F.lit(0)).otherwise(F.lit(1)).cast("long")
    ).withColumn("_edit", backspace)
    rows, w = framed(typed, GROUP, back=1)
    starts = F.coalesce(F.lag("_end").over(w) | (gap_seconds(w) > idle), F.lit(True))
    marked = settled(rows.withColumn("_start", starts.cast("long")))
    totals = running(marked, GROUP, {"segment": F.col("_start"), "_level": F.col("_delta")})
    at = F.struct("us", "event_id")
    base = F.min_by(F.col("_level") - F.col("_delta"), at)
    return totals.groupBy(*GROUP, "segment").agg(
        F.count(F.lit(1)).alias("keys"),
        F.count_if("_edit").alias("edits"),
        (F.max_by("_level", at) - base - F.least(F.lit(0), F.min("_level") - base)).alias("net_length"),
        F.min("us").alias("started"),
        ((F.max("us") - F.min("us")) / 1e6).alias("seconds"),
    )


def baseline_drift(
    df: DataFrame, features: Sequence[str], window: int = 1000, cold_start: int = 250, limit: float = 0.15
) -> DataFrame:
    """Mean of min(1, |z| / 5) over the features against a rolling baseline of the rows before.

    The rolling sums are differences of running sums, so a long window costs no more than a short one; values are
    centred on the user's mean first, so the sums do not cancel.
    """
    means = df.groupBy(*GROUP).agg(*[F.avg(f).alias(f"_m_{f}") for f in features])
    centred = attach(df, means, GROUP).withColumns({f"_x_{f}": F.col(f) - F.col(f"_m_{f}") for f in features})
    rows, w = framed(centred.drop(*[f"_m_{f}" for f in features]), GROUP, back=window)
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    sums, parts, checked = {"_n": F.least(size_of(before(w, window)), F.lit(window))}, [], []
    for f in features:
        x = F.col(f"_x_{f}").cast("double")
        for name, v in ((f"_s_{f}", x), (f"_q_{f}", x * x)):
            sums[name] = F.coalesce(F.sum(v).over(upto), F.lit(0.0))
    out = rows.withColumns(sums)
    rolled = {c: F.col(c) - F.coalesce(F.lag(c, window).over(w), F.lit(0.0)) for c in sums if c != "_n"}
    out = out.withColumns(rolled)
    for f in features:
        mean = F.try_divide(f"_s_{f}", "_n")
        var = F.greatest(F.lit(0.0), F.try_divide(f"_q_{f}", "_n") - mean * mean)
        spread = F.coalesce(var > 1e-8, F.lit(False))
        z = F.try_divide(F.abs(F.col(f"_x_{f}") - mean), F.sqrt(var)) / 5.0
        parts.append(F.when(spread, F.least(F.lit(1.0), z)).otherwise(0.0))
        checked.append(F.when(spread, 1).otherwise(0))
    total, count = sum(parts[1:], parts[0]), sum(checked[1:], checked[0])
    drift = F.when(F.col("_n") >= cold_start, F.try_divide(total, count))
    done = settled(out.withColumn("drift", drift)).drop(*sums, *[f"_x_{f}" for f in features])
    return done.withColumn("drifted", F.coalesce(F.col("drift") > limit, F.lit(False)))


def trend_label(df: DataFrame, score: str = "score", anomalous: str = "is_anomalous") -> DataFrame:
    """Whether the last 5 scores only rise, only fall or neither; count and mean over the last 10."""
    rows, w = framed(df, GROUP, back=10)
    five, ten = last(w, 5), last(w, 10)
    scores = [F.lag(score, j).over(w) for j in range(5)]
    rising = [F.coalesce(scores[j + 1] <= scores[j], F.lit(True)) for j in range(4)]
    falling = [F.coalesce(scores[j + 1] >= scores[j], F.lit(True)) for j in range(4)]
    label = (
        F.when(size_of(five) < 3, "insufficient_data")
        .when(rising[0] & rising[1] & rising[2] & rising[3], "increasing")
        .when(falling[0] & falling[1] & falling[2] & falling[3], "decreasing")
        .otherwise("stable")
    )
    return settled(
        rows.withColumns(
            {
                "trend": label,
                "anomalies_last_10": F.count_if(anomalous).over(ten),
                "average_last_10": F.avg(score).over(ten),
            }
        )
    )


def confidence_share(df: DataFrame, confidence: str = "confidence", n: int = 10, least: int = 5, above: float = 0.7) -> DataFrame:
    """Share of confident results among the last n; NULL below `least` rows."""
    rows, w = framed(df, GROUP, back=n)
    share = F.avg((F.col(confidence) > above).cast("double")).over(last(w, n))
    return settled(rows.withColumn("confidence_level", F.when(size_of(last(w, n)) >= least, share)))


def moving_average(df: DataFrame, value: str, alpha: float = 0.1, start: float = 0.0) -> DataFrame:
    """The exponential moving average after a group's last row, by its closed form."""
    ranked = running(df, GROUP, {"_rn": F.lit(1).cast("long")})
    total = df.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n"))
    weight = alpha * F.pow(F.lit(1 - alpha), F.col("_n") - F.col("_rn"))
    return attach(ranked, total, GROUP).groupBy(*GROUP).agg(
        (F.sum(weight * F.col(value)) + start * F.pow(F.lit(1 - alpha), F.max("_n"))).alias("ema")
    )


def anomaly_runs(df: DataFrame, flag: Column, least: int = 3) -> DataFrame:
    """Runs of at least `least` consecutive flagged events."""
    flagged = running(df.withColumn("_flag", flag), GROUP, {"_island": (~F.col("_flag")).cast("long")})
    return (
        flagged.filter("_flag")
        .groupBy(*GROUP, "_island")
        .agg(F.count(F.lit(1)).alias("length"), F.min("us").alias("started"), F.max("us").alias("ended"))
        .filter(F.col("length") >= least)
        .drop("_island")
    )


def sequence_likelihood(df: DataFrame, kind: str = "event_type", n: int = 50) -> DataFrame:
    """Mean log-probability of the last n transitions under the overall transition probabilities."""
    counts = transitions(df, GROUP[0], kind)
    leaving = counts.groupBy("previous").agg(F.sum("n").alias("_out"))
    logs = counts.join(leaving, "previous").select(
        F.col("previous").alias("_prev"), F.col("next").alias(kind), F.ln(F.col("n") / F.col("_out")).alias("_logp")
    )
    # Written first, so that the size of the table is known before it is joined to all rows.
    table = checked_broadcast(cut_lineage(logs))
    rows, w = framed(df, GROUP, back=1)
    stepped = settled(rows.withColumn("_prev", F.lag(kind).over(w))).join(table, ["_prev", kind], "left")
    framed_rows, w = framed(stepped, GROUP, back=n)
    return settled(framed_rows.withColumn("likelihood", F.avg("_logp").over(last(w, n)))).drop("_prev", "_logp")


def ngram_tables(rows: DataFrame, kind: str, least: int) -> dict[str, DataFrame]:
    """Counts of sequences of one, two and three kinds; longer ones seen fewer than `least` times are left out.

    Columns: the kinds (`_p2`, `_p1`, kind), `n` and, for one and two, `left`: before how many different kinds it follows."""
    seen = cut_lineage(rows.groupBy("_p2", "_p1", kind).agg(F.count(F.lit(1)).alias("n")))
    three = seen.filter(F.col("_p2").isNotNull() & (F.col("n") >= least))
    two = seen.filter(F.col("_p1").isNotNull()).groupBy("_p1", kind).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    one = seen.groupBy(kind).agg(F.sum("n").alias("n"))
    after_two = three.groupBy("_p1", kind).agg(F.count(F.lit(1)).alias("left"))
    after_one = two.groupBy(kind).agg(F.count(F.lit(1)).alias("left"))
    two = matched(two, after_two, ["_p1", kind], "left")
    return {"seen": seen, "three": three, "two": cut_lineage(two), "one": cut_lineage(matched(one, after_one, [kind], "left"))}


def ngram_probabilities(asked: DataFrame, tables: dict[str, DataFrame], kind: str, discount: float) -> DataFrame:
    """p1, p2 and p3 of each asked (`_p2`, `_p1`, kind): probabilities of the kind after none, one and two kinds.

    Interpolated with absolute discounts: of each count `discount` is taken away and given to the shorter context, down to
    equal shares of all kinds. Within longer models a shorter sequence counts by the number of different kinds before it
    (continuations), since its own count is spent where the longer one was seen. A context that is NULL or was not kept
    leaves everything to the shorter one, so the probabilities after each context sum to 1, also of what was never seen.
    """

    def level(table: DataFrame, context: list[str], value: str, name: str) -> tuple[DataFrame, DataFrame]:
        """Discounted shares and the mass left over, per context."""
        some = table.filter(F.coalesce(F.col(value), F.lit(0)) > 0)
        total = some.groupBy(*context).agg(F.sum(value).alias(f"_{name}_all"), F.count(F.lit(1)).alias(f"_{name}_kinds"))
        return some.select(*context, kind, F.col(value).alias(f"_{name}")), total

    def with_level(df: DataFrame, table: DataFrame, context: list[str], value: str, name: str, shorter: Column) -> tuple[DataFrame, Column]:
        shares, total = level(table, context, value, name)
        out = matched(df, checked_broadcast(shares), [*context, kind], "left")
        every, kinds = F.col(f"_{name}_all"), F.col(f"_{name}_kinds")
        if context:
            out = matched(out, checked_broadcast(total), context, "left")
        else:
            every, kinds = (total.select(c).scalar() for c in (every, kinds))
        own = F.greatest(F.coalesce(F.col(f"_{name}"), F.lit(0)) - discount, F.lit(0.0)) / every
        rest = discount * kinds / every
        return out, F.when(every > 0, own + rest * shorter).otherwise(shorter)

    one, two, three = tables["one"], tables["two"], tables["three"]
    kinds, events = one.agg(F.count(F.lit(1))).scalar(), one.agg(F.sum("n")).scalar()
    base = matched(asked, checked_broadcast(one.select(kind, F.col("n").alias("_n"))), [kind], "left")
    base, after_none = with_level(base, one, [], "left", "c1", 1 / kinds)
    base, raw_two = with_level(base, two, ["_p1"], "n", "r2", after_none)
    base, after_one = with_level(base, two, ["_p1"], "left", "c2", after_none)
    base, raw_three = with_level(base, three, ["_p2", "_p1"], "n", "r3", after_one)
    return base.select(*asked.columns, (F.coalesce("_n", F.lit(0)) / events).alias("p1"), raw_two.alias("p2"), raw_three.alias("p3"))


def sequence_ngrams(df: DataFrame, kind: str = "event_type", n: int = 50, least: int = 2, discount: float = 0.75) -> DataFrame:
    """Mean log-probability of the last n events under back-off models of one, two and three kinds (likelihood_1 to _3).

    Models are over all groups; sequences never span groups. Each distinct sequence is scored once, and rows look theirs up.
    """
    rows, w = framed(df, GROUP, back=2)
    stepped = settled(rows.withColumns({"_p1": F.lag(kind, 1).over(w), "_p2": F.lag(kind, 2).over(w)}))
    tables = ngram_tables(stepped, kind, least)
    scored = ngram_probabilities(tables["seen"].drop("n"), tables, kind, discount)
    logs = cut_lineage(scored.select("_p2", "_p1", kind, *(F.ln(f"p{i}").alias(f"_l{i}") for i in (1, 2, 3))))
    looked = matched(stepped, checked_broadcast(logs), ["_p2", "_p1", kind], "left").drop("_p1", "_p2")
    framed_rows, w = framed(looked, GROUP, back=n)
    means = {f"likelihood_{i}": F.avg(f"_l{i}").over(last(w, n)) for i in (1, 2, 3)}
    return settled(framed_rows.withColumns(means)).drop("_l1", "_l2", "_l3")


def since_last_device(df: DataFrame) -> DataFrame:
    """Seconds since the last earlier device event."""
    seen = last_known(df, GROUP, {"_usb": F.when(F.col("kind") == "usb", F.col("us"))})
    return seen.withColumn("since_device", (F.col("us") - F.col("_usb")) / 1e6).drop("_usb")
