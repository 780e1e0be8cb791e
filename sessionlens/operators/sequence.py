"""Ordered operators over groups of any size.

A plain `Window.partitionBy(user)` puts all rows of a user into one task. That is the fastest plan while
every group is small, and it fails when one user holds a third of the data. Each operator here first
checks the largest group. Within the bound (`spark.sessionlens.maxGroupRows`) it uses the plain window.
Beyond it, groups are cut into consecutive slices of about that many rows, and each slice gets what it
needs from its neighbours: the last rows before it (`framed`), the totals before it (`running`) or the
last known values before it (`last_known`). Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sessionlens.session import GROUP_ROWS_DEFAULT, GROUP_ROWS_KEY, checked_broadcast, cut_lineage, setting

TIME_ORDER = ("ts", "event_id")
SLICE = "_slice"
HALO = "_halo"
WHOLE = -1  # the slice number of a group that is not cut
CELLS = 4096
REFINEMENTS = 4


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL is a value like any other."""
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    equal = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right.withColumnsRenamed(names), reduce(and_, equal), how).drop(*names.values())


def largest_group_exceeds(df: DataFrame, keys: Sequence[str], bound: int) -> bool:
    """Whether any group holds more than `bound` rows; the table size settles most cases alone."""
    if df.count() <= bound:
        return False
    return not df.groupBy(*keys).count().filter(F.col("count") > bound).limit(1).isEmpty()


def cell_of(x: Column, low: Column, high: Column) -> Column:
    """The cell of x between low and high, in the sort order of Spark: NULL first, NaN last."""
    return (
        F.when(x.isNull(), -1).when(F.isnan(x), CELLS + 1).when(low.isNull() | (x <= low), 0).when(x >= high, CELLS)
        .otherwise(F.floor((x - low) / (high - low) * CELLS)).cast("long")
    )


def slices(df: DataFrame, keys: Sequence[str], by: Column | None = None) -> DataFrame | None:
    """Number consecutive slices of oversized groups from 0, and mark other groups as WHOLE.

    None when no group is oversized. `by` is the first column of the order (default: the event time). Its range in a
    group is divided into cells, and a cell with more rows than the bound is divided again by its own range,
    so slices hold at most twice the bound unless that many rows share one value or nearly so. The window runs over
    cells, not rows.
    """
    bound = setting(df.sparkSession, GROUP_ROWS_KEY, GROUP_ROWS_DEFAULT)
    keys = list(keys)
    if not largest_group_exceeds(df.select(*keys), keys, bound):
        return None
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")).filter(F.col("_total") > bound)
    rows = matched(
        df.withColumn("_x", (F.unix_micros("ts") if by is None else by).cast("double")),
        checked_broadcast(cut_lineage(totals)), keys, "left",
    )
    finite = F.when(~F.isnan("_x") & (F.abs("_x") < F.lit(float("inf"))), F.col("_x"))
    ends = [F.count(F.lit(1)).alias("_n"), F.min(finite).alias("_low"), F.max(finite).alias("_high")]
    cells: list[str] = []
    ranges = rows.filter("_total IS NOT NULL").groupBy(*keys).agg(*ends)
    for depth in range(REFINEMENTS):
        table = checked_broadcast(cut_lineage(ranges.drop("_n")))
        rows = matched(rows, table, [*keys, *cells], "left")
        rows = rows.withColumn(f"_c{depth}", cell_of(F.col("_x"), F.col("_low"), F.col("_high"))).drop("_low", "_high")
        cells.append(f"_c{depth}")
        held = cut_lineage(rows.filter("_total IS NOT NULL").groupBy(*keys, *cells).agg(*ends))
        ranges = held.filter((F.col("_n") > bound) & (F.col("_high") > F.col("_low")))
        if ranges.isEmpty():
            break
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(*cells)) - F.col("_n")
    starts = held.select(*keys, *cells, F.floor(before / F.lit(bound)).alias(SLICE))
    table = checked_broadcast(cut_lineage(starts))
    out = matched(rows, table, [*keys, *cells], "left")
    number = F.when(F.col("_total").isNull(), WHOLE).otherwise(F.col(SLICE)).cast("long")
    return out.withColumn(SLICE, number).drop("_x", "_total", *cells)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    back: int = 0,
    ahead: int = 0,
    order: Sequence[str] = TIME_ORDER,
    by: Column | None = None,
) -> tuple[DataFrame, WindowSpec]:
    """Rows and a window for frames reaching at most `back` rows back and `ahead` rows ahead.

    In oversized groups the neighbours of a slice are copied into it, marked by `_halo`.
    Call `settled` on the result to drop the copies.
    """
    keys, order = list(keys), list(order)
    cut = slices(df, keys, by)
    if cut is None:
        return df.withColumn(HALO, F.lit(False)), Window.partitionBy(*keys).orderBy(*order)

    rest = [c for c in cut.columns if c not in (*keys, SLICE)]
    row = F.struct(*order, *[c for c in rest if c not in order])
    per_slice = Window.partitionBy(*keys, SLICE)
    across = Window.partitionBy(*keys).orderBy(SLICE)

    def edge(depth: int, newest: bool) -> DataFrame:
        direction = [F.col(c).desc() if newest else F.col(c).asc() for c in order]
        return (
            cut.filter(F.col(SLICE) != WHOLE)
            .withColumn("_rn", F.row_number().over(per_slice.orderBy(*direction)))
            .filter(F.col("_rn") <= depth)
            .groupBy(*keys, SLICE)
            .agg(F.array_sort(F.collect_list(row)).alias("_rows"))
        )

    def halo(depth: int, newest: bool, kept: Column) -> DataFrame:
        frame = across.rowsBetween(-depth, -1) if newest else across.rowsBetween(1, depth)
        near = edge(depth, newest).withColumn("_near", F.flatten(F.collect_list("_rows").over(frame)))
        return near.select(*keys, SLICE, F.explode(kept).alias("_row"))

    halos = []
    if back:
        halos.append(halo(back, True, F.slice("_near", F.greatest(F.size("_near") - back + 1, F.lit(1)), back)))
    if ahead:
        halos.append(halo(ahead, False, F.slice("_near", 1, ahead)))
    out = cut.withColumn(HALO, F.lit(False))
    for copies in halos:
        out = out.unionByName(
            copies.select(*keys, SLICE, *[F.col("_row")[c].alias(c) for c in rest]).withColumn(HALO, F.lit(True))
        )
    return out, per_slice.orderBy(*order)


def settled(df: DataFrame) -> DataFrame:
    """Drop the copied neighbours and the slice numbers."""
    return df.filter(~F.col(HALO)).drop(HALO, SLICE)


def running(
    df: DataFrame,
    keys: Sequence[str],
    totals: dict[str, Column],
    order: Sequence[str] = TIME_ORDER,
    by: Column | None = None,
) -> DataFrame:
    """Running sums up to and including each row, over groups of any size."""
    keys, order = list(keys), list(order)
    cut = slices(df, keys, by)
    if cut is None:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(c).over(upto) for name, c in totals.items()})
    across = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, SLICE).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in totals.items()])
    carry = sums.select(
        *keys, SLICE, *[F.coalesce(F.sum(f"_s_{n}").over(across), F.lit(0)).alias(f"_c_{n}") for n in totals]
    )
    within = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = matched(cut, carry, [*keys, SLICE])
    out = joined.withColumns({n: F.col(f"_c_{n}") + F.sum(c).over(within) for n, c in totals.items()})
    return out.drop(SLICE, *[f"_c_{n}" for n in totals])


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    values: dict[str, Column],
    order: Sequence[str] = TIME_ORDER,
    inclusive: bool = False,
    forward: bool = False,
    by: Column | None = None,
) -> DataFrame:
    """As-of lookup inside a group: the nearest earlier (or later) non-null value of each expression.

    `inclusive` lets the row itself answer.
    """
    keys, order = list(keys), list(order)
    cut = slices(df, keys, by)
    end = 0 if inclusive else (1 if forward else -1)
    frame = (end, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, end)
    nearest = F.first if forward else F.last
    if cut is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)
        return df.withColumns({n: nearest(c, ignorenulls=True).over(w) for n, c in values.items()})
    at = F.struct(*order)
    edge = F.min_by if forward else F.max_by
    summary = cut.groupBy(*keys, SLICE).agg(
        *[edge(c, F.when(c.isNotNull(), at)).alias(f"_s_{n}") for n, c in values.items()]
    )
    bounds = (1, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(*bounds)
    carry = summary.select(
        *keys, SLICE, *[nearest(f"_s_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in values]
    )
    w = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(*frame)
    joined = matched(cut, carry, [*keys, SLICE])
    out = joined.withColumns(
        {n: F.coalesce(nearest(c, ignorenulls=True).over(w), F.col(f"_c_{n}")) for n, c in values.items()}
    )
    return out.drop(SLICE, *[f"_c_{n}" for n in values])


def newest(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str] = TIME_ORDER) -> DataFrame:
    """The newest `n` rows of each group, numbered from the newest.

    Spark cuts each map task's output to `n` rows per group before the shuffle (WindowGroupLimit),
    so a hot group sends at most tasks x n rows.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def attach(df: DataFrame, values: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one row of values per group to all rows of the group, over groups of any size.

    Oversized groups are dealt out to several parts by the hash of their rows, and their values are copied
    to each part. NULL is a key like any other.
    """
    keys = list(keys)
    bound = setting(df.sparkSession, GROUP_ROWS_KEY, GROUP_ROWS_DEFAULT)
    if not largest_group_exceeds(df.select(*keys), keys, bound):
        return matched(df, values, keys, how)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound)
    parts = checked_broadcast(cut_lineage(sizes.select(*keys, F.ceil(F.col("_n") / bound).alias("_parts"))))
    rest = [c for c in df.columns if c not in keys] or keys
    dealt = matched(df, parts, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*rest), F.coalesce("_parts", F.lit(1))))
    copies = matched(values, parts, keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))
    )
    return matched(dealt.drop("_parts"), copies.drop("_parts"), [*keys, "_part"], how).drop("_part")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group.

    Equal values are counted first, then the two ranks around each quantile are read off the running
    counts; no group's values are held in one aggregation buffer.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    size = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = running(counts, keys, {"_upto": F.col("_n")}, order=[value], by=F.col(value))
    picks, outputs = [], []
    for name, p in probs.items():
        rank = (F.col("_total") - 1) * F.lit(p)
        picks += [
            F.min(F.when(F.col("_upto") > F.floor(rank), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > F.ceil(rank), F.col(value))).alias(f"_hi_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outputs.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return attach(ranked, size, keys).groupBy(*keys, "_total").agg(*picks).select(*keys, *outputs)
