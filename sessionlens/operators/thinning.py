"""Greedy thinning: keep a row only when enough time has passed since the last row kept.

Which rows stay depends on all rows before, so a window function cannot say it. Two facts split the work:
a row that follows its predecessor by at least the gap is always kept, so such rows cut a group into
independent runs; and for a piece of a run, all that matters from before it is the time up to which it
is blocked, so each piece can be summarised on its own as a step function from the blocking time before
it to the blocking time after it. The summaries are chained, then each piece is marked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.operators.sequence import SLICE, framed, largest_group_exceeds, running, settled, slices
from sessionlens.session import GROUP_ROWS_DEFAULT, GROUP_ROWS_KEY, cut_lineage, setting

FREE = -(2**62)


def keep_from(times: np.ndarray, gap: int, blocked: int) -> np.ndarray:
    """Positions kept in a sorted piece when rows before `blocked` are suppressed."""
    kept, at = [], int(np.searchsorted(times, blocked))
    while at < len(times):
        kept.append(at)
        at = int(np.searchsorted(times, times[at] + gap))
    return np.array(kept, dtype=np.int64)


def step_function(times: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(upto, leaves): a piece entered with blocking time <= upto[i] is left with blocking time leaves[i]."""
    after = np.searchsorted(times, times + gap)
    leaves = times + gap
    for i in range(len(times) - 1, -1, -1):
        if after[i] < len(times):
            leaves[i] = leaves[after[i]]
    last = np.append(leaves[1:] != leaves[:-1], True)
    return times[last], leaves[last]


def chain(pieces: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """The blocking time at the start of each piece, from their step functions in order."""
    blocked, out = FREE, []
    for number, upto, leaves in pieces:
        out.append((number, blocked))
        at = int(np.searchsorted(upto, blocked))
        if at < len(upto):
            blocked = int(leaves[at])
    return out


def thin_sorted(df: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Thin whole groups in one pass over sorted partitions; only the last blocking time is held."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, blocked = None, FREE
        for batch in batches:
            times = batch["us"].to_numpy()
            starts = batch[keys].ne(batch[keys].shift()).any(axis=1).to_numpy().nonzero()[0]
            keep = []
            for start, end in zip(starts, np.append(starts[1:], len(batch))):
                key = tuple(batch[k].iloc[start] for k in keys)
                if key != current:
                    current, blocked = key, FREE
                part = times[start:end]
                kept = keep_from(part, gap_us, blocked)
                if len(kept):
                    blocked = int(part[kept[-1]]) + gap_us
                    keep.append(kept + start)
            if keep:
                yield batch.iloc[np.concatenate(keep)]

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, "us", "event_id")
    return ordered.mapInPandas(fold, df.schema)


def thin(df: DataFrame, keys: Sequence[str], gap_us: int) -> DataFrame:
    """The kept rows as (keys, event_id, us), in the order of (ts, event_id)."""
    keys = list(keys)
    rows = df.select(*keys, "event_id", "ts", "us")
    kept_schema = df.select(*keys, "event_id", "us").schema

    bound = setting(df.sparkSession, GROUP_ROWS_KEY, GROUP_ROWS_DEFAULT)
    if not largest_group_exceeds(rows.select(*keys), keys, bound):
        return thin_sorted(rows.drop("ts"), keys, gap_us).select(*kept_schema.names)

    placed, w = framed(rows, keys, back=1)
    free = F.coalesce(F.col("us") - F.lag("us").over(w) >= gap_us, F.lit(True))
    runs = running(settled(placed.withColumn("_free", free.cast("long"))), keys, {"_run": F.col("_free")})
    group = [*keys, "_run"]
    cut = slices(runs, group)
    if cut is None:
        return thin_sorted(runs.select(*group, "event_id", "us"), group, gap_us).select(*kept_schema.names)

    pieces = cut_lineage(cut.select(*group, SLICE, "event_id", "us"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*group, SLICE).schema)

    def summarise(piece: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(piece["us"].to_numpy())
        upto, leaves = step_function(times, gap_us)
        head = piece[[*group, SLICE]].iloc[[0]]
        return head.loc[head.index.repeat(len(upto))].assign(upto=upto, leaves=leaves)

    steps = pieces.groupBy(*group, SLICE).applyInPandas(summarise, f"{fields}, upto long, leaves long")

    def enter(group_steps: pd.DataFrame) -> pd.DataFrame:
        ordered = [
            (number, part["upto"].to_numpy(), part["leaves"].to_numpy())
            for number, part in group_steps.sort_values([SLICE, "upto"]).groupby(SLICE, sort=True)
        ]
        found = pd.DataFrame(chain(ordered), columns=[SLICE, "blocked"])
        head = group_steps[group].iloc[[0]]
        return pd.concat([head.loc[head.index.repeat(len(found))].reset_index(drop=True), found], axis=1)

    entries = steps.groupBy(*group).applyInPandas(enter, f"{fields}, blocked long")

    def mark(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values(["us", "event_id"])
        kept = keep_from(piece["us"].to_numpy(), gap_us, int(piece["blocked"].iloc[0]))
        return piece.iloc[kept][[*keys, "event_id", "us"]]

    return pieces.join(entries, [*group, SLICE]).groupBy(*group, SLICE).applyInPandas(mark, kept_schema)
