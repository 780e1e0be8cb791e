"""Risk with feedback: a score is raised when it stands out from the mean of the last final scores.

The final scores depend on earlier final scores, so the exact result looks sequential. But each row has
only two possible results, with and without the raise, and the raise is settled as soon as it is the
same under the lowest and the highest possible scores before it. Starting from both bounds, a few passes
of plain windows settle almost all rows. Later rounds take up only the rows still open and the rows their
mean reads. Each pass settles at least the first open row of every group, so the rounds end, and no group
has to pass through one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.levels import clamp, squash
from sessionlens.operators.sequence import framed, running, settled
from sessionlens.operators.windows import GROUP, before, last, size_of
from sessionlens.session import cut_lineage

HISTORY = 10


def is_open() -> Column:
    """Whether the bounds of a row still differ."""
    return F.col("_lo") < F.col("_hi")


def settle(state: DataFrame, base: str, passes: int) -> DataFrame:
    """Tighten the bounds of the open rows; a row whose last scores are not all at hand stays open."""
    rows, w = framed(state, GROUP, back=HISTORY * passes)
    past = before(w, HISTORY)
    for _ in range(passes):
        known = is_open() & (size_of(past) == HISTORY)
        rows = rows.withColumns(
            {
                "_up": known & (F.col(base) > 1.5 * F.avg("_hi").over(past)),
                "_down": known & (F.col(base) <= 1.5 * F.avg("_lo").over(past)),
            }
        ).withColumns(
            {
                "_lo": F.when(F.col("_up"), F.col("_raised")).otherwise(F.col("_lo")),
                "_hi": F.when(F.col("_down"), F.col("_plain")).otherwise(F.col("_hi")),
            }
        )
    return cut_lineage(settled(rows).drop("_up", "_down"))


def risk_with_feedback(
    df: DataFrame, base: str = "base", kind: str = "kind", cold_start: int = 250, same_kind: int = 15,
    decay: float = 0.95, passes: int = 4,
) -> DataFrame:
    """Final risk per event; `base` is the score before adjustments."""
    numbered = running(df, GROUP, {"_i": F.lit(1).cast("long")})
    rows, w = framed(numbered, GROUP, back=20)
    kinds = F.collect_list(kind).over(last(w, 20))
    often = F.size(F.filter(F.col("_kinds"), lambda k: k == F.col(kind))) > same_kind
    rows = settled(rows.withColumn("_kinds", kinds)).withColumn("_often", often).drop("_kinds")

    def final(boost: float) -> Column:
        adjusted = clamp(F.col(base) * boost * F.when(F.col("_often"), 1.1).otherwise(1.0) * decay)
        return squash(F.when(F.col("_i") <= cold_start, F.least(adjusted, F.lit(0.4))).otherwise(adjusted))

    plain, raised = final(1.0), final(1.2)
    can_raise = F.col("_i") > HISTORY + 1
    state = rows.withColumns({"_plain": plain, "_raised": raised}).withColumns(
        {"_lo": F.col("_plain"), "_hi": F.when(can_raise, F.col("_raised")).otherwise(F.col("_plain"))}
    )
    state = settle(state, base, passes)
    results = [state.filter(~is_open())]
    while True:
        rows, w = framed(state, GROUP, ahead=HISTORY)
        needed = F.max(is_open()).over(w.rowsBetween(0, HISTORY))
        part = cut_lineage(settled(rows.withColumn("_needed", needed)).filter("_needed").withColumn("_was", is_open()))
        if part.isEmpty():
            break
        state = settle(part.drop("_needed"), base, 2 * passes)
        results.append(state.filter(F.col("_was") & ~is_open()).drop("_was"))
        state = state.drop("_was")
    whole = reduce(DataFrame.unionByName, results)
    return whole.withColumn("risk", F.col("_lo")).drop("_i", "_often", "_plain", "_raised", "_lo", "_hi")
