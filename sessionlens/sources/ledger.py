"""A privacy budget that outlives sessions: a ledger of releases, what they cost together, and noise that is drawn once.

Every release is an entry with its epsilon and delta; entries are numbered files that one writer alone can create, so two
callers cannot spend the same budget. A release is written before its numbers are shown, and asking for it again reads them
back: the same numbers, at no further cost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import exp, expm1, log, sqrt

from pyspark.sql import DataFrame, SparkSession

from sessionlens.sources import claims


class BudgetExceeded(ValueError):
    """The release would cost more than is left."""


def composed(costs: Sequence[tuple[float, float]], slack: float) -> tuple[float, float]:
    """Epsilon and delta of several releases together: the sum, or with `slack` more delta the smaller epsilon of the
    advanced composition theorem for unequal releases, if that is less."""
    epsilon, delta = sum(e for e, _ in costs), sum(d for _, d in costs)
    if slack > 0 and costs:
        square = sum(e * e for e, _ in costs)
        drift = sum(e * expm1(e) / (exp(e) + 1) for e, _ in costs)
        advanced = drift + sqrt(2 * square * log(1 / slack))
        if advanced < epsilon:
            return advanced, delta + slack
    return epsilon, delta


class Ledger:
    """The budget of one data set, below a folder that all sessions share."""

    def __init__(self, spark: SparkSession, root: str, epsilon: float, delta: float = 0.0):
        self.spark, self.root, self.epsilon, self.delta = spark, root, epsilon, delta

    def releases(self) -> list[dict]:
        return claims.entries(self.spark, f"{self.root}/ledger")

    def spent(self, more: Sequence[tuple[float, float]] = ()) -> tuple[float, float]:
        """What all releases cost together; half of the delta is kept for the composition."""
        return composed([(r["epsilon"], r["delta"]) for r in self.releases()] + list(more), self.delta / 2)

    def release(self, name: str, epsilon: float, make: Callable[[], DataFrame], delta: float = 0.0) -> DataFrame:
        """The numbers of a release: made, paid and written the first time, read back ever after.

        The cost is entered before the numbers are made, so a failure loses budget and never privacy; a release that was
        entered and not written is made at its next call, without paying twice.
        """
        if not (epsilon > 0 and delta >= 0):
            raise ValueError("a release costs more than 0")
        path = f"{self.root}/releases/{name}"

        def entry(before: list[dict]) -> dict:
            for old in before:
                if old["name"] == name:
                    if (old["epsilon"], old["delta"]) != (epsilon, delta):
                        raise ValueError(f"{name} was released at another cost")
                    raise FileExistsError(name)
            total = composed([(r["epsilon"], r["delta"]) for r in before] + [(epsilon, delta)], self.delta / 2)
            if total[0] > self.epsilon * (1 + 1e-12) or total[1] > self.delta * (1 + 1e-12):
                raise BudgetExceeded(f"{name} would bring the cost to {total}; the budget is {(self.epsilon, self.delta)}")
            return {"name": name, "epsilon": epsilon, "delta": delta}

        try:
            claims.append(self.spark, f"{self.root}/ledger", entry)
        except FileExistsError:
            pass
        if not claims.exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
