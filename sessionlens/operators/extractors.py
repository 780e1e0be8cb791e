"""The caller's own parts: named feature extractors that share one scan, and a response policy given as a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.functions import patterns as P
from sessionlens.session import checked_broadcast

Extractor = Callable[[], dict[str, Column]]
Preparation = Callable[[DataFrame], DataFrame]


class Extractors:
    """Named extractors of features per group.

    An extractor gives aggregate expressions by name, and may name a preparation: a function of the rows (a window, a parsed
    column) that several extractors can share and that is applied once. All expressions go into one aggregation, so adding an
    extractor adds neither a scan nor a shuffle.
    """

    def __init__(self) -> None:
        self.extractors: dict[str, tuple[Extractor, tuple[Preparation, ...]]] = {}

    def register(self, name: str, extractor: Extractor, *preparations: Preparation, replace: bool = False) -> None:
        if name in self.extractors and not replace:
            raise ValueError(f"there is an extractor {name} already")
        self.extractors[name] = extractor, preparations

    def features(self, names: Sequence[str] | None = None) -> dict[str, Column]:
        """The expressions of the chosen extractors (default: all); two of one name are an error."""
        out: dict[str, Column] = {}
        for name in self.extractors if names is None else names:
            for feature, expression in self.extractors[name][0]().items():
                if feature in out:
                    raise ValueError(f"{name} gives {feature}, which another extractor gives too")
                out[feature] = expression
        return out

    def profile(self, df: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
        """One row per group with the features of the chosen extractors."""
        chosen = list(self.extractors if names is None else names)
        features = self.features(chosen)
        if not features:
            raise ValueError("no extractor is chosen")
        done: list[Preparation] = []
        for name in chosen:
            for step in self.extractors[name][1]:
                if step not in done:
                    df = step(df)
                    done.append(step)
        return df.groupBy(*keys).agg(*[c.alias(n) for n, c in features.items()])


def standard_extractors() -> Extractors:
    """Statistical, temporal and contextual features of an activity table."""
    out = Extractors()
    value, hour = F.col("value"), F.hour("ts")
    out.register("statistical", lambda: {
        "value_mean": F.avg(value), "value_std": F.stddev_pop(value), "value_min": F.min(value), "value_max": F.max(value)})
    out.register("temporal", lambda: {
        "events": F.count(F.lit(1)), "night_share": F.avg((hour < 6).cast("double")), "weekend_share": F.avg((F.weekday("ts") >= 5).cast("double"))})
    out.register("contextual", lambda: {"applications": F.count_distinct("app"), "devices": F.count_distinct("device")})
    return out


POLICY = "scope string, name string, actions array<string>"
"""scope: `level`, `type` or `evidence` (actions of strong findings); name: which level or type ('' for evidence)."""


def default_policy(spark) -> DataFrame:
    """The built-in policy as a table, for callers to change."""
    rows = [("level", k, v) for k, v in P.LEVEL_ACTIONS.items()] + [("type", k, v) for k, v in P.TYPE_ACTIONS.items()]
    return spark.createDataFrame([*rows, ("evidence", "", ["preserve_evidence"])], POLICY)


def overridden(policy: DataFrame, changes: DataFrame) -> DataFrame:
    """A policy with the rows of `changes` in place of those of the same scope and name; an empty list takes actions away."""
    kept = policy.join(changes.select("scope", "name"), ["scope", "name"], "left_anti")
    return kept.unionByName(changes)


def respond(findings: DataFrame, policy: DataFrame, level: str = "level", kind: str = "kind", confidence: str = "confidence", risk: str = "risk") -> DataFrame:
    """`findings` with the actions its policy gives: those of the level, of the type, and of strong findings, without repeats.

    Actions are only reported. Levels and types the policy does not name have none. Where a policy names one twice, the lists
    follow each other in their own order.
    """
    lists = policy.filter("actions IS NOT NULL").groupBy("scope", "name").agg(
        F.flatten(F.array_sort(F.collect_list("actions"))).alias("_actions"))

    def of(scope: str, name: str) -> DataFrame:
        own = lists.filter(F.col("scope") == scope)
        return checked_broadcast(own.select(F.col("name").alias(f"_{scope}"), F.col("_actions").alias(name)))

    none = F.array().cast("array<string>")
    strong = F.when((F.col(confidence) > 0.8) & (F.col(risk) >= 0.7), "")
    out = findings.withColumn("_strong", strong)
    out = out.join(of("level", "_a"), F.col(level) == F.col("_level"), "left").join(of("type", "_b"), F.col(kind) == F.col("_type"), "left")
    out = out.join(of("evidence", "_c"), F.col("_strong") == F.col("_evidence"), "left")
    actions = F.array_distinct(F.concat(*(F.coalesce(c, none) for c in ("_a", "_b", "_c"))))
    return out.select(*findings.columns, actions.alias("actions"))
