"""Scores, levels and probability measures as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionlens.functions import patterns as P


def level(score: Column, table: str) -> Column:
    """The label of a score in one of the level tables."""
    *ranked, (lowest, _) = P.LEVELS[table]
    out = F.when(score >= ranked[0][1], ranked[0][0])
    for label, bound in ranked[1:]:
        out = out.when(score >= bound, label)
    return out.otherwise(lowest)


def typing_severity(score: Column) -> Column:
    return F.when(score > 0.8, "high").when(score > 0.5, "medium").otherwise("low")


def severity_score(severity: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in P.SEVERITY_SCORES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, F.lower(severity)), F.lit(0.5))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def squash(x: Column, lo: Column | float = 0.0, hi: Column | float = 1.0) -> Column:
    """Min-max scaling followed by a logistic curve around the middle."""
    lo = F.lit(lo) if isinstance(lo, float) else lo
    hi = F.lit(hi) if isinstance(hi, float) else hi
    top = F.when(hi <= lo, lo + F.lit(1e-6)).otherwise(hi)
    scaled = (F.greatest(lo, F.least(top, x)) - lo) / (top - lo)
    return 1.0 / (1.0 + F.exp(-6.0 * (scaled - 0.5)))


def points(*rules: tuple[Column, float], cap: float = 1.0) -> Column:
    """The sum of the points whose condition holds, at most `cap`."""
    parts = [F.when(condition, F.lit(score)).otherwise(0.0) for condition, score in rules]
    return F.least(F.lit(cap), reduce(lambda a, b: a + b, parts))


def weighted_mean(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    total = reduce(lambda a, b: a + b, [scores[name] * F.lit(weights[name]) for name in scores])
    return total / F.lit(sum(weights[name] for name in scores))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def array_mean(values: Column) -> Column:
    return array_sum(values) / F.size(values)


def array_var(values: Column) -> Column:
    """Population variance by two passes over the array."""
    return F.aggregate(
        values,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0).alias("n")),
        lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"), (a["n"] + 1).alias("n")),
        lambda a: F.greatest(F.lit(0.0), a["q"] / a["n"] - (a["s"] / a["n"]) * (a["s"] / a["n"])),
    )


def entropy(probabilities: Column) -> Column:
    return F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - p * F.ln(p + F.lit(1e-10)))


def probability_measures(probabilities: Column, classes: int) -> dict[str, Column]:
    """Confidence measures of a class distribution held as an array."""
    ranked = F.sort_array(probabilities, asc=False)
    rising = F.sort_array(probabilities)
    margin = ranked[0] - ranked[1]
    ranks = F.sequence(F.lit(1), F.lit(classes))
    weighted = F.aggregate(F.zip_with(rising, ranks, lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x)
    spread = entropy(probabilities)
    out = {
        "confidence": F.array_max(probabilities),
        "margin": margin,
        "normalized_margin": F.when(ranked[0] > 0, margin / ranked[0]).otherwise(0.0),
        "entropy": spread,
        "entropy_confidence": 1.0 - spread / F.ln(F.lit(float(classes))),
        "gini_coefficient": 2.0 * weighted / (classes * array_sum(rising)) - F.lit((classes + 1) / classes),
        "probability_variance": array_var(probabilities),
        "top_2_confidence": ranked[0] + ranked[1],
    }
    if classes >= 3:
        out["top_3_confidence"] = ranked[0] + ranked[1] + ranked[2]
    return out


def reliability(confidence: Column, aleatoric: Column, epistemic: Column | None, normalized_margin: Column) -> Column:
    bonus = F.lit(0.0) if epistemic is None else F.greatest(F.lit(0.0), 0.1 - epistemic)
    return clamp(confidence - aleatoric / F.ln(F.lit(10.0)) + bonus + normalized_margin * 0.1)
