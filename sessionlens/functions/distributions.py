"""Distribution functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Lanczos coefficients for g = 7 and nine terms.
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
TINY = 1e-300


def ln_gamma(x: Column) -> Column:
    """The logarithm of the gamma function, for x > 0."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (z + i)
    t = z + 7.5
    return F.lit(0.9189385332046727) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def _fraction(a: Column, b: Column, x: Column, terms: int) -> Column:
    """The continued fraction of the incomplete beta function, front to back with numerator and denominator ratios."""

    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < TINY, TINY).otherwise(v)

    def factor(state: Column, weight: Column) -> Column:
        c = safe(1 + weight / state["c"])
        d = 1 / safe(1 + weight * state["d"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    def both(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return factor(factor(state, even), odd)

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda m: m.cast("double"))
    return F.aggregate(steps, start, both, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column, terms: int = 300) -> Column:
    """The regularised incomplete beta function I_x(a, b), for a, b > 0 and x from 0 to 1."""
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    low = front * _fraction(a, b, x, terms) / a
    high = 1 - front * _fraction(b, a, 1 - x, terms) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def student_p(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of a t statistic; NULL and NaN stay NULL."""
    square = t * t
    tail = incomplete_beta(freedom / 2, F.lit(0.5), freedom / (freedom + square))
    return F.when(t.isNotNull() & ~F.isnan(t) & (freedom > 0), tail)
