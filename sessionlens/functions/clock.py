"""Time predicates and scores as column expressions."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(us: Column | str) -> Column:
    """Microseconds to seconds as a double."""
    return (F.col(us) if isinstance(us, str) else us) / F.lit(1e6)


def weekday(ts: str = "ts") -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def is_weekend(ts: str = "ts") -> Column:
    return weekday(ts) >= 5


def hour_between(ts: str, first: int, last: int) -> Column:
    return F.hour(ts).between(first, last)


def after_hours(ts: str = "ts", first: int = 8, last: int = 18) -> Column:
    """Outside the hours first..last; both borders count as working hours."""
    return ~hour_between(ts, first, last)


def hour_risk(hour: Column) -> Column:
    return (
        F.when(hour.between(2, 6), 0.9).when((hour <= 8) | (hour >= 20), 0.7).when(hour.between(9, 17), 0.1).otherwise(0.5)
    )


def day_risk(day: Column) -> Column:
    return F.when(day >= 5, 0.8).otherwise(0.2)


def parse_period(text: str) -> timedelta:
    """'24h', '7d' or '30m' as a time span."""
    found = re.fullmatch(r"\s*(\d+)\s*([dhm])\s*", text)
    if not found:
        raise ValueError(f"period must look like 24h, 7d or 30m: {text!r}")
    unit = {"d": "days", "h": "hours", "m": "minutes"}[found.group(2)]
    return timedelta(**{unit: int(found.group(1))})


def age_label(age: Column) -> Column:
    """Seconds since the last activity as a short label."""
    whole = F.floor(F.greatest(age, F.lit(0.0)))
    return (
        F.when(age.isNull(), "N/A")
        .when(age < 5, "just now")
        .when(age < 60, F.concat(whole.cast("string"), F.lit("s ago")))
        .when(age < 3600, F.concat(F.floor(whole / 60).cast("string"), F.lit("m ago")))
        .otherwise(
            F.concat(
                F.floor(whole / 3600).cast("string"), F.lit("h "),
                F.floor((whole % 3600) / 60).cast("string"), F.lit("m ago"),
            )
        )
    )
