"""Input rows packed into one struct, so that columns an operator works with cannot clash with the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_row"


def packed(df: DataFrame) -> DataFrame:
    """One column, a struct of all columns."""
    return df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias(ROW))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field(name: str) -> Column:
    return F.col(ROW).getField(name)


def unpacked(df: DataFrame, columns: list[str], changed: dict[str, Column]) -> DataFrame:
    """The caller's columns, those in `changed` replaced, or added at the end where the caller has none of the name."""
    old = [changed.get(c, field(c)).alias(c) for c in columns]
    return df.select(*old, *(v.alias(c) for c, v in changed.items() if c not in columns))
