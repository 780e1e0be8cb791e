"""Key characteristics and keyboard positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionlens.functions import patterns as P


def _position_map(of) -> Column:
    pairs = [F.lit(v) for row, keys in enumerate(P.KEYBOARD_ROWS) for col, key in enumerate(keys) for v in (key, of(row, col))]
    return F.create_map(*pairs)


def _lookup(table: Column, key: Column) -> Column:
    return F.coalesce(F.try_element_at(table, F.lower(key)), F.lit(-1))


def key_row(key: Column) -> Column:
    return _lookup(_position_map(lambda row, col: row), key)


def key_col(key: Column) -> Column:
    return _lookup(_position_map(lambda row, col: col), key)


def key_hand(key: Column) -> Column:
    return _lookup(_position_map(lambda row, col: 0 if col < 5 else 1), key)


def key_finger(key: Column) -> Column:
    return _lookup(_position_map(lambda row, col: P.COLUMN_FINGERS[col]), key)


def adjacent(a: Column, b: Column) -> Column:
    known = (key_row(a) >= 0) & (key_row(b) >= 0)
    near = (F.abs(key_row(a) - key_row(b)) <= 1) & (F.abs(key_col(a) - key_col(b)) <= 1)
    return F.coalesce(known & near, F.lit(False))


def key_traits(key: Column) -> dict[str, Column]:
    return {
        "key_length": F.length(key),
        "is_letter": key.rlike(r"^\p{L}+$"),
        "is_digit": key.rlike(r"^\d+$"),
        "is_special": ~key.rlike(r"^[\p{L}\d]+$"),
        "is_uppercase": (F.upper(key) == key) & (F.lower(key) != key),
        "is_lowercase": (F.lower(key) == key) & (F.upper(key) != key),
        "is_function_key": key.rlike(r"^f\d+$"),
        "is_special_key": key.isin(P.SPECIAL_KEYS),
    }
