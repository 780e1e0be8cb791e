"""Documents with nulls, empty and long texts, ties, repeated rows and columns that clash with those of the operators."""

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def words(r, n, width=6):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, width))) for _ in range(n))


def odd_rows():
    r = random.Random(5)
    base = words(r, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "xx", "a", 1), (2, base, "xx", "b", 1), (3, " ".join(near), "xx", "c", 1),
        (4, base.replace(" ", "\n", 3) + "  ", "xx", None, None), (5, "", None, "a", 0), (6, None, None, None, None),
        (7, " \n\t ", "xx", "b", 4), (8, "one two", "xx", "c", 7), (9, words(r, 30_000), "xx", "a", None),
        (10, "Ünïcödé straße Ελλάδα 日本語 á  x　y <|endoftext|> z", "yy", "b", 1),
        (11, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" and text', "yy", "a", 1), (None, "null id", "yy", "a", 1),
        (None, "null id", "yy", "a", 1), (12, "same\nsame\nsame", "yy", "a", 1), (12, "same\nsame\nsame", "yy", "a", 1),
        (13, "\u0000odd\u0001 bytes\x1c here", "yy", "b", 1), (14, "x" * 5000, "yy", "c", 1),
    ]
    return rows + [(100 + i, words(r, 60) + "\nshared line of many sites\n" + words(r, 9), "zz", f"s{i}", 1) for i in range(14)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with names that the operators use."""
    out = odd
    for name in ("shard", "slot", "_id", "_key", "_row", "n_lines", "n_tokens", "score", "length", "n_words", "kept", "findings",
                 "_h", "_cell", "p_good", "ids", "lang_pred", "class"):
        out = out.withColumn(name, odd["doc_id"])
    return out
