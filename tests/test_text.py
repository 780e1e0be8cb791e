"""Literal cases of the text rules; expected values follow the rules, not taste."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sessionlens.functions import text
from sessionlens.functions.keys import adjacent, key_finger, key_row
from sessionlens.functions.levels import level


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t STRING").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "kind"),
    [
        ("ann.lee@mail.org", "email"), ("see http://a.b/c", "url"), ("id 321-54-9876 end", "ssn"),
        ("5500 0000 0000 0004", "credit_card"), ("call 222.333.4444", "phone"), ("open D:\\data\\x.csv", "file_path"),
        ("import os", "code"), ("two plain words", "text"), (" \t ", "empty"),
        ("12", "numeric"), ("word", "single_word"), ("a\nb\nc\nd e", "multiline_text"),
        # classes are those of Unicode, and a line end is no digit
        ("١٢٣٤", "numeric"), ("१२", "numeric"), ("12\n", "single_word"), ("\u00a0\u00a0", "empty"), ("x\u00a0y", "text"),
        ("\u3000\u2003", "empty"),
    ],
)
def test_content_type(spark, value, kind):
    assert one(spark, value, text.content_type) == kind


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("new passwd set", True), ("a TOKEN", True), ("pk_9f8e7d", True), ("ann.lee@mail.org", True),
        ("5500 0000 0000 0004", True), ("nothing to see", False), ("-----BEGIN X", True), ("٣٢١-٥٤-٩٨٧٦", True),
        ("१२३४ १२३४ १२३४ १२३४", True),
    ],
)
def test_sensitive_clipboard(spark, value, expected):
    assert one(spark, value, text.sensitive_clipboard) is expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("pwd changed", True), ("the Secret", True), ("spinning", True), ("321-54-9876", True), ("٣٢١-٥٤-٩٨٧٦", True),
        ("plain words", False), ("ann.lee@mail.org", False),
    ],
)
def test_sensitive_typed(spark, value, expected):
    assert one(spark, value, text.sensitive_typed) is expected


@pytest.mark.parametrize(
    ("title", "shown"),
    [
        ("My SECRET plan", "My [REDACTED] plan"), ("room 4321 free", "room [REDACTED] free"),
        ("ann@мир.рф writes", "ann[REDACTED] writes"), ("ROOM ٤٣٢١", "ROOM [REDACTED]"),
        ("at http://a.b/c now", "at [URL] now"), ("notes", "notes"),
    ],
)
def test_title(spark, title, shown):
    assert one(spark, title, text.redact_title) == shown


@pytest.mark.parametrize("number", ["222-333-4444", "٢٢٢-٣٣٣-٤٤٤٤", "२२२-३३३-४४४४", "２２２-３３３-４４４４"])
def test_phone_numbers_of_any_script_are_redacted(spark, number):
    out = text.redact_pii(spark.createDataFrame([(f"tel {number} ok",)], "t STRING"), "t", "r").first().r
    assert number not in out and out.startswith("tel [PHONE_")
    assert "phone" in one(spark, f"tel {number} ok", text.content_tags)


def test_redaction_replaces_each_match_by_its_hash(spark):
    df = spark.createDataFrame([("mail a@b.org or a@b.org, call 555-123-4567",)], "t STRING")
    out = text.redact_pii(df, "t", "r").first().r
    mail, phone = (hashlib.sha256(v.encode()).hexdigest()[:8] for v in ("a@b.org", "555-123-4567"))
    assert out == f"mail [EMAIL_{mail}] or [EMAIL_{mail}], call [PHONE_{phone}]"


def test_mask_is_at_most_twenty(spark):
    assert one(spark, "x" * 25, lambda t: text.sanitize(t, "mask")) == "*" * 20


def test_tags(spark):
    tags = one(spark, "SHOUT at 10:30 to a@b.org", text.content_tags)
    assert tags == ["email", "time", "contains_numbers"]
    assert one(spark, "ABCDEFG", text.content_tags) == ["caps_lock"]
    assert one(spark, "привет мир", text.content_tags) == ["cyrillic"]


def test_null_text_gives_null_flags(spark):
    assert one(spark, None, text.sensitive_typed) is None
    assert one(spark, None, text.content_type) == "empty"


def test_keyboard(spark):
    assert one(spark, "G", key_row) == 1
    assert one(spark, "p", key_finger) == 9
    assert one(spark, "1", key_row) == -1
    pairs = spark.createDataFrame([("q", "a"), ("q", "p"), ("1", "q")], "a STRING, b STRING")
    assert [r.x for r in pairs.select(adjacent(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False]


def test_levels(spark):
    scores = spark.createDataFrame([(0.95,), (0.7,), (0.1,)], "s DOUBLE")
    assert [r.x for r in scores.select(level(F.col("s"), "risk").alias("x")).collect()] == ["critical", "high", "minimal"]


def test_no_condition_hides_a_match(spark):
    """What spares a text the pattern holds wherever the pattern does, for all letters that have a case like ASCII ones."""
    from sessionlens.functions import patterns as P

    letters = sorted({c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000} - set("\ufeff"))
    rows = spark.createDataFrame([(c,) for c in letters], "c STRING").select(F.repeat("c", 40).alias("t"))
    assert rows.filter(F.col("t").rlike(text.UNICODE_CASE + P.LONG_KEY) & ~text.may_match(F.col("t"), P.LONG_KEY)).count() == 0
    assert rows.filter(F.col("t").rlike(text.UNICODE_CASE + P.LONG_KEY)).count() == 4  # the dotted and the dotless i, long s, Kelvin
    for value in ("k" * 32, "é" + "k" * 32, "-" + "k" * 33 + "-", "a b " + "K1" * 16):
        assert one(spark, value, lambda t: text.found(t, P.LONG_KEY, ignore_case=True))
    for value in ("functıon  x", "claſſ a", "İMPORT y", "defa", "DEF é", "CLASS\t1", "import"):
        for pattern in P.CONTENT_TYPES["code"]:
            hit = one(spark, value, lambda t: t.rlike(text.UNICODE_CASE + pattern))
            assert one(spark, value, lambda t: text.matches_any(t, [pattern])) == hit
            assert one(spark, value, lambda t: text.matches_any(t, [pattern], F.lower(t))) == hit
        assert one(spark, value, lambda t: text.matches_any(t, P.CONTENT_TYPES["code"])) == (value not in ("defa", "import"))


@pytest.mark.parametrize("value", ["a  ", "  a", " a b ", "\x1c", "\u00a0a\u3000", "a\x1fb", None, ""])
def test_form_of_the_text_without_rewriting_it(spark, value):
    plain = "".join(" " if c.isspace() else c for c in value or "").split()
    assert one(spark, value, text.content_type) == {0: "empty", 1: "single_word"}.get(len(plain), "text")
    plan = spark.range(1).select(text.content_type(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan and "split(" not in plan
