"""Text predicates, redaction and cleaning as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.functions import patterns as P


# Classes of the patterns (digits, words, white space, word borders) are those of Unicode.
UNICODE, UNICODE_CASE = "(?U)", "(?iU)"
BLANK, NO_BLANK = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"

# What a match of a pattern must hold; testing for it first spares most texts the pattern.
DIGITS_3 = UNICODE + r"\d{3}"
MUST_CONTAIN = {
    P.EMAIL: "@", P.LOG_URL: "://", P.PLAIN_URL: "://", P.WINDOWS_PATH: ":\\", P.CLOCK_TIME: ":",
    P.TYPED_WINDOWS_PATH: ":\\", P.TYPED_UNIX_PATH: "/", P.SK_KEY: "-", P.PK_KEY: "_",
}
MUST_MATCH = {
    P.LOG_PHONE: DIGITS_3, P.LOG_CARD: DIGITS_3, P.LOG_SSN: DIGITS_3, P.CARD_GROUPS: DIGITS_3, P.SSN_DASHED: DIGITS_3,
    P.PHONE_GROUPS: DIGITS_3, P.PHONE_PLAIN: DIGITS_3, P.DOTTED_NUMBERS: UNICODE + r"\d\.\d", P.LONG_KEY: r"(?<!\S)\S{32}",
}

# The words of the code patterns, and the letters beyond ASCII that a pattern without case takes for one of i, s and k.
CODE_WORDS, FOLDED = {e: e.split("\\")[0] for e in P.CONTENT_TYPES["code"]}, "ıİſ\u212a"


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether the lower-cased text contains one of the words."""
    lowered = F.lower(text)
    return any_of(lowered.contains(w) for w in words)


def may_match(text: Column, expression: str) -> Column:
    """A cheap condition without which the pattern cannot match."""
    if expression in MUST_CONTAIN:
        return text.contains(MUST_CONTAIN[expression])
    if expression in MUST_MATCH:
        return text.rlike(MUST_MATCH[expression])
    return F.lit(True)


def found(text: Column, expression: str, ignore_case: bool = False, lowered: Column | None = None) -> Column:
    if ignore_case and re.fullmatch("[a-z]+", expression):
        return (F.lower(text) if lowered is None else lowered).contains(expression)
    if lowered is not None and expression in CODE_WORDS:
        holds_word = lowered.contains(CODE_WORDS[expression]) | any_of(text.contains(c) for c in FOLDED)
        return holds_word & text.rlike((UNICODE_CASE if ignore_case else UNICODE) + expression)
    return may_match(text, expression) & text.rlike((UNICODE_CASE if ignore_case else UNICODE) + expression)


def matches_any(text: Column, expressions: Iterable[str], lowered: Column | None = None) -> Column:
    """Whether one of the patterns matches. Give a column of the lower-cased text to have it made once for all words."""
    return any_of(found(text, e, ignore_case=True, lowered=lowered) for e in expressions)


def keyword_flags(names: Iterable[str] | None = None) -> dict[str, Column]:
    """Indicator columns over the `app` and `content` columns."""
    return {
        name: contains_any(F.col(column), words)
        for name, (column, words) in P.KEYWORD_INDICATORS.items()
        if names is None or name in names
    }


# --- sensitive content -------------------------------------------------------------------------------


def sensitive_clipboard(text: Column) -> Column:
    kinds = [e for t in P.SENSITIVE_TYPES for e in P.CONTENT_TYPES[t]]
    return matches_any(text, kinds) | any_of(text.contains(m) for m in P.KEY_MARKERS)


def sensitive_typed(text: Column) -> Column:
    return contains_any(text, P.TYPED_SENSITIVE) | found(text, P.CARD_GROUPS) | found(text, P.SSN_DASHED)


def sensitive_data(text: Column, with_email: bool = True) -> Column:
    kinds = [P.SSN_DASHED, P.CARD_GROUPS, P.PASSWORD_PAIR, P.API_KEY_PAIR]
    return matches_any(text, kinds + [P.EMAIL] if with_email else kinds)


def has_credentials(text: Column) -> Column:
    return contains_any(text, P.CREDENTIAL_WORDS)


def has_file_path(text: Column) -> Column:
    return text.rlike(f"{UNICODE}(?:{P.ANY_WINDOWS_PATH})|(?:{P.ANY_UNIX_PATH})")


def has_url(text: Column) -> Column:
    return found(text, P.PLAIN_URL, ignore_case=True)


def content_type(text: Column, lowered: Column | None = None) -> Column:
    """The first typed pattern group that matches, else the form of the text."""
    out = F.when(F.coalesce(~text.rlike(UNICODE + NO_BLANK), F.lit(True)), "empty")
    for name, expressions in P.CONTENT_TYPES.items():
        out = out.when(matches_any(text, expressions, lowered), name)
    second_word = text.rlike(f"{UNICODE}{NO_BLANK}{BLANK}++{NO_BLANK}")
    return (
        out.when(text.rlike(UNICODE + r"\A\d+\z"), "numeric")
        .when(F.regexp_count(text, F.lit("\n")) >= 3, "multiline_text")
        .when(~second_word, "single_word")
        .when(text.rlike("^(http://|https://|ftp://)"), "url")
        .when(text.rlike(r"^(/|C:\\|D:\\)"), "file_path")
        .otherwise("text")
    )


# --- redaction -----------------------------------------------------------------------------------------


def _hash_tag(name: str):
    """A fold step that replaces one match by `[NAME_<hash>]`."""

    def replace(text: Column, match: Column) -> Column:
        tag = F.concat(F.lit(f"[{name}_"), F.substring(F.sha2(match, 256), 1, 8), F.lit("]"))
        return F.replace(text, match, tag)

    return replace


def redact_pii(df: DataFrame, column: str, into: str) -> DataFrame:
    """Replace each email, phone, card and SSN match by a short hash tag, in that order.

    Each step is its own projection, so a long text is scanned once per pattern.
    """
    out = df.withColumn(into, F.col(column))
    for name, expression in P.REDACTED_PATTERNS.items():
        hits = F.array_distinct(F.regexp_extract_all(F.col(into), F.lit(UNICODE + expression), F.lit(0)))
        tagged = F.when(may_match(F.col(into), expression), F.aggregate(hits, F.col(into), _hash_tag(name)))
        out = out.withColumn(into, tagged.otherwise(F.col(into)))
    return out


def short_digest(text: Column) -> Column:
    """The first 16 characters of the base64 SHA-256."""
    return F.substring(F.base64(F.unhex(F.sha2(text, 256))), 1, 16)


def sanitize(text: Column, method: str) -> Column:
    """Replace a whole sensitive text by a marker."""
    if method == "hash":
        return F.concat(F.lit("[SENSITIVE_DATA_HASH:"), short_digest(text), F.lit("]"))
    if method == "mask":
        return F.repeat(F.lit("*"), F.least(F.length(text), F.lit(20)))
    if method == "remove":
        return F.lit("[SENSITIVE_DATA_REMOVED]")
    return F.lit("[SENSITIVE_DATA_DETECTED]")


def disclosure(
    text: Column, kind: Column, sensitive: Column, max_length: int = 500, keep_hash: bool = False,
    length_only: bool = False,
) -> Column:
    """What may be shown of a copied text."""
    n = F.length(text).cast("string")
    label = F.upper(kind)
    if keep_hash:
        hidden = F.concat(
            F.lit("[SENSITIVE_"), label, F.lit("_HASH:"), F.substring(F.sha2(text, 256), 1, 16), F.lit("] Length: "), n
        )
    else:
        hidden = F.concat(F.lit("[SENSITIVE_"), label, F.lit("_DETECTED] Length: "), n)
    head = F.concat(F.lit("Content copied ("), kind)
    if length_only:
        return F.when(sensitive, hidden).otherwise(F.concat(head, F.lit("): "), n, F.lit(" characters")))
    return (
        F.when(sensitive, hidden)
        .when(
            F.length(text) > max_length,
            F.concat(head, F.lit("): "), F.substring(text, 1, max_length), F.lit("...[truncated]")),
        )
        .when(F.length(text) <= 200, F.concat(head, F.lit("): "), text))
        .otherwise(F.concat(head, F.lit(", "), n, F.lit(" chars): "), F.substring(text, 1, 100), F.lit("...[preview]")))
    )


def redact_title(title: Column) -> Column:
    out = title
    for expression in P.TITLE_SECRETS:
        out = F.regexp_replace(out, UNICODE_CASE + expression, "[REDACTED]")
    out = F.regexp_replace(out, P.TITLE_PATH, "[FILE_PATH]")
    return F.regexp_replace(out, UNICODE + P.PLAIN_URL, "[URL]")


# --- cleaning --------------------------------------------------------------------------------------------


def clean(text: Column, max_length: int = 1000) -> Column:
    """Drop control characters, collapse white space, trim, and cap the length."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    flat = F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
    return F.when(F.length(flat) > max_length, F.concat(F.substring(flat, 1, max_length), F.lit("..."))).otherwise(flat)


def key_symbols(text: Column) -> Column:
    out = text
    for name, symbol in P.KEY_SYMBOLS.items():
        out = F.replace(out, F.lit(name), F.lit(symbol))
    return out


def click_label(text: Column) -> Column:
    spot = r"\((\d+), (\d+)\)"
    at = F.concat(
        F.lit("Click at ("), F.regexp_extract(text, spot, 1), F.lit(", "), F.regexp_extract(text, spot, 2), F.lit(")")
    )
    return F.when(text.rlike(spot), at).otherwise(text)


def clipboard_preview(text: Column, cap: int = 100) -> Column:
    n = F.length(text)
    return F.when(
        n > cap, F.concat(F.substring(text, 1, cap), F.lit("... ("), n.cast("string"), F.lit(" chars total)"))
    ).otherwise(text)


def content_tags(text: Column) -> Column:
    """Tags of the patterns found, then of form and script, in a fixed order."""
    kinds = [F.when(found(text, e), name) for name, e in P.TAG_PATTERNS.items()]
    script = (
        F.when(text.rlike("[а-яёА-ЯЁ]"), "cyrillic")
        .when(text.rlike("[一-龯]"), "chinese")
        .when(text.rlike("[ひらがなカタカナ]"), "japanese")
    )
    shouted = (F.upper(text) == text) & (F.lower(text) != text) & (F.length(text) > 5)
    form = [
        F.when(F.length(text) > 50, "long_content"),
        F.when(shouted, "caps_lock"),
        F.when(text.rlike(UNICODE + r"\d") & (F.length(text) > 3), "contains_numbers"),
        script,
    ]
    return F.filter(F.array(*kinds, *form), lambda t: t.isNotNull())


def words(text: Column, min_length: int = 2) -> Column:
    every = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(every, lambda w: F.length(w) >= min_length)


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a blank text."""
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def digit_share(text: Column) -> Column:
    return F.regexp_count(text, F.lit(UNICODE + r"\d")) / F.greatest(F.length(text), F.lit(1))
