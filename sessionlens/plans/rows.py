"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlens.functions import clock, keys, levels, text
from sessionlens.functions import patterns as P
from sessionlens.operators import filters
from sessionlens.operators.sequence import framed, settled
from sessionlens.plans.catalog import query
from sessionlens.plans.tables import ACT, activity, read, texts

SPACE = r"[\s\x0b\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# The Unicode classes of the patterns, spelled out for the oracle's pattern engine.
CLASSES = {
    "d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{N}\p{Pc}",
    "s": r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}",
}


def uni(pattern: str) -> str:
    """A pattern with Unicode classes in place of the short ones; word borders stay those of the engine."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            name, i = pattern[i + 1], i + 1
            body = CLASSES.get(name.lower()) if name != "D" else None
            if body is None:
                out.append("\\" + name)
            elif name.isupper():
                out.append(f"[^{body}]")
            else:
                out.append(body if inside else f"[{body}]")
        else:
            if c in "[]":
                inside = c == "["
            out.append(c)
        i += 1
    return "".join(out)


def any_of(column: str, patterns, flag: str = "i") -> str:
    alternation = "|".join(f"(?:{uni(p)})" for p in patterns)
    return f"regexp_matches({column}, {quoted(alternation)}, '{flag}')"


def contains_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {quoted(w)})" for w in words) + ")"


@query(
    "time_range",
    "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'",
)
def time_range(spark, sf):
    events = read(spark, sf, "events")
    return filters.time_range(events, "2024-01-05", "2024-01-20 12:00:00").select("event_id", "user_id")


@query(
    "log_search",
    ACT + " SELECT event_id FROM act WHERE contains(lower(kind), 'o') AND contains(lower(app), 'exe') "
    "AND contains(lower(content), 'a')",
)
def log_search(spark, sf):
    return filters.search(activity(spark, sf), kind="O", app="EXE", content="a").select("event_id")


@query(
    "exclude_apps",
    ACT + " SELECT event_id, app FROM act WHERE NOT (contains(lower(app), 'chrome') OR contains(lower(app), 'admin'))",
)
def exclude_apps(spark, sf):
    return filters.exclude_apps(activity(spark, sf), ["Chrome", "Admin"]).select("event_id", "app")


@query(
    "canonical_type",
    ACT + " SELECT event_id, CASE WHEN kind = 'usb' THEN 'Device' ELSE kind END AS kind FROM act",
)
def canonical_type(spark, sf):
    labels = {kind: label for label, kind in P.LABEL_KINDS.items()}
    label = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in labels.items()], F.lit("Device"))
    raw = activity(spark, sf).select("event_id", label.alias("label"))
    return raw.select("event_id", filters.canonical_kind(F.col("label")).alias("kind"))


@query(
    "temporal_flags",
    """SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, isodow(ts) >= 6 AS is_weekend,
  hour(ts) BETWEEN 9 AND 17 AS is_business_hours, hour(ts) < 8 OR hour(ts) > 18 AS after_hours,
  hour(ts) < 9 OR hour(ts) > 17 AS off_hours FROM events""",
)
def temporal_flags(spark, sf):
    return activity(spark, sf).select(
        "event_id",
        F.hour("ts").alias("hour"),
        clock.weekday().alias("day_of_week"),
        clock.is_weekend().alias("is_weekend"),
        clock.hour_between("ts", 9, 17).alias("is_business_hours"),
        clock.after_hours().alias("after_hours"),
        clock.after_hours(first=9, last=17).alias("off_hours"),
    )


@query(
    "hour_day_risk",
    """SELECT event_id, CASE WHEN hour(ts) BETWEEN 2 AND 6 THEN 0.9 WHEN hour(ts) <= 8 OR hour(ts) >= 20 THEN 0.7
  WHEN hour(ts) BETWEEN 9 AND 17 THEN 0.1 ELSE 0.5 END::DOUBLE AS hour_risk,
  CASE WHEN isodow(ts) >= 6 THEN 0.8 ELSE 0.2 END::DOUBLE AS day_risk FROM events""",
)
def hour_day_risk(spark, sf):
    return activity(spark, sf).select(
        "event_id",
        clock.hour_risk(F.hour("ts")).alias("hour_risk"),
        clock.day_risk(clock.weekday()).alias("day_risk"),
    )


@query(
    "keyword_flags",
    ACT + "SELECT user_id, "
    + ", ".join(
        f"count(*) FILTER (WHERE {contains_sql(c, ws)}) AS {n}" for n, (c, ws) in P.KEYWORD_INDICATORS.items()
    )
    + " FROM act GROUP BY user_id",
)
def keyword_flags(spark, sf):
    """All indicators, counted per user."""
    flags = text.keyword_flags()
    flagged = activity(spark, sf).select("user_id", *[c.alias(n) for n, c in flags.items()])
    return flagged.groupBy("user_id").agg(*[F.count_if(n).alias(n) for n in flags])


CONTENT_WORDS = {n: ws for n, (column, ws) in P.KEYWORD_INDICATORS.items() if column == "content"}


@query(
    "keyword_flags_text",
    "SELECT source, " + ", ".join(f"count(*) FILTER (WHERE {contains_sql('text', ws)}) AS {n}" for n, ws in CONTENT_WORDS.items())
    + " FROM documents GROUP BY source",
)
def keyword_flags_text(spark, sf):
    """The content indicators over whole documents, counted per source."""
    flags = text.keyword_flags(CONTENT_WORDS)
    rows = texts(spark, sf).select("source", F.col("text").alias("content"))
    flagged = rows.select("source", *[c.alias(n) for n, c in flags.items()])
    return flagged.groupBy("source").agg(*[F.count_if(n).alias(n) for n in flags])


_CLIP = any_of("text", [e for t in P.SENSITIVE_TYPES for e in P.CONTENT_TYPES[t]])
_MARK = "(" + " OR ".join(f"contains(text, {quoted(m)})" for m in P.KEY_MARKERS) + ")"


@query(
    "sensitive_flags",
    f"""SELECT doc_id, {_CLIP} OR {_MARK} AS clipboard_sensitive,
  {contains_sql('text', P.TYPED_SENSITIVE)} OR regexp_matches(text, {quoted(uni(P.CARD_GROUPS))})
    OR regexp_matches(text, {quoted(uni(P.SSN_DASHED))}) AS typed_sensitive,
  {any_of('text', [P.SSN_DASHED, P.CARD_GROUPS, P.PASSWORD_PAIR, P.API_KEY_PAIR, P.EMAIL])} AS sensitive_data,
  {contains_sql('text', P.CREDENTIAL_WORDS)} AS has_credentials,
  {any_of('text', [P.ANY_WINDOWS_PATH, P.ANY_UNIX_PATH], 'c')} AS has_file_path,
  {any_of('text', [P.PLAIN_URL])} AS has_url FROM documents""",
)
def sensitive_flags(spark, sf):
    t = F.col("text")
    return texts(spark, sf).select(
        "doc_id",
        text.sensitive_clipboard(t).alias("clipboard_sensitive"),
        text.sensitive_typed(t).alias("typed_sensitive"),
        text.sensitive_data(t).alias("sensitive_data"),
        text.has_credentials(t).alias("has_credentials"),
        text.has_file_path(t).alias("has_file_path"),
        text.has_url(t).alias("has_url"),
    )


SSN_LOOSE = r"\b\d{3}[-.]?\d{2}[-.]?\d{4}\b"


def ssn_matches(column: str) -> str:
    """SSN matches without look-ahead, which the oracle's pattern engine lacks."""
    digits = "regexp_replace(m, '[-.]', '', 'g')"
    return f"""list_filter(regexp_extract_all({column}, {quoted(uni(SSN_LOOSE))}), lambda m:
      substr({digits}, 1, 3) NOT IN ('000', '666') AND substr({digits}, 1, 1) <> '9'
      AND substr({digits}, 4, 2) <> '00' AND substr({digits}, 6, 4) <> '0000')"""


def _redact_sql() -> str:
    steps, source = [], "documents"
    for i, (name, pattern) in enumerate(P.REDACTED_PATTERNS.items()):
        column = "text" if i == 0 else "t"
        found = ssn_matches(column) if name == "SSN" else f"regexp_extract_all({column}, {quoted(uni(pattern))})"
        fold = (
            f"list_reduce(list_prepend({column}, {found}), "
            f"lambda acc, m: replace(acc, m, '[{name}_' || substr(sha256(m), 1, 8) || ']'))"
        )
        steps.append(f"s{i} AS (SELECT doc_id, {fold} AS t FROM {source})")
        source = f"s{i}"
    return "WITH " + ", ".join(steps) + f" SELECT doc_id, t AS redacted FROM {source}"


@query("redact_pii", _redact_sql())
def redact_pii(spark, sf):
    return text.redact_pii(texts(spark, sf), "text", "redacted").select("doc_id", "redacted")


@query(
    "sanitize_text",
    """SELECT doc_id, '[SENSITIVE_DATA_HASH:' || substr(to_base64(unhex(sha256(text))), 1, 16) || ']' AS hashed,
  repeat('*', least(length(text), 20)) AS masked, '[SENSITIVE_DATA_REMOVED]' AS removed,
  '[SENSITIVE_DATA_DETECTED]' AS marked FROM documents""",
)
def sanitize_text(spark, sf):
    t = F.col("text")
    return texts(spark, sf).select(
        "doc_id",
        text.sanitize(t, "hash").alias("hashed"),
        text.sanitize(t, "mask").alias("masked"),
        text.sanitize(t, "remove").alias("removed"),
        text.sanitize(t, "").alias("marked"),
    )


def type_sql(column: str) -> str:
    blank = f"trim(regexp_replace(coalesce({column}, ''), '[{CLASSES['s']}]', ' ', 'g')) = ''"
    groups = " ".join(f"WHEN {any_of(column, ps)} THEN '{n}'" for n, ps in P.CONTENT_TYPES.items())
    word = f"len(string_split(trim(regexp_replace({column}, '[{CLASSES['s']}]+', ' ', 'g')), ' ')) = 1"
    return f"""CASE WHEN {blank} THEN 'empty' {groups} WHEN regexp_full_match({column}, '\\p{{Nd}}+') THEN 'numeric'
      WHEN length({column}) - length(replace({column}, chr(10), '')) >= 3 THEN 'multiline_text'
      WHEN {word} THEN 'single_word' WHEN regexp_matches({column}, '^(http://|https://|ftp://)') THEN 'url'
      WHEN regexp_matches({column}, '^(/|C:\\\\|D:\\\\)') THEN 'file_path' ELSE 'text' END"""


@query("content_type", f"SELECT doc_id, {type_sql('text')} AS content_type FROM documents")
def content_type(spark, sf):
    rows = texts(spark, sf).withColumn("lowered", F.lower("text"))
    return rows.select("doc_id", text.content_type(F.col("text"), F.col("lowered")).alias("content_type"))


@query(
    "content_disclosure",
    f"""WITH d AS (SELECT doc_id, text, {type_sql('text')} AS kind, {_CLIP} OR {_MARK} AS sensitive FROM documents)
SELECT doc_id, CASE WHEN sensitive THEN '[SENSITIVE_' || upper(kind) || '_DETECTED] Length: ' || length(text)
    WHEN length(text) > 500 THEN 'Content copied (' || kind || '): ' || substr(text, 1, 500) || '...[truncated]'
    WHEN length(text) <= 200 THEN 'Content copied (' || kind || '): ' || text
    ELSE 'Content copied (' || kind || ', ' || length(text) || ' chars): ' || substr(text, 1, 100) || '...[preview]' END AS shown,
  CASE WHEN sensitive THEN '[SENSITIVE_' || upper(kind) || '_HASH:' || substr(sha256(text), 1, 16) || '] Length: ' || length(text)
    ELSE 'Content copied (' || kind || '): ' || length(text) || ' characters' END AS short_form
FROM d""",
)
def content_disclosure(spark, sf):
    t = F.col("text")
    typed = texts(spark, sf).withColumn("lowered", F.lower("text")).select(
        "doc_id", "text", text.content_type(t, F.col("lowered")).alias("kind"), text.sensitive_clipboard(t).alias("sensitive")
    )
    kind, sensitive = F.col("kind"), F.col("sensitive")
    return typed.select(
        "doc_id",
        text.disclosure(t, kind, sensitive).alias("shown"),
        text.disclosure(t, kind, sensitive, keep_hash=True, length_only=True).alias("short_form"),
    )


def _title_sql() -> str:
    out = "text"
    for p in P.TITLE_SECRETS:
        out = f"regexp_replace({out}, {quoted(uni(p))}, '[REDACTED]', 'gi')"
    out = f"regexp_replace({out}, {quoted(P.TITLE_PATH)}, '[FILE_PATH]', 'g')"
    return f"regexp_replace({out}, {quoted(uni(P.PLAIN_URL))}, '[URL]', 'g')"


@query("redact_title", f"SELECT doc_id, md5({_title_sql()}) AS title_md5, length({_title_sql()}) AS title_length FROM documents")
def redact_title(spark, sf):
    titles = texts(spark, sf).select("doc_id", text.redact_title(F.col("text")).alias("title"))
    return titles.select("doc_id", F.md5("title").alias("title_md5"), F.length("title").alias("title_length"))


_FLAT = f"trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{7f}}-\\x{{9f}}]', '', 'g'), '{SPACE}', ' ', 'g'))"


@query(
    "clean_content",
    f"""WITH d AS (SELECT doc_id, {_FLAT} AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 1000 THEN substr(t, 1, 1000) || '...' ELSE t END AS cleaned FROM d""",
)
def clean_content(spark, sf):
    return texts(spark, sf).select("doc_id", text.clean(F.col("text")).alias("cleaned"))


def _symbols_sql(column: str) -> str:
    for name, symbol in P.KEY_SYMBOLS.items():
        column = f"replace({column}, '{name}', '{symbol}')"
    return column


@query(
    "key_symbols",
    ACT + f""", named AS (SELECT *, key || ({list(P.KEY_SYMBOLS)})[k % 8 + 1] AS pressed,
  'Mouse at (' || x || ', ' || y || ') ' || action AS spot, repeat(content || ' ', k % 12 + 1) AS copied FROM act)
SELECT event_id, {_symbols_sql('pressed')} AS symbols, 'Click at (' || x || ', ' || y || ')' AS click,
  CASE WHEN length(copied) > 100 THEN substr(copied, 1, 100) || '... (' || length(copied) || ' chars total)' ELSE copied END AS copied
FROM named""",
)
def key_symbols(spark, sf):
    k = F.col("k")
    names = F.array(*[F.lit(n) for n in P.KEY_SYMBOLS])
    raw = activity(spark, sf).select(
        "event_id",
        F.concat("key", F.element_at(names, k % 8 + 1)).alias("pressed"),
        F.concat(F.lit("Mouse at ("), "x", F.lit(", "), "y", F.lit(") "), "action").alias("spot"),
        F.repeat(F.concat("content", F.lit(" ")), k % 12 + 1).alias("copied"),
    )
    return raw.select(
        "event_id",
        text.key_symbols(F.col("pressed")).alias("symbols"),
        text.click_label(F.col("spot")).alias("click"),
        text.clipboard_preview(F.col("copied")).alias("copied"),
    )


def tags_sql(column: str = "text") -> str:
    found = [
        f"CASE WHEN len({ssn_matches(column)}) > 0 THEN 'ssn' END" if n == "ssn"
        else f"CASE WHEN regexp_matches({column}, {quoted(uni(p))}) THEN '{n}' END"
        for n, p in P.TAG_PATTERNS.items()
    ]
    form = [
        f"CASE WHEN length({column}) > 50 THEN 'long_content' END",
        f"CASE WHEN upper({column}) = {column} AND lower({column}) <> {column} AND length({column}) > 5 THEN 'caps_lock' END",
        f"CASE WHEN regexp_matches({column}, '\\p{{Nd}}') AND length({column}) > 3 THEN 'contains_numbers' END",
        f"CASE WHEN regexp_matches({column}, '[а-яёА-ЯЁ]') THEN 'cyrillic' WHEN regexp_matches({column}, '[一-龯]') THEN 'chinese'"
        f" WHEN regexp_matches({column}, '[ひらがなカタカナ]') THEN 'japanese' END",
    ]
    return f"list_filter([{', '.join(found + form)}], lambda t: t IS NOT NULL)"


@query("content_tags", f"SELECT doc_id, array_to_string({tags_sql()}, ',') AS tags FROM documents")
def content_tags(spark, sf):
    return texts(spark, sf).select("doc_id", F.array_join(text.content_tags(F.col("text")), ",").alias("tags"))


@query(
    "clipboard_features",
    """SELECT doc_id, length(text) AS length, len(regexp_extract_all(text, '\\S+')) AS words,
  length(text) - length(replace(text, chr(10), '')) AS lines, contains(lower(text), 'http') AS has_url,
  contains(text, '@') AND contains(text, '.') AS has_email,
  round(len(regexp_extract_all(text, '\\d')) / greatest(length(text), 1), 6) AS numeric_ratio FROM documents""",
)
def clipboard_features(spark, sf):
    t = F.col("text")
    return texts(spark, sf).select(
        "doc_id",
        F.length(t).alias("length"),
        text.word_count(t).alias("words"),
        F.regexp_count(t, F.lit("\n")).alias("lines"),
        F.lower(t).contains("http").alias("has_url"),
        (t.contains("@") & t.contains(".")).alias("has_email"),
        F.round(text.digit_share(t), 6).alias("numeric_ratio"),
    )


@query(
    "window_features",
    ACT + f"""SELECT event_id, length(app) AS app_name_length, length(content) AS window_title_length,
  {contains_sql('app', P.BROWSERS)} AS is_browser, {contains_sql('app', P.OFFICE_APPS)} AS is_office,
  {contains_sql('app', P.DEV_APPS)} AS is_dev_tool FROM act WHERE kind = 'window'""",
)
def window_features(spark, sf):
    app = F.col("app")
    return activity(spark, sf).filter("kind = 'window'").select(
        "event_id",
        F.length(app).alias("app_name_length"),
        F.length("content").alias("window_title_length"),
        text.contains_any(app, P.BROWSERS).alias("is_browser"),
        text.contains_any(app, P.OFFICE_APPS).alias("is_office"),
        text.contains_any(app, P.DEV_APPS).alias("is_dev_tool"),
    )


LAYOUT_SQL = "layout AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{key}', {row}, {col}, {0 if col < 5 else 1}, {P.COLUMN_FINGERS[col]})"
    for row, line in enumerate(P.KEYBOARD_ROWS)
    for col, key in enumerate(line)
) + ") AS t(name, key_row, key_col, key_hand, key_finger))"

PRESSED = "CASE WHEN k % 17 = 0 THEN 'f' || (k % 12 + 1) WHEN k % 13 = 0 THEN 'shift' WHEN k % 5 = 0 THEN CAST(k % 10 AS VARCHAR) WHEN k % 7 = 0 THEN upper(key) ELSE key END"


@query(
    "key_features",
    ACT + f""", {LAYOUT_SQL}, p AS (SELECT event_id, {PRESSED} AS pressed FROM act WHERE kind = 'keyboard')
SELECT event_id, length(pressed) AS key_length, regexp_full_match(pressed, '\\p{{L}}+') AS is_letter,
  regexp_full_match(pressed, '\\d+') AS is_digit, NOT regexp_full_match(pressed, '[\\p{{L}}\\d]+') AS is_special,
  upper(pressed) = pressed AND lower(pressed) <> pressed AS is_uppercase,
  lower(pressed) = pressed AND upper(pressed) <> pressed AS is_lowercase,
  regexp_full_match(pressed, 'f\\d+') AS is_function_key,
  pressed IN ('shift', 'ctrl', 'alt', 'tab', 'enter', 'backspace') AS is_special_key,
  coalesce(key_row, -1) AS key_row, coalesce(key_col, -1) AS key_col, coalesce(key_hand, -1) AS key_hand,
  coalesce(key_finger, -1) AS key_finger
FROM p LEFT JOIN layout ON layout.name = lower(pressed)""",
)
def key_features(spark, sf):
    pressed = activity(spark, sf).filter("kind = 'keyboard'").select("event_id", F.expr(PRESSED.replace("VARCHAR", "STRING")).alias("pressed"))
    key = F.col("pressed")
    return pressed.select(
        "event_id",
        *[c.alias(n) for n, c in keys.key_traits(key).items()],
        keys.key_row(key).alias("key_row"),
        keys.key_col(key).alias("key_col"),
        keys.key_hand(key).alias("key_hand"),
        keys.key_finger(key).alias("key_finger"),
    )


@query(
    "key_adjacent",
    ACT + f""", {LAYOUT_SQL}, p AS (SELECT event_id, key, lag(key) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev
  FROM act WHERE kind = 'keyboard')
SELECT event_id, coalesce(key = prev, false) AS same_key,
  coalesce(abs(a.key_row - b.key_row) <= 1 AND abs(a.key_col - b.key_col) <= 1, false) AS adjacent
FROM p LEFT JOIN layout a ON a.name = key LEFT JOIN layout b ON b.name = prev""",
)
def key_adjacent(spark, sf):
    typed = activity(spark, sf).filter("kind = 'keyboard'").select("user_id", "event_id", "ts", "key")
    rows, w = framed(typed, ["user_id"], back=1)
    paired = settled(rows.withColumn("prev", F.lag("key").over(w)))
    return paired.select(
        "event_id",
        F.coalesce(F.col("key") == F.col("prev"), F.lit(False)).alias("same_key"),
        keys.adjacent(F.col("prev"), F.col("key")).alias("adjacent"),
    )


SAMPLES = "value, value * 0.5, value + k, k * 1.0"


@query(
    "pressure_features",
    ACT + f""", s AS (SELECT event_id, [{SAMPLES}]::DOUBLE[] AS samples FROM act)
SELECT event_id, round(list_avg(samples), 6) AS pressure_mean, round(list_stddev_pop(samples), 6) AS pressure_std,
  round(list_max(samples), 6) AS pressure_max, round(list_min(samples), 6) AS pressure_min FROM s""",
)
def pressure_features(spark, sf):
    rows = activity(spark, sf).select("event_id", F.expr(f"array({SAMPLES.replace('0.5', '0.5D').replace('1.0', '1.0D')})").alias("samples"))
    s = F.col("samples")
    return rows.select(
        "event_id",
        F.round(levels.array_mean(s), 6).alias("pressure_mean"),
        F.round(F.sqrt(levels.array_var(s)), 6).alias("pressure_std"),
        F.round(F.array_max(s), 6).alias("pressure_max"),
        F.round(F.array_min(s), 6).alias("pressure_min"),
    )


def quadrant(x: str = "x", y: str = "y", width: int = 1920, height: int = 1080):
    return F.when(F.col(y) < height // 2, 0).otherwise(2) + F.when(F.col(x) < width // 2, 0).otherwise(1)


def near_edge(x: str = "x", y: str = "y", width: int = 1920, height: int = 1080, margin: int = 50):
    return ~(F.col(x).between(margin, width - margin) & F.col(y).between(margin, height - margin))


@query(
    "screen_zone",
    ACT + """SELECT event_id, (CASE WHEN y < 540 THEN 0 ELSE 1 END) * 2 + (CASE WHEN x < 960 THEN 0 ELSE 1 END) AS quadrant,
  x < 50 OR x > 1870 OR y < 50 OR y > 1030 AS near_edge FROM act""",
)
def screen_zone(spark, sf):
    return activity(spark, sf).select("event_id", quadrant().alias("quadrant"), near_edge().alias("near_edge"))


@query(
    "coarsen_xy",
    ACT + "SELECT event_id, CAST(floor(x / 10) * 10 AS BIGINT) AS cx, CAST(floor(y / 10) * 10 AS BIGINT) AS cy, 0 AS off_x FROM act",
)
def coarsen_xy(spark, sf):
    def coarse(column: str, precision: int = 10, shown: bool = True):
        return F.floor(F.col(column) / precision) * precision if shown else F.lit(0)

    return activity(spark, sf).select(
        "event_id", coarse("x").alias("cx"), coarse("y").alias("cy"), coarse("x", shown=False).alias("off_x")
    )


def level_sql(score: str, table: str) -> str:
    whens = " ".join(f"WHEN {score} >= {b} THEN '{n}'" for n, b in P.LEVELS[table] if b is not None)
    return f"CASE {whens} ELSE '{P.LEVELS[table][-1][0]}' END"


SCORE = "least(value / 120, 1.0)"


@query(
    "score_levels",
    f"WITH s AS (SELECT event_id, {SCORE} AS score FROM events) SELECT event_id, "
    + ", ".join(f"{level_sql('score', t)} AS {t}_level" for t in P.LEVELS)
    + f""", CASE WHEN score > 0.8 THEN 'high' WHEN score > 0.5 THEN 'medium' ELSE 'low' END AS typing_severity,
  CASE {level_sql('score', 'severity')} WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 ELSE 0.2 END::DOUBLE
    AS severity_score FROM s""",
)
def score_levels(spark, sf):
    scored = read(spark, sf, "events").select("event_id", F.expr(SCORE.replace("1.0", "1.0D")).alias("score"))
    score = F.col("score")
    return scored.select(
        "event_id",
        *[levels.level(score, t).alias(f"{t}_level") for t in P.LEVELS],
        levels.typing_severity(score).alias("typing_severity"),
        levels.severity_score(levels.level(score, "severity")).alias("severity_score"),
    )


@query(
    "threshold_filter",
    ACT + f"""SELECT event_id, {SCORE} > 0.7 AS insider, {SCORE} > 0.8 AS risk, k % 10 = 0 AS unverified, k > 95 AS behavioural
FROM act WHERE {SCORE} > 0.7 OR {SCORE} > 0.8 OR (kind = 'keyboard' AND k % 10 = 0) OR k > 95""",
)
def threshold_filter(spark, sf):
    rows = activity(spark, sf).withColumn("score", F.expr(SCORE.replace("1.0", "1.0D")))
    insider, risk = F.col("score") > 0.7, F.col("score") > 0.8
    unverified, behavioural = F.col("k") % 10 == 0, F.col("k") > 95
    hit = insider | risk | ((F.col("kind") == "keyboard") & unverified) | behavioural
    return rows.filter(hit).select(
        "event_id", insider.alias("insider"), risk.alias("risk"), unverified.alias("unverified"), behavioural.alias("behavioural")
    )


@query(
    "metric_alerts",
    ACT + """, m AS (SELECT event_id, k * 1.0 AS cpu, (k * 7 % 100) * 1.0 AS memory, (k * 3 % 100) * 1.0 AS disk, value AS process_mb FROM act),
  long AS (SELECT event_id, 'cpu' AS metric, cpu::DOUBLE AS metric_value, 80.0::DOUBLE AS threshold FROM m
    UNION ALL SELECT event_id, 'memory', memory, 85.0 FROM m UNION ALL SELECT event_id, 'disk', disk, 90.0 FROM m
    UNION ALL SELECT event_id, 'process_mb', process_mb, 100.0 FROM m)
SELECT * FROM long WHERE metric_value > threshold""",
)
def metric_alerts(spark, sf):
    k = F.col("k")
    metrics = activity(spark, sf).select(
        "event_id",
        k.cast("double").alias("cpu"),
        (k * 7 % 100).cast("double").alias("memory"),
        (k * 3 % 100).cast("double").alias("disk"),
        F.col("value").alias("process_mb"),
    )
    return filters.metric_alerts(metrics, ["event_id"], P.METRIC_LIMITS)


@query(
    "min_sample_gate",
    "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 70)",
)
def min_sample_gate(spark, sf):
    return filters.min_samples(read(spark, sf, "events").select("event_id", "user_id"), ["user_id"], 70)


@query(
    "period_cutoff",
    "\nUNION ALL ".join(
        f"SELECT '{p}' AS period, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {i}"
        for p, i in {"24h": "24 HOUR", "7d": "7 DAY", "90m": "90 MINUTE"}.items()
    ),
)
def period_cutoff(spark, sf):
    rows = activity(spark, sf)
    as_of = rows.agg(F.max("ts")).scalar()
    counts = [
        filters.within(rows, p, as_of).agg(F.lit(p).alias("period"), F.count(F.lit(1)).alias("n")) for p in ("24h", "7d", "90m")
    ]
    return counts[0].union(counts[1]).union(counts[2])


@query(
    "holiday_flag",
    "SELECT event_id, CAST(ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-15') AS is_holiday FROM events",
)
def holiday_flag(spark, sf):
    calendar = spark.createDataFrame([("2024-01-01",), ("2024-01-15",)], "d STRING").select(F.to_date("d").alias("day"))
    return filters.with_holidays(activity(spark, sf), calendar).select("event_id", "is_holiday")


@query(
    "safe_history",
    f"""WITH d AS (SELECT conv_id, turn, text, {type_sql('text')} AS kind FROM conversations)
SELECT conv_id, turn, kind, length(text) AS length, sha256(text) AS content_hash,
  CASE WHEN length(text) <= 100 AND kind NOT IN ('password', 'api_key') THEN
    substr(text, 1, 50) || CASE WHEN length(text) > 50 THEN '...' ELSE '' END END AS preview FROM d""",
)
def safe_history(spark, sf):
    t = F.col("text")
    rows = texts(spark, sf, "conversations").withColumn("lowered", F.lower("text"))
    typed = rows.withColumn("kind", text.content_type(t, F.col("lowered")))
    shown = (F.length(t) <= 100) & ~F.col("kind").isin("password", "api_key")
    preview = F.concat(F.substring(t, 1, 50), F.when(F.length(t) > 50, "...").otherwise(""))
    return typed.select(
        "conv_id", "turn", "kind", F.length(t).alias("length"), F.sha2(t, 256).alias("content_hash"),
        F.when(shown, preview).alias("preview"),
    )
