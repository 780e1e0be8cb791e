r"""Quality filtering by weak supervision.

Ten rules look at a document and vote good, bad or abstain. A latent-class model takes the votes as noisy readings of the
true quality: expectation-maximisation estimates how often each rule votes bad on good and on bad documents, from the
number of documents per pattern of votes (3^10 patterns at most, whatever the table's size; documents that fail the base
conditions need no verdict and are left out). The posterior probability of being good decides, instead of all rules
having to pass.

Everything per document is a column expression. Words are `[^\x20\x09-\x0D]+`. Repeated three-word windows are found by
sorting (hash, position) numbers; equal neighbours are compared word by word, and a text in which two different windows
share a hash is sorted by the words themselves.

The rules look at different facts, so no fault is counted twice, and three of them see one kind of junk independently, which
expectation-maximisation needs to tell reliable rules from unreliable ones. The two rules on the form of words abstain
where fewer than a quarter of the characters are Latin letters.

Defined cases: null text counts as empty: no words, base_failed, not kept; rules abstain where they have nothing to look at;
repeated rows count as often as they occur; an empty table gives an empty result; input columns with the names of
new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.catalog import documents, query
from sessionlens.llm.rows import field, packed, unpacked
from sessionlens.session import scratch_path, spread

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?"
#: Words that prose of the larger Latin-script languages cannot do without (a parameter of one rule, fixed).
FUNCTION_WORDS = """the of and to in is that was for with are this on as at by
    de la le les des et en un une est que el los y por con una der die das und den von zu mit ist ein eine nicht""".split()
ALONE = (r"(?<![^\x20\x09-\x0D])", r"(?![^\x20\x09-\x0D])")
CLEAN_WORD = ALONE[0] + r"[\p{L}\p{M}'\u2019\-]++[.,;:!?]?+" + ALONE[1]
"""Letters with at most one mark behind them."""
COMMON_WORD = ALONE[0] + "(?i:" + "|".join(FUNCTION_WORDS) + ")" + ALONE[1]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5
EM_STEPS = 60
GOOD_SHARE = 0.8
PRIOR = 0.02
START = {True: 0.01, False: 0.3}
"""Share of bad votes among a rule's votes on good and on bad documents."""

#: name -> (numerator, denominator, bad below, good from, good to, bad above); between them a rule abstains.
#: Each rule looks at a numerator of its own, and can vote bad on documents that pass the base conditions.
RULES = {
    "word_length": ("word_chars", "n_words", 2.5, 3.5, 8, 10),
    "few_symbols": ("n_symbols", "n_words", None, None, 0.05, 0.2),
    "clean_words": ("n_clean_words", "n_latin_words", 0.6, 0.8, None, None),
    "common_words": ("n_common_words", "n_latin_words", 0.02, 0.06, None, None),
    "few_capitals": ("n_capitals", "word_chars", None, None, 0.1, 0.3),
    "few_marks": ("n_marks", "n_words", None, None, 0.4, 0.75),
    "many_words": ("n_distinct_words", "root_words", 2, 3, None, None),
    "few_copied_lines": ("n_dup_lines", "n_lines", None, None, 0.2, 0.4),
    "few_repeats": ("n_repeat_words", "n_words", None, None, 0.2, 0.4),
    "sentence_ends": ("n_ended_lines", "n_lines", 0.1, 0.5, None, None),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` bound to a name, so that it is computed once."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeat_words(words: Column) -> Column:
    """The number of words that lie in three-word windows found twice or more."""
    low = (1 << 32) - 1

    def number(w: Column, i: Column) -> Column:
        return F.shiftleft(F.hash(w[i], w[i + 1], w[i + 2]).cast("long"), 32).bitwiseOR(i.cast("long"))

    def place(s: Column, k: Column) -> Column:
        return s[k].bitwiseAND(F.lit(low)).cast("int")

    def differ(w: Column, a: Column, b: Column) -> Column:
        return (w[a] != w[b]) | (w[a + 1] != w[b + 1]) | (w[a + 2] != w[b + 2])

    def by_hash(w: Column, s: Column) -> Column:
        equal = lambda k: F.shiftright(s[k], 32) == F.shiftright(s[k - 1], 32)

        def counted(hits: Column) -> Column:
            clash = F.exists(hits, lambda k: differ(w, place(s, k), place(s, k - 1)))
            return F.when(F.size(hits) == 0, 0).when(clash, by_words(w)).otherwise(F.size(covered(hits, lambda k: place(s, k))))

        return let(F.filter(F.sequence(F.lit(1), F.size(s) - 1), equal), counted)

    def covered(hits: Column, start: Callable[[Column], Column]) -> Column:
        places = F.array_distinct(F.flatten(F.transform(hits, lambda k: F.array(start(k - 1), start(k)))))
        return F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2))))

    def by_words(w: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("at")))

        def counted(t: Column) -> Column:
            equal = lambda k: ((t[k]["a"] == t[k - 1]["a"]) & (t[k]["b"] == t[k - 1]["b"])
                               & (t[k]["c"] == t[k - 1]["c"]))
            hits = F.filter(F.sequence(F.lit(1), F.size(t) - 1), equal)
            return F.size(covered(hits, lambda k: t[k]["at"]))

        return let(F.array_sort(rows), counted)

    def windows(w: Column) -> Column:
        numbers = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: number(w, i))
        return F.when(F.size(w) < 4, 0).otherwise(let(F.sort_array(numbers), lambda s: by_hash(w, s)))

    return let(words, windows)


def base_columns(text: Column) -> dict[str, Column]:
    """The counts that the rules look at."""
    whole = F.coalesce(text, F.lit(""))
    body = F.btrim(whole, F.lit(BLANKS))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    ended = F.filter(lines, lambda x: F.right(F.rtrim(x), F.lit(1)).isin(".", "!", "?", '"', ":", ";", ")"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(without(whole, BLANKS)).cast("long"),
        "n_symbols": (F.length(whole) - F.length(without(whole, SYMBOLS))).cast("long"),
        "n_latin_words": F.when(4 * F.regexp_count(whole, F.lit(r"\p{IsLatin}")) >= F.length(without(whole, BLANKS)),
                                F.size(words).cast("long")),
        "n_clean_words": F.regexp_count(whole, F.lit(CLEAN_WORD)).cast("long"),
        "n_common_words": F.regexp_count(whole, F.lit(COMMON_WORD)).cast("long"),
        "n_capitals": F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("long"),
        "n_marks": (F.length(whole) - F.length(without(whole, MARKS))).cast("long"),
        "n_distinct_words": F.size(F.array_distinct(words)).cast("long"),
        "root_words": F.sqrt(F.size(words)),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_ended_lines": F.size(ended).cast("long"),
        "n_repeat_words": repeat_words(words).cast("long"),
    }


def vote(name: str) -> Column:
    """1 good, -1 bad, 0 abstains."""
    top, bottom, bad_below, good_from, good_to, bad_above = RULES[name]
    value = F.col(top) if bottom is None else F.try_divide(F.col(top), F.col(bottom))
    bad, good = F.lit(False), F.lit(True)
    if bad_below is not None:
        bad = bad | (value < bad_below)
    if bad_above is not None:
        bad = bad | (value > bad_above)
    if good_from is not None:
        good = good & (value >= good_from)
    if good_to is not None:
        good = good & (value <= good_to)
    return F.when(bad, -1).when(good, 1).otherwise(0)


class LabelModel:
    """Two latent classes with independent votes: the class's share, and per rule how often its votes are bad in each.

    An abstention says nothing. The start says that rules seldom call a good document bad, and that a bad one fails few
    of them; it also weighs in at each step like `PRIOR` of the documents. No rule may come out worse than chance: if its
    votes were bad more often among good documents, both classes share the rate, and the rule carries no weight.
    """

    def __init__(self, rules: list[str], patterns: dict[tuple[int, ...], int], steps: int = EM_STEPS):
        self.rules = rules
        self.good = GOOD_SHARE
        self.bad_rate = [dict(START) for _ in rules]
        total = sum(patterns.values())
        trust = PRIOR * total + 1
        for _ in range(steps if total else 0):
            share = {p: self.posterior(p) for p in patterns}
            self.good = (sum(share[p] * n for p, n in patterns.items()) + trust * GOOD_SHARE) / (total + trust)
            for j, rate in enumerate(self.bad_rate):
                bad, cast = {}, {}
                for y in (True, False):
                    held = {v: sum((share[p] if y else 1 - share[p]) * n for p, n in patterns.items() if p[j] == v)
                            for v in (-1, 1)}
                    bad[y], cast[y] = held[-1] + trust * START[y], held[-1] + held[1] + trust
                    rate[y] = bad[y] / cast[y]
                if rate[True] > rate[False]:
                    rate[True] = rate[False] = (bad[True] + bad[False]) / (cast[True] + cast[False])

    def posterior(self, pattern: tuple[int, ...]) -> float:
        """Probability that a document with these votes is good."""
        x = log(self.good / (1 - self.good)) + sum(self.weight(j, v) for j, v in enumerate(pattern))
        return 1 / (1 + exp(-max(-500.0, min(500.0, x))))

    def weight(self, j: int, v: int) -> float:
        good, bad = self.bad_rate[j][True], self.bad_rate[j][False]
        return {-1: log(good / bad), 0: 0.0, 1: log((1 - good) / (1 - bad))}[v]

    def column(self) -> Column:
        """The posterior as an expression of the vote columns, which are named like the rules."""
        x = F.lit(log(self.good / (1 - self.good)))
        for j, name in enumerate(self.rules):
            x = x + F.when(F.col(name) == -1, self.weight(j, -1)).when(F.col(name) == 1, self.weight(j, 1)).otherwise(0.0)
        return 1 / (1 + F.exp(-x))


def quality(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`carry` columns of `df` (all but the text) with the counts, votes, `p_good`, `base_failed` and `kept`."""
    spark = df.sparkSession
    carry = [c for c in (carry or df.columns) if c != text]
    counts = base_columns(field(text))
    path = scratch_path(spark, "quality-counts")
    # counted once, then read for the model and for the verdicts
    packed(spread(df)).select(F.struct(*(field(c).alias(c) for c in carry)).alias("_row"),
                      *(v.alias(c) for c, v in counts.items())).write.parquet(path)
    voted = spark.read.parquet(path).withColumns({name: vote(name) for name in RULES})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    names = list(RULES)
    judged = voted.filter(~failed).groupBy(*names).count()
    model = LabelModel(names, {tuple(r[n] for n in names): r["count"] for r in judged.collect()})  # 3^10 rows at most
    return unpacked(voted, carry, {
        **{c: F.col(c) for c in counts}, **{name: F.col(name) for name in names},
        "p_good": model.column(), "base_failed": failed, "kept": ~failed & (model.column() >= KEEP_FROM)})


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts and the verdict of the label model."""
    return quality(documents(spark, sf_dir, "doc_id", "text"))
