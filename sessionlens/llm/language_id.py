"""Language identification by cross-parsing entropy.

For each language one suffix automaton is built over a bounded sample of labelled text (`CHARS_PER_LANGUAGE` letters). A text is
parsed greedily against every automaton: the longest match from the current place is a phrase, then the next begins. The
cost of a language is its phrases times log2 of its sample's length, per letter; the language of least cost wins. The score
is the share by which the best cost stays below the second (1 where only one language was learned).

Letters are lower-cased, each run of other characters is one gap. Parsing is vectorised: many texts take one step
at a time through the automata's transition tables, in which a missing transition already leads to the state after a new
phrase has begun. Texts are parsed in segments of `SEGMENT` letters, so a very long text is no chain of as many steps. Every letter of
the samples has a code: the `ALPHABET` most frequent ones have columns in the tables, the transitions of all others are
looked up in one sorted list.

Learned languages are the non-null labels. Their number of distinct texts is estimated over the table; sampled texts are
those with the lowest hashes, copies counting once. Defined cases: null text, and text without letters, gives `und` with score 0; ties go to the
alphabetically first language; without labelled rows every text is `und`; an empty table gives an empty result;
input columns with the names of new ones are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.catalog import documents, query
from sessionlens.llm.vocab import chunks
from sessionlens.session import spread

CHARS_PER_LANGUAGE = 24_000
ROWS_PER_LANGUAGE = 120
PIECE = 400
"""At most this many letters of one sampled row are learned, so that no row fills a language's sample."""

SEGMENT = 2048
ALPHABET = 62
GAP, OTHER = 0, 1
UNKNOWN = "und"


def letters(text: str) -> str:
    """Lower-case letters, with one blank for each run of other characters."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Automaton:
    """Suffix automaton of a sequence of codes as a dense table: state x code -> state, -1 where there is none.

    Transitions by codes from `size` on are in `rare`, as (state, code, state).
    """

    def __init__(self, codes: list[int], size: int):
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(dict(step[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.table = np.full((len(step), size), -1, np.int32)
        self.rare = [(s, c, to) for s, edges in enumerate(step) for c, to in edges.items() if c >= size]
        for s, edges in enumerate(step):
            near = {c: to for c, to in edges.items() if c < size}
            self.table[s, list(near.keys())] = list(near.values())


class Model:
    """The automata of all languages in one table of signed states; a negative entry means that a phrase ended there.

    Entry of state s and code c: the state after c if s has a transition; else minus the state that a new phrase begins
    with: the root's transition, or for a letter that the sample lacks a state in which every phrase has ended. States
    count from 1.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(x for x in samples if letters(samples[x]))
        seen = Counter(c for x in self.languages for c in letters(samples[x]) if c != " ")
        ranked = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        alphabet = [*sorted(ranked[:ALPHABET]), *ranked[ALPHABET:]]
        self.code = {c: i + 2 for i, c in enumerate(alphabet)} | {" ": GAP}
        self.size, self.all = min(ALPHABET, len(alphabet)) + 2, len(alphabet) + 2
        edges, self.begun = [], np.zeros((len(self.languages), self.all - self.size), np.int32)
        self.weights, tables, self.roots, base = [], [], [], 1
        for k, x in enumerate(self.languages):
            text = letters(samples[x])
            automaton = Automaton([self.code[c] for c in text], self.size)
            table = automaton.table
            lone = base + len(table)
            self.begun[k] = lone
            for s, c, to in automaton.rare:
                edges.append(((base + s) * self.all + c, base + to))
                if s == 0:
                    self.begun[k, c - self.size] = base + to
            begun = np.where(table[0] >= 0, table[0] + base, lone)
            signed = np.where(table >= 0, table + base, -begun)
            signed[0] = begun  # at the start of a text there is no phrase to end
            tables += [signed, -begun[None, :]]
            self.roots.append(base)
            self.weights.append(np.log2(max(2, len(text))))
            base = lone + 1
        pad = np.zeros((1, self.size), np.int32)
        self.table = np.concatenate([pad, *tables]).astype(np.int32) if tables else pad
        edges.sort()
        self.edges = np.array([e for e, _ in edges] + [np.iinfo(np.int64).max], np.int64)
        self.ends = np.array([to for _, to in edges] + [0], np.int32)
        wide = np.full(0x250, GAP, np.int32)
        for cp in range(0x250):
            low = chr(cp).lower()
            if chr(cp).isalpha():
                wide[cp] = self.code.get(low if len(low) == 1 else low[0], OTHER)
        self.wide = wide

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts in a row, with a gap between words only, and the number of codes of each text."""
        points = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        far = points >= 0x250
        codes = self.wide[np.where(far, 0, points)]
        if far.any():
            points_far, back = np.unique(points[far], return_inverse=True)
            known = np.array([
                self.code.get(chr(p).lower(), OTHER) if chr(p).isalpha() else GAP for p in points_far.tolist()], np.int32)
            codes[far] = known[back]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))  # with the end mark
        at = np.flatnonzero(codes != GAP)
        if not len(at):
            return codes[:0], np.zeros(len(texts), np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)[at]
        apart = np.zeros(len(at), np.int64)
        apart[1:] = (np.diff(at) > 1) & (owner[1:] == owner[:-1])
        place = np.arange(len(at)) + np.cumsum(apart)
        out = np.full(place[-1] + 1, GAP, np.int32)
        out[place] = codes[at]
        lens = np.bincount(owner, minlength=len(texts)) + np.bincount(owner, apart, len(texts)).astype(np.int64)
        return out, lens

    def rare(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The entries of states (language x text) for codes without a column."""
        key = state.astype(np.int64) * self.all + code
        at = np.searchsorted(self.edges, key)
        begun = self.begun[:, code - self.size]
        missing = np.where(state == np.array(self.roots, np.int32)[:, None], begun, -begun)
        return np.where(self.edges[at] == key, self.ends[at], missing)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text and language, and the texts' lengths in codes."""
        codes, lens = self.codes(texts)
        n, k = len(texts), len(self.languages)
        total = np.zeros((n, k), np.int64)
        if not len(codes):
            return total, lens
        parts = -(-lens // SEGMENT)
        owner = np.repeat(np.arange(n), parts)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(np.cumsum(lens) - lens, parts) + index * SEGMENT
        size = np.minimum(SEGMENT, np.repeat(lens, parts) - index * SEGMENT)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        longest = int(size[0])
        active = len(size) - np.searchsorted(size[::-1], np.arange(1, longest + 1))
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(size), axis=1)
        broken = np.zeros((k, len(size)), np.int32)
        flat, width = self.table.ravel(), np.int32(self.size)
        for t in range(longest):
            m = active[t]
            c = codes[start[:m] + t]
            far = np.flatnonzero(c >= width)
            new = flat[state[:, :m] * width + (np.where(c >= width, GAP, c) if len(far) else c)]
            if len(far):
                new[:, far] = self.rare(state[:, far], c[far])
            ends = new < 0
            broken[:, :m] += ends
            np.abs(new, out=new)
            state[:, :m] = new
        np.add.at(total, owner, broken.T + 1)
        return total, lens

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        phrases, lens = self.phrases(texts)
        cost = phrases * np.array(self.weights)
        best = np.argmin(cost, axis=1)
        least = cost[np.arange(len(texts)), best]
        if len(self.languages) > 1:
            second = np.partition(cost, 1, axis=1)[:, 1]
            score = np.where(second > 0, 1 - least / np.maximum(second, 1e-9), 0.0)
        else:
            score = np.ones(len(texts))
        return [(self.languages[b], float(s)) if size else (UNKNOWN, 0.0)
                for b, s, size in zip(best, np.clip(score, 0, 1), lens, strict=True)]


def sample(df: DataFrame, text: str, lang: str) -> dict[str, str]:
    """Labelled text per language: pieces of the rows with the lowest hashes, up to CHARS_PER_LANGUAGE letters.

    What reaches the driver is bounded by the number of languages times a few ROWS_PER_LANGUAGE pieces.
    """
    rows = df.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))
    texts = F.approx_count_distinct(F.xxhash64("text"))
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(texts.alias("n")).collect()}
    if not counts:
        return {}
    share: Column = F.lit(0.0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 4 * ROWS_PER_LANGUAGE / n))).otherwise(share)
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    low = rows.withColumn("h", place).filter(F.col("h") < share * (1 << 30))
    # the middle of a row stands for it
    middle = F.greatest(F.lit(1), (F.length("text") / 2 - PIECE / 2).cast("int"))
    found = low.select("lang", "h", F.substring(F.col("text"), middle, F.lit(PIECE)).alias("text")).distinct()
    samples: dict[str, list[str]] = {}
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return {name: " ".join(pieces)[:CHARS_PER_LANGUAGE] for name, pieces in samples.items()}


def predict_language(df: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """`df`, without its text unless it is to be kept, with `lang_pred` and `score`."""
    added = T.StructType().add("lang_pred", "string").add("score", "double")
    kept = [c for c in df.columns if c not in added.names and (keep_text or c != text)]
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by languages x CHARS_PER_LANGUAGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part, texts in chunks(batch, text):
                found = fitted.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array([x for x, _ in found], pa.string()),
                     pa.array([x for _, x in found], pa.float64())], schema.names)

    return spread(df).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame) -> Model:
    """The model of the documents that are not held out."""
    return Model(sample(docs.filter(~held_out()), "text", "lang"))


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of all documents, learned from those that are not held out."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict_language(rows, fitted(docs))
