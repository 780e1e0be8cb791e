"""Secret scans with a random forest that removes false positives.

Candidates are unbroken runs of 16 or more key characters, runs joined by dots of which one is that long, values of keys
named like a secret whatever their length and signs, whatever the length of the key and the blanks around the sign (one line
break among them), with escaped quotes inside, passwords in URLs, and blocks of private keys under labels of any length. Each is described by its length, its character classes and
the changes between them, its entropy, how likely its letters follow each other in ordinary words, the share of it that
dictionary words cover, its path (the place the text came from) and the words in front of it. Of the text around a candidate
the forest sees the key it is assigned to, at least 40 characters to the left and 8 to the right, with runs of blanks as one
blank; the last three words in front have 32 hash places. A random forest trained on
labelled findings gives the probability that it is a secret; candidates below the threshold are dropped as false positives.

Labelled findings are those made from the formats and placeholders below, plus a bounded sample of candidates of the
table (of each label half of `MAX_LABELLED`, those with the lowest hashes, copies counting once; only their description
leaves the task, taken from the whole candidate) that a strict rule
labels: a quoted or assigned value of a key named like a secret is one, a candidate without any such name, quote or
assignment near it is none, others are left out.
The dictionary is the list of whole words of a public tokenizer file.

Scanning and scoring need one pass over the texts; only the forest and dictionary are sent to the tasks (both bounded).

Defined cases: null text counts as empty and has no findings; candidates of any length are read whole; equal findings at
several places are all reported, and so is one within another (redaction cuts what any of them covers); a null path counts as empty; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.catalog import documents, query
from sessionlens.llm.vocab import chunks
from sessionlens.session import spread

THRESHOLD = 0.5
MAX_LABELLED = 2000
PARTS = 4
TREES, DEPTH, LEAST = 40, 8, 4
MARK = "[REDACTED SECRET]"

CANDIDATE = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_\-]{12,}[A-Za-z0-9+/](?:={1,2}(?![A-Za-z0-9+/_\-=]))?")
"""An '=' belongs to a candidate as padding at its end only, so that the key of an assignment stays to its left."""

LEAST_LETTERS = 16
DOTTED = re.compile(r"(?<![A-Za-z0-9_\-.])[A-Za-z0-9_\-]++(?:\.[A-Za-z0-9_\-]++)++")
URL_PASSWORD = re.compile(r"""://[^\s:/@"'<>]*+:([^\s/@"'<>]++)(?=@)""")
LABEL = r"(?:(?!PRIVATE KEY|-----)[^\n])*+PRIVATE KEY(?: BLOCK)?-----"
BLOCK = re.compile(
    r"-----BEGIN " + LABEL + r"(?:(?:(?!-----)[\s\S])*+-----END " + LABEL + r"|(?:\s+[A-Za-z0-9+/=]{16,})*)")
LEFT = 40
NAMES = re.compile(
    r"(?i)(?:token|secret|passwd|password|pwd|api[_-]?key|apikey|access[_-]?key|auth|credential|bearer|private[_-]?key)")
SIGN = re.compile(r":=|=>|=+|:")
#: What follows the sign: blanks with at most one line break, then an escaped, quoted, unclosed or bare value.
VALUE = re.compile(
    r"""[^\S\n]*+(?:\n[^\S\n]*+)?(?:\\(["'])(?P<escaped>(?:(?!\\\1)[^\n])++)\\\1"""
    r"""|"(?P<double>(?:[^"\\\n]|\\[^\n])++)"|'(?P<single>(?:[^'\\\n]|\\[^\n])++)'|["']*+(?P<bare>[^\s"'`<>]++))""")
BLANK_RUN = re.compile(r"[^\S\n]{2,}")
BLANKS_HERE = re.compile(r"[^\S\n]*+")
FOLLOWED_BY_SIGN = re.compile(r"""[\\"'\]]*+\s?(?:=|:(?!//))""")
KEY_SIGNS = frozenset("-_")
TESTING = re.compile(r"(?i)test|example|sample|fixture|mock|docs?/|demo|placeholder|dummy")
ASSIGNED = re.compile(r"""(?:=|:|=>)\s*["']?$|["']$|(?i:bearer\s+)$""")
PLACEHOLDER = re.compile(r"(?i)your|example|xxxx|changeme|placeholder|dummy|sample|insert|redacted|0{8}|1234567|abcdefg")
#: Beginnings that providers give their keys.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "SG.",
            "npm_", "eyJ")
NEAR_WORDS = 32
"""Hash places for the words in front of a candidate."""


@lru_cache(maxsize=2)
def dictionary(path: str) -> frozenset[str]:
    """Whole words of four letters or more of a tokenizer file with word ends."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = (w[:-4] for w in vocab if w.endswith("</w>"))
    return frozenset(w for w in words if len(w) >= 4 and w.isascii() and w.isalpha())


@lru_cache(maxsize=2)
def lengths(path: str) -> dict[str, list[int]]:
    """The lengths, longest first, of the dictionary's words with the same first four letters."""
    out: dict[str, set[int]] = {}
    for w in dictionary(path):
        out.setdefault(w[:4], set()).add(len(w))
    return {k: sorted(v, reverse=True) for k, v in out.items()}


@lru_cache(maxsize=2)
def followers(path: str) -> np.ndarray:
    """Log probability of a letter after a letter in the dictionary's words."""
    count = np.ones((26, 26))
    for w in dictionary(path):
        codes = [ord(c) - 97 for c in w]
        for a, b in zip(codes[:-1], codes[1:], strict=True):
            if 0 <= a < 26 and 0 <= b < 26:
                count[a, b] += 1
    return np.log(count / count.sum(axis=1, keepdims=True))


def covered(text: str, path: str) -> float:
    """Share of the characters that dictionary words cover, longest word first from left to right."""
    words, sizes = dictionary(path), lengths(path)
    low, i, n = text.lower(), 0, 0
    while i < len(low) - 3:
        for size in sizes.get(low[i: i + 4], ()):
            if low[i: i + size] in words:
                n, i = n + size, i + size
                break
        else:
            i += 1
    return n / max(1, len(text))


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(value: str, left: str, right: str, path: str, words: str) -> list[float]:
    """The description of one candidate; `words` is the tokenizer file with the dictionary."""
    n, kinds = len(value), [kind(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    changes = sum(a != b for a, b in zip(kinds[:-1], kinds[1:], strict=True)) / max(1, n - 1)
    counts = np.unique(list(value), return_counts=True)[1] / n
    table, low = followers(words), [ord(c) - 97 for c in value.lower()]
    steps = [table[a, b] for a, b in zip(low[:-1], low[1:], strict=True) if 0 <= a < 26 and 0 <= b < 26]
    named = list(NAMES.finditer(left))
    row = [
        n, math.log(n), *share, changes, float(-(counts * np.log2(counts)).sum()), len(counts) / n,
        sum(steps) / len(steps) if steps else -3.3, len(steps) / n, covered(value, words),
        float(value.startswith(PREFIXES)), float(bool(PLACEHOLDER.search(value))),
        float(all(c in "0123456789abcdefABCDEF" for c in value)), float(value.isdigit()), value.count("-") / n,
        value.count("/") / n, float(bool(named)), min(LEFT, len(left) - named[-1].end()) if named else LEFT,
        float(bool(ASSIGNED.search(left))), float(right[:1] in "\"'" and right != ""), float("@" in right[:2]),
        float(bool(TESTING.search(path))), float("/" in left[-1:]), len(path), float(value.startswith("-----BEGIN")),
        value.count(".") / n, float(any(c in "(){}[]<>$ " for c in value)), float("://" in left and right[:1] == "@"),
        float(value.lower() in dictionary(words)), float(value.isalpha()), float(bool(FOLLOWED_BY_SIGN.match(right))),
    ]
    near = [0.0] * NEAR_WORDS
    for w in re.findall(r"[A-Za-z]+", left.lower())[-3:]:
        near[hashlib.blake2b(w.encode(), digest_size=1).digest()[0] % NEAR_WORDS] = 1.0
    return row + near


def made_findings(seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (value, left, right, path, is_secret) from the formats of keys and the usual false positives."""
    r = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    names = ["token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "private_key"]
    plain = ["the value of", "see", "commit", "version", "checksum", "order number", "build", "image", "call", "reference"]
    syllables = ["con", "ter", "ation", "ment", "pre", "log", "user", "data", "set", "get", "ing", "able", "view", "list"]
    paths = ["src/app.py", "config/settings.yml", "site/page", "", "deploy/run.sh", "notes"]
    out = []

    def add(value: str, left: str, right: str, path: str, label: int) -> None:
        """The finding as found() gives it for a text that holds it."""
        at = range(len(left), len(left) + len(value))
        out.extend((v, x, y, path, label) for a, b, v, x, y in found(left + value + right) if (a, b) == (at.start, at.stop))

    for _ in range(60):
        for value in ("AKIA" + some(upper, 16), "ghp_" + some(alnum, 36), "sk_live_" + some(alnum, 24), some(hexa, 40),
                      some(hexa, 32), some(alnum, 40), some(alnum + "+/", 43) + "=", "eyJ" + some(alnum, 60)):
            quote, name = r.choice(['"', "'", ""]), r.choice(names)
            left = f"{name}{r.choice([' = ', '=', ': '])}{quote}"
            add(value, left, quote + "\n", r.choice(paths), 1)
        for value in ("AKIA" + some(upper, 16), "ghp_" + some(alnum, 36), "sk_live_" + some(alnum, 24)):
            add(value, r.choice(plain) + " ", " and", r.choice(paths), 1)
        for left, right in ((f"{r.choice(names).upper()}=", "\n"), (f"export {r.choice(names).upper()}=", "\n"),
                            (f"https://site/list?page=2&{r.choice(names)}=", "&sort=up")):
            add(some(r.choice([hexa, alnum]), r.choice([32, 40])), left, right, r.choice(paths), 1)
        uuid = "-".join([some(hexa, 8), some(hexa, 4), some(hexa, 4), some(hexa, 4), some(hexa, 12)])
        word = "_".join(r.choice(syllables) + r.choice(syllables) for _ in range(3)) + str(r.randint(1, 99))
        for value, left, right, path in (
            (uuid, "https://site/items/", " ", "web/page"), (uuid, "id: ", "\n", "logs"), (some(hexa, 40), "commit ", "\n", "log"),
            (some(hexa, 64), "sha256 checksum ", "\n", "release"), (some("0123456789", 16), r.choice(plain) + " ", " ", ""),
            (word, r.choice(plain) + " ", " ", "src/app.py"), (word, f"{r.choice(names)} = ", "\n", "src/app.py"),
            (word, f"{r.choice(names)}=", "\n", "src/app.py"), (uuid, "https://site/list?id=", "&sort=up", "web/page"),
            ("your_api_key_here_" + str(r.randint(1, 9)), f'{r.choice(names)} = "', '"', "docs/setup"),
            ("xxxxxxxxxxxxxxxx" + str(r.randint(10, 99)), f'{r.choice(names)}: "', '"', "example"),
            ("example_token_" + str(r.randint(100, 999)), f'{r.choice(names)} = "', '"', "tests/fixture"),
            (f"2024{r.randint(1000, 9999)}-{r.randint(1000, 9999)}-report", r.choice(plain) + " ", " ", "notes"),
            (some(alnum, 30), "image/png;base64,", " ", "page.html"),
        ):
            add(value, left, right, path, 0)
        signs, letter = alnum + "!@#$%^*?", alnum[:52]
        plainer = alnum + "!#$%^*"
        human = r.choice(syllables) + r.choice(syllables) + str(r.randint(1, 999)) + r.choice("!#$%*") + some(letter, r.randint(0, 4))
        mixed = some(letter[:26], r.randint(4, 7)) + str(r.randint(1, 99)) + r.choice("!#$%*@") + some(letter, r.randint(2, 4))
        for value in (some(signs, r.randint(8, 14)) + r.choice("0123456789"), human, mixed, some(letter, 32)):
            quote, name = r.choice(['"', "'"]), r.choice(names)
            add(value, f"{name}{r.choice([' = ', '=', ': '])}{quote}", quote + "\n", r.choice(paths), 1)
            add(value, f"{name.upper()}=", "\n", r.choice(paths), 1)
        for value in (human, some(plainer, r.randint(8, 16)), some(letter, 10) + str(r.randint(0, 9))):
            scheme, user = r.choice(["postgres", "https", "redis", "mysql"]), r.choice(["bob", "admin", "user", "app"])
            add(value, f"{scheme}://{user}:", "@" + r.choice(["db", "localhost", "10.0.0.1", "host.net"]) + ":5432/x", r.choice(paths), 1)
        jwt = "eyJ" + some(alnum, 33) + ".eyJ" + some(alnum, r.randint(40, 80)) + "." + some(alnum + "-_", 42) + "A"
        for value in (jwt, "SG." + some(alnum, 22) + "." + some(alnum, 43)):
            add(value, r.choice([f"{r.choice(names)}=", "Authorization: Bearer ", r.choice(plain) + " ", 'x = "']), "\n", r.choice(paths), 1)
        kind_of_key = r.choice(["RSA ", "EC ", "OPENSSH ", ""])
        body = "\n".join(some(alnum + "+/", 64) for _ in range(r.randint(4, 26)))
        add(f"-----BEGIN {kind_of_key}PRIVATE KEY-----\n{body}\n-----END {kind_of_key}PRIVATE KEY-----", r.choice(["", "key:\n", "x "]),
            "\n", r.choice(paths), 1)
        long_key = "_".join(r.choice(syllables) + r.choice(syllables) for _ in range(r.randint(2, 6)))
        long_key = r.choice([f"{long_key}_{r.choice(names)}", f"{r.choice(names)}_{long_key}"])
        long_key = r.choice([long_key, long_key.upper(), long_key.replace("_", "-")])
        for value in (mixed, some(hexa, 32), some(signs, r.randint(8, 14)) + r.choice("0123456789")):
            add(value, long_key + r.choice([': "', ' = "', '": "']), '"\n', r.choice(paths), 1)
        add(long_key, r.choice(["", '"', "  ", "export "]), r.choice([' = "x"', '": "x"', ": x", "=x1"]), r.choice(paths), 0)
        prose = r.choice(["the", "nobody", "some", "that", "because", "Smith", "Johnson", "never", "people", "keep", "this", "your"])
        code = r.choice(["None", "null", "true", "false", "get_password()", "${DB_PASSWORD}", 'os.environ["TOKEN"]', "args.password",
                         "{{secret}}", "input()", "********", "str", "string", "required", "self.token"])
        long_word = "-".join(r.choice(syllables) + r.choice(syllables) for _ in range(r.randint(3, 5)))
        for value, left, right, path in (
            (prose, r.choice(["the secret: ", "author: ", "password: ", "token: "]), " is", "notes"), (code, f"{r.choice(names)} = ", "\n", "src/app.py"),
            (code, f"{r.choice(names)}=", "\n", "src/app.py"), (str(r.randint(1, 9999)), f"max_{r.choice(names)}s: ", "\n", "src/app.py"),
            (long_word, r.choice(plain) + " ", " and", "web/page"), (long_word.replace("-", "/"), "https://site/", " ", "web/page"),
            (long_word.replace("-", ""), r.choice(plain) + " ", " ", "notes"), ("x" * r.randint(16, 99), "", " ", "notes"),
            (r.choice(["password", "pass", "changeme", "<password>"]), "postgres://user:", "@host/db", "docs/setup"),
            (some(letter[26:], 8) + ".report-" + long_word + str(r.randint(1, 99)) + ".html", "https://", " ", "web/page"),
        ):
            add(value, left, right, path, 0)
    return out


def strict_label(value: str, left: str) -> int | None:
    """A label for a candidate whose surroundings leave no doubt, else None."""
    if PLACEHOLDER.search(value):
        return 0
    if BLOCK.fullmatch(value):
        return 1 if len(value) > 200 else None
    named, assigned = bool(NAMES.search(left)), bool(ASSIGNED.search(left))
    if named and assigned and len(value) >= LEAST_LETTERS and any(c.isdigit() for c in value) and not value.isdigit():
        return 1 if CANDIDATE.fullmatch(value) or DOTTED.fullmatch(value) else None
    return None if named or assigned or value.startswith(PREFIXES) else 0


class Forest:
    """Random forest of binary trees in arrays, grown on bootstrap samples with a random part of the features per split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = []
        tries = max(1, int(math.sqrt(x.shape[1]) * 1.5))
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            feature, cut, low, high, value = [], [], [], [], []

            def grow(rows: np.ndarray, level: int) -> int:
                at = len(value)
                for column, v in ((feature, -1), (cut, 0.0), (low, -1), (high, -1), (value, float(y[rows].mean()))):
                    column.append(v)
                if level < depth and len(rows) >= 2 * LEAST and 0 < value[at] < 1:
                    best = (0.0, -1, 0.0)
                    for f in rng.choice(x.shape[1], tries, replace=False):
                        best = max(best, self.gain(x[rows, f], y[rows], int(f)))
                    if best[1] >= 0:
                        feature[at], cut[at] = best[1], best[2]
                        left = x[rows, best[1]] <= best[2]
                        low[at] = grow(rows[left], level + 1)
                        high[at] = grow(rows[~left], level + 1)
                return at

            grow(rows, 0)
            self.trees.append((np.array(feature), np.array(cut), np.array(low), np.array(high), np.array(value)))

    @staticmethod
    def gain(v: np.ndarray, y: np.ndarray, f: int) -> tuple[float, int, float]:
        """(fall of the Gini impurity, feature, cut) of the best cut of one feature."""
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order].astype(float)
        n, ones = len(y), np.cumsum(y)
        left = np.arange(1, n)
        p, q = ones[:-1] / left, (ones[-1] - ones[:-1]) / (n - left)
        fall = ones[-1] / n * (1 - ones[-1] / n) - (left * p * (1 - p) + (n - left) * q * (1 - q)) / n
        fall[(v[1:] == v[:-1]) | (left < LEAST) | (n - left < LEAST)] = -1
        k = int(fall.argmax())
        return (float(fall[k]), f, float((v[k] + v[k + 1]) / 2)) if fall[k] > 1e-9 else (0.0, -1, 0.0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, low, high, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                f = feature[at[inner]]
                at[inner] = np.where(x[inner, f] <= cut[at[inner]], low[at[inner]], high[at[inner]])
            total += value[at]
        return total / len(self.trees)


def key_before(text: str, sign: int) -> tuple[int, int]:
    """Start and end of the key in front of a sign: behind it blanks, quotes and brackets may stand."""
    end = sign
    while end and text[end - 1].isspace():
        end -= 1
    while end and text[end - 1] in "\\\"']":
        end -= 1
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in KEY_SIGNS):
        start -= 1
    return start, end


def named_values(text: str) -> Iterator[tuple[int, int, int]]:
    """Start, end and start of the key of each value whose key is named like a secret."""
    done = 0
    for sign in SIGN.finditer(text):
        if sign.start() < done:
            continue
        start, end = key_before(text, sign.start())
        if start == end or not NAMES.search(text, start, end):
            continue
        m = VALUE.match(text, sign.end())
        if not m:
            continue
        a, b = m.span(m.lastgroup)
        if m.lastgroup == "bare":
            if start and text[start - 1] in "?&":  # a parameter of a URL
                stop = text.find("&", a, b)
                b = b if stop < 0 else stop
            while b > a and text[b - 1] in ",;)]}.":
                b -= 1
        if b > a:
            done = b
            yield a, b, start


def spans(text: str) -> dict[tuple[int, int], int]:
    """Places of the candidates of all forms, each with the start of the key it is assigned to (else its own start)."""
    out = {}
    for m in CANDIDATE.finditer(text):
        if len(m.group()) >= LEAST_LETTERS:
            out[m.span()] = m.start()
    if "." in text:
        for m in DOTTED.finditer(text):
            if m.group().startswith(PREFIXES) or any(
                    len(x) >= LEAST_LETTERS and any(c.isdigit() for c in x) for x in m.group().split(".")):
                out[m.span()] = m.start()
    if "://" in text:
        for m in URL_PASSWORD.finditer(text):
            out[m.span(1)] = m.start(1)
    if "-----BEGIN " in text:
        for m in BLOCK.finditer(text):
            out[m.span()] = m.start()
    for a, b, key in named_values(text):
        out[a, b] = key
    return out


def found(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, value, left, right) of the candidates of a text; runs of blanks around them count as one."""
    for (a, b), key in sorted(spans(text).items()):
        left = BLANK_RUN.sub(" ", text[min(key, max(0, a - LEFT)): a])
        end = BLANKS_HERE.match(text, b).end()
        yield a, b, text[a:b], left, (text[b: min(end, b + 1)] + text[end: end + 8])[:8]


def redacted(text: str, places: list[tuple[int, int]]) -> str:
    """The text with a mark for each stretch that the places, sorted by start, cover."""
    out, end = [], 0
    for a, b in places:
        if a >= end:
            out += [text[end:a], MARK]
        end = max(end, b)
    return "".join([*out, text[end:]])


def described(findings: list[tuple[str, str, str, str, int]], words: str) -> list[tuple[list[float], int]]:
    """(features, is_secret) of labelled findings (value, left, right, path, is_secret)."""
    return [(features(*f[:4], words), f[4]) for f in findings]


def trained(rows: list[tuple[list[float], int]]) -> Forest:
    """A forest from described findings."""
    return Forest(np.array([x for x, _ in rows]), np.array([label for _, label in rows]))


def lowest(rows: Iterator[tuple], most: int, describe: Callable[..., list[float]]) -> list[tuple]:
    """Of each label the `most` rows (h, label, path, right, features) with the lowest hashes, the smallest row per hash.

    Rows come as (h, label, path, right, what `describe` takes); it is asked only for rows that are held.
    """
    best: tuple[dict, dict] = ({}, {})
    limit = [math.inf, math.inf]
    for h, label, path, right, rest in rows:
        held = best[label]
        if h <= limit[label] and (h not in held or (path, right) < held[h][:2]):
            held[h] = (path, right, describe(path, right, rest))
            if len(held) > 2 * most:
                for x in sorted(held)[most:]:
                    del held[x]
                limit[label] = max(held)
    return [(h, label, *held[h]) for label, held in enumerate(best) for h in sorted(held)[:most]]


def labelled_sample(df: DataFrame, words: str, text: str, path: str, most: int = MAX_LABELLED) -> list[tuple[list[float], int]]:
    """Descriptions of candidates that the strict rule labels; of each label the `most` / 2 with the lowest hashes.

    Copies (equal left and value) count once. Each task keeps its lowest, `PARTS` tasks keep the lowest of those.
    """
    names = ["h", "label", "path", "right", "x"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64())]
    schema = "h long, label int, path string, right string, x array<double>"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                for t, where in zip(texts, part.column("path").to_pylist(), strict=True):
                    for _, _, value, left, right in found(t):
                        label = strict_label(value, left)
                        if label is not None:
                            h = hashlib.blake2b(f"{left}\0{value}".encode(), digest_size=7).digest()
                            yield int.from_bytes(h, "big"), label, where, right, (value, left)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield batch_of(lowest(labelled(batches), most // 2, lambda where, right, x: features(*x, right, where, words)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        yield batch_of(lowest(rows, most // 2, lambda where, right, x: x))

    rows = df.select(F.col(text).alias("text"), F.coalesce(F.col(path), F.lit("")).cast("string").alias("path"))
    few = spread(rows).mapInArrow(scan, schema).repartition(PARTS, "h").mapInArrow(merge, schema)
    low = lowest((tuple(r) for r in few.collect()), most // 2, lambda where, right, x: x)  # at most `PARTS` x `most` rows
    return [(x, label) for _, label, _, _, x in low]


def scan_secrets(df: DataFrame, forest: Forest, words: str, text: str = "text", path: str = "source",
                 redact: bool = False) -> DataFrame:
    """`df` without its text, with `findings` (start, end, sha256, score and is_secret of each candidate); with `redact`, `df`
    with the secrets in its text replaced by a mark."""
    kept = [c for c in df.columns if redact or c not in (text, "findings")]
    finding = T.StructType().add("start", "long").add("end", "long").add("sha256", "string").add("score", "double").add(
        "is_secret", "boolean")
    schema = T.StructType([df.schema[c] for c in kept] + ([] if redact else [T.StructField("findings", T.ArrayType(finding))]))
    shared = df.sparkSession.sparkContext.broadcast(forest)
    kind_of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sha256", pa.string()),
                                  ("score", pa.float64()), ("is_secret", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, texts in chunks(batch, text):
                places, rows, spans = [], [], []
                where = [x or "" for x in part.column(path).to_pylist()]
                for k, t in enumerate(texts):
                    for a, b, value, left, right in found(t):
                        places.append(k)
                        spans.append((a, b, value))
                        rows.append(features(value, left, right, str(where[k]), words))
                score = model.probability(np.array(rows)).tolist() if rows else []
                hits: list[list] = [[] for _ in texts]
                for k, (a, b, value), s in zip(places, spans, score, strict=True):
                    hits[k].append((a, b, value, s))
                if redact:
                    column = part.column(text).to_pylist()
                    for k, t in enumerate(texts):
                        places = [(a, b) for a, b, _, s in hits[k] if s >= THRESHOLD]
                        if places:
                            column[k] = redacted(t, places)
                    arrays = [pa.array(column, part.column(text).type) if c == text else part.column(c) for c in kept]
                    yield pa.RecordBatch.from_arrays(arrays, kept)
                else:
                    column = [[{"start": a, "end": b, "sha256": hashlib.sha256(v.encode()).hexdigest(), "score": s,
                                "is_secret": s >= THRESHOLD} for a, b, v, s in h] for h in hits]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(column, kind_of)],
                                                     [*kept, "findings"])

    return spread(df).mapInArrow(run, schema)


def fitted(df: DataFrame, words: str, text: str = "text", path: str = "source") -> Forest:
    """The forest for a table of documents."""
    return trained(described(made_findings(), words) + labelled_sample(df, words, text, path))


@query("op9_secret_scans")
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their candidates and what the forest says of them; one row per document."""
    words = public_tokenizers.path("word_bpe_49k.json")
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    out = scan_secrets(docs, fitted(docs, words), words)
    return out.select("doc_id", F.size("findings").alias("n_candidates"),
                      F.size(F.filter("findings", lambda f: f["is_secret"])).alias("n_secrets"), "findings")
