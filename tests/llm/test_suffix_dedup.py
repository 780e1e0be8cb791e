"""Removal of repeated passages against a count of all windows."""

import collections
import hashlib
import random

import numpy as np
import pytest
from odd_documents import SMALL, clashing, nothing, odd  # noqa: F401

from sessionlens.llm import suffix_dedup

COLUMNS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i: i + length] for r in raw for i in range(len(r) - length + 1))
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i: i + length]] > 1:
                gone[i: i + length] = b"\1" * length
        stay = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        yield len(r), len(r) - len(stay), sum(1 for p, g in zip(b"\0" + gone, gone, strict=False) if g and not p), hashlib.sha256(stay).hexdigest()


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop", "a"])
@pytest.mark.parametrize("length", [1, 5, 9, 20])
def test_blocks_find_all_repeats(alphabet, length):
    r = random.Random(length)
    for _ in range(12):
        bodies = ["".join(r.choice(alphabet) for _ in range(r.randint(length, 70))).encode() for _ in range(r.randint(1, 9))]
        bodies += bodies[:1] if r.random() < .3 else []
        starts, again, kind = suffix_dedup.repeats(bodies, length)
        at, windows = 0, []
        for b in bodies:
            windows += [b[i: i + length] if i + length <= len(b) else None for i in range(len(b) + 1)]
            at += len(b) + 1
        count = collections.Counter(w for w in windows if w is not None)
        assert starts.tolist() == [w is not None for w in windows]
        assert again.tolist() == [w is not None and count[w] > 1 for w in windows]
        named = collections.defaultdict(set)
        for w, k in zip(windows, kind.tolist(), strict=True):
            if w is not None:
                named[w].add(k)
        assert all(len(k) == 1 for k in named.values()) and len(set.union(*named.values())) == len(named)


def test_runs_depend_on_windows_only():
    """Equal windows get equal keys wherever they stand; runs cover each window once."""
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list("abcde "), n)) for n in (0, 5, 30, 400, 2000)]
    texts += [texts[4][100:900] + "x", "a" * 9000]
    length, gram = 30, 6
    for size in (64, 1 << 20):
        suffix_dedup.SECTION, before = size, suffix_dedup.SECTION
        key_of, covered = {}, collections.Counter()
        for raw, ends, which, place in suffix_dedup.sections(texts, length):
            text, start, windows, key, twice = suffix_dedup.runs(np.frombuffer(raw, np.uint8), ends, length, gram)
            began = np.r_[0, ends[:-1]]
            for t, s, n, k, two in zip(text, start, windows, key, twice, strict=True):
                own = [raw[i: i + length] for i in range(s, s + n)]
                assert two or len(set(own)) == len(own)
                for i, w in enumerate(own):
                    assert key_of.setdefault(w, k) == k
                    covered[which[t], place[t] + s - began[t] + i] += 1
        suffix_dedup.SECTION = before
        assert covered == {(i, p): 1 for i, t in enumerate(texts) for p in range(len(t.encode()) - length + 1)}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = [(d.doc_id, *row) for d, row in zip(docs, brute([d.text for d in docs], 200), strict=True)]
    got = suffix_dedup.op13_suffix_dedup(spark, SMALL)
    assert got.columns == ["doc_id", *COLUMNS]
    assert plain(got.collect()) == plain(want)
    assert sum(r[2] for r in want) > 0


def test_hot_passage_in_ever_new_surroundings(spark):
    """Keys split into parts: a passage, and rare pairs of documents that share more than it."""
    r = random.Random(6)
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage, rows = noise(60), []
    for i in range(300):
        rows.append(noise(40) + passage + noise(40))
        if i % 50 == 0:
            rows.append(noise(3) + rows[-1][15:130] + noise(9))
    rows += ["ab" * 100, "xyz" + "ab" * 30, noise(30)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    want = plain((i, *x) for i, x in enumerate(brute(rows, 25)))
    for block_bytes in (600, 5000, 1 << 21):
        got = suffix_dedup.suffix_dedup(df, length=25, gram=6, block_bytes=block_bytes)
        assert plain(got.select("doc_id", *COLUMNS).collect()) == want


def test_suffix_dedup_of_odd_documents(odd, clashing, nothing):
    want = plain(brute([r.text for r in odd.select("text").collect()], 200))
    for df in (odd, clashing.withColumn("n_spans", odd["lang"])):
        out = suffix_dedup.suffix_dedup(df, keep=True)
        assert set(out.columns) == {c for c in df.columns if c != "text"} | {*COLUMNS, "kept_bytes"}
        rows = out.select(*COLUMNS, "kept_bytes").collect()
        assert plain(r[:4] for r in rows) == want
        assert all(hashlib.sha256(r.kept_bytes).hexdigest() == r.kept_sha256 for r in rows)
    assert suffix_dedup.suffix_dedup(nothing).isEmpty()
    assert suffix_dedup.suffix_dedup(odd.select("text")).columns == COLUMNS
