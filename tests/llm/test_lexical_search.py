"""Ranked search against SQL and a plain scorer."""

import collections
import math
import random
import re

import duckdb
import pytest
from odd_documents import SMALL, clashing, nothing, odd, words  # noqa: F401

from sessionlens.llm import catalog, lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best):
    """(item_id, rank, doc_id, score) by scoring everything."""
    held = [(d, collections.Counter(split(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 100 - 25 + 25 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in split(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d, -score))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k, x[2], -x[0]) for k, x in enumerate(scored[:best], 1)]
    return out


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_search_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    cur = con.execute(catalog.ORACLES["op12_lexical_search"])
    columns = [d[0] for d in cur.description]
    got = lexical_search.op12_lexical_search(spark, SMALL)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert plain(got.select(*columns).collect()) == plain(cur.fetchall())


def test_terms_are_those_of_the_pattern():
    r = random.Random(1)
    for size in (3, 1 << 22):
        lexical_search.SECTION_BYTES, before = size, lexical_search.SECTION_BYTES
        try:
            for text in ["", " \u0000\u001c", "Ünï Ab_c\x7fd é x y 　 İ I"] + ["".join(r.choice("aB9 é-\u0085\n日_") for _ in range(80)) for _ in range(50)]:
                assert {t.decode(): n for t, n in lexical_search.terms(text).items()} == collections.Counter(split(text))
        finally:
            lexical_search.SECTION_BYTES = before
    assert not lexical_search.terms(None)


def test_search_of_odd_documents(spark, odd, clashing, nothing):
    """Nulls, empty texts, repeated rows and items, ties, an item of one common term, blocks of one item."""
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [(1, "shared line of many sites"), (2, None), (3, ""), (None, "null id one two"), (5, "SAME Same"), (5, "x  x Ünïcödé"), (6, "of")]
    asked = spark.createDataFrame(items, "item_id int, text string")
    want = plain(brute(docs, items, 5))
    for df, size in ((odd, 1024), (clashing, 2)):
        lexical_search.BLOCK_ITEMS, before = size, lexical_search.BLOCK_ITEMS
        try:
            assert plain(lexical_search.search(df, asked, best=5).collect()) == want
        finally:
            lexical_search.BLOCK_ITEMS = before
    assert lexical_search.search(nothing, asked).isEmpty()
    assert lexical_search.search(odd, asked.limit(0)).isEmpty()


@pytest.mark.parametrize("width", [7, 1 << 16])
def test_collisions_never_lose_a_document(spark, width):
    """With seven coordinates nearly every bound is too high, and the results stay the same; counts beyond a byte too."""
    r = random.Random(8)
    docs = [(i, words(r, r.randint(1, 40), 2)) for i in range(400)] + [(400, "aa " * 700), (401, "aa " * 300 + "bb")]
    docs += [(500 + i, "aa bb cc") for i in range(40)]
    items = [(i, words(r, 6, 2)) for i in range(20)] + [(20, "aa bb cc"), (21, "aa")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = lexical_search.search(table, spark.createDataFrame(items, "item_id int, text string"), width=width, first=3)
    assert plain(got.collect()) == plain(brute(docs, items, 20))
