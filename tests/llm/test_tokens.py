"""Encoding, counting and packing against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from odd_documents import SMALL, clashing, nothing, odd  # noqa: F401
from tokenizers import Tokenizer

from sessionlens.llm import bpe_codec, packing, token_counts
from sessionlens.llm.memo import LONGEST

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "'s", "'S", "it's", "123", "!", "...", "é", "ß", "日本", " ", "　", " ",
          "\x1c", "\x85", "\x00", "á", "<|endoftext|>", "<|", "endoftext|>", "aaaa", "\r\n", "🙂", "ǅ", "Σ", "İ", "²", "_", "-"]
TEXTS = st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=25).map("".join)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_codec_is_the_library(byte_library, texts):
    for text, (ids, decoded) in zip(texts, bpe_codec.codec(BYTES)(texts), strict=True):
        want = byte_library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == byte_library.decode(want, skip_special_tokens=False) == text


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_counts_are_the_library(byte_library, texts):
    want = [len(byte_library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.counter(BYTES)(texts) == want


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_word_ids_are_the_library(word_library, texts):
    for text, ids in zip(texts, packing.encoder(WORDS)(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == word_library.encode(text, add_special_tokens=False).ids


def test_memos_are_bounded_in_bytes_for_texts_without_blanks(byte_library, word_library):
    """Documents of scripts without blanks are long pieces: encoded as the library does, and not remembered."""
    r = np.random.default_rng(3)
    codec, counter, words = bpe_codec.Codec(BYTES), token_counts.Counter(BYTES), packing.WordEncoder(WORDS)
    for _ in range(30):
        texts = ["".join(map(chr, r.integers(0x4E00, 0x9FA0, 4000))), "".join(map(chr, r.integers(97, 123, 900))) + ".,", "a Word, here"]
        want = [byte_library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(i, "<u4").tolist() for i, _ in codec(texts)] == want
        assert counter(texts) == [len(x) for x in want]
        assert [np.frombuffer(i, "<u4").tolist() for i in words(texts)] == [word_library.encode(t, add_special_tokens=False).ids for t in texts]
    for memo in (codec.memo, counter.memo, words.memo):
        memo.make_room()
        assert memo.size < 20_000 and all(len(p) <= LONGEST for p in memo.store)


def test_merges_take_overlapping_pairs_from_the_left(byte_library):
    words = [b"a" * n for n in range(1, 40)] + [b"ababababa", b"-" * 17]
    got = token_counts.Merger(token_counts.vocabulary(BYTES)).counts(words)
    assert got.tolist() == [len(byte_library.encode(w.decode(), add_special_tokens=False).ids) for w in words]


def test_forced_pairs_occur_in_no_token():
    tokens = list(token_counts.vocabulary(BYTES).bytes_of.values())
    forced = bpe_codec.forced_pairs(tokens)
    assert forced[ord("e"), ord(" ")] and forced[ord("e"), ord(",")] and not forced[ord("t"), ord("h")]
    assert not any(forced[a, b] for t in tokens for a, b in zip(t[:-1], t[1:], strict=True))


def test_odd_documents(odd, clashing, nothing, byte_library):
    for df in (odd, clashing):
        both = {}
        for r in token_counts.token_counts(df, BYTES).collect():
            both.setdefault((r.doc_id, r.n_bytes), set()).add(r.n_tokens)
        for doc_id, text, *_ in odd.collect():
            text = text or ""
            want = len(byte_library.encode(text, add_special_tokens=False).ids)
            assert want in both[doc_id, len(text.encode())]
        rows = bpe_codec.encode_decode(df, BYTES, digests=True).collect()
        want = sorted(hashlib.sha256((x.text or "").encode()).hexdigest() for x in odd.collect())
        assert sorted(r.decoded_sha256 for r in rows) == want
        assert bpe_codec.encode_decode(df, BYTES).count() == odd.count()
    assert token_counts.token_counts(nothing, BYTES).isEmpty() and bpe_codec.encode_decode(nothing, BYTES).isEmpty()


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(3)
    for high in (30, 60, 100):
        lengths = rng.integers(1, high + 1, 300)
        bins, offsets = packing.best_fit(lengths, 100)
        fill = np.bincount(bins, lengths)
        assert fill.max() <= 100 and packing.lower_bound(lengths, 100) <= len(fill)
        for b in range(len(fill)):
            at = np.argsort(offsets[bins == b])
            assert (np.cumsum(lengths[bins == b][at]) - lengths[bins == b][at] == offsets[bins == b][at]).all()
    # three of 51 never share; 34 fits three times; bound beats the sum
    assert packing.lower_bound(np.array([51] * 9), 100) == 9
    assert packing.lower_bound(np.array([34] * 9), 100) == 5 - (100 // 34 < 2)
    assert packing.lower_bound(np.array([], int), 100) == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_odd_documents(spark, odd, clashing, nothing, word_library):
    for df in (odd, clashing):
        rows = packing.pack(spark, packing.pieces(df, WORDS)).collect()
        check_packing(rows, 2048)
        want = []
        for doc_id, text, *_ in odd.collect():
            ids = [*word_library.encode(text or "", add_special_tokens=False).ids, 0]
            want += [(str(doc_id), k, 2048 * k, len(ids[2048 * k: 2048 * (k + 1)]),
                      zlib.crc32(np.array(ids[2048 * k: 2048 * (k + 1)], "<u4").tobytes())) for k in range(-(-len(ids) // 2048))]
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert packing.pack(spark, packing.pieces(nothing, WORDS)).isEmpty()


def test_groups_exchange_until_the_bound(spark):
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in rng.integers(200, 700, 3000)]
    items = spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "doc_id long, length long").repartition(4)
    alone = sum(int(packing.best_fit(np.array(lengths[k::60]), 1000)[0].max()) + 1 for k in range(60))
    rows = packing.pack(spark, items, capacity=1000, group=50).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    assert packing.lower_bound(np.array(lengths), 1000) <= check_packing(rows, 1000) < alone


def test_queries_cover_the_table(spark, byte_library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = {r.doc_id: byte_library.encode(r.text, add_special_tokens=False).ids for r in docs}
    for r in token_counts.op10_token_counts(spark, SMALL).collect():
        assert (r.n_tokens, r.over_limit) == (len(want[r.doc_id]), len(want[r.doc_id]) > 512)
    for r in bpe_codec.op8_bpe_round_trip(spark, SMALL).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()
    rows = packing.op5_best_fit_packing(spark, SMALL).collect()
    lengths = np.array([r.length for r in rows])
    assert {r.doc_id for r in rows} == set(want)
    bound = packing.lower_bound(lengths, 2048)
    assert bound <= check_packing(rows, 2048) <= bound * 1.02 + 1
