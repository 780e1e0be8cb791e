"""Alignment of two tokenizers against brute force over the libraries' own ids."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import sentencepiece
from odd_documents import SMALL, clashing, nothing, odd  # noqa: F401
from tokenizers import Tokenizer

from sessionlens.llm import alignment
from sessionlens.llm.memo import Memo

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def symbol_bytes():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Brute:
    """Whole texts through the libraries, every pair of tokens compared."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.byte = symbol_bytes()

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch(r"<0x..>", piece) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        ids = self.a.encode(" " + text, add_special_tokens=False).ids
        raw = [bytes(map(self.byte.__getitem__, self.a.id_to_token(i))) for i in ids]
        other = self.b.encode(text)
        raw_b = [self.bytes_b(i) for i in other]
        whole = (" " + text).encode()
        if not text or b"".join(raw) != whole or b"".join(raw_b) != whole:
            return None
        return ids, raw, other, raw_b

    def document(self, text):
        found = self.tokens(text or "")
        if found is None:
            return (0, 0, 0, 0, ""), collections.Counter()
        a, raw_a, b, raw_b = found
        end_a, end_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        both = sorted(set(end_a) & set(end_b))
        place_a, place_b = ({e: i for i, e in enumerate(ends, 1)} for ends in (end_a, end_b))
        groups, i, j = [], 0, 0
        links = collections.Counter()
        for end in both:
            k, m = place_a[end], place_b[end]
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            for x in range(i, k):
                for y in range(j, m):
                    start = max(end_a[x] - len(raw_a[x]), end_b[y] - len(raw_b[y]))
                    if start < min(end_a[x], end_b[y]):
                        links[a[x], b[y]] += 1
            i, j = k, m
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        return (len(a), len(b), len(both), links.total(), digest), links

    def corpus(self, texts):
        found = [self.document(t) for t in texts]
        count = sum((links for _, links in found), collections.Counter())
        best = collections.Counter()
        for (_, b), n in count.items():
            best[b] = max(best[b], n)
        for (na, nb, groups, n, digest), links in found:
            top = sum(k for (a, b), k in links.items() if count[a, b] == best[b])
            yield na, nb, groups, n, top, sum(k * count[p] for p, k in links.items()), digest


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = ["a▁b and more", "▁", "  two  blanks ", "end ", " ", "\n\n x\n y \t z", "<s> </s> <unk> <0x41> <|endoftext|> x",
        "日本語のテキスト。次の文", "é" * 300, "a" * 700, "  　 x", "mixed\u0000nul <|endoftext|>", "don't we'll  'tis", "1234567 89"]


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_gallop_finds_lower_bounds():
    r = np.random.default_rng(2)
    for n, m in ((1, 1), (5, 200), (200, 5), (3000, 4000)):
        short, long = (np.unique(r.integers(0, 3 * max(n, m), k)) for k in (n, m))
        for start in (np.zeros(len(short), int), np.full(len(short), len(long) + 3), r.integers(-3, len(long) + 3, len(short))):
            assert alignment.gallop(short, long, start).tolist() == np.searchsorted(long, short).tolist()


def test_pieces_encode_as_whole_texts():
    """Sections of a few bytes give what whole texts give."""
    brute, aligner = Brute(), alignment.Aligner(A, B)
    r = random.Random(3)
    texts = HARD + ["".join(r.choice(["a", "the ", " ", "\n", "é", "ing", "日", ",", "'s", "\t "]) for _ in range(60)) for _ in range(300)]
    for size in (8, alignment.SECTION_BYTES):
        alignment.SECTION_BYTES, before = size, alignment.SECTION_BYTES
        try:
            got = aligner(texts)
        finally:
            alignment.SECTION_BYTES = before
        for text, row in zip(texts, got, strict=True):
            want, links = brute.document(text)
            assert row[:5] == want, text
            size_b = len(aligner.bytes_b)
            assert {(k // size_b, k % size_b): n for k, n in zip(row[5].tolist(), row[6].tolist(), strict=True)} == links


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = [(d.doc_id, *row) for d, row in zip(docs, Brute().corpus([d.text for d in docs]), strict=True)]
    got = alignment.op11_token_alignment(spark, SMALL)
    assert got.columns == ["doc_id", *COLUMNS]
    assert plain(got.collect()) == plain(want)


def test_alignment_of_odd_documents(spark, odd, clashing, nothing):
    want = list(Brute().corpus([r.text for r in odd.select("text").collect()]))
    for df, slice_rows in ((odd, 2000), (clashing.withColumn("count_sum", odd["lang"]).withColumn("_links", odd["lang"]), 1_000_000)):
        out = alignment.align(df, A, B, slice_rows=slice_rows)
        assert set(out.columns) == {c for c in df.columns if c != "text"} | set(COLUMNS)
        assert plain(out.select(*COLUMNS).collect()) == plain(want)
    assert alignment.align(nothing, A, B).isEmpty()
    assert alignment.align(nothing.select("text"), A, B).columns == COLUMNS


def test_memo_is_bounded_in_bytes():
    memo = Memo(limit=100_000)
    for k in range(0, 4000, 40):
        pieces = [f"piece {i}" for i in range(k, k + 40)] + ["x" * (5000 + k)]
        out = memo.fetch(pieces, lambda missing: {p: (p.encode(),) for p in missing})
        assert {p: out[p][0].decode() for p in pieces} == {p: p for p in pieces}
        memo.make_room()
        assert memo.size <= 100_000 and not any(p.startswith("x") for p in memo.store)
