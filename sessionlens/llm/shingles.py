"""Word shingles of texts as hashes, and their minwise signatures, for whole batches of texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

BLANK = np.isin(np.arange(256), [*range(9, 14), 32])
WIDTH = 5
COORDINATES = 64

_random = np.random.default_rng(20260)
_CELL = _random.integers(0, 2**64, (64, 256), dtype=np.uint64)
_FACTOR = _random.integers(0, 2**32, COORDINATES, dtype=np.uint32) | np.uint32(1)
_M = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words:
    """Words (runs of characters that are not ASCII blanks) of texts, as hashes in one array."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        whole = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in raw])
        blank = BLANK[whole]
        before = np.concatenate(([True], blank[:-1]))
        starts = np.flatnonzero(~blank & before)
        stops = np.flatnonzero(blank & ~before)
        self.sizes = np.diff(np.searchsorted(starts, ends), prepend=0)
        lengths = stops - starts
        if not len(starts):
            self.hashes = np.zeros(0, np.uint64)
        else:
            inner = np.flatnonzero(~blank)
            place = inner - np.repeat(starts, lengths)
            cells = _CELL[place & 63, whole[inner]] * (((place >> 6) << 1) + 1).astype(np.uint64)
            first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            self.hashes = mixed(np.add.reduceat(cells, first) + lengths.astype(np.uint64) * _M)
        self._whole, self._blank, self._before, self._ends = whole, blank, before, ends

    def digests(self) -> list[bytes]:
        """16 bytes for each text, equal for texts with equal sequences of words."""
        stay = ~self._blank | ~self._before
        compact = np.where(self._blank, np.uint8(32), self._whole)[stay]
        places = np.concatenate(([0], np.cumsum(stay)))[np.concatenate(([0], self._ends))].tolist()
        data = compact.tobytes()
        return [hashlib.blake2b(data[a:b].rstrip(), digest_size=16).digest()
                for a, b in zip(places[:-1], places[1:], strict=True)]

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles of WIDTH words, and how many each text has; a shorter text with words has one."""
        w, sizes = self.hashes, self.sizes
        counts = np.where(sizes >= WIDTH, sizes - WIDTH + 1, np.minimum(sizes, 1))
        total = np.cumsum(sizes)
        if len(w) >= WIDTH:
            h = w[: len(w) - WIDTH + 1].copy()
            for k in range(1, WIDTH):
                h = h * _M + w[k: len(w) - WIDTH + 1 + k]
        else:
            h = np.zeros(0, np.uint64)
        h = np.concatenate([h, np.zeros(len(w) - len(h), np.uint64)])  # one place per word
        inside = np.arange(len(w)) - np.repeat(total - sizes, sizes)
        stay = inside < np.repeat(counts, sizes)
        for i in np.flatnonzero((sizes > 0) & (sizes < WIDTH)).tolist():
            a, x = int(total[i] - sizes[i]), int(sizes[i])
            for v in w[a: int(total[i])].tolist():
                x = (x * int(_M) + v) % 2**64
            h[a] = x
        return mixed(h[stay]), counts


def sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = Words(texts).shingles()
    return [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])] if texts else []


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """COORDINATES minima per text; rows of texts without shingles are meaningless."""
    out = np.zeros((len(counts), COORDINATES), np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(COORDINATES):
            out[full, k] = np.minimum.reduceat(x * _FACTOR[k], starts)
    return out
