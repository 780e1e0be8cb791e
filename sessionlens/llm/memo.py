"""A worker's memo of what was worked out for pieces of text, bounded in bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

LIMIT_BYTES = 48 << 20
LONGEST = 256
"""Longer pieces are worked out anew each time: they seldom come back, and one of them may be a whole document."""

ENTRY_BYTES = 300
"""What the objects of an entry take beside their content, at most."""


def tuple_bytes(value: tuple) -> int:
    return sum(map(len, value))


class Memo:
    """Values of pieces; when it is full, those learned first stay, mostly the frequent ones.

    `content` gives the bytes of a value; values are tuples of bytes unless it says otherwise.
    """

    def __init__(self, limit: int = LIMIT_BYTES, content: Callable[..., int] = tuple_bytes):
        self.limit, self.content, self.size, self.store, self.passing = limit, content, 0, {}, []

    def taken(self, entries: dict) -> int:
        """Bytes that entries take, at most (a character takes up to four)."""
        return ENTRY_BYTES * len(entries) + 4 * sum(map(len, entries)) + sum(map(self.content, entries.values()))

    def make_room(self) -> None:
        """Forget the long pieces of the last call, and all but the first third of a full memo."""
        for p in self.passing:
            del self.store[p]
        self.passing = []
        if self.size > self.limit:
            share = self.limit / 3 / self.size
            self.store = dict(islice(self.store.items(), int(len(self.store) * share)))
            self.size = self.taken(self.store)
            if self.size > self.limit:  # unlike sizes
                self.store, self.size = {}, 0

    def fetch(self, pieces: Iterable, learn: Callable[[list], dict]) -> dict:
        """A table with the values of all pieces, good until the next call; those it lacks are learned together."""
        self.make_room()
        store = self.store
        missing = [p for p in set(pieces) if p not in store]
        if missing:
            new = learn(missing)
            store.update(new)
            self.passing = [p for p in missing if len(p) > LONGEST]
            self.size += self.taken(new) - self.taken({p: new[p] for p in self.passing})
        return store
