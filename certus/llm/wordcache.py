"""A bounded memory of the ids of words, for encoders whose words are independent."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain, filterfalse

import numpy as np

#: Characters of texts whose words are learned at once.
TOGETHER = 1 << 20


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.fromiter(ids, "<u4").tobytes()


class WordCache:
    """Word to packed ids. encode takes words that aren't known yet.

    Two generations: a full one becomes the old one, and a word that is used
    again moves back from it; what isn't used for a generation is forgotten.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 800_000):
        self.encode, self.half, self.known, self.old = encode, limit // 2, {}, {}

    def learn(self, texts: list[list[str]]) -> None:
        """Sees to it that the words of some texts are known."""
        new = set(filterfalse(self.known.__contains__, chain.from_iterable(texts)))
        if len(self.known) + len(new) > self.half:
            self.known, self.old = {}, self.known
            new = set(chain.from_iterable(texts))
        back = self.old.keys() & new
        self.known.update((w, self.old[w]) for w in back)
        if new := list(new - back):
            self.known.update(zip(new, self.encode(new), strict=True))

    def ids(self, words: list[str]) -> bytes:
        """The ids of the words, one after another. Long texts are learned in parts."""
        if len(words) > self.half // 2:
            half = len(words) // 2
            return self.ids(words[:half]) + self.ids(words[half:])
        self.learn([words])
        return b"".join(map(self.known.__getitem__, words))

    def ids_of_all(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each of several texts' words."""
        if sum(map(len, texts)) > self.half // 2:
            return [self.ids(t) for t in texts]
        self.learn(texts)
        return [b"".join(map(self.known.__getitem__, t)) for t in texts]


def together(texts: list[str]) -> list[list[str]]:
    """The texts in order, in groups of about TOGETHER characters."""
    out, size = [], TOGETHER
    for t in texts:
        if size >= TOGETHER:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out
