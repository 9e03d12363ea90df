"""Words of many texts at once: runs of letters and digits, A-Z lowered, found and hashed as arrays of code points."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


_PARTS: list[np.ndarray] = []


def _parts() -> np.ndarray:
    """Which code points are letters or digits, made once a worker."""
    if not _PARTS:
        _PARTS.append(np.array([chr(c).isalnum() for c in range(sys.maxunicode + 1)]))
    return _PARTS[0]


@dataclass(frozen=True)
class Read:
    """Words of texts in order: where each begins and ends in `low` (the texts, lowered, each with a line end behind it), its hash; where
    lines end, and texts."""

    low: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hashes: np.ndarray
    other: np.ndarray
    lines: np.ndarray
    texts: np.ndarray

    def distinct(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words, and for each of them its hash and how often it stands there; of each place the number of its word; and places whose
        word is another than the one of that number, which has its hash: they stand behind the words again, without occurrences."""
        known, one, group, n = np.unique(self.hashes, return_index=True, return_inverse=True, return_counts=True)
        hidden = np.flatnonzero(self.other != self.other[one][group])
        shown, low = np.concatenate([one, hidden]), self.low.tobytes().decode("utf-32-le")
        words = [low[a:b] for a, b in zip(self.first[shown].tolist(), self.last[shown].tolist(), strict=True)]
        return pa.array(words, pa.string()), self.hashes[shown], np.pad(n, (0, len(hidden))), group, hidden

    def text(self) -> np.ndarray:
        """The number of each word's text."""
        return np.searchsorted(self.texts, self.first, "right")

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its line in its text and its number in that line."""
        line = np.searchsorted(self.lines, self.first)
        begins = np.concatenate([[0], self.texts[:-1]]) if len(self.texts) else self.texts
        before = np.searchsorted(self.lines, begins)
        first_of_line = np.searchsorted(self.first, np.concatenate([[0], self.lines]))
        return line - before[self.text()], np.arange(len(self.first)) - first_of_line[line]


class Reader:
    """A word's hash is the sum over its characters of a number of the character times one of its place; no hash is zero."""

    def __init__(self, seed: int = 0):
        self.draw = np.random.default_rng([11, seed])
        self.of_character = self.draw.integers(1, 1 << 64, sys.maxunicode + 1, dtype=np.uint64)
        self.of_place = [self._odd(64) for _ in range(2)]

    def _odd(self, n: int) -> np.ndarray:
        return self.draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def read(self, texts: list[str]) -> Read:
        c = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)
        c = np.where((c >= 65) & (c <= 90), c + 32, c)
        part = _parts()[c]
        first = np.flatnonzero(part & ~np.concatenate([[False], part[:-1]]))
        last = np.flatnonzero(part & ~np.concatenate([part[1:], [False]])) + 1
        at, size = np.flatnonzero(part), last - first
        while len(self.of_place[0]) < size.max(initial=0):
            self.of_place = [np.concatenate([f, self._odd(len(f))]) for f in self.of_place]
        begins = np.cumsum(size) - size
        place, value = np.arange(len(at)) - np.repeat(begins, size), self.of_character[c[at]]
        w, other = (np.add.reduceat(value * f[place], begins) if len(begins) else np.zeros(0, np.uint64) for f in self.of_place)
        w[w == 0] = 1
        return Read(c, first, last, w, other, np.flatnonzero(c == 10), np.cumsum([len(t) + 1 for t in texts]))


def starts(texts: list[str]) -> np.ndarray:
    """How many words each text has."""
    part = _parts()[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)]
    first = np.flatnonzero(part & ~np.concatenate([[False], part[:-1]]))
    return np.diff(np.searchsorted(first, np.cumsum([0] + [len(t) + 1 for t in texts])))


def slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of texts that have about that many characters together."""
    begin = n = 0
    for k, t in enumerate(texts, 1):
        n += len(t)
        if n > most or k == len(texts):
            yield begin, k
            begin, n = k, 0
