"""Hashed features of many words at once, and a bounded table of what they give."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all words end to end, where each begins, how long each is)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return points, np.cumsum(lengths) - lengths, lengths


def windows(points: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A hash of every run of ``n`` code points; equal runs under another salt differ."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(size, salt * int(_MIX) & (1 << 64) - 1, np.uint64)
    for k in range(n):
        h = (h ^ points[k : k + size]) * _STEP
    return h


def buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = hashes ^ (hashes >> np.uint64(31))
    return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def inner(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of every character n-gram that lies within a word."""
    h = windows(points, n, salt)
    owner = np.repeat(np.arange(len(lengths)), lengths)[: len(h)]
    ends = np.repeat(starts + lengths, lengths)[: len(h)]
    within = np.arange(len(h)) + n <= ends
    return h[within], owner[within]


class WordTable:
    """Rows of numbers for words, made for many words at a time and kept for the
    next text; emptied when it has too many words or too long ones."""

    def __init__(self, width: int, make: Callable[[list[str]], np.ndarray], entries: int = 200_000, chars: int = 8_000_000):
        self._make, self._entries, self._chars = make, entries, chars
        self._rows = np.empty((entries, width))
        self._clear()

    def _clear(self) -> None:
        self._slots: dict[str, int] = {}
        self._held = 0

    def look_up(self, words: list[str]) -> np.ndarray:
        get = self._slots.get
        slots = np.array([get(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new = list(dict.fromkeys([words[i] for i in missing.tolist()]))
            size = sum(map(len, new))
            if len(self._slots) + len(new) > self._entries or self._held + size > self._chars:
                if self._slots:
                    self._clear()
                    return self.look_up(words)
                if len(new) > 1:  # more than the table holds: in two parts
                    half = len(words) // 2
                    return np.concatenate([self.look_up(words[:half]), self.look_up(words[half:])])
            at = len(self._slots)
            self._rows[at : at + len(new)] = self._make(new)
            self._slots.update(zip(new, range(at, at + len(new))))
            self._held += size
            slots[missing] = [self._slots[words[i]] for i in missing.tolist()]
        return self._rows[slots]
