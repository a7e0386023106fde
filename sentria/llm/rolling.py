"""Karp-Rabin hashes of all windows of a sequence of codes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**n; kept, and made anew in double the length when too short."""
    held = _known.get(base)
    if held is None or len(held) <= n:
        size = max(1 << 12, 2 * n)
        held = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]), dtype=np.uint64)
        if size <= 1 << 22:
            _known[base] = held
    return held[: n + 1]


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``width`` codes (uint64, modulo 2**64)."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers(_BASE, len(codes) - 1), out=sums[1:])
    return (sums[width:] - sums[:-width]) * _powers(_INVERSE, n - 1)  # each window from the same power


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def lowest(values: np.ndarray, width: int, among: np.ndarray | None = None) -> np.ndarray:
    """Places whose value is the least of some ``width`` neighbours, ties all. ``among``:
    whether the neighbours from each place on count; those of other places are left out."""
    least = sliding(values, width, np.minimum)
    if among is not None:
        least = np.where(among, least, 0)
    ends = np.zeros(width - 1, values.dtype)  # values are not negative
    return np.flatnonzero(sliding(np.concatenate([ends, least, ends]), width, np.maximum) == values)


def mixed(codes: np.ndarray) -> np.ndarray:
    """Token numbers spread over 64 bits, so that sums of few of them differ."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))
