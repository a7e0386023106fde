"""Words of many texts at once, and their XXH64, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Inputs of so many bytes or more go through four lanes in XXH64; words are seldom as long.
LANES = 32
#: What str.split() cuts at, by code point; none is higher.
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each stretch of ``data``, those of one length at a time."""
    out, sizes = np.empty(len(starts), np.uint64), ends - starts
    padded = data + bytes(8)
    # every place as the number that begins there
    ones, fours, eights = (np.ndarray(len(data) + 1, kind, padded, 0, (1,)) for kind in ("u1", "<u4", "<u8"))
    for size in np.flatnonzero(np.bincount(np.minimum(sizes, LANES), minlength=LANES)[:LANES]).tolist():
        which = np.flatnonzero(sizes == size)
        at, end = starts[which], size - size % 8
        h = np.full(len(which), _P5 + np.uint64(size), np.uint64)
        for k in range(0, end, 8):
            h = _turned(h ^ (_turned(eights[at + k] * _P2, 31) * _P1), 27) * _P1 + _P4
        if size % 8 >= 4:
            h = _turned(h ^ (fours[at + end].astype(np.uint64) * _P1), 23) * _P2 + _P3
            end += 4
        for k in range(end, size):
            h = _turned(h ^ (ones[at + k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[which] = h ^ (h >> np.uint64(32))
    for i in np.flatnonzero(sizes >= LANES).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _bounds(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word, as str.split() finds them."""
    space = np.ones(len(points) + 2, bool)
    space[1:-1] = _SPACE[np.minimum(points, len(_SPACE) - 1)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words in each text; start, end and XXH64 of each word, in lower case). Places are
    code points, counted through all texts with one between two texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = "\n".join(texts)
    points = _points(whole)
    starts, ends = _bounds(points)
    low = whole.lower()
    if len(low) == len(whole):
        first, last = starts, ends
    else:  # some characters become two, of no word's edge
        first, last = _bounds(_points(low))
    data = low.encode("utf-8", "surrogatepass")
    if len(data) > len(low):
        points = _points(low)
        past = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=past[1:])
        first, last = past[first], past[last]
    begins = np.cumsum(sizes + 1) - sizes - 1
    counts = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
    return counts, starts, ends, xxh64(data, first, last)
