"""Scores of a query against a sentence with at most one edit.

A window of the sentence may equal the query, or differ from it by one changed,
missing or extra character. Twice the matching characters, less a penalty for the
edit and its place in the query, is the window's score; a sentence scores the best
of its windows, and null without one. Because penalties stop falling at the fifth
character, a query of any length has at most ten different scores, each reached by
a set of LIKE patterns: the best score is one CASE, tested from the top down.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def substitution_penalty(position: Column | int) -> Column:
    return F.greatest(6 - _col(position), F.lit(1))


def insertion_deletion_penalty(position: Column | int) -> Column:
    return F.greatest(12 - 2 * _col(position), F.lit(2))


def exact_score(length: Column | int) -> Column:
    return 2 * _col(length)


def substitution_score(length: Column | int, position: Column | int) -> Column:
    return 2 * (_col(length) - 1) - substitution_penalty(position)


def extra_character_score(length: Column | int, position: Column | int) -> Column:
    return 2 * (_col(length) - 1) - insertion_deletion_penalty(position)


def missing_character_score(length: Column | int, position: Column | int) -> Column:
    return 2 * _col(length) - insertion_deletion_penalty(position)


def _col(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


#: What stands for no score where there is no null.
NONE = -(1 << 30)
#: The kinds of match that a query may ask for.
KINDS = ("exact", "missing", "substitution", "extra")


def patterns(query: str, kinds: tuple[str, ...] = KINDS) -> dict[int, list[str]]:
    """score -> LIKE patterns that reach it, best score first.

    A character missing before the first or after the last would leave the query
    itself in the sentence, so those places are the exact match. A query of one
    character has no extra one. Normalised text holds no character that LIKE reads
    specially.
    """
    n = len(query)
    tiers: dict[int, list[str]] = {}

    def add(score: int, pattern: str) -> None:
        found = tiers.setdefault(score, [])
        if pattern not in found:
            found.append(pattern)

    if n and "exact" in kinds:
        add(2 * n, f"%{query}%")
    for p in range(1, n + 1):
        left, right = query[: p - 1], query[p:]
        if "missing" in kinds and p > 1:
            add(2 * n - max(12 - 2 * p, 2), f"%{left}_{query[p - 1 :]}%")
        if "substitution" in kinds:
            add(2 * (n - 1) - max(6 - p, 1), f"%{left}_{right}%")
        if "extra" in kinds and n > 1:
            add(2 * (n - 1) - max(12 - 2 * p, 2), f"%{left}{right}%")
    return dict(sorted(tiers.items(), reverse=True))


def _any(sentence: str, likes: list[str]) -> Column:
    listed = ", ".join("'" + p.replace("'", "''") + "'" for p in likes)
    return F.expr(f"`{sentence}` LIKE ANY ({listed})")


def best_match(query: str, sentence: str = "normalized_sentence", kinds: tuple[str, ...] = KINDS) -> Column:
    """The best score of a normalised query against a column; null if none. Zero and
    negative scores are scores."""
    out = None
    for score, likes in patterns(query, kinds).items():
        test = _any(sentence, likes)
        out = F.when(test, F.lit(score)) if out is None else out.when(test, F.lit(score))
    if out is None:
        return F.lit(None).cast("int")
    return F.when(F.col(sentence) != "", out).cast("int")


def best_match_columns(query: Column, sentence: Column) -> Column:
    """The same for a query that is a column too, for batches of queries."""
    n = F.length(query)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def best(lowest: int, pattern, score) -> Column:
        fits = F.filter(places, lambda p: (p >= lowest) & F.like(sentence, pattern(p)))
        return F.array_max(F.transform(fits, lambda p: score(n, p)))

    left, at, after = (lambda p: F.substring(query, F.lit(1), p - 1)), (lambda p: F.substring(query, p, n)), (lambda p: F.substring(query, p + 1, n))
    missing = best(2, lambda p: F.concat(F.lit("%"), left(p), F.lit("_"), at(p), F.lit("%")), missing_character_score)
    changed = best(1, lambda p: F.concat(F.lit("%"), left(p), F.lit("_"), after(p), F.lit("%")), substitution_score)
    extra = F.when(n > 1, best(1, lambda p: F.concat(F.lit("%"), left(p), after(p), F.lit("%")), extra_character_score))
    inexact = F.greatest(missing, changed, extra)
    score = F.when(F.contains(sentence, query), exact_score(n)).otherwise(inexact)
    return F.when((n > 0) & (F.length(sentence) > 0), score).cast("int")


def split_filter(query: str, sentence: str = "normalized_sentence") -> Column:
    """Cheap test that no match fails: one edit spares one half of the query."""
    half = len(query) // 2
    if not half:
        return F.lit(True)
    s = F.col(sentence)
    return s.contains(query[:half]) | s.contains(query[half:])


def partition_filter(query: str, sentence: str = "normalized_sentence") -> Column:
    """The same test at every split of the query, the middle one first."""
    n = len(query)
    s, out = F.col(sentence), F.lit(True)
    for k in sorted(range(1, n), key=lambda k: abs(2 * k - n)):
        out = out & (s.contains(query[:k]) | s.contains(query[k:]))
    return out


def split_filter_columns(query: Column, sentence: Column) -> Column:
    """``split_filter`` for a query that is a column."""
    half = (F.length(query) / 2).cast("int")
    return (half == 0) | F.contains(sentence, F.substring(query, F.lit(1), half)) | F.contains(sentence, F.substring(query, half + 1, F.length(query)))


#: Pairs whose sentences are held as code points at a time.
TOGETHER = 4096


def score_sentences(query: str, sentences: list[str]) -> np.ndarray:
    """The best score of a query in each of many sentences, all normalised; ``NONE``
    where there is no match.

    The sentences stand behind each other in one array of code points. Two numbers
    for each place, how much of the query begins there and how much of it ends there,
    say of every window whether one edit makes it the query, and where: an edit as late
    as possible costs least. Each of those numbers takes one pass a character of the query.
    """
    n, sizes = len(query), np.fromiter(map(len, sentences), np.int64, len(sentences))
    out = np.full(len(sentences), NONE, np.int64)
    kept = np.flatnonzero(sizes)
    if not n or not len(kept):
        return out
    text = np.frombuffer("".join(sentences).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.frombuffer(query.encode("utf-32-le", "surrogatepass"), np.uint32)
    total = len(text)
    padded = np.concatenate([text, np.full(n + 1, 0xFFFFFFFF, np.uint32)])
    kind = np.uint8 if n < 256 else np.int32
    begins, ends = np.zeros(total + n + 2, kind), np.zeros(total + n + 2, kind)
    alive = np.ones(total, bool)
    for k in range(n):  # begins[i]: the query's first characters from place i on
        alive &= padded[k : k + total] == code[k]
        if not alive.any():
            break
        begins[:total] += alive
    alive = np.ones(total, bool)
    for k in range(min(n, total)):  # ends[i]: the query's last characters before place i
        alive[k:] &= text[: total - k] == code[n - 1 - k]
        alive[:k] = False
        if not alive.any():
            break
        ends[1 : total + 1] += alive
    begins, ends = begins.astype(np.int32), ends.astype(np.int32)
    stops = np.repeat(np.cumsum(sizes), sizes)  # where the sentence of a place ends
    at = np.arange(total)
    p = np.minimum(begins[:total] + 1, n)  # the latest place of the query at which an edit may be
    best = np.full(total, NONE, np.int64)

    def offer(size: int, fits: np.ndarray, score: np.ndarray) -> None:
        np.maximum(best, np.where(fits & (at + size <= stops), score, NONE), out=best)

    offer(n, begins[:total] >= n, np.full(total, 2 * n))
    offer(n, (begins[:total] < n) & (ends[n : n + total] >= n - p), 2 * (n - 1) - np.maximum(6 - p, 1))
    # the character that the query lacks stands before its p-th
    offer(n + 1, (p >= 2) & (ends[n + 1 : n + 1 + total] >= n + 1 - p), 2 * n - np.maximum(12 - 2 * p, 2))
    if n > 1:
        offer(n - 1, ends[n - 1 : n - 1 + total] >= n - p, 2 * (n - 1) - np.maximum(12 - 2 * p, 2))
    out[kept] = np.maximum.reduceat(best, (np.cumsum(sizes) - sizes)[kept])
    return out


def score_pair(query: str, sentence: str) -> int | None:
    """The score of one query and one sentence, both normalised."""
    found = int(score_sentences(query, [sentence])[0])
    return None if found == NONE else found


def pair_score() -> Callable[..., Column]:
    """``score_sentences`` over two columns: the sentences of one query are scored together."""

    @F.arrow_udf("int")
    def score(query: pa.Array, sentence: pa.Array) -> pa.Array:
        queries, sentences = query.dictionary_encode(), sentence.to_pylist()
        of, out = queries.indices.fill_null(-1).to_numpy(), np.full(len(sentences), NONE, np.int64)
        order = np.argsort(of, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            if len(rows) and of[rows[0]] >= 0:
                own = queries.dictionary[int(of[rows[0]])].as_py()
                for lo in range(0, len(rows), TOGETHER):
                    part = rows[lo : lo + TOGETHER]
                    out[part] = score_sentences(own, [sentences[r] or "" for r in part])
        return pa.array(out.astype(np.int32), pa.int32(), mask=out == NONE)

    return score
