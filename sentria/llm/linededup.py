"""Substring deduplication by hashing lines or paragraphs, and the phrases in them.

Units are normalised and digested where they lie; digests are grouped over the
whole corpus; of equal units the earliest ranked stays and all others go, each
with its place in the original text.

A passage that stands within a line is no line, so hashing lines alone leaves it.
Therefore runs of ``PHRASE`` words are units too. Of the runs that begin at
``APART`` words in a row the one with the lowest digest is taken, whatever stands
before or after: two texts that share PHRASE + APART - 1 words in a row have taken
the same runs there, and these cover what is shared but for fewer than APART words
at either end.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.llm import wordhash
from sentria.llm.common import bounded_batches, free_name, single_texts, slices, text_key, written
from sentria.llm.rolling import lowest, mixed, rolling

#: What parts the units, as text and as it joins them again.
BREAKS = {"line": "\n", "paragraph": "\n\n"}
#: Units of fewer words stay, unless the caller asks for less; op9 and the pipeline take all that are not empty.
MIN_WORDS = 8
#: Words of a phrase, and how far apart the beginnings of two may lie.
PHRASE, APART = 16, 10
#: Characters of texts that are looked at together, about.
GROUP = 1 << 19

_SPACES = re.compile(r"[ \t-\r]+")
_CONTROLS = re.compile(r"[\t-\r]")


def normalise(unit: str) -> str:
    """Lower case, runs of ASCII white space as one space, none at the ends."""
    low = unit.lower()
    if "  " in low or _CONTROLS.search(low):
        low = _SPACES.sub(" ", low)
    return low.strip(" ")


def _units(texts: DataFrame, unit: str, min_words: int) -> DataFrame:
    """(id, text_key, pos, start_char, end_char, words, digest) of each unit of at least ``min_words``."""
    id_type = texts.schema["id"].dataType.simpleString()
    gap = BREAKS[unit]

    def run(batches):
        for batch in slices(batches):
            owners, rows = [], []
            for row, text in enumerate(batch.column(2)):
                at = 0
                for pos, u in enumerate(text.as_py().split(gap)):
                    clean = normalise(u)
                    words = clean.count(" ") + 1 if clean else 0
                    if words >= min_words:
                        owners.append(row)
                        rows.append((pos, at, at + len(u), words, hashlib.blake2b(clean.encode(), digest_size=16).digest()))
                    at += len(u) + len(gap)
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            owners = pa.array(owners, pa.int32())
            yield pa.record_batch(
                [batch.column(0).take(owners), batch.column(1).take(owners)] + [pa.array(c, k) for c, k in zip(cols, kinds)],
                names=["id", "text_key", "pos", "start_char", "end_char", "words", "digest"],
            )

    return texts.mapInArrow(run, f"id {id_type}, text_key long, pos int, start_char long, end_char long, words int, digest binary")


def _repeated_units(texts: DataFrame, unit: str, min_words: int) -> DataFrame:
    found = written(_units(texts, unit, min_words), "units")
    # counts and minima are combined before the shuffle, so a very common unit is a few rows there
    groups = found.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("id", "text_key", "pos")).alias("first"))
    groups = written(groups.where("copies > 1"), "groups")
    # both sides are plain tables: a partition with a very common unit can be split
    return found.join(groups, "digest").where(F.struct("id", "text_key", "pos") != F.col("first"))


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per unit to remove: (id, text_key, pos, start_char, end_char, words, first_id,
    first_pos, copies).

    ``pos``: number of the unit in its text, from 0; ``start_char`` and ``end_char``:
    its code points. Rank is (id, text_key, pos): the unit with the lowest stays,
    wherever else its like stands, in the same text or another. ``copies`` counts
    all of them, the one that stays included. Null and empty texts have no units;
    an empty table gives an empty result; rows repeated under one id are one text,
    whose units count once; other texts under the same id are told apart by
    ``text_key``. Rows without an id have no units, for nothing could say where
    they are. Other columns are not read.
    """
    gone = _repeated_units(single_texts(docs, id_col, text_col), unit, min_words)
    return gone.select(F.col("id").alias(id_col), "text_key", "pos", "start_char", "end_char", "words", F.col("first.id").alias("first_id"), F.col("first.pos").alias("first_pos"), "copies")


def _taken(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, text, first digest) of each phrase taken of the texts that have
    ``sizes`` of these words. Windows that reach from one into the next are left out."""
    found, ends = mixed(rolling(codes, PHRASE)), np.cumsum(sizes)
    begins = ends - sizes
    full = sizes >= PHRASE + APART - 1
    runs = np.where(full, sizes - (PHRASE + APART - 2), 0)  # of APART windows in a row, within a text
    at = np.zeros(0, np.int64)
    if full.any():
        first = np.repeat(begins - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        inside = np.zeros(len(found) - APART + 1, bool)
        inside[first] = True
        at = lowest(found, APART, inside)
    few = [begins[i] + lowest(w := found[begins[i] : ends[i] - PHRASE + 1], len(w)) for i in np.flatnonzero((sizes >= PHRASE) & ~full)]
    if few:
        at = np.sort(np.concatenate([at, *few]))
    return at, np.searchsorted(ends, at, "right"), found[at]


def digests(texts: list[str]) -> np.ndarray:
    """The first digest of each phrase taken of the texts, in order."""
    sizes, _, _, codes = wordhash.words(texts)
    return _taken(np.maximum(codes >> np.uint64(1), np.uint64(1)), sizes)[2]


def phrases(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(text, start, end, end of the word before, start of the word after, first digest,
    second digest) of each phrase taken of the texts, in order."""
    sizes, starts, stops, codes = wordhash.words(texts)
    codes = np.maximum(codes >> np.uint64(1), np.uint64(1))
    at, owner, d1 = _taken(codes, sizes)
    d2 = mixed(rolling(mixed(codes), PHRASE)[at]) if len(at) else d1
    ends, chars = np.cumsum(sizes), np.fromiter(map(len, texts), np.int64, len(texts))
    origin = (np.cumsum(chars + 1) - chars - 1)[owner]
    last = at + PHRASE - 1
    before = np.where(at > (ends - sizes)[owner], stops[at - 1] - origin, 0)
    after = np.where(last + 1 < ends[owner], np.append(starts, 0)[last + 1] - origin, chars[owner])
    return owner, starts[at] - origin, stops[last] - origin, before, after, d1, d2


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of neighbours that have about ``GROUP`` characters together."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.as_py())
        size += len(held[-1])
        if size >= GROUP:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _digests(texts: DataFrame) -> DataFrame:
    """(d1): the phrases of every text, by their first digest alone."""

    def run(batches):
        for batch in slices(batches):
            for _, held in _groups(batch.column(0)):
                yield pa.record_batch([pa.array(digests(held).view(np.int64))], names=["d1"])

    return texts.select("text").mapInArrow(run, "d1 long")


_PLACES = ("start_char", "end_char", "before", "after", "d1", "d2")


def _phrases(texts: DataFrame) -> DataFrame:
    """The phrases of every text with their places."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            for first, held in _groups(batch.column(2)):
                owner, *cols = phrases(held)
                rows = pa.array(first + owner, pa.int64())
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(c.view(np.int64)) for c in cols)], names=["id", "text_key", *_PLACES])

    return texts.mapInArrow(run, f"id {id_type}, text_key long, " + ", ".join(f"{c} long" for c in _PLACES))


#: What a stretch is: a repeated line; a phrase that ranks earlier elsewhere, or in
#: the same text; the first place of a repeated phrase, in texts with the latter.
LINE, FAR, NEAR, KEPT = range(4)


def _repeated_phrases(texts: DataFrame) -> DataFrame:
    """(id, text_key, start_char, end_char, first_id, kind) of each phrase whose like
    ranks earlier, and, of texts that repeat their own phrases, of those that stay.

    The first pass counts 64-bit digests and no more; only phrases that it finds
    twice are looked at again, with places and another 64 bits.
    """
    twice = written(_digests(texts).groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1"), "digests")
    # both sides without an order of their own: a partition with a very common phrase can be split
    hits = written(_phrases(texts).join(twice, "d1"), "phrases")
    place = F.struct("id", "text_key", "start_char")
    first = hits.groupBy("d1", "d2").agg(F.min(F.struct("id", "text_key", "start_char", "before", "after")).alias("first"), F.max(place).alias("last"))
    first = first.where(F.struct("first.id", "first.text_key", "first.start_char") < F.col("last")).drop("last")
    first = written(first, "first")
    own = (F.col("first.id") == F.col("id")) & (F.col("first.text_key") == F.col("text_key"))
    gone = hits.join(first, ["d1", "d2"]).where(place != F.struct("first.id", "first.text_key", "first.start_char"))
    gone = gone.select("id", "text_key", "start_char", "end_char", F.col("first.id").alias("first_id"), F.when(own, NEAR).otherwise(FAR).alias("kind"))
    gone = written(gone, "gone")
    periodic = gone.where(F.col("kind") == NEAR).select("id", "text_key").distinct()
    stay = first.select("first.*").join(periodic, ["id", "text_key"], "left_semi")
    return gone.unionByName(stay.select("id", "text_key", F.col("before").alias("start_char"), F.col("after").alias("end_char"), F.col("id").alias("first_id"), F.lit(KEPT).alias("kind")))


def _without(start: int, end: int, kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a stretch beside those that stay (sorted)."""
    out = []
    for a, b in kept[max(0, bisect_right(kept, (start,)) - 1) :]:
        if a >= end:
            break
        if b > start:
            if a > start:
                out.append((start, a))
            start = b
    return out + [(start, end)] * (start < end)


def joined(spans: list[tuple]) -> list[tuple[int, int, int, list]]:
    """(start, end, units, first ids) of what to remove, from (start, end, first_id, kind).

    A phrase is never removed where a phrase of the same text stays: text that goes
    round in circles keeps its first round, whole phrases of it.
    """
    kept: list[list[int]] = []
    for start, end, *_ in sorted(s for s in spans if s[3] == KEPT):
        if kept and start <= kept[-1][1]:
            kept[-1][1] = max(end, kept[-1][1])
        else:
            kept.append([start, end])
    fixed = [tuple(k) for k in kept]
    pieces = []
    for start, end, first, kind in spans:
        if kind != KEPT:
            pieces += [(a, b, first) for a, b in (_without(start, end, fixed) if kind == NEAR else [(start, end)])]
    out: list[tuple[int, int, int, set]] = []
    for start, end, first in sorted(pieces):
        if out and start <= out[-1][1]:
            was = out[-1]
            out[-1] = (was[0], max(end, was[1]), was[2] + 1, was[3] | {first})
        else:
            out.append((start, end, 1, {first}))
    return [(a, b, n, sorted(firsts)) for a, b, n, firsts in out]


def _spans(docs: DataFrame, id_col: str, text_col: str, unit: str, min_words: int) -> DataFrame:
    """(id, text_key, spans): the stretches to remove of each text that has any."""
    bounded_batches(docs.sparkSession)
    texts = single_texts(docs, id_col, text_col)
    lines = _repeated_units(texts, unit, min_words).select("id", "text_key", "start_char", "end_char", F.col("first.id").alias("first_id"), F.lit(LINE).alias("kind"))
    gone = lines.unionByName(_repeated_phrases(texts))
    lists = gone.groupBy("id", "text_key").agg(F.collect_set(F.struct("start_char", "end_char", "first_id", "kind")).alias("found"))
    id_type = texts.schema["id"].dataType.simpleString()
    def run(batches):
        for batch in slices(batches):
            ids, found = batch.column(0), batch.column(2)
            ends = np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            pieces = list(zip(*(c.to_pylist() for c in found.flatten().flatten())))
            out = [joined(pieces[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
            starts, stops, units, firsts = zip(*rows) if (rows := list(chain.from_iterable(out))) else [()] * 4
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(list(chain.from_iterable(firsts)), ids.type))
            spans = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(units, pa.int32()), lists], ["start_char", "end_char", "units", "first_ids"])
            yield pa.record_batch([ids, batch.column(1), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), spans)], names=["id", "text_key", "spans"])

    found = lists.mapInArrow(run, f"id {id_type}, text_key long, spans array<struct<start_char: long, end_char: long, units: int, first_ids: array<{id_type}>>>")
    return found.where(F.size("spans") > 0)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per stretch to remove: (id, text_key, start_char, end_char, units, first_ids).

    Repeated lines (or paragraphs) and repeated phrases, joined where they overlap;
    ``first_ids`` are the texts in which the units of the stretch stay. Rank is
    (id, text_key, place). Of phrases that a text itself repeats the first places
    stay whole. A text's stretches are gathered by text, so no more of them meet
    than the text has units. Null and empty texts have none; an empty table gives
    an empty result; rows repeated under one id are one text, other texts under
    the same id have another ``text_key``; rows without an id have no stretches.
    """
    return _spans(docs, id_col, text_col, unit, min_words).select(F.col("id").alias(id_col), "text_key", F.inline("spans"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans and the spaces after them. A line that is all cut
    goes with its end."""
    out, at = "", 0
    for start, end in spans:
        out += text[at:start]
        at = end
        while at < len(text) and text[at] == " ":
            at += 1
        if not out or out.endswith("\n"):
            if at < len(text) and text[at] == "\n":
                at += 1
            elif at == len(text):
                out = out[:-1]
    return out + text[at:]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = MIN_WORDS, spans_col: str | None = None) -> DataFrame:
    """``docs`` with the repeated stretches taken out of their texts.

    All rows and columns stay, rows repeated under one id each with the same text.
    A text that loses nothing is left as it is, byte for byte, and so is one without
    an id. ``spans_col``: also what went, an array of (start_char, end_char, units,
    first_ids) with places in code points of the original text.
    """
    gone = _spans(docs, id_col, text_col, unit, min_words)
    lost, key, of_text = (free_name(docs, c) for c in ("_lost", "_lost_id", "_lost_text"))
    lists = gone.select(F.col("id").alias(key), F.col("text_key").alias(of_text), F.col("spans").alias(lost))
    met = docs.join(lists, (F.col(id_col) == F.col(key)) & (text_key(text_col) == F.col(of_text)), "left").drop(key, of_text)
    at = met.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            texts, lost_in = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1)
            sizes = lost_in.value_lengths().fill_null(0).to_pylist()
            spans = list(zip(*(c.to_pylist() for c in lost_in.flatten().flatten()[:2])))
            new = [cut(t, spans[e - n : e]) if n else t for t, n, e in zip(texts, sizes, accumulate(sizes))]
            yield batch.set_column(at, batch.field(at), pa.array(new, batch.column(at).type))

    out = met.mapInArrow(run, met.schema)
    if spans_col:
        return out.withColumn(spans_col, F.coalesce(lost, F.array().cast(out.schema[lost].dataType))).drop(lost)
    return out.drop(lost)
