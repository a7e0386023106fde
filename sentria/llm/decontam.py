"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items meet on shared seeds: Karp-Rabin hashes of ``min_match``
tokens. For each pair that shares one, running Karp-Rabin matching repeatedly
marks the longest matches that overlap nothing marked before. Tiles may lie in any
order, so a passage whose sentences were rearranged is covered like the original.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sentria.llm.common import free_name, slices, written
from sentria.llm.rolling import mixed, rolling

MIN_MATCH, COVERAGE = 5, 0.5
#: A benchmark of up to this many characters is sent to every task; a larger one
#: meets the texts in a shuffle instead.
BROADCAST_CHARS = 16_000_000

_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _free(marked: np.ndarray, width: int) -> np.ndarray:
    """True for windows of ``width`` with nothing marked inside."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return sums[width:] == sums[:-width]


def tiling(text: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (place in text, place in item, length) of two code sequences.

    The search length starts at the item's and falls to ``min_match``. At each
    length all windows free of marks are matched by hash, checked and extended as
    far as they agree; the longest is marked first, ties by place in the text, then
    in the item. Of a match that meets marks, the free pieces wait for their turn.
    A length is searched again until it marks nothing more.
    """
    out: list[tuple[int, int, int]] = []
    used_t, used_i = np.zeros(len(text), bool), np.zeros(len(item), bool)
    hash_t, hash_i = mixed(text), mixed(item)
    width = max(min_match, min(len(item), len(text)))
    while width >= min_match and len(text) >= width and len(item) >= width:
        ht, hi = rolling(hash_t, width), rolling(hash_i, width)
        free_t, free_i = np.flatnonzero(_free(used_t, width)), np.flatnonzero(_free(used_i, width))
        free_t = free_t[np.isin(ht[free_t], hi[free_i])]
        where: dict[int, list[int]] = {}
        for j in free_i.tolist():
            where.setdefault(int(hi[j]), []).append(j)
        found = []
        covered: dict[int, int] = {}  # diagonal -> end of its last match
        for p in free_t.tolist():
            for q in where.get(int(ht[p]), ()):
                if covered.get(p - q, -1) > p or not np.array_equal(text[p : p + width], item[q : q + width]):
                    continue
                n = width
                while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] and not used_t[p + n] and not used_i[q + n]:
                    n += 1
                covered[p - q] = p + n - width + 1
                found.append((-n, p, q))
        marks = 0
        heapify(found)
        while found:
            n, p, q = heappop(found)
            taken = np.concatenate([[True], used_t[p : p - n] | used_i[q : q - n], [True]])
            if not taken[1:-1].any():
                used_t[p : p - n] = used_i[q : q - n] = True
                out.append((p, q, -n))
                marks += 1
            else:  # what is left between the marks waits for its turn by length
                ends = np.flatnonzero(taken) - 1
                for lo, hi in zip(ends[:-1] + 1, ends[1:]):
                    if hi - lo >= width:
                        heappush(found, (int(lo - hi), p + int(lo), q + int(lo)))
        if not marks:
            width = width // 2 if width // 2 > min_match else min_match if width > min_match else 0
    return sorted(out)


class _Items:
    """Benchmark texts in one process: token numbers, seeds, and each text's codes.
    A text is known by its place in ``rows``, so no two share codes."""

    def __init__(self, rows: list[tuple[int, str]], min_match: int):
        self.ids = [item for item, _ in rows]
        self.numbers: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        seeds, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for place, (_, text) in enumerate(rows):
            codes = np.array([self.numbers.setdefault(t, len(self.numbers)) for t in tokens(text)], np.int64)
            self.codes.append(codes)
            h = np.unique(rolling(mixed(codes), min_match))
            seeds.append(h)
            owners.append(np.full(len(h), place, np.int64))
        found, owned = np.concatenate(seeds), np.concatenate(owners)
        order = np.argsort(found, kind="stable")
        self.seeds, self.owners = found[order], owned[order]

    def read(self, text: str | None) -> np.ndarray:
        get = self.numbers.get
        return np.array([get(t, -1) for t in tokens(text)], np.int64)

    def sharing(self, codes: np.ndarray, min_match: int) -> dict[int, np.ndarray]:
        """place of an item -> places of the text's windows that are a seed of it. A window with
        a token that no item has is no seed and is never looked up."""
        if len(codes) < min_match or not len(self.seeds):
            return {}
        at = np.flatnonzero(_free(codes < 0, min_match))
        if not len(at):
            return {}
        h = rolling(mixed(codes), min_match)[at]
        lo, hi = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
        hit = np.flatnonzero(hi > lo)
        out: dict[int, list[int]] = {}
        for k in hit.tolist():
            for owner in self.owners[lo[k] : hi[k]].tolist():
                out.setdefault(owner, []).append(int(at[k]))
        return {k: np.array(v) for k, v in out.items()}


@lru_cache(maxsize=2)
def _single(text: str, min_match: int) -> _Items:
    return _Items([(0, text)], min_match)


def _score(codes: np.ndarray, item: np.ndarray, places: np.ndarray, min_match: int) -> tuple[int, int]:
    """(tiles, covered tokens), looking only at the tokens that seeds cover."""
    held = np.zeros(len(codes) + 1, bool)
    for k in range(min_match):
        held[places + k] = True
    kept = np.flatnonzero(held[:-1])
    part = codes[kept].copy()
    cuts = np.flatnonzero(np.diff(kept) > 1) + 1  # what was apart must not touch
    part = np.insert(part, cuts, -2)
    tiles = tiling(part, item, min_match)
    return len(tiles), sum(t[2] for t in tiles)


_NAMES = ["item_id", "n_tiles", "covered_tokens", "item_tokens", "coverage"]


def _fields(items: DataFrame) -> str:
    return f"item_id {items.schema['item_id'].dataType.simpleString()}, n_tiles int, covered_tokens int, item_tokens int, coverage double"


def _out(ids: pa.Array, rows: list, id_col: str, item_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 6
    kinds = (item_type, pa.int32(), pa.int32(), pa.int32(), pa.float64())
    names = _NAMES
    return pa.record_batch([ids.take(pa.array(cols[0], pa.int32()))] + [pa.array(c, k) for c, k in zip(cols[1:], kinds)], names=[id_col, *names])


def _measured(benchmark: DataFrame, item_col: str, item_text_col: str, min_match: int) -> tuple[DataFrame, int]:
    """The distinct (item_id, item_text) that can take part, and their characters.

    A text of ``min_match`` tokens has a character for each, and one between any two, so
    shorter ones go, and there are no more rows than characters by that number.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text")).where("item_id is not null")
    items = items.where(F.length("item_text") >= 2 * min_match - 1).distinct()
    return items, items.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).head()[0]


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = COVERAGE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(id, item_id, n_tiles, covered_tokens, item_tokens, coverage) of each row of
    ``docs`` and each benchmark text whose tiles cover at least ``threshold`` of it.

    Tokens are runs of word characters in lower case. Null and empty texts match
    nothing; items of under ``min_match`` tokens, and those without an id, cannot be
    told from chance and take no part. Rows of ``docs`` are judged one by one, by
    their own text: repeated rows give repeated results, and rows without an id
    theirs. Several texts under one item_id are compared one by one; a benchmark row
    repeated whole counts once. Ids are of any type. Either table may be empty. Other columns are not
    read. A benchmark of up to ``broadcast_chars`` characters goes to every task
    whole and the texts are not shuffled; a larger one meets them by seed, with the
    same results.
    """
    items, size = _measured(benchmark, item_col, item_text_col, min_match)
    if size <= broadcast_chars:
        return _by_broadcast(docs, items, id_col, text_col, min_match, threshold)
    key = free_name(docs, "_text")
    hits = _covered_texts(docs.select(text_col), items, text_col, min_match, threshold)
    return docs.select(id_col, _text_key(text_col).alias(key)).join(hits.withColumnRenamed("text_key", key), key).select(id_col, *_NAMES)


def _covering(known: _Items, text: str | None, min_match: int, threshold: float) -> list[tuple]:
    """(item, tiles, covered tokens, item tokens, coverage) of the items that a text covers."""
    codes, out = known.read(text), []
    for place, places in sorted(known.sharing(codes, min_match).items()):
        item = known.codes[place]
        n, covered = _score(codes, item, places, min_match)
        if covered >= threshold * len(item):
            out.append((known.ids[place], n, covered, len(item), covered / len(item)))
    return out


def _sent(items: DataFrame):
    """The benchmark, whose size has been checked, as a broadcast list."""
    return items.sparkSession.sparkContext.broadcast(sorted((r.item_id, r.item_text) for r in items.collect()))


def _by_broadcast(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, min_match: int, threshold: float) -> DataFrame:
    sent = _sent(items)
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(items.schema["item_id"].dataType)

    def run(batches):
        known = _Items(sent.value, min_match)
        for batch in slices(batches):
            rows = [(row, *hit) for row, text in enumerate(batch.column(1)) for hit in _covering(known, text.as_py(), min_match, threshold)]
            yield _out(batch.column(0), rows, id_col, item_type)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {_fields(items)}")


def _text_key(text_col: str):
    """What names a text wherever it stands; null for null. The cost of one pass in the JVM."""
    return F.sha2(F.col(text_col).cast("binary"), 256)


def _seeds(df: DataFrame, key: str, text: str, min_match: int) -> DataFrame:
    """(key, seed, times): the distinct hashes of ``min_match`` tokens of each text."""

    def run(batches):
        for batch in slices(batches):
            owners, found, times = [], [], []
            for row, t in enumerate(batch.column(1)):
                parts = [w.encode() for w in tokens(t.as_py())]
                own = Counter(xxhash.xxh64_intdigest(b" ".join(parts[i : i + min_match])) for i in range(len(parts) - min_match + 1))
                owners += [row] * len(own)
                found += own
                times += own.values()
            seeds = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column(0).take(pa.array(owners, pa.int32())), seeds, pa.array(times, pa.int32())], names=[key, "seed", "times"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, seed long, times int")


def _telling(met: DataFrame, item_seeds: DataFrame, min_match: int, threshold: float) -> DataFrame:
    """(place, seed): seeds enough of each item that any text that covers it has one.

    A shared window covers ``min_match`` tokens at most, so a covering text shares at
    least threshold * tokens / min_match of an item's windows. An item's commonest
    seeds may go while fewer windows than that go with them: every text that covers
    it still has one of the others. So a seed that very many texts have makes no
    pairs, unless an item has nothing rarer.
    """
    common = met.groupBy("seed").agg(F.count("*").alias("texts"))
    order = Window.partitionBy("place").orderBy(F.desc("texts"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    ranked = item_seeds.join(common, "seed")
    ranked = ranked.withColumn("gone", F.sum("times").over(order)).withColumn("needed", F.ceil((F.col("windows") + min_match - 1) * threshold / min_match - 1e-9))
    return ranked.where(F.col("gone") >= F.col("needed")).select("place", "seed")


def _covered_texts(docs: DataFrame, items: DataFrame, text_col: str, min_match: int, threshold: float) -> DataFrame:
    """(text_key, item_id, ...) of each distinct text and the items that it covers.

    Whether a text covers an item depends on nothing but the two, so copies are
    compared once, and no row of ``docs`` is named by its id.
    """
    texts = docs.select(_text_key(text_col).alias("text_key"), F.col(text_col).alias("doc_text")).where("doc_text is not null")
    items = written(items.withColumn("place", F.xxhash64("item_id", "item_text")), "items")
    item_seeds = _seeds(items, "place", "item_text", min_match)
    item_seeds = written(item_seeds.withColumn("windows", F.sum("times").over(Window.partitionBy("place"))), "seeds")
    met = _seeds(texts, "text_key", "doc_text", min_match).join(item_seeds.select("seed").distinct(), "seed", "left_semi")
    met = written(met.select("text_key", "seed").distinct(), "met")
    pairs = written(met.join(_telling(met, item_seeds, min_match, threshold), "seed").select("text_key", "place").distinct(), "pairs")
    # copies of a text meet as keys first: only one of them is moved for an item
    once = texts.join(pairs.select("text_key").distinct(), "text_key", "left_semi").groupBy("text_key").agg(F.first("doc_text").alias("doc_text"))
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    both = pairs.join(items, "place").join(written(once, "texts"), "text_key").select("text_key", "item_id", "item_text", "doc_text")

    def run(batches):
        for batch in slices(batches):
            rows = []
            for row, (item, item_text, text) in enumerate(zip(*(batch.column(k) for k in (1, 2, 3)))):
                known = _single(item_text.as_py(), min_match)
                rows += [(row, item.as_py(), *hit[1:]) for hit in _covering(known, text.as_py(), min_match, threshold)]
            yield _out(batch.column(0), rows, "text_key", item_type)

    return written(both.mapInArrow(run, f"text_key string, {_fields(items)}"), "hits")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = COVERAGE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The rows of ``docs`` that no benchmark text covers, all columns as they are.

    Each row is judged by its own text, whatever its id. With a benchmark of up to
    ``broadcast_chars`` characters that happens where it lies, without a shuffle;
    with a larger one by joins, with the same rows left.
    """
    items, size = _measured(benchmark, item_col, item_text_col, min_match)
    if size > broadcast_chars:
        key = free_name(docs, "_text")
        hit = _covered_texts(docs.select(text_col), items, text_col, min_match, threshold).select(F.col("text_key").alias(key)).distinct()
        return docs.withColumn(key, _text_key(text_col)).join(hit, key, "left_anti").select(*docs.columns)
    sent, at = _sent(items), docs.columns.index(text_col)

    def run(batches):
        known = _Items(sent.value, min_match)
        for batch in slices(batches):
            yield batch.filter(pa.array([not _covering(known, t.as_py(), min_match, threshold) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
