"""Near copies by exact Jaccard similarity of word shingles.

Texts that agree in one of ``BANDS`` bands of ``ROWS`` MinHash values are candidates:
only such pairs are ever compared, exactly, by their sets of shingles, and only as far
as links of ``LEAST`` similarity or more have not connected them already. A pair at just that similarity
agrees in no band with a chance of (1 - 0.8**5)**40 = 1.2e-7, a closer one with less.

SimHash comes first: fingerprints of the same shingles are compared by tiles, as op8
does, and what they link is confirmed exactly. At just this similarity fingerprints differ
in about 10 of 64 bits, where a radius that loses nothing would skip no tiles; so bands
find what is left, and nothing is compared that fingerprints have connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.llm.common import apart, bounded_batches, slices, text_key, written
from sentria.llm.components import components
from sentria.llm.rolling import mixed, rolling
from sentria.llm.simhash import RADIUS, bit_sums, lowest, majority, near_links, rank

SHINGLE = 5
#: The least similarity of near copies, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 40, 5
#: Texts and shingles in a tile, about; a fuller group becomes several tiles.
TILE, TILE_SHINGLES = 256, 1 << 19
#: Shingles under all MinHash functions at a time.
BLOCK = 1 << 12
MEMO_ENTRIES = 200_000

_RNG = np.random.default_rng(42)
_FACTORS = (_RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)).astype(np.uint32)
_ADDENDS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


class Shingles:
    """The shingles of texts as sets of hashes, with a bounded memory of words' hashes."""

    def __init__(self, width: int = SHINGLE):
        self.width = width
        self._memo: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        if len(self._memo) >= MEMO_ENTRIES:
            self._memo.clear()
        h = self._memo[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes. Words are those of SimHash: runs of anything but
        ASCII white space, A-Z in lower case. A text of fewer words than a shingle
        is one shingle; one of none has none."""
        words = (text or "").encode("utf-8").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known, make = self._memo.get, self._hash
        codes = np.array([known(w) or make(w) for w in words], np.uint64)
        return np.unique(mixed(rolling(codes, min(self.width, len(codes)))) ^ np.uint64(min(self.width, len(codes))))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The band values of a set of shingles; none, if it is empty."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), BLOCK):
        np.minimum(low, (short[None, i : i + BLOCK] * _FACTORS + _ADDENDS).min(1), out=low)
    parts = low.reshape(BANDS, ROWS)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(bytes, parts), range(BANDS)), np.uint64, BANDS).view(np.int64)


def similar(left: np.ndarray, right: np.ndarray) -> bool:
    """Two sorted sets are of ``LEAST`` similarity or more: shared / (a + b - shared) is at
    least part / whole, in whole numbers."""
    part, whole = LEAST
    few, many = sorted((left, right), key=len)
    if len(few) * whole < part * len(many):
        return False
    at = np.searchsorted(many, few)
    shared = int((many[np.minimum(at, len(many) - 1)] == few).sum())
    return (whole + part) * shared >= part * (len(few) + len(many))


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, text, text_key, key, n, fp, bands, row) of every row; equal sets of shingles have one
    key. fp: the SimHash fingerprint of the set."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        shingles = Shingles(shingle)
        for batch in slices(batches):
            sets = [shingles.of(t.as_py()) for t in batch.column(1)]
            keys = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets), np.uint64, len(sets))
            values = [bands(s) for s in sets]
            ends = np.cumsum([0, *map(len, values)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            fps = np.fromiter((majority(bit_sums(s), len(s)) for s in sets), np.uint64, len(sets)).view(np.int64)
            yield pa.record_batch([*batch.columns, pa.array(keys.view(np.int64)), sizes, pa.array(fps), lists], names=["id", "text", "text_key", "key", "n", "fp", "bands"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("text_key"))
    return found.mapInArrow(run, f"id {id_type}, text string, text_key long, key long, n long, fp long, bands array<long>").withColumn("row", F.monotonically_increasing_id())


def _banded(sketches: DataFrame) -> DataFrame:
    """(band, key): the bands that several keys agree in."""
    banded = sketches.select("key", "bands").dropDuplicates(["key"]).select("key", F.explode("bands").alias("band"))
    # minima are combined before the shuffle, so a very common band is a few rows there
    full = banded.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    full = written(full.where("low < high").select("band"), "bands")
    return written(banded.join(full, "band"), "banded")


def _fingerprinted(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): the pairs of keys that SimHash finds. Of each fingerprint its keys with the
    smallest of them, and the smallest keys of fingerprints that op8's tiles link."""
    least = written(distinct.groupBy("fp").agg(F.min("key").alias("low")), "fingerprints")
    same = distinct.join(least, "fp").where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b"))
    a, b = least.select(F.col("fp").alias("a"), F.col("low").alias("low_a")), least.select(F.col("fp").alias("b"), F.col("low").alias("low_b"))
    links = written(near_links(least.select("fp"), radius), "links").distinct()
    return written(same.unionByName(links.join(a, "a").join(b, "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))), "near")


def _texts(sketches: DataFrame, distinct: DataFrame, banded: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(key, text, n, bands) of every key that shares a band or is near another's fingerprint. Texts move and not their
    shingles, which are more bytes and do not compress."""
    keys = banded.select("key")
    keys = keys if near is None else keys.union(near.select("a")).union(near.select("b"))
    members = written(distinct.join(keys.distinct(), "key", "left_semi").select("row"), "members")
    # no other text moves, however many members there are
    maybe, _ = apart(sketches.select("row", "key", "text", "n", "bands"), ["row"], members)
    return written(maybe.join(members, "row").drop("row"), "texts")


def _rooted(banded: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(band, key, root) of the bands whose keys are not all connected yet."""
    if roots is None:
        return banded.withColumn("root", F.col("key"))
    rooted = banded.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = written(rooted.select("band", "key", "root"), "rooted")
    open_ = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    return written(rooted.join(written(open_, "open"), "band"), "unconnected")


def _stars(rooted: DataFrame, single: bool) -> DataFrame:
    """(a, b): each key with the smallest key of its bands, unless they are connected; with
    ``single`` only the smallest of those."""
    low = rooted.groupBy("band").agg(F.min(F.struct("key", "root")).alias("low"))
    pairs = rooted.join(low, "band").where("root <> low.root").select(F.col("key").alias("a"), F.col("low.key").alias("b"))
    return pairs.groupBy("a").agg(F.min("b").alias("b")) if single else pairs.distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The (a, b) of ``pairs`` that are of ``LEAST`` similarity or more.

    Texts are dealt by the b that they are compared with, in parts if those are many,
    and stream by behind it: a part holds one set of shingles at a time beside b's.
    """
    pairs = written(pairs, "pairs")
    full = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")), "full")
    each = pairs.join(full, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("key"), F.lit(1).alias("turn"))
    heads = full.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("b").alias("key"), F.lit(0).alias("turn"))
    met = written(each.unionByName(heads), "compares").join(texts.select("key", "text"), "key")
    met = met.select("b", "part", "turn", "key", "text").repartition("b", "part").sortWithinPartitions("b", "part", "turn", "key")

    def run(batches):
        shingles, head = Shingles(shingle), np.zeros(0, np.uint64)
        for batch in slices(batches):
            found = []
            for b, turn, key, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if turn == 0:
                    head = shingles.of(text)
                elif similar(shingles.of(text), head):
                    found.append((key, b))
            a, b = zip(*found) if found else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return written(met.mapInArrow(run, "a long, b long"), "confirmed")


def cross(band: int, left: list[tuple], right: list[tuple], same: bool) -> tuple[list[tuple[int, int]], int]:
    """(links, compares) of what two tiles of a band hold, (key, root, set, bands) each.

    Compared are keys that are not connected yet, in the first of their common bands
    only. A link found connects what it joins, and spares later compares here.
    """
    root = {m[1]: m[1] for m in (*left, *right)}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    others = np.array([m[3] for m in right])
    links, compares = [], 0
    for i, (key, own, hashes, bands_) in enumerate(left):
        agree = others == np.asarray(bands_)
        first = np.argmax(agree, 1)
        fits = np.flatnonzero(others[np.arange(len(right)), first] == band)
        for j in fits[fits > i].tolist() if same else fits.tolist():
            if top(own) != top(right[j][1]):
                compares += 1
                if similar(hashes, right[j][2]):
                    links.append((key, right[j][0]))
                    root[top(own)] = top(right[j][1])
    return links, compares


def _compared(rooted: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b, compares): links between keys of one band that are not connected yet; one
    row a task without a link counts the compares. A band of very many keys is cut to
    tiles, which meet in many tasks."""
    sized = rooted.join(texts.select("key", "n"), "key")
    full = sized.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES), F.lit(1)).cast("int").alias("parts"))
    placed = written(rooted.join(written(full, "full"), "band").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")), "placed")
    one = F.struct("key", "root", "text", "bands")
    tiles = placed.join(texts.drop("n"), "key").groupBy("band", "part").agg(F.collect_list(one).alias("tile"), F.first("parts").alias("parts"))
    tiles = written(tiles, "tiles")
    left = tiles.select("band", F.col("part").alias("from_part"), F.col("tile").alias("left"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("part"))
    # a tile beside itself need not be moved twice
    alone = left.where("from_part = part").select("band", "left", F.lit(None).cast(tiles.schema["tile"].dataType).alias("right"))
    pairs = alone.unionByName(left.where("from_part < part").join(tiles.select("band", "part", F.col("tile").alias("right")), ["band", "part"]).select("band", "left", "right"))

    def run(batches):
        total, shingles = 0, Shingles(shingle)

        def read(tile):
            held = tile.values
            sets = [shingles.of(t.as_py()) for t in held.field("text")]
            return list(zip(held.field("key").to_pylist(), held.field("root").to_pylist(), sets, held.field("bands").to_pylist()))

        for batch in batches:
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                mine = read(batch.column(1)[i])
                same = not batch.column(2)[i].is_valid
                links, compares = cross(batch.column(0)[i].as_py(), mine, mine if same else read(batch.column(2)[i]), same)
                found += links
                total += compares
            a, b = zip(*found) if found else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(a), pa.int64())], names=["a", "b", "compares"])
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["a", "b", "compares"])

    return written(pairs.mapInArrow(run, "a long, b long, compares long"), "compared")


def _roots(sketches: DataFrame, distinct: DataFrame, shingle: int) -> DataFrame:
    """(node, root): what links of ``LEAST`` similarity or more connect.

    First what SimHash finds is confirmed. Then each key is compared with the smallest that
    it shares a band with, unless they are connected, then with the smallest of each band where that left anything apart. Near copies are nearly
    all connected then, by about as many compares as there are texts; only bands
    whose keys still are not are compared pair by pair.
    """
    banded = _banded(sketches)
    near = _fingerprinted(distinct)
    texts = _texts(sketches, distinct, banded, near)
    links = _confirmed(near, texts, shingle)
    links = links.unionByName(_confirmed(_stars(_rooted(banded, components(links)), True), texts, shingle))
    links = links.unionByName(_confirmed(_stars(_rooted(banded, components(links)), False), texts, shingle))
    links = links.unionByName(_compared(_rooted(banded, components(links)), texts, shingle).where("a is not null").select("a", "b"))
    return components(links)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_key, first) of every row, ``first`` the (id, text_key) of least rank
    that links of ``LEAST`` similarity or more reach."""
    bounded_batches(docs.sparkSession)
    sketches = written(_sketches(docs, id_col, text_col, shingle), "sketches")
    distinct = sketches.groupBy("key").agg(F.min(rank()).alias("least"), F.min("row").alias("row"), F.min("n").alias("n"), F.min("fp").alias("fp"))
    distinct = written(distinct, "distinct")
    roots = _roots(sketches, distinct, shingle)
    named = distinct.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = written(named.join(lowest(named), "root").select("key", "first"), "named")
    return sketches.select("id", "text_key", "key").join(named, "key").drop("key")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, component_id) of every row.

    ``component_id``: the smallest id that links of ``LEAST`` similarity or more
    reach, itself included; a row whose id is null takes part and gets its group's
    smallest id, null if there is none. Texts without words are copies of each
    other. Repeated rows share a component. An empty table gives an empty result.
    Other columns are not read. Equal sets are grouped before any comparison.
    """
    return groups(docs, id_col, text_col, shingle).select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))
