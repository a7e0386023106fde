"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared in tiles: arrays of fingerprints that agree in the bit
counts of their four 16-bit quarters. Two fingerprints within ``radius`` bits have
bit counts whose differences sum to at most ``radius``, so all other pairs of tiles
are skipped unseen, and what is left is compared exactly with exclusive-or and
bit counts in numpy.
"""

from __future__ import annotations

from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentria.llm.common import apart, free_name, new_path, slices, text_key, write_at, written
from sentria.llm.components import components
from sentria.shared import passing

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints in a tile, about; a fuller cell of bit counts becomes several tiles.
TILE = 2048
#: Shingles hashed at a time, so that a very long text needs no more memory.
BLOCK = 1 << 16

#: byte -> its eight bits in the eight lanes of a 64-bit word
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: bit set if set in over half of the shingles' hashes.

    Words are runs of anything but ASCII white space, A-Z in lower case. A text of
    fewer words than a shingle is one shingle; one of none has fingerprint 0.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    sums = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + shingle - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        sums += bit_sums(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64))
    return majority(sums, n)


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each of the 64 bits is set."""
    sums = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        lanes = _LANES[hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)]
        for i in range(0, len(lanes), 255):  # a lane holds up to 255
            sums += lanes[i : i + 255].sum(axis=0).view(np.uint8)
    return sums


def majority(sums: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes: a bit is set if it is in over half of them."""
    return int(np.packbits(2 * sums > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_key, fp) of every row; fp is the fingerprint as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["id", "text_key", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), text_col)
    return rows.mapInArrow(run, f"id {id_type}, text_key long, fp long")


def linked(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what two tiles hold within ``radius``: each fingerprint that
    has a partner, with the smallest one it is connected to here. So a group of
    near copies gives as many links as it has members, not as many as it has pairs."""
    near = np.empty((len(left), len(right)), bool)
    for i in range(0, len(left), 256):
        near[i : i + 256] = np.bitwise_count(left[i : i + 256, None].view(np.uint64) ^ right[None, :].view(np.uint64)) <= radius
    if same:
        np.fill_diagonal(near, False)
    return spanning(near, left, right)


def spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the true places of ``near`` connect, one a member."""
    rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(rows):
        return left[:0], left[:0]
    near, a, b = near[np.ix_(rows, cols)], left[rows], right[cols]
    top = np.iinfo(np.int64).max
    low_a, low_b = a.copy(), b.copy()
    while True:
        new_a = np.minimum(low_a, np.where(near, low_b[None, :], top).min(1))
        new_b = np.minimum(low_b, np.where(near, new_a[:, None], top).min(0))
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    nodes, roots = np.concatenate([a, b]), np.concatenate([low_a, low_b])
    keep = nodes != roots
    return nodes[keep], roots[keep]


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``radius`` of each other."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(65535)) for k in range(4)]
    code = lambda q: sum((q[k] * 17**k for k in range(1, 4)), q[0])
    cells = distinct.select("fp", *(q.cast("int").alias(f"q{k}") for k, q in enumerate(quarter)))
    cells = cells.withColumn("cell", code([F.col(f"q{k}") for k in range(4)]))
    # at most 17**4 cells, whatever the input: small enough to send to every task
    full = cells.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    full = written(full, "cells")
    tiles = (
        cells.join(F.broadcast(full), "cell")
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .groupBy("cell", "part")
        .agg(F.collect_list("fp").alias("fps"), *(F.first(f"q{k}").alias(f"q{k}") for k in range(4)))
    )
    tiles = written(tiles, "tiles")
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    step = F.explode(F.array(*(F.struct(*(F.lit(x).alias(f"d{k}") for k, x in enumerate(d))) for d in steps)))
    there = [F.col(f"q{k}") + F.col(f"step.d{k}") for k in range(4)]
    inside = F.lit(True)
    for x in there:
        inside = inside & x.between(0, 16)
    left = tiles.withColumn("step", step).where(inside).select(F.col("cell").alias("from"), F.col("part").alias("from_part"), F.col("fps").alias("left"), code(there).alias("cell"))
    # a row for each tile it meets, so that the tiles of a full cell meet in many tasks
    first = F.when(F.col("from") == F.col("cell"), F.col("from_part")).otherwise(0)
    left = left.join(F.broadcast(full), "cell").withColumn("part", F.explode(F.sequence(first, (F.col("parts") - 1).cast("int")))).drop("parts")
    pairs = left.join(tiles.select("cell", "part", F.col("fps").alias("right")), ["cell", "part"])
    pairs = pairs.select("left", "right", ((F.col("from") == F.col("cell")) & (F.col("from_part") == F.col("part"))).alias("same"))

    def run(batches):
        for batch in batches:
            ends = []
            for i in range(batch.num_rows):
                left, right = (batch.column(k)[i].values.to_numpy() for k in (0, 1))
                ends.append(linked(left, right, radius, batch.column(2)[i].as_py()))
            a, b = (np.concatenate([e[k] for e in ends]) if ends else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


_near_links = near_links  #: its name in the tests


def lowest(named: DataFrame) -> DataFrame:
    """(root, first): the (id, text_key) of least rank in each group, null without an id."""
    return named.groupBy("root").agg(F.min("least").alias("first"))


def rank() -> Column:
    """What a row is ranked by: its id, then its text; null without an id."""
    return F.when(F.col("id").isNotNull(), F.struct("id", "text_key"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, text_key, fp, first) of every row, ``first`` the (id, text_key) of least
    rank that links of ``radius`` or fewer differing bits reach."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min(rank()).alias("least")), "distinct")
    roots = components(near_links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(named.join(lowest(named), "root").select("fp", "first"), "named")
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    ``fingerprint``: 16 hexadecimal digits. ``component_id``: the smallest id that
    links of ``radius`` or fewer differing bits reach, itself included; a row whose
    id is null takes part and gets its group's smallest id, null if there is none.
    Null and empty texts have fingerprint 0 and link like any other. Repeated rows
    share a component. An empty table gives an empty result. Other columns are not
    read. Equal fingerprints are grouped before any comparison.
    """
    found = groups(docs, id_col, text_col, shingle, radius)
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=groups, **kw) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the text of least (id, text_key).

    A text is judged by itself, whatever other texts its id has: one that is like no
    other stays. The rows of one text under one id are one document, and stay or go
    together. Rows without an id stay, since nothing can name them. ``groups`` finds
    the groups: (id, text_key, first) of every row.
    """
    id_key, of_text = free_name(docs, "_gone_id"), free_name(docs, "_gone_text")
    spark = docs.sparkSession
    at = new_path(spark, "gone")
    with passing(spark):  # all that finds the groups goes, before whatever comes next needs room
        found = groups(docs, id_col, text_col, **kw)
        gone = found.where(rank() != F.col("first")).select(F.col("id").alias(id_key), F.col("text_key").alias(of_text)).distinct()
        gone = write_at(gone, at)  # its size is known when the join is planned
    # only what may go is looked for among what goes: all other texts stay where they are
    maybe, stay = apart(docs, [id_col, text_key(text_col)], gone)
    return stay.union(maybe.join(gone, (F.col(id_col) == F.col(id_key)) & (text_key(text_col) == F.col(of_text)), "left_anti"))
