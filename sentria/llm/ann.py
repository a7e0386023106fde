"""Approximate nearest neighbours with a hash-prefix forest.

For each tree, every distinct vector has a hash string: the signs of random
projections. A tree is the sorted array of all strings, so the vectors that share a
prefix with a query lie next to each other in it. A search stands at the longest
prefixes and ascends in all trees at once, a bit at a time, until the trees
together show enough vectors; what they show is compared exactly.

The sorted array of every tree is cut into ranges. A directory of where each begins
is all that tasks know beforehand, so a query meets, in each tree, only the ranges
that its prefix lies in: first to learn how many vectors share each of its prefixes
(differences of ranks), and then, at the depth where it stands, which. What the trees
show of a block of vectors is brought together, and each vector is compared once.

How many vectors are enough is learned from a bounded sample of vectors that are no
queries, which is compared with everything.
"""

from __future__ import annotations

import math
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentria.llm.common import slices, written
from sentria.operators.running import numbered

#: Trees, and bits of a hash string.
TREES, BITS = 48, 32
#: Entries of a range of a tree's array, vectors of a block, queries of a block, at most.
RANGE, BLOCK, ASKED = 1 << 16, 4096, 128
#: The directory has about so many ranges at most; ranges grow beyond that.
DIRECTORY = 1 << 20
#: The vectors that the sample takes at most, and the recall that it must reach.
SAMPLE, RECALL = 256, 0.94
SEED = 17


def projections(dim: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, trees * bits))


def hashes(vectors: np.ndarray, centre: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """vectors x trees hash strings, the first bit the most significant."""
    signs = (vectors - centre) @ projections(vectors.shape[1], trees, bits) > 0
    weights = np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return (signs.reshape(len(vectors), trees, bits) * weights).sum(2, dtype=np.uint32)


def shared_bits(left: np.ndarray, right: np.ndarray, bits: int = BITS) -> np.ndarray:
    """How long a prefix strings share."""
    return bits - np.frexp((left ^ right).astype(np.float64))[1]


def bounds(strings: np.ndarray, depth: np.ndarray | int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The least string with the same prefix, and the one after the last, as 64 bits."""
    rest = np.uint64(bits) - np.asarray(depth, np.uint64)
    least = strings.astype(np.uint64) >> rest << rest
    return least, least + (np.uint64(1) << rest)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part: an id, and a vector without null or
    non-finite components that is not zero."""
    kept = "float" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "double"  # moved as narrow as they came
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{kept}>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("vector", lambda x: x != 0)
    return rows.where("id is not null and vector is not null").where(F.coalesce(sound, F.lit(False)))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def hashed(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """``vectors`` (dim, vector, ...) with ``strings``, the strings of all trees as bytes,
    and ``first``, that of the first tree."""
    met = vectors.join(centres, "dim")
    schema = T.StructType([f for f in met.schema if f.name != "centre"] + [T.StructField("strings", T.BinaryType()), T.StructField("first", T.LongType())])
    at = {c: i for i, c in enumerate(met.columns)}

    def run(batches):
        for batch in slices(batches, 1024):
            dims = batch.column(at["dim"]).to_numpy()
            out: list[bytes] = [b""] * len(dims)
            first = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                centre = np.array(batch.column(at["centre"])[int(rows[0])].as_py())
                found = hashes(_matrix(batch.column(at["vector"]).take(pa.array(rows)), dim), centre)
                first[rows] = found[:, 0]
                for row, strings in zip(rows.tolist(), found):
                    out[row] = strings.tobytes()
            kept = [i for c, i in at.items() if c != "centre"]
            yield pa.record_batch([batch.column(i) for i in kept] + [pa.array(out, pa.binary()), pa.array(first)], names=schema.names)

    return met.mapInArrow(run, schema)


def packed(vectors: DataFrame, size: int) -> DataFrame:
    """(dim, block, matrix, ids, strings): blocks of ``size`` rows of ``vectors`` (dim, vector,
    ids, strings, first) that follow each other in the first tree, so that vectors which
    are alike lie together. ``matrix`` holds doubles."""
    kind = vectors.schema["ids"].dataType
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("matrix", T.BinaryType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("strings", T.BinaryType())])
    rows = numbered(vectors, [F.col("dim"), F.col("first"), F.xxhash64("vector")], "number")
    # blocks of rows by number, however the rows are partitioned; a block has one dim
    block = F.shiftleft(F.floor(F.col("number") / size), 20) + F.col("dim")
    held = rows.groupBy("dim", block.alias("block")).agg(F.collect_list(F.struct("vector", "ids", "strings")).alias("rows"))

    def run(batches):
        for batch in slices(batches, 1):
            own = batch.column(2)[0].values
            vector, ids, strings = (own.field(c) for c in ("vector", "ids", "strings"))
            matrix = _matrix(vector, batch.column(0)[0].as_py())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([matrix.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([b"".join(strings.to_pylist())], pa.binary())],
                names=schema.names,
            )

    return held.mapInArrow(run, schema)


class Directory:
    """Where the ranges of every tree begin, how many entries stand before each, and
    their numbers. Small: one entry for each range."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        """``rows``: (dim, tree, number, least, entries)"""
        self.trees: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for (dim, tree), own in groupby(sorted(rows), itemgetter(0, 1)):
            numbers, least, n = (np.array(c) for c in list(zip(*own))[2:])
            self.trees[dim, tree] = numbers, least.astype(np.uint64), np.cumsum(n) - n  # numbers rise as the strings do

    def meeting(self, dim: int, tree: int, value: np.ndarray) -> np.ndarray:
        """The place of the range in which a value's rank is decided, -1 if none stands before it."""
        return np.searchsorted(self.trees[dim, tree][1], value, "left") - 1


class Forest:
    """The stored blocks of vectors, the ranges of the trees, (dim, centre), and the vectors."""

    def __init__(self, blocks: DataFrame, ranges: DataFrame, directory: Directory, centres: DataFrame, vectors: DataFrame):
        self.blocks, self.ranges, self.directory, self.centres, self.vectors = blocks, ranges, directory, centres, vectors


def _entries(blocks: DataFrame) -> DataFrame:
    """(dim, tree, string, place) of each vector in each tree; a place is block * BLOCK + row."""

    def run(batches):
        for batch in slices(batches, 1):
            dim, block, strings = batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), np.frombuffer(batch.column(2)[0].as_py(), np.uint32).reshape(-1, TREES)
            places = np.int64(block) * BLOCK + np.arange(len(strings))
            for tree in range(TREES):
                n = len(places)
                yield pa.record_batch([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, tree, np.int32)), pa.array(strings[:, tree].astype(np.int64)), pa.array(places)], names=["dim", "tree", "string", "place"])

    return blocks.select("dim", "block", "strings").mapInArrow(run, "dim int, tree int, string long, place long")


def _ranges(entries: DataFrame, size: int) -> DataFrame:
    """(range, dim, tree, least, n, strings, places): every tree's sorted array, cut."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        key: tuple[int, int] | None = None

        def emit(rows):
            nonlocal number
            row = pa.record_batch(
                [pa.array([number], pa.int64()), pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([int(rows[0, 0])], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([rows[:, 0].astype(np.uint32).tobytes()], pa.binary()), pa.array([rows[:, 1].tobytes()], pa.binary())],
                names=["range", "dim", "tree", "least", "n", "strings", "places"],
            )
            number += 1
            return row

        for batch in batches:
            dims, trees = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], 1)
            cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (trees[1:] != trees[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
                if hi == lo:
                    continue
                own = int(dims[lo]), int(trees[lo])
                if key != own and held:
                    yield emit(np.concatenate(held))
                    held = []
                key = own
                held.append(rows[lo:hi])
                while sum(map(len, held)) >= size:
                    every = np.concatenate(held)
                    yield emit(every[:size])
                    held = [every[size:]] if len(every) > size else []
        if held:
            yield emit(np.concatenate(held))

    order = ["dim", "tree", "string", "place"]
    return entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "range long, dim int, tree int, least long, n long, strings binary, places binary")


def build(rows: DataFrame, per_vector: int, block: int = BLOCK, entries: int = RANGE) -> Forest:
    """The forest over (id, vector). Of equal vectors one is kept, with its
    ``per_vector`` smallest ids: more could not be among a query's nearest. The
    ranking drops the others in every partition before it shuffles."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.distinct().withColumn("place", place).where(F.col("place") <= per_vector)
    distinct = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("vector"))
    distinct = written(distinct, "vectors")
    means = distinct.select("dim", F.posexplode("vector").alias("at", "x")).groupBy("dim", "at").agg(F.avg("x").alias("x"))
    centres = means.groupBy("dim").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda m: m["x"]).alias("centre"))
    centres = written(centres, "centres")
    vectors = written(hashed(distinct, centres), "hashed")
    blocks = written(packed(vectors, block), "blocks")
    size = max(entries, vectors.count() * TREES // DIRECTORY)
    ranges = written(_ranges(_entries(blocks), size), "ranges")
    directory = Directory([(r.dim, r.tree, r["range"], r.least, r.n) for r in ranges.select("dim", "tree", "range", "least", "n").collect()])
    return Forest(blocks, ranges, directory, centres, vectors)


def _enough(forest: Forest, sample: DataFrame, k: int, recall: float) -> DataFrame:
    """(dim, enough): how many vectors the trees must show, learned from ``sample``
    (dim, vector, strings), which comes to the driver.

    The sample meets every vector, which gives its true neighbours, the depth at
    which the trees would show each of them, and how many vectors they show down to
    each depth. The least number that finds ``recall`` of the neighbours is enough;
    it shows k + 1 vectors at least, since a tree shows a vector once.
    """
    spark = forest.vectors.sparkSession
    chosen: dict[int, list] = {}
    for i, r in enumerate(sample.collect()):
        chosen.setdefault(r.dim, []).append((i, r.vector, r.strings))
    sent = spark.sparkContext.broadcast(chosen)

    def run(batches):
        shown, near = {}, {}
        for batch in slices(batches, 1024):
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in sent.value:
                    continue
                rows = pa.array(np.flatnonzero(dims == dim))
                matrix = _matrix(batch.column(1).take(rows), dim)
                strings = np.frombuffer(b"".join(batch.column(2).take(rows).to_pylist()), np.uint32).reshape(len(matrix), -1)
                for i, point, own in sent.value[dim]:
                    bits = shared_bits(strings, np.frombuffer(own, np.uint32))
                    shown[dim, i] = shown.get((dim, i), 0) + np.bincount(bits.ravel(), minlength=BITS + 1)
                    apart = ((matrix - np.array(point)) ** 2).sum(1)
                    best = np.argsort(apart, kind="stable")[: k + 1]
                    near[dim, i] = sorted(near.get((dim, i), []) + list(zip(apart[best].tolist(), bits[best].max(1).tolist())))[: k + 1]
        keys = sorted(shown)
        yield pa.record_batch(
            [pa.array([d for d, _ in keys], pa.int32()), pa.array([i for _, i in keys], pa.int64()), pa.array([shown[x].tolist() for x in keys], pa.list_(pa.int64())), pa.array([[list(map(float, p)) for p in near[x]] for x in keys], pa.list_(pa.list_(pa.float64())))],
            names=["dim", "id", "shown", "near"],
        )

    found = forest.vectors.select("dim", "vector", "strings").mapInArrow(run, "dim int, id long, shown array<long>, near array<array<double>>")
    totals = [F.sum(F.col("shown")[d]).alias(f"s{d}") for d in range(BITS + 1)]
    rows = found.groupBy("dim", "id").agg(*totals, F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")).collect()
    out = []
    for dim in chosen:
        of_dim = [r for r in rows if r.dim == dim]
        visits = [np.cumsum([r[f"s{d}"] for d in range(BITS, -1, -1)])[::-1] for r in of_dim]  # shown at a depth or below
        depths = [np.array([p[1] for p in r.near[1:]]) for r in of_dim]  # the first is the vector itself
        wanted = recall * sum(map(len, depths))
        least = (k + 1) * TREES
        for least in sorted({max((k + 1) * TREES, int(v)) for of_one in visits for v in of_one}):
            stand = [int(np.flatnonzero(v >= min(least, v[0])).max()) for v in visits]
            if sum(int((d >= s).sum()) for d, s in zip(depths, stand)) >= wanted:
                break
        out.append((dim, least))
    return spark.createDataFrame(out, "dim int, enough long")


def _meeting(asked: DataFrame, forest: Forest, reach, columns: list[str]) -> DataFrame:
    """(range, asked, own): for each block of ``asked`` and each range that it meets, the rows
    that do. ``reach`` names the ranges: (directory, dim, tree, strings, other columns of
    the block) -> (places of rows, places of ranges)."""
    sent = asked.sparkSession.sparkContext.broadcast(forest.directory)

    def run(batches):
        for batch in slices(batches, 1):
            dim, block = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            strings = np.frombuffer(batch.column(2)[0].as_py(), np.uint32).reshape(-1, TREES)
            others = [batch.column(i + 3)[0].values.to_numpy() for i in range(len(columns))]
            out = []
            for tree in range(TREES):
                if (dim, tree) not in sent.value.trees:
                    continue
                rows, places = reach(sent.value, dim, tree, strings[:, tree], *others)
                numbers = sent.value.trees[dim, tree][0]
                for place in np.unique(places).tolist():
                    out.append((int(numbers[place]), block, np.unique(rows[places == place]).astype(np.int32).tobytes()))
            cols = list(zip(*out)) or [()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["range", "asked", "own"])

    return asked.select("dim", "block", "strings", *columns).mapInArrow(run, "range long, asked long, own binary")


def _ranked(directory: Directory, dim: int, tree: int, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that decide the rank of any prefix of the strings."""
    depths = np.arange(BITS + 1)
    ends = np.concatenate(bounds(strings[:, None], depths[None]), 1)
    places = directory.meeting(dim, tree, ends)
    rows, at = np.nonzero(places >= 0)
    return rows, places[rows, at]


def _standing(asked: DataFrame, forest: Forest, enough: DataFrame) -> DataFrame:
    """``asked`` with ``depths``: for each query the longest prefixes, of one length in all
    trees, at which the whole forest shows enough vectors."""
    directory = asked.sparkSession.sparkContext.broadcast(forest.directory)
    met = _meeting(asked, forest, _ranked, []).join(forest.ranges.select("range", "dim", "tree", "strings"), "range")
    met = met.join(asked.select(F.col("block").alias("asked"), F.col("strings").alias("own_strings")), "asked").select("dim", "tree", "range", "asked", "own", "own_strings", "strings")

    def run(batches):
        depths = np.arange(BITS + 1)
        for batch in slices(batches, 1):
            dim, tree, number, block, own, own_strings, strings = (batch.column(i)[0].as_py() for i in range(7))
            rows = np.frombuffer(own, np.int32)
            asked_strings = np.frombuffer(own_strings, np.uint32).reshape(-1, TREES)[rows, tree]
            sorted_strings = np.frombuffer(strings, np.uint32)
            numbers, leasts, before = directory.value.trees[dim, tree]
            place = int(np.flatnonzero(numbers == number)[0])
            counts = np.zeros((len(rows), BITS + 1), np.int64)
            for sign, ends in zip((-1, 1), bounds(asked_strings[:, None], depths[None])):
                here = directory.value.meeting(dim, tree, ends) == place
                counts[here] += sign * (before[place] + np.searchsorted(sorted_strings, ends[here], "left"))
            yield pa.record_batch([pa.array(np.full(len(rows), block)), pa.array(rows), pa.array(counts.tolist(), pa.list_(pa.int64()))], names=["block", "row", "shown"])

    counted = met.mapInArrow(run, "block long, row int, shown array<long>").groupBy("block", "row").agg(*(F.sum(F.col("shown")[d]).alias(f"s{d}") for d in range(BITS + 1)))
    blocks = asked.select("block", "dim").join(enough, "dim", "left")
    need = F.least("enough", "s0")  # all there are, at depth 0
    depth = F.coalesce(F.greatest(F.lit(0), *(F.when(F.col(f"s{d}") >= need, d) for d in range(BITS + 1))), F.lit(0))
    found = counted.join(blocks, "block").select("block", F.struct("row", depth.alias("depth")).alias("one"))
    found = found.groupBy("block").agg(F.transform(F.sort_array(F.collect_list("one")), lambda x: x["depth"]).alias("depths"))
    return asked.join(found, "block")


def _within(directory: Directory, dim: int, tree: int, strings: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that hold any string with a query's prefix."""
    least, after = bounds(strings, depths)
    first = np.maximum(directory.meeting(dim, tree, least), 0)
    last = np.maximum(directory.meeting(dim, tree, after), -1)
    n = np.maximum(last - first + 1, 0)
    rows = np.repeat(np.arange(len(strings)), n)
    return rows, np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _shown(asked: DataFrame, forest: Forest) -> DataFrame:
    """(block, asked, codes): what a tree shows of a block of vectors to a block of queries,
    as query * BLOCK + vector, rows of their blocks."""
    met = _meeting(asked, forest, _within, ["depths"]).join(forest.ranges.select("range", "tree", "strings", "places"), "range")
    met = met.join(asked.select(F.col("block").alias("asked"), F.col("strings").alias("own_strings"), "depths"), "asked").select("tree", "asked", "own", "own_strings", "depths", "strings", "places")

    def run(batches):
        for batch in slices(batches, 1):
            tree, block, own, own_strings, _, strings, places = (batch.column(i)[0].as_py() if i != 4 else None for i in range(7))
            rows = np.frombuffer(own, np.int32)
            depths = batch.column(4)[0].values.to_numpy()[rows]
            least, after = bounds(np.frombuffer(own_strings, np.uint32).reshape(-1, TREES)[rows, tree], depths)
            sorted_strings, places = np.frombuffer(strings, np.uint32), np.frombuffer(places, np.int64)
            lo, hi = np.searchsorted(sorted_strings, least, "left"), np.searchsorted(sorted_strings, after, "left")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            codes = (np.repeat(rows.astype(np.int64), n) * BLOCK + places[at] % BLOCK).astype(np.uint32)
            of = places[at] // BLOCK
            order = np.argsort(of, kind="stable")
            found, starts = np.unique(of[order], return_index=True)
            parts = [c.tobytes() for c in np.split(codes[order], starts[1:])] if len(found) else []
            yield pa.record_batch([pa.array(found, pa.int64()), pa.array(np.full(len(found), block), pa.int64()), pa.array(parts, pa.binary())], names=["block", "asked", "codes"])

    return met.mapInArrow(run, "block long, asked long, codes binary")


def search(queries: DataFrame, forest: Forest, k: int = 10, recall: float = RECALL, shown: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score, seen, blocks) of the ``k`` nearest that each
    (id, vector) of ``queries`` finds; ``seen``: how many vectors it was compared with,
    of how many blocks. ``shown``: what is enough, if it is not to be learned."""
    asked = queries.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    asked = hashed(asked, forest.centres).withColumn("ids", F.col("id"))
    asked = written(packed(asked, ASKED), "asked")
    if shown is None:
        judged = queries.select("vector").distinct()
        few = forest.vectors.orderBy(F.xxhash64("vector")).limit(2 * SAMPLE)  # more than the sample, of which some may be queries
        others = few.join(judged, "vector", "left_anti").limit(SAMPLE)
        if others.isEmpty():  # hardly a vector that is no query
            others = few.limit(SAMPLE)
        enough = _enough(forest, others, k, recall)
    else:
        enough = forest.centres.select("dim", F.lit(shown).cast("long").alias("enough"))
    asked = written(_standing(asked, forest, enough), "standing")
    # a block of queries and one of vectors have no more codes than ASKED * BLOCK * TREES
    codes = written(_shown(asked, forest), "codes").groupBy("block", "asked").agg(F.collect_list("codes").alias("codes"))
    points = asked.select(F.col("block").alias("asked"), F.col("matrix").alias("points"), F.col("ids").alias("query_ids"))
    met = codes.join(forest.blocks.select("block", "dim", "matrix", "ids"), "block").join(points, "asked").select("dim", "codes", "matrix", "ids", "points", "query_ids")
    id_type = queries.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType()), T.StructField("seen", T.LongType())])
    arrow_id = pa.int64() if isinstance(id_type, T.LongType) else None

    def run(batches):
        for batch in slices(batches, 1):
            dim, codes = batch.column(0)[0].as_py(), batch.column(1)[0].values.to_pylist()
            matrix, points = (np.frombuffer(batch.column(i)[0].as_py(), np.float64).reshape(-1, dim) for i in (2, 4))
            ids, query_ids = batch.column(3)[0].as_py(), batch.column(5)[0].as_py()
            held = np.zeros(len(points) * BLOCK, bool)
            for part in codes:
                held[np.frombuffer(part, np.uint32)] = True
            out: list[tuple] = []
            for row, query in enumerate(query_ids):
                near = np.flatnonzero(held[row * BLOCK : row * BLOCK + len(matrix)])
                if not len(near):
                    continue
                apart = np.sqrt(((matrix[near] - points[row]) ** 2).sum(1))
                # a vector has its own id at least, so k + 1 of them leave k
                cut = np.partition(apart, k)[k] if len(apart) > k else math.inf
                best = [(float(apart[j]), v) for j in np.flatnonzero(apart <= cut) for v in ids[near[j]] if v != query]
                out += [(query, v, d, 0) for d, v in sorted(best)[:k]]
                out.append((query, None, None, len(near)))
            cols = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (arrow_id or batch.schema.field(5).type.value_type,) * 2 + (pa.float64(), pa.int64()))], names=schema.names)

    found = written(met.mapInArrow(run, schema), "found")
    seen = found.groupBy("query_id").agg(F.sum("seen").alias("seen"), F.count_if(F.col("seen") > 0).alias("blocks"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = found.where("vec_id is not null").drop("seen").withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(seen, "query_id").select("query_id", "rank", "vec_id", "score", "seen", "blocks")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, entries: int = RANGE, recall: float = RECALL, shown: int | None = None) -> DataFrame:
    """The ``k`` nearest found, by Euclidean distance, of every row whose id is
    divisible by ``every``, among all rows but those with its own id.

    Nearest first, ties to the smaller id, distances in double precision on the
    original vectors; all candidates if there are fewer than ``k``; ``seen`` says
    with how many different vectors the query was compared. Null ids, and vectors
    that are null, zero, or hold null or non-finite components, take no part;
    vectors of another length than the query's are not compared with it. Rows
    repeated whole count once; of several vectors under one query id the smallest
    asks. An empty table gives an empty result. Other columns are not read. Ids are of
    any whole or string type; a string that is no whole number is never a query.
    """
    rows = written(usable(vectors, id_col, vector_col), "usable")
    number = F.col("id") if not isinstance(rows.schema["id"].dataType, T.StringType) else F.expr("try_cast(id AS bigint)")
    return search(rows.where(number % every == 0), build(rows, k + 1, block, entries), k, recall, shown)
