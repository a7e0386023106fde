"""The trigram index: postings, candidates, statistics, and building it once."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sentria.functions.text import normalize_query, query_trigrams, trigrams
from sentria.operators.running import numbered
from sentria.session import ship_code
from sentria.shared import delete, listed, passing, qualified, size_of, write_at, written

#: One edit damages this many trigrams of a query at most.
DAMAGE = 3
#: Bytes of a row group of postings: a trigram is read with what little stands around it.
ROW_GROUP = 1 << 20
#: Ids of a block of postings.
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
#: Postings of a query's shortest lists that are sent to every task, and that may be named
#: in a plan; more are joined.
LISTED_POSTINGS, NAMED_POSTINGS = 1_000_000, 10_000
#: Bytes of sentences whose trigrams are taken apart at a time, about.
PIECE = 1 << 21


def postings(sentences: DataFrame, *key: str, only: list[str] | None = None) -> DataFrame:
    """(trigram, key): a row for each distinct trigram of each sentence; with ``only``, of
    these trigrams, which are looked for without taking sentences apart."""
    if only is None:
        return sentences.select(F.explode(trigrams("normalized_sentence")).alias("trigram"), *key)
    asked = F.array(*map(F.lit, only)).cast("array<string>")
    return sentences.select(F.explode(F.filter(asked, lambda g: F.contains("normalized_sentence", g))).alias("trigram"), *key)


def posting_sizes(posts: DataFrame) -> DataFrame:
    """How many sentences have each trigram."""
    return posts.groupBy("trigram").agg(F.count("*").alias("postings"))


def candidates(sentences: DataFrame, posts: DataFrame, query: str, *key: str) -> DataFrame:
    """Sentences that could match a normalised query with one edit, with ``shared``,
    the number of query trigrams they have: no false negatives.

    All of them if the query has so few trigrams that an edit could damage all
    (``shared`` is null then); none for an empty query.
    """
    if not query:
        return sentences.where(F.lit(False)).withColumn("shared", F.lit(None).cast("long"))
    grams = query_trigrams(query)
    if len(grams) <= DAMAGE:
        return sentences.withColumn("shared", F.lit(None).cast("long"))
    hits = posts.where(F.col("trigram").isin(grams)).groupBy(*key).agg(F.count("*").alias("shared"))
    return sentences.join(hits.where(F.col("shared") >= len(grams) - DAMAGE), list(key))


def rarest(sizes: DataFrame, query: str, n: int = DAMAGE + 1) -> dict[str, int]:
    """The ``n`` trigrams of a query that fewest sentences have, and how many have them.

    ``sizes``: (trigram, postings). No more rows come to the driver than the query
    has trigrams.
    """
    grams = query_trigrams(query)
    known = {r.trigram: r.postings for r in sizes.where(F.col("trigram").isin(grams)).collect()}
    return {g: known.get(g, 0) for g in sorted(grams, key=lambda g: (known.get(g, 0), g))[:n]}


def distinct_trigrams(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(trigrams, ends, places): the distinct trigrams of up to ``BLOCK`` texts, in order of
    characters; those of place i are in the texts ``places[ends[i] : ends[i + 1]]``, ascending."""
    joined = "".join(texts.to_pylist())
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    if len(chars) < 3:
        return pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.int16)
    # characters by their number among those that occur, so that a trigram and its place are one number
    used = np.flatnonzero(np.bincount(chars))
    number = np.zeros(int(used[-1]) + 1, np.int64)
    number[used] = np.arange(len(used))
    coded, width = number[chars], len(used)
    grams = (coded[:-2] * width + coded[1:-1]) * width + coded[2:]
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = text[:-2] == text[2:]
    grams, text = grams[inside], text[:-2][inside]
    if width**3 > 1 << (62 - BLOCK_BITS):
        named, grams = np.unique(grams, return_inverse=True)
    else:
        named = None
    pairs = np.sort((grams << BLOCK_BITS) | text)
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    grams = pairs >> BLOCK_BITS
    starts = np.flatnonzero(np.diff(grams, prepend=-1) != 0)
    each = grams[starts] if named is None else named[grams[starts]]
    spelt = used[np.stack([each // width // width, each // width % width, each % width], 1)].astype(np.uint32).tobytes().decode("utf-32-le")
    return pa.array([spelt[i : i + 3] for i in range(0, len(spelt), 3)], pa.string()), np.append(starts, len(pairs)), (pairs & (BLOCK - 1)).astype(np.int16)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in runs that lie in one block of ids, of about ``PIECE`` bytes at most. The
    columns are a block, whatever a run has, and the sentences last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(0).to_numpy()
        size = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)) // PIECE
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(size) != 0)) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            for at in range(first, last, BLOCK):
                yield batch.slice(at, min(BLOCK, last - at))


def trigram_sizes(sentences: DataFrame) -> DataFrame:
    """``posting_sizes`` of sentences without their postings as rows: tasks count trigrams in
    runs of sentences. The row of trigram null counts the sentences."""
    ship_code(sentences.sparkSession)

    def run(batches):
        for piece in _pieces(batches):
            grams, ends, _ = distinct_trigrams(piece.column(1))
            sizes = pa.array(np.append(np.diff(ends), piece.num_rows))
            yield pa.record_batch([pa.concat_arrays([grams, pa.nulls(1, pa.string())]), sizes], names=["trigram", "postings"])

    texts = sentences.select(F.lit(0).cast("long").alias("block"), "normalized_sentence")
    return texts.mapInArrow(run, "trigram string, postings long").groupBy("trigram").agg(F.sum("postings").alias("postings"))


def statistics(sentences: DataFrame) -> DataFrame:
    """One row: record_count, distinct_trigrams, total_postings."""
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("postings"))), F.lit(0).cast("long"))
    none = F.col("trigram").isNull()
    return trigram_sizes(sentences).agg(of(none).alias("record_count"), F.count("trigram").alias("distinct_trigrams"), of(~none).alias("total_postings"))


def posting_blocks(sentences: DataFrame, key: str) -> DataFrame:
    """(trigram, block, places): the postings of sentences numbered without gaps, packed.

    A row holds what one trigram has in one block of ``BLOCK`` ids, as sorted distances
    from where the block begins, 12 bits each as Parquet packs them. Sentences stand in
    order of their numbers, so a task finds whole blocks and nothing is shuffled; of a
    block that two tasks or two pieces share each has a row, with other places.
    """
    ship_code(sentences.sparkSession)

    def run(batches):
        for piece in _pieces(batches):
            grams, ends, texts = distinct_trigrams(piece.column(2))
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(piece.column(1).to_numpy()[texts]))
            yield pa.record_batch([grams, pa.array(np.full(len(grams), piece.column(0)[0].as_py())), places], names=["trigram", "block", "places"])

    placed = sentences.select(F.shiftright(key, BLOCK_BITS).alias("block"), F.col(key).bitwiseAND(BLOCK - 1).cast("short").alias("place"), "normalized_sentence")
    return placed.mapInArrow(run, "trigram string, block long, places array<short>")


def unpacked(blocks: DataFrame, key: str) -> DataFrame:
    """(trigram, key): a row for each posting."""
    return blocks.select("trigram", "block", F.explode("places").alias("place")).select("trigram", _id().alias(key))


def _id() -> Column:
    return F.shiftleft("block", BLOCK_BITS) + F.col("place")


def merged(blocks: DataFrame, sizes: dict[str, int], key: str) -> DataFrame:
    """(key, shared) of the sentences that have all but ``DAMAGE`` of the trigrams in
    ``sizes``, a query's with their posting sizes.

    Such a sentence is in one of the ``DAMAGE + 1`` shortest lists. Of the longer lists
    only blocks are opened in which the shortest have something, and of a block only
    what the shortest have is taken out.
    """
    order = sorted(sizes, key=lambda g: (sizes[g], g))
    short, long = order[: DAMAGE + 1], order[DAMAGE + 1 :]
    probes = blocks.where(F.col("trigram").isin(short))
    hits = probes.select("block", F.explode("places").alias("place"))
    if long:
        there = probes.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("probed"))
        there = F.broadcast(there) if sum(sizes[g] for g in short) <= LISTED_POSTINGS else there
        met = blocks.where(F.col("trigram").isin(long)).join(there, "block")
        hits = hits.unionByName(met.select("block", F.explode(F.array_intersect("places", "probed")).alias("place")))
    counted = hits.groupBy("block", "place").agg(F.count("*").alias("shared"))
    return counted.where(F.col("shared") >= len(order) - DAMAGE).select(_id().alias(key), "shared")


def probed(blocks: DataFrame, trigrams: list[str]) -> list[int]:
    """The ids in the lists of some trigrams whose sizes have been checked."""
    return [r[0] for r in blocks.where(F.col("trigram").isin(trigrams)).select("block", F.explode("places").alias("place")).select(_id()).distinct().collect()]


class SentenceIndex:
    """Sentences, packed postings and posting sizes, stored once and used by every query after."""

    KEY = "sentence_id"

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.sentences, self.blocks, self.sizes, self._stats = (spark.read.parquet(f"{path}/{t}") for t in ("sentences", "postings", "sizes", "stats"))
        self._known: dict[float, tuple[int, dict[str, int]]] = {}

    @classmethod
    def build(cls, spark: SparkSession, sentences: DataFrame, path: str) -> SentenceIndex:
        """Write a new version of the index below ``path``.

        Sentences get dense ids in the order of source and offset, the same in every
        build; postings are made from the stored table, so the two agree whatever is
        run again. Counts are observed while tables are written. Statistics come last
        and make the version the current one; whoever has opened the version before
        keeps it, those before that are deleted.
        """
        began, path = time.perf_counter(), qualified(spark, path)
        older = cls._versions(spark, path)
        now = f"{path}/version={time.time_ns():020d}"
        records, packed = Observation(), Observation()
        with passing(spark):
            ordered = [F.col(c).asc_nulls_first() for c in ("source_text", "offset", "original_sentence")]
            # stored first: range partitions are chosen by a pass of their own
            numbers = numbered(written(sentences, "sentences", compression="zstd"), ordered, cls.KEY).observe(records, F.count("*").alias("record_count"))
            stored = write_at(numbers, f"{now}/sentences", compression="zstd")
        layout = ["trigram", "block"]
        # each file is sorted: a trigram is one place in it, found by the statistics of row groups and pages
        blocks = posting_blocks(stored, cls.KEY).sortWithinPartitions(*layout)
        blocks = write_at(blocks, f"{now}/postings", **{"parquet.block.size": ROW_GROUP})
        sizes = blocks.groupBy("trigram").agg(F.sum(F.size("places")).cast("long").alias("postings")).coalesce(1).sortWithinPartitions("trigram")
        sizes = sizes.observe(packed, F.count("*").alias("distinct_trigrams"), F.coalesce(F.sum("postings"), F.lit(0)).cast("long").alias("total_postings"))
        write_at(sizes, f"{now}/sizes")
        counts = {**records.get, **packed.get}
        row = (counts["record_count"], counts["distinct_trigrams"], counts["total_postings"], time.perf_counter() - began, size_of(spark, now))
        write_at(spark.createDataFrame([row], "record_count long, distinct_trigrams long, total_postings long, build_seconds double, index_bytes long"), f"{now}/stats")
        for version in older[:-1]:
            delete(spark, version)
        return cls(spark, now)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SentenceIndex:
        versions = cls._versions(spark, path)
        if not versions:
            raise FileNotFoundError(f"No index below {path}")
        return cls(spark, versions[-1])

    @staticmethod
    def _versions(spark: SparkSession, path: str) -> list[str]:
        return [found.removesuffix("/stats/_SUCCESS") for found in listed(spark, f"{path}/version=*/stats/_SUCCESS")]

    def keep(self) -> SentenceIndex:
        """Hold the index in the executors' memory from its first use on."""
        for df in (self.sentences, self.blocks, self.sizes):
            df.cache()
        return self

    def located(self, *columns: str) -> DataFrame:
        """(trigram, columns): a row for each posting, with these columns of its sentence.

        Blocks of postings meet the sentences of their block, so the postings are moved
        packed and taken apart where they meet.
        """
        ship_code(self.sentences.sparkSession)
        kinds = {f.name: f.dataType.simpleString() for f in self.sentences.schema}

        def run(packed: pa.Table, held: pa.Table) -> pa.Table:
            number = np.zeros(BLOCK, np.int64)
            number[held.column("place").to_numpy()] = np.arange(held.num_rows)
            places = packed.column("places").combine_chunks()
            row = pa.array(number[places.flatten().to_numpy()])
            gram = packed.column("trigram").take(pc.list_parent_indices(places))
            return pa.table([gram, *(held.column(c).take(row) for c in columns)], names=["trigram", *columns])

        held = self.sentences.select(F.shiftright(self.KEY, BLOCK_BITS).alias("block"), F.col(self.KEY).bitwiseAND(BLOCK - 1).cast("int").alias("place"), *columns)
        met = self.blocks.groupBy("block").cogroup(held.groupBy("block"))
        return met.applyInArrow(run, ", ".join(["trigram string", *(f"`{c}` {kinds[c]}" for c in columns)]))

    @property
    def postings(self) -> DataFrame:
        """(trigram, sentence_id), unpacked."""
        return unpacked(self.blocks, self.KEY)

    def common(self, share: float) -> tuple[int, dict[str, int]]:
        """The number of sentences, and the sizes of trigrams that a ``share`` of them
        have: at most the trigrams of an average sentence, divided by ``share``. Read once."""
        if share not in self._known:
            n = self._stats.head().record_count
            self._known[share] = n, {r.trigram: r.postings for r in self.sizes.where(F.col("postings") >= max(1, share * n)).collect()}
        return self._known[share]

    def sizes_of(self, grams: list[str]) -> dict[str, int]:
        """How many sentences have each of a query's trigrams."""
        known = {r.trigram: r.postings for r in self.sizes.where(F.col("trigram").isin(grams)).collect()}
        return {g: known.get(g, 0) for g in grams}

    def candidates(self, prefix: str) -> DataFrame:
        """The sentences that could match with one edit; all for a query of too few trigrams."""
        query = normalize_query(self.sentences.sparkSession, prefix)
        grams = query_trigrams(query)
        if not query or len(grams) <= DAMAGE:
            return self.sentences.where(F.lit(bool(query)))
        sizes = self.sizes_of(grams)
        if sum(not n for n in sizes.values()) > DAMAGE:
            return self.sentences.where(F.lit(False))
        return self.sentences.join(merged(self.blocks, sizes, self.KEY), self.KEY).drop("shared")

    def stats(self) -> DataFrame:
        """One row: record_count, distinct_trigrams, total_postings, build_seconds,
        index_bytes (as stored)."""
        return self._stats
