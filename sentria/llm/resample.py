"""Importance resampling towards a target distribution of hashed words.

Two passes over the documents in Arrow. The first counts each partition's features
into one vector of ``BUCKETS`` numbers (``np.bincount``); vectors are merged by
``treeReduce``, so the driver gets one of them, whatever the table's size. Both
tables' vectors give each bucket a gain, which every task of the second pass gathers
for the features of its documents and sums by document (``np.bincount`` with
weights). Documents are then drawn by Gumbel keys: the highest of weight plus noise.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.llm.common import slices, written
from sentria.operators.running import numbered

BUCKETS = 10_000
#: Percent of the documents that may be drawn which are drawn; the words that these have.
PERCENT, LEAST_WORDS = 10, 20
SEED = 2024
#: Bytes of a text whose words are held at a time, about.
PIECE = 1 << 20

# in UTF-8 all bytes of a character past ASCII are 0x80 or more
_WORD, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def word_buckets(text: bytes, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of a text's words, a piece at a time. A-Z are lower-cased."""
    text = text.lower()  # of bytes: ASCII only
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        words = _WORD.findall(text, at, end)
        yield np.fromiter(map(crc32, words), np.uint32, len(words)).astype(np.int64) % buckets
        at = end


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in slices(batches):
        yield batch, [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket. One vector leaves each
    partition."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, held in _texts(batches, 0):
            for text in held:
                for found in word_buckets(text, buckets):
                    total += np.bincount(found, minlength=buckets)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = texts.select(text_col).mapInArrow(run, "counts binary").rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight, in thousandths of a
    natural logarithm of its (smoothed) share in the target to that in the documents."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    n = len(s)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))))


def noise(key: object, seed: int = SEED) -> float:
    """Gumbel noise of a document, in thousandths, by a hash of its id."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return float(np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))))


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray, seed: int, id_col: str) -> Iterator[pa.RecordBatch]:
    for batch, held in _texts(batches, 1):
        found = [(row, piece) for row, text in enumerate(held) for piece in word_buckets(text, len(gain))]
        owners = np.repeat(np.array([row for row, _ in found], np.int64), [len(piece) for _, piece in found])
        features = np.concatenate([np.zeros(0, np.int64), *(piece for _, piece in found)])
        n = np.bincount(owners, minlength=len(held))
        weight = np.bincount(owners, weights=gain[features], minlength=len(held)).astype(np.int64)
        shift = [None if key is None else int(w + noise(key, seed)) for key, w in zip(batch.column(0).to_pylist(), weight.tolist())]
        yield pa.record_batch([batch.column(0), pa.array(n.astype(np.int64)), pa.array(weight), pa.array(shift, pa.int64())], names=[id_col, "n_features", "weight", "score"])


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score) of every row. ``gain`` goes to every task: one
    number for each bucket. The score is null without an id."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        yield from _weigh(batches, sent.value, seed, id_col)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_features long, weight long, score long")


def drawn(scored: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... of the highest scores, ties to the smaller
    id; null for documents that are not drawn.

    The rows that may be drawn are sorted in range partitions and numbered from
    those, so no task sees all of them.
    """
    may = F.coalesce((F.col("n_features") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    eligible = scored.where(may)
    number = eligible.count() * percent // 100
    ranked = numbered(eligible, [F.desc("score"), F.asc(id_col), F.asc("n_features")], "place")
    rank = F.when(F.col("place") < number, F.col("place") + 1)
    columns = [*scored.columns, "rank"]
    return ranked.withColumn("rank", rank).select(columns).unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")).select(columns))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``.

    Null and empty texts have no features and weight 0. A row without an id has a
    weight but no score and is not drawn. Rows repeated under one id are documents of
    their own: each counts, and each may be drawn; equal scores go to the smaller id,
    then to fewer features. With an empty ``target`` all gains compare with an even
    distribution; an empty ``docs`` gives an empty result. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    return drawn(written(weights(docs, gain, id_col, text_col, seed), "weights"), id_col, percent, least_words)
