"""Quality scores from supervised subword embeddings.

A text is the average of the learned vectors of its words, of their character
n-grams and of its pairs of neighbouring words, all hashed into one table; a
softmax layer turns the average into two class probabilities. Table and layer are
learned together by stochastic gradient descent in numpy, on a bounded sample of
labelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.llm.common import hashed_sample, held_out, slices
from sentria.llm.wordtable import WordTable, buckets, codes, inner

BITS, DIM, NGRAMS = 18, 12, (3, 4)
BUCKETS = 1 << BITS
#: The sample: so many labelled texts of each class, none longer than so many characters.
PER_CLASS, SAMPLE_CHARS = 800, 20_000
EPOCHS, RATE, SEED = 6, 4.0, 7
#: Words that are looked up together.
GROUP = 50_000


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of each word and of each character n-gram of ``<word>``."""
    points, starts, lengths = codes([f"<{w}>" for w in words])
    whole = np.array([word_hash(w) for w in words], np.uint64)
    parts = [(whole, np.arange(len(words)))] + [inner(points, starts, lengths, n, n) for n in NGRAMS]
    return buckets(np.concatenate([h for h, _ in parts]), BITS), np.concatenate([o for _, o in parts])


def word_hash(word: str) -> int:
    return crc32(word.encode("utf-8"))


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words. The hash is of the difference of the words'
    own, so that all repetitions of a word, whichever it is, fall together."""
    return buckets((hashes[1:] - hashes[:-1]).view(np.uint64), BITS)


@dataclass
class Model:
    """What scoring needs: each bucket's share of the logit, and the bias.

    The softmax of two classes depends only on the difference of their outputs,
    which is linear in the averaged vector, so each bucket's vector shrinks to one
    number.
    """

    weight: np.ndarray
    bias: float


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent, one text a step, the rate falling to zero."""
    rng = np.random.default_rng(seed)
    docs = []
    for text in texts:
        words = text.split()
        ids, _ = word_features(words)
        hashes = np.array([word_hash(w) for w in words], np.int64)
        docs.append(np.unique(np.concatenate([ids, pair_features(hashes)]), return_counts=True))
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, counts = docs[i]
            lr = rate * (1 - step / steps)
            step += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)[:, None]
            mean = (table[ids] * share).sum(0)
            out = mean @ layer + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= lr * 0.1 * np.outer(mean, p)
            bias -= lr * 0.02 * p
            table[ids] -= (lr * 40) * share * back
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, max_chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """At most ``per_class`` texts of each class, the first by a hash of their id.

    Only rows that may be learned from, with an id, a label of 0 or 1 and a text of
    1 to ``max_chars`` characters. Ids are chosen before any text is gathered.
    """
    known = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).where("key is not null and label in (0, 1)").where(~held_out("key"))
    lengths = docs.select(F.col(id_col).alias("key"), F.length(text_col).alias("n")).where(F.col("n").between(1, max_chars))
    fit = known.groupBy("key").agg(F.max("label").alias("label")).join(lengths.select("key").distinct(), "key", "left_semi")
    chosen = hashed_sample(fit, "label", "key", per_class).select("key", "label")
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # at most 2 * per_class ids
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("words")).where(F.length("words").between(1, max_chars))
    rows = {}
    for r in texts.join(F.broadcast(chosen), "key").groupBy("key").agg(F.max("words").alias("words"), F.max("label").alias("label")).collect():
        rows[r["key"]] = (r["words"], r["label"])
    keys = sorted(rows)
    return [rows[k][0] for k in keys], [rows[k][1] for k in keys]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.table = WordTable(3, self._make)

    def _make(self, words: list[str]) -> np.ndarray:
        """Of each word: its features' share of the logit, their number, its hash."""
        ids, owner = word_features(words)
        sums = np.bincount(owner, self.model.weight[ids], len(words))
        return np.stack([sums, np.bincount(owner, minlength=len(words)), [word_hash(w) for w in words]], 1)

    def scores(self, texts: list[str | None]) -> list[float]:
        out: list[float] = []
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append((text or "").split())
            size += len(held[-1])
            if size >= GROUP:
                out += self._group(held)
                held, size = [], 0
        return out + self._group(held)

    def _group(self, docs: list[list[str]]) -> list[float]:
        rows = self.table.look_up([w for words in docs for w in words])
        out, at = [], 0
        for words in docs:
            own = rows[at : at + len(words)]
            at += len(words)
            logit = self.model.bias
            if words:
                pairs = self.model.weight[pair_features(own[:, 2].astype(np.int64))]
                logit += (own[:, 0].sum() + pairs.sum()) / (own[:, 1].sum() + len(pairs))
            out.append(float(1 / (1 + np.exp(-np.clip(logit, -500, 500)))))
        return out


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) of every row, whole texts, no shuffle.

    A null or empty text scores what the bias alone gives. Rows with a null or
    repeated id come out as they are; an id that is null is never held out. Other
    columns are not read.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # BUCKETS numbers
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in slices(batches):
            scores = pa.array(scorer.scores(batch.column(1).to_pylist()), pa.float64())
            yield pa.record_batch([batch.column(0), scores], names=[id_col, "score"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, score double")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Learn from ``labels`` and score ``docs``. With no usable label every score
    is 0.5."""
    texts, known = sample(docs, labels, id_col, text_col, **kw)
    model = train(texts, known) if texts else Model(np.zeros(BUCKETS), 0.0)
    return score_texts(docs, model, id_col, text_col)
