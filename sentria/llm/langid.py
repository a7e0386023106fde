"""Language identification with a linear-chain conditional random field.

Every word of a text gets a distribution over the languages from forward-backward:
affix, character n-gram and lexicon features say what a word looks like, learned
transitions say how often neighbouring words change language. A text's language is
the one with the greatest mean over its words, so text that switches languages is
read word by word. Training and prediction run in numpy, many sequences in step.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.llm.common import bounded_batches, hashed_sample, held_out, slices
from sentria.llm.wordtable import WordTable, buckets, codes, inner, windows

UNKNOWN = "und"
BITS = 17
BUCKETS = 1 << BITS
#: The sample: so many labelled texts of each language, none longer than so many characters.
PER_LANG, SAMPLE_CHARS = 150, 12_000
#: Words of each language's lexicon, by how often the sample has them.
LEXICON = 400
#: Training sequences: their length in words, and how many words run on in one language.
SEQUENCE, RUN = 64, (3, 48)
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.15, 11
#: Words that go through forward-backward together.
GROUP = 300_000

#: A text is rejected if its best language has a lower mean than this.
MIN_SCORE = 0.35

#: Runs of what \w holds beside digits; numerals such as fractions are still among it.
_RUN = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters (Unicode L), in lower case."""
    found = _RUN.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    parted = (w if w.isalpha() else "".join(c if c.isalpha() else " " for c in w) for w in found)
    return " ".join(parted).split()


def word_features(found: list[str], lexicon: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every word's affixes (1 to 4 letters), n-grams (2 and 3
    letters) and lexicon entries."""
    points, starts, lengths = codes(found)
    hashes, owners = [], []
    for n in range(1, 5):
        long = np.flatnonzero(lengths >= n)
        hashes += [windows(points, n, 10 + n)[starts[long]], windows(points, n, 20 + n)[starts[long] + lengths[long] - n]]
        owners += [long, long]
    for n in (2, 3):
        h, owner = inner(points, starts, lengths, n, n)
        hashes.append(h)
        owners.append(owner)
    listed = [(i, crc32(w.encode()) if k < 0 else k) for i, w in enumerate(found) if w in lexicon for k in (-1, *lexicon[w])]
    hashes.append(np.array([k for _, k in listed], np.uint64) ^ np.uint64(0xC2B2AE3D27D4EB4F))
    owners.append(np.array([i for i, _ in listed], np.int64))
    return buckets(np.concatenate(hashes), BITS), np.concatenate(owners)


@dataclass
class Crf:
    langs: list[str]
    weight: np.ndarray  # buckets x languages
    moves: np.ndarray  # log-weights of going from one language to the next
    lexicon: dict[str, list[int]]

    def emissions(self, found: list[str]) -> np.ndarray:
        """words x languages: the summed weights of each word's features."""
        ids, owner = word_features(found, self.lexicon)
        return np.stack([np.bincount(owner, self.weight[ids, k], len(found)) for k in range(len(self.langs))], 1)


def _step(a: np.ndarray) -> np.ndarray:
    return a / a.sum(-1, keepdims=True)


def gradient(scores: np.ndarray, moves: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log-likelihood of labels ``y`` (sequences x places): its
    gradient by every score (sequences x places x languages) and by every move."""
    k, size = len(moves), scores.shape[1]
    psi = np.exp(scores - scores.max(2, keepdims=True))
    go = np.exp(moves - moves.max())
    ahead, behind = np.empty_like(psi), np.ones_like(psi)
    ahead[:, 0] = _step(psi[:, 0])
    for t in range(1, size):
        ahead[:, t] = _step(psi[:, t] * (ahead[:, t - 1] @ go))
    for t in range(size - 2, -1, -1):
        behind[:, t] = _step((psi[:, t + 1] * behind[:, t + 1]) @ go.T)
    post = _step(ahead * behind)
    pair = ahead[:, :-1, :, None] * go * (psi * behind)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    post[np.arange(len(y))[:, None], np.arange(size), y] -= 1
    there = np.bincount((y[:, :-1].astype(int) * k + y[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
    return post, pair.sum((0, 1)) - there


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Crf:
    """Maximum likelihood by stochastic gradients, each weight with its own rate.

    A labelled text is in one language, so training sequences are spliced: runs of
    words of one text follow runs of another, which is what transitions are learned
    from.
    """
    langs = sorted(set(labels))
    k, rng = len(langs), np.random.default_rng(seed)
    counts = [Counter() for _ in langs]
    streams: list[list[str]] = []
    for text, lang in zip(texts, labels):
        streams.append(words(text))
        counts[langs.index(lang)].update(streams[-1])
    lexicon: dict[str, list[int]] = {}
    for i, c in enumerate(counts):
        for word, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(word, []).append(i)
    numbers: dict[str, int] = {}
    runs = []
    for stream, lang in zip(streams, labels):
        ids, y, at = [numbers.setdefault(w, len(numbers)) for w in stream], langs.index(lang), 0
        while at < len(ids):
            n = int(rng.integers(*RUN))
            runs.append((ids[at : at + n], y))
            at += n
    turn = rng.permutation(len(runs))
    xs = np.array([w for i in turn for w in runs[i][0]], np.int32)
    ys = np.array([runs[i][1] for i in turn for _ in runs[i][0]], np.int8)
    n = len(xs) // SEQUENCE
    ids, owner = word_features(list(numbers), lexicon)
    order = np.argsort(owner, kind="stable")
    feats = np.split(ids[order], np.cumsum(np.bincount(owner, minlength=len(numbers)))[:-1]) if numbers else []
    weight, moves = np.zeros((BUCKETS, k)), np.zeros((k, k))
    seen_w, seen_m = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    if n == 0:
        return Crf(langs, weight, moves, lexicon)
    xs, ys = xs[: n * SEQUENCE].reshape(n, SEQUENCE), ys[: n * SEQUENCE].reshape(n, SEQUENCE)
    for _ in range(epochs):
        for at in range(0, n, BATCH):
            x, y = xs[at : at + BATCH], ys[at : at + BATCH]
            kinds, back = np.unique(x, return_inverse=True)
            sizes = np.array([len(feats[w]) for w in kinds])
            flat = np.concatenate([feats[w] for w in kinds])
            owner = np.repeat(np.arange(len(kinds)), sizes)
            scores = np.stack([np.bincount(owner, weight[flat, j], len(kinds)) for j in range(k)], 1)
            post, grad_m = gradient(scores[back.reshape(x.shape)], moves, y)
            by_word = np.stack([np.bincount(back.ravel(), post[..., j].ravel(), len(kinds)) for j in range(k)], 1)
            used, slot = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(slot, by_word[owner, j], len(used)) for j in range(k)], 1) / len(x)
            grad_m /= len(x)
            seen_w[used] += grad**2
            weight[used] -= RATE * grad / np.sqrt(seen_w[used])
            seen_m += grad_m**2
            moves -= RATE * grad_m / np.sqrt(seen_m)
    return Crf(langs, weight, moves, lexicon)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, max_chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """At most ``per_lang`` whole texts of each language, the first by a hash of
    their id, from rows that may be learned from."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("words"), F.col(lang_col).alias("label"))
    rows = rows.where("key is not null and label is not null and words is not null").where(~held_out("key")).where(F.length("words").between(1, max_chars) & (F.col("label") != UNKNOWN))
    chosen = hashed_sample(rows, "label", "key", per_lang).orderBy("label", "place").collect()
    return [r["words"] for r in chosen], [r["label"] for r in chosen]


class Tagger:
    """Posteriors of whole texts under one model, with a bounded memory of words."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.go = np.exp(crf.moves - crf.moves.max(initial=-1e300))
        self.table = WordTable(len(crf.langs), self._make)

    def _make(self, found: list[str]) -> np.ndarray:
        e = self.crf.emissions(found)
        return np.exp(e - e.max(1, keepdims=True)) + 1e-30

    def emissions(self, found: list[str]) -> np.ndarray:
        """A row of potentials for each word."""
        return self.table.look_up(found)

    def posteriors(self, psi: list[np.ndarray]) -> list[np.ndarray]:
        """Forward-backward over many sequences at once, step by step; sequences
        that have ended drop out, the longest come first."""
        k = len(self.crf.langs)
        sizes = np.array([len(p) for p in psi])
        rank = np.argsort(-sizes, kind="stable")
        live = np.searchsorted(-sizes[rank], -np.arange(sizes.max(initial=0)), "left")  # how many are longer than t
        starts = np.concatenate([[0], np.cumsum(live)])
        places = [starts[: sizes[r]] + i for i, r in enumerate(rank)]
        line = np.empty((starts[-1], k))
        for i, r in enumerate(rank):
            line[places[i]] = psi[r]
        ahead = np.empty_like(line)
        last = None
        for t in range(len(live)):
            here = line[starts[t] : starts[t + 1]]
            last = here if last is None else here * (last[: live[t]] @ self.go)
            last = last / last.sum(1, keepdims=True)
            ahead[starts[t] : starts[t + 1]] = last
        back_go = self.go.T.copy()
        behind = np.ones((live[-1] if len(live) else 0, k))
        for t in range(len(live) - 1, -1, -1):
            if t + 1 < len(live):
                grown = np.ones((live[t], k))
                grown[: live[t + 1]] = (line[starts[t + 1] : starts[t + 2]] * behind) @ back_go
                behind = grown / grown.sum(1, keepdims=True)
            ahead[starts[t] : starts[t + 1]] *= behind
        ahead /= ahead.sum(1, keepdims=True)
        out: list[np.ndarray] = [np.zeros((0, k))] * len(psi)
        for i, r in enumerate(rank):
            out[r] = ahead[places[i]]
        return out

    def read(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, mean posterior) of each text."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            found = words(text)
            if found and self.crf.langs:
                held.append((i, found))
                size += len(found)
                if size >= GROUP:
                    self._group(held, out)
                    held, size = [], 0
        if held:
            self._group(held, out)
        return out

    def _group(self, held: list[tuple[int, list[str]]], out: list[tuple[str, float]]) -> None:
        psi = self.emissions([w for _, found in held for w in found])
        cuts = np.cumsum([len(found) for _, found in held])[:-1]
        for (i, _), post in zip(held, self.posteriors(np.split(psi, cuts))):
            mean = post.mean(0)
            best = int(mean.argmax())
            out[i] = self.crf.langs[best], min(1.0, float(mean[best]))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw) -> Crf:
    """A model from a bounded sample of ``docs``; of no languages if none is known."""
    texts, labels = sample(docs, id_col, text_col, lang_col, **kw)
    return train(texts, labels)


def predict(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, whole texts, no shuffle.

    A null text, and one without a letter, is ``und`` with score 0, as is every text
    if the model knows no language. Of equally likely languages the first by name
    wins. Rows with a null or repeated id come out as they are; a null id is never
    held out. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(crf)  # BUCKETS rows and a lexicon of fixed size
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tagger = Tagger(sent.value)
        for batch in slices(batches, 1024):
            found = tagger.read(batch.column(1).to_pylist())
            yield pa.record_batch(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[id_col, "lang_pred", "score"],
            )

    out = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, crf: Crf, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` in a known language, all columns as they are, without a
    shuffle: those that are not ``und`` and whose words agree on their language at
    least as far as ``min_score``."""
    bounded_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(crf), docs.columns.index(text_col)

    def run(batches):
        tagger = Tagger(sent.value)
        for batch in slices(batches, 1024):
            keep = [lang != UNKNOWN and score >= min_score for lang, score in tagger.read(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
