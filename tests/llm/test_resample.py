import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np

from sentria.llm import resample as op
from sentria.llm.resample import bucket_counts, gains, resample, word_buckets

SCHEMA = "doc_id long, text string, score string, rank string, n_features string"


def plain(rows, target, buckets=10_000, percent=10, least=20):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").translate(lower))
    bucket = lambda w: crc32(w.encode()) % buckets
    s, t = Counter(bucket(w) for _, x in rows for w in words(x)), Counter(bucket(w) for x in target for w in words(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        found = words(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(found), weight, score))
    may = sorted((r for r in out if r[1] >= least and r[3] is not None), key=lambda r: (-r[3], r[0], r[1]))
    rank = [(*r, n + 1) for n, r in enumerate(may[: len(may) * percent // 100])]
    left = Counter(out) - Counter(r[:4] for r in rank)
    return sorted(map(repr, rank + [(*r, None) for r in left.elements()]))


def rows():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(300)] + ["ÉTÉ", "été", "x\x00y", "1.5", "a_b", "naïve"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))).title() for _ in range(160)]
    out = list(enumerate(texts))
    out += [(5, texts[5]), (5, texts[5]), (7, "short"), (200, None), (201, ""), (202, "?! ."), (None, texts[9]), (None, None)]
    return out + [(203, "lang " * 40_000)]


def test_equals_plain_arithmetic(spark, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 64)  # only of this process: the counts below
    docs, target = rows(), ["w1 w2 W3 w4", None, "", "w1 été été"]
    df = spark.createDataFrame([(i, t, "s", "r", "n") for i, t in docs], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(df, bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(docs, target)
    assert sorted(repr(tuple(r)) for r in resample(df, bench.limit(0), buckets=50, percent=40, least_words=3).collect()) == plain(docs, [], 50, 40, 3)
    assert resample(df.limit(0), bench).collect() == []


def test_pieces_change_nothing(monkeypatch):
    text = ("One two-three, fünf" * 50).encode()
    whole = np.concatenate(list(word_buckets(text)))
    for size in (1, 7, 100):
        monkeypatch.setattr(op, "PIECE", size)
        assert np.array_equal(np.concatenate(list(word_buckets(text))), whole)


def test_partition_vectors_add_up(spark):
    df = spark.createDataFrame([(f"a b {i}",) for i in range(500)], "text string")
    one, many = bucket_counts(df.coalesce(1)), bucket_counts(df.repartition(40))
    assert np.array_equal(one, many) and one.sum() == 1500
    assert bucket_counts(df.limit(0)).sum() == 0
    assert (gains(one, one) == 0).all()


def test_the_draw_leans_to_the_target(spark):
    """Documents of the target's words are drawn far more often than their share."""
    rng = np.random.default_rng(1)
    text = lambda kind: " ".join(f"{kind}{rng.integers(0, 40)}" for _ in range(30))
    df = spark.createDataFrame([(i, text("t" if i % 10 == 0 else "o")) for i in range(600)], "doc_id long, text string")
    bench = spark.createDataFrame([(text("t"),) for _ in range(20)], "text string")
    got = [r.doc_id for r in resample(df, bench).where("rank is not null").collect()]
    assert len(got) == 60 and all(i % 10 == 0 for i in got)
