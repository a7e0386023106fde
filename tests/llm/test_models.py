import math
"""Language ID and quality scores: held-out accuracy, and what odd rows give."""

import itertools
import unicodedata
from zlib import crc32

import numpy as np
import pytest

from sentria.llm import langid, quality
from sentria.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    crf = langid.Crf(["a", "b", "c"], np.zeros((8, 3)), rng.standard_normal((3, 3)), {})
    tagger = langid.Tagger(crf)
    psi = [rng.random((n, 3)) + 0.01 for n in (4, 1, 6, 6, 2)]
    for p, got in zip(psi, tagger.posteriors(psi)):
        want = np.zeros_like(p)
        for path in itertools.product(range(3), repeat=len(p)):
            v = np.prod([p[i, y] for i, y in enumerate(path)]) * np.prod([tagger.go[a, b] for a, b in zip(path, path[1:])])
            for i, y in enumerate(path):
                want[i, y] += v
        assert np.allclose(got, want / want.sum(1, keepdims=True))


def test_code_switched_words():
    en, fr = "the house and the garden with that thing".split(), "le jardin est dans la maison avec des fleurs".split()
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(en, 300)) for _ in range(5)] + [" ".join(rng.choice(fr, 300)) for _ in range(5)]
    crf = langid.train(texts, ["en"] * 5 + ["fr"] * 5)
    tagger = langid.Tagger(crf)
    text = en + fr + en
    (post,) = tagger.posteriors([tagger.emissions(text)])
    assert [crf.langs[i] for i in post.argmax(1)] == ["en"] * len(en) + ["fr"] * len(fr) + ["en"] * len(en)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.predict(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_only_letters_are_words():
    assert langid.words("½ ² Ⅷ ① ٣ 5 _ é\u0301") == ["é"] and langid.words("Héllo x²y 日本一 a½") == ["héllo", "x", "y", "日本一", "a"]
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if unicodedata.category(c)[0] in "LN":
            assert bool(langid.words(c)) == (unicodedata.category(c)[0] == "L"), c


def test_texts_without_letters_are_in_no_language(spark):
    crf = langid.train(["the house by the garden " * 20, "le jardin de la maison " * 20], ["en", "fr"])
    rows = [(1, "½ ²"), (2, "Ⅷ"), (3, "① ٣ 7"), (4, "x²")]
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), crf).collect()}
    assert [out[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and out[4][0] in ("en", "fr")


def test_training_follows_the_gradient():
    """After an epoch every feature speaks for its own language, and languages go on."""
    texts, labels = ["aa ab ba " * 30, "cc cd dc " * 30], ["x", "y"]
    crf = langid.train(texts, labels, epochs=1)
    ids = {w: langid.word_features([w], crf.lexicon)[0] for w in ("aa", "ab", "cc", "dc")}
    for w, lang in (("aa", 0), ("ab", 0), ("cc", 1), ("dc", 1)):
        assert (crf.weight[ids[w], lang] > 0).all() and (crf.weight[ids[w], 1 - lang] < 0).all()
    assert crf.moves[0, 0] > crf.moves[0, 1] and crf.moves[1, 1] > crf.moves[1, 0]


def plain_likelihood(psi_scores, moves, y):
    """Log-probability of one labelling by enumeration."""
    def total(path):
        return sum(psi_scores[i][k] for i, k in enumerate(path)) + sum(moves[a][b] for a, b in zip(path, path[1:]))

    every = [total(p) for p in itertools.product(range(len(moves)), repeat=len(psi_scores))]
    return total(y) - np.log(np.sum(np.exp(every)))


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(2)
    for _ in range(5):
        scores, moves = rng.standard_normal((1, 5, 3)), rng.standard_normal((3, 3))
        y = rng.integers(0, 3, (1, 5))
        grad_e, grad_m = langid.gradient(scores, moves, y)
        step = 1e-5
        for t in range(5):
            for k in range(3):
                up, down = scores.copy(), scores.copy()
                up[0, t, k] += step
                down[0, t, k] -= step
                want = (plain_likelihood(up[0], moves, y[0]) - plain_likelihood(down[0], moves, y[0])) / (2 * step)
                assert abs(-grad_e[0, t, k] - want) < 1e-6
        for a in range(3):
            for b in range(3):
                up, down = moves.copy(), moves.copy()
                up[a, b] += step
                down[a, b] -= step
                want = (plain_likelihood(scores[0], up, y[0]) - plain_likelihood(scores[0], down, y[0])) / (2 * step)
                assert abs(-grad_m[a, b] - want) < 1e-6


def plain_quality(model, text):
    """The score of one text by the definition, feature by feature."""
    words = (text or "").split()
    crc = lambda w: crc32(w.encode())
    bucket = lambda h: int(quality.buckets(np.array([h], np.int64).view(np.uint64), quality.BITS)[0])
    found = []
    for w in words:
        found.append(bucket(crc(w)))
        for n in quality.NGRAMS:
            for i in range(len(w) + 2 - n + 1):
                gram = f"<{w}>"[i : i + n]
                h = n * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                for c in gram:
                    h = (h ^ ord(c)) * 0x100000001B3 & (1 << 64) - 1
                found.append(int(quality.buckets(np.array([h], np.uint64), quality.BITS)[0]))
    found += [bucket(crc(b) - crc(a)) for a, b in zip(words, words[1:])]
    logit = model.bias + (sum(model.weight[i] for i in found) / len(found) if found else 0.0)
    return 1 / (1 + np.exp(-logit))


def test_scores_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    model = quality.Model(rng.standard_normal(quality.BUCKETS) * 3, 0.2)
    texts = [None, "", "one", "one one one", "Ünï cödé 日本語 x", " spaced \t out\nlines ", " ".join(f"w{i % 37}" for i in range(500)), "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score_texts(df, model).collect()}
    for i, t in enumerate(texts):
        want = plain_quality(model, t)
        assert abs(got[i][0] - want) < 1e-9 and got[i][1] == int(got[i][0] >= 0.7)


def test_a_training_step_equals_plain_arithmetic():
    """One text, one epoch: table, layer and bias after the step, written out."""
    text, label, rate = "good words here good", 1, 2.0
    got = quality.train([text], [label], epochs=1, rate=rate, seed=3)
    rng = np.random.default_rng(3)
    table = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.BUCKETS, quality.DIM)).astype(np.float32)
    words = text.split()
    ids = [*quality.word_features(words)[0].tolist(), *quality.pair_features(np.array([crc32(w.encode()) for w in words], np.int64)).tolist()]
    mean = [sum(float(table[i, j]) for i in ids) / len(ids) for j in range(quality.DIM)]
    # the layer is zero at first: both classes have 0.5, and the table does not move
    off = [0.5, 0.5 - 1]
    layer = [[-rate * 0.1 * mean[j] * off[c] for c in (0, 1)] for j in range(quality.DIM)]
    bias = [-rate * 0.02 * off[c] for c in (0, 1)]
    change = np.array([row[1] - row[0] for row in layer])
    assert abs(got.bias - (bias[1] - bias[0])) < 1e-6
    assert np.allclose(got.weight, table.astype(np.float64) @ change, atol=1e-6)


def test_later_training_steps_equal_plain_arithmetic():
    """Two texts, two epochs: the table moves too, and the layer is no longer zero."""
    texts, labels, rate = ["good words here good", "bad words there", "other text"], [1, 0, 1], 1.5
    got = quality.train(texts, labels, epochs=2, rate=rate, seed=5)
    rng = np.random.default_rng(5)
    ids = []
    for text in texts:
        words = text.split()
        ids.append([*quality.word_features(words)[0].tolist(), *quality.pair_features(np.array([crc32(w.encode()) for w in words], np.int64)).tolist()])
    start = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.BUCKETS, quality.DIM)).astype(np.float32)
    used = {i: [float(x) for x in start[i]] for own in ids for i in own}
    layer, bias, step = [[0.0, 0.0] for _ in range(quality.DIM)], [0.0, 0.0], 0
    for _ in range(2):
        for at in rng.permutation(3).tolist():
            lr, own = rate * (1 - step / 6), ids[at]
            step += 1
            mean = [sum(used[i][j] for i in own) / len(own) for j in range(quality.DIM)]
            out = [sum(mean[j] * layer[j][c] for j in range(quality.DIM)) + bias[c] for c in (0, 1)]
            p = [math.exp(o) / sum(map(math.exp, out)) for o in out]
            off = [p[c] - (labels[at] == c) for c in (0, 1)]
            back = [sum(layer[j][c] * off[c] for c in (0, 1)) for j in range(quality.DIM)]
            layer = [[layer[j][c] - lr * 0.1 * mean[j] * off[c] for c in (0, 1)] for j in range(quality.DIM)]
            bias = [bias[c] - lr * 0.02 * off[c] for c in (0, 1)]
            for i in set(own):
                used[i] = [used[i][j] - lr * 40 * own.count(i) / len(own) * back[j] for j in range(quality.DIM)]
    change = [row[1] - row[0] for row in layer]
    assert abs(got.bias - (bias[1] - bias[0])) < 1e-5
    moved = [sum(used[i][j] * change[j] for j in range(quality.DIM)) for i in used]
    assert np.allclose(got.weight[list(used)], moved, rtol=1e-3, atol=1e-6)
    assert any(not np.allclose(used[i], start[i], atol=1e-4) for i in used)  # the vectors did move


def test_only_the_commonest_labels_are_sampled(spark):
    from sentria.llm.common import hashed_sample

    df = spark.createDataFrame([(f"l{i % 7 if i % 2 else i}", i) for i in range(100)], "label string, key long")
    got = hashed_sample(df, "label", "key", 3, most=5).groupBy("label").count().collect()
    assert len(got) == 5 and all(r["count"] == 3 for r in got)


def odd(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "123 --- !!", None, 1), (4, "the house " * 100_000, "en", 1), (None, "the house", "en", 1), (5, "the house", "en", 1), (5, "the house", "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_language_of_odd_rows(spark):
    docs = odd(spark)
    known = docs.unionByName(spark.range(100, 140).selectExpr("id doc_id", "'the house by the garden' text", "'en' lang", "0 score"))
    crf = langid.learn(known)
    out = sorted(((r.doc_id or 0, r.lang_pred) for r in langid.predict(docs, crf).collect()))
    assert out == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en"), (5, "en")]
    assert [r.lang_pred for r in langid.predict(docs, langid.learn(docs.limit(0))).collect()] == ["und"] * 7
    assert langid.predict(docs.limit(0), crf).collect() == []
    kept = langid.accepted(docs, crf)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 5]


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)
    good = [r for r in held if r.quality]
    assert sum(r.predicted for r in good) >= 0.95 * len(good)


def test_quality_of_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (7, 3, 0), (1, 1, 0)], "doc_id long, quality int, score int")
    out = quality.quality(docs, labels).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out) and [r for r in out if r.doc_id is None][0].held_out is False
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).collect() == []


def test_nothing_is_learned_from_held_out_rows(spark):
    docs = spark.createDataFrame([(i, f"word{i}", "en", i % 2) for i in range(200)], "doc_id long, text string, lang string, quality int")
    kept = {r.doc_id for r in docs.where(~held_out("doc_id")).collect()}
    assert kept == {i for i in range(200) if crc32(str(i).encode()) % 4 != 2}
    assert set(langid.sample(docs)[0]) == {f"word{i}" for i in kept} if len(kept) <= langid.PER_LANG else len(langid.sample(docs)[0]) == langid.PER_LANG
    assert set(quality.sample(docs.drop("quality"), docs)[0]) == {f"word{i}" for i in kept}


@pytest.mark.parametrize("n", [3, 7])
def test_samples_are_bounded(spark, n):
    docs = spark.createDataFrame([(i, f"word{i}", "en" if i % 3 else "fr", i % 2) for i in range(200)], "doc_id long, text string, lang string, quality int")
    assert len(langid.sample(docs, per_lang=n)[0]) == 2 * n and len(quality.sample(docs, docs, per_class=n)[0]) == 2 * n
