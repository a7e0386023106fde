import random

import numpy as np
import xxhash

from sentria.llm import linededup, wordhash

PIECES = ["x", "y ", "Zz\t", "　İ", "ΑΣ", "\x1c", " ß\x85", "😀é" * 9, "Q" * 31, "q" * 32, "w" * 100, "ΣΑ'Σ", "\xad", "\n\n"]


def drawn(seed=1, n=120):
    rng = random.Random(seed)
    texts = [rng.choice(["", " "]).join(rng.choice(PIECES) + " " * rng.randrange(2) for _ in range(rng.randrange(150))) for _ in range(n)]
    return [*texts, "", " ", "one", *(" ".join(rng.choice("abc") for _ in range(k)) for k in range(14, 30)), ""]


def test_hashes_are_those_of_xxhash():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(500))
    starts = np.array([rng.randrange(400) for _ in range(300)] + [500, 0])
    ends = np.minimum(starts + [rng.randrange(70) for _ in range(302)], 500)
    assert wordhash.xxh64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(starts, ends)]


def test_words_are_those_of_split():
    texts = drawn()
    counts, starts, ends, hashes = wordhash.words(texts)
    whole = "\n".join(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert [whole[a:b] for a, b in zip(starts, ends)] == whole.split()
    assert hashes.tolist() == [xxhash.xxh64_intdigest(w.lower().encode()) for w in whole.split()]
    assert [len(x) for x in wordhash.words([])] == [0, 0, 0, 0]


def test_phrases_of_texts_together_are_those_of_each():
    texts = drawn(3)
    owner, *together = linededup.phrases(texts)
    assert len(set(owner.tolist())) > 50
    for i, text in enumerate(texts):
        _, *alone = linededup.phrases([text])
        for a, b in zip(together, alone):
            assert a[owner == i].tolist() == b.tolist()
    assert linededup.digests(texts).tolist() == together[4].tolist()
