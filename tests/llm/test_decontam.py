import random

import numpy as np
import pytest

from sentria.llm.decontam import overlaps, tiling, tokens, uncontaminated
from sentria.llm.rolling import mixed, rolling

DOCS = "doc_id long, text string, item_id string, coverage string"
ITEMS = "item_id long, text string, doc_id long"


def plain_tiling(text, item, least):
    """Greedy string tiling as it is defined: the longest free match, again and again."""
    free_t, free_i, out = [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for p in range(len(text)):
            for q in range(len(item)):
                n = 0
                while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] and free_t[p + n] and free_i[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return sorted(out)
        for k in range(n):
            free_t[p + k] = free_i[q + k] = False
        out.append((p, q, n))


def test_tiling_equals_plain_tiling():
    rng = random.Random(5)
    for _ in range(300):
        text = np.array([rng.randrange(4) for _ in range(rng.randrange(0, 40))], np.int64)
        item = np.array([rng.randrange(4) for _ in range(rng.randrange(0, 20))], np.int64)
        got, want = tiling(text, item, 3), plain_tiling(text.tolist(), item.tolist(), 3)
        for p, q, n in got:
            assert n >= 3 and (text[p : p + n] == item[q : q + n]).all()
        assert len({k for p, _, n in got for k in range(p, p + n)}) == sum(n for *_, n in got)
        assert len({k for _, q, n in got for k in range(q, q + n)}) == sum(n for *_, n in got)
        assert got == sorted(want)


def test_distinct_tokens_give_the_same_tiles():
    item = np.arange(60)
    text = np.concatenate([[90, 91], item[40:], [92], item[:20], item[20:40], [93]])
    assert tiling(text, item, 5) == plain_tiling(text.tolist(), item.tolist(), 5)


def test_rolling_hash_depends_on_the_window_alone():
    a = mixed(np.arange(50))
    assert (rolling(a, 5)[10:20] == rolling(a[10:24], 5)).all()
    assert len(set(rolling(a, 5).tolist())) == 46


WORDS = [f"w{i}" for i in range(500)]


def passage(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def case():
    items = [(1, passage(1, 40), 9), (2, passage(2, 20), 9), (3, "too short", 9), (4, None, 9), (5, "", 9), (None, passage(1, 40), 9)]
    one, two = items[0][1].split(), items[1][1].split()
    docs = [
        (10, f"{passage(10, 50)} {items[0][1].upper()}, {passage(11, 9)}"),
        (11, " ".join(one[25:] + ["x"] + one[10:25] + ["y"] + one[:10])),  # rearranged
        (12, " ".join(one[:12])),  # under the threshold
        (13, items[1][1] + " " + items[0][1]),
        (14, passage(14, 3000)),
        (15, None),
        (16, ""),
        (17, "too short"),
        (None, items[0][1]),
        (18, ("zz " * 1000) + " ".join(two[8:] + two[:8])),
        (18, ("zz " * 1000) + " ".join(two[8:] + two[:8])),
    ]
    return [(d, t, "a", "b") for d, t in docs], items


@pytest.mark.parametrize("limit", [16_000_000, 0])
def test_planted_passages(spark, limit):
    docs, items = case()
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = sorted(((r.doc_id, r.item_id, round(r.coverage, 3)) for r in overlaps(df, bench, broadcast_chars=limit).collect()), key=str)
    want = []
    for d, t, *_ in docs:
        for i, text, _ in items:
            item = tokens(text)
            if i is not None and len(item) >= 5:
                covered = sum(n for *_, n in plain_tiling(tokens(t)[-400:], item, 5)) / len(item)
                if covered >= 0.5:
                    want.append((d, i, round(covered, 3)))
    assert got == sorted(want, key=str)
    assert {g[:2] for g in got} == {(10, 1), (11, 1), (13, 1), (13, 2), (None, 1), (18, 2)}


def awkward():
    """Several texts under one item_id, repeated benchmark rows, null and repeated ids."""
    docs, items = case()
    one, five = items[0][1], passage(5, 30)
    items += [(1, five, 9), items[0], (7, one, 9), (None, five, 9)]
    docs += [(20, f"{passage(20, 40)} {five}", "a", "b"), (20, passage(21, 60), "a", "b"), (None, passage(22, 30), "a", "b"), (None, five, "a", "b"), (None, None, "a", "b")]
    return docs, items


def test_both_paths_agree_on_awkward_tables(spark):
    docs, items = awkward()
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want, clean = [], []
    for d, t, *_ in docs:
        hits = []
        for i, text in {(i, text) for i, text, _ in items if i is not None and len(tokens(text)) >= 5}:
            item = tokens(text)
            tiles = plain_tiling(tokens(t)[-400:], item, 5)
            if 2 * sum(n for *_, n in tiles) >= len(item):
                hits.append((d, i, sum(n for *_, n in tiles), len(item)))
        want += hits
        clean += [] if hits else [(d, t)]
    for limit in (16_000_000, 0):
        got = overlaps(df, bench, broadcast_chars=limit).select("doc_id", "item_id", "covered_tokens", "item_tokens").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        kept = uncontaminated(df, bench, broadcast_chars=limit)
        assert kept.dtypes == df.dtypes
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(clean, key=str)
    assert (20, passage(21, 60)) in clean and (None, None) in clean and (20, 1) in {w[:2] for w in want} and {(None, 1), (None, 7)} <= {w[:2] for w in want}


def test_both_paths_agree_on_random_tables(spark):
    rng = random.Random(9)
    few = [f"w{i}" for i in range(40)]
    items = [(i % 5, " ".join(rng.choices(few, k=rng.randrange(4, 30))), 0) for i in range(12)]
    common = " ".join(few[:8])
    docs = []
    for d in range(80):
        parts = [" ".join(rng.choices(few, k=rng.randrange(12)))]
        for _ in range(rng.randrange(3)):
            words = rng.choice(items)[1].split()
            at = rng.randrange(len(words))
            parts.append(" ".join(words[at:] + words[:at]))
        docs.append((d, " ".join([common, *parts]), "a", "b"))  # eight words that all texts have
    items.append((50, f"{common} and more", 0))
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    near, far = (sorted(map(tuple, overlaps(df, bench, broadcast_chars=limit).collect())) for limit in (10**6, 0))
    assert near == far and len(near) > 80
    some, rest = (sorted(r.doc_id for r in uncontaminated(df, bench.where("item_id < 50"), broadcast_chars=limit).collect()) for limit in (10**6, 0))
    assert some == rest and 0 < len(some) < 80


@pytest.mark.parametrize("limit", [16_000_000, 0])
def test_empty_tables(spark, limit):
    docs, items = case()
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert overlaps(df, bench.limit(0), broadcast_chars=limit).collect() == [] and overlaps(df.limit(0), bench, broadcast_chars=limit).collect() == []
    assert uncontaminated(df.limit(0), bench, broadcast_chars=limit).collect() == []
    assert uncontaminated(df, bench.limit(0), broadcast_chars=limit).count() == len(docs)


@pytest.mark.parametrize("limit", [10**9, 0])
def test_ids_of_any_type_and_items_too_short(spark, limit):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([("d1", f"so {text} ends"), ("d2", "clean words only")], "doc_id string, text string")
    bench = spark.createDataFrame([("set-1", text), ("set-2", ""), ("set-3", "a b c d"), ("set-4", None), (None, text)], "item_id string, text string")
    got = overlaps(docs, bench, broadcast_chars=limit).collect()
    assert [(r.doc_id, r.item_id, r.n_tiles, r.coverage) for r in got] == [("d1", "set-1", 1, 1.0)]
    assert [r.doc_id for r in uncontaminated(docs, bench, broadcast_chars=limit).collect()] == ["d2"]
