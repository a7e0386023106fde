import random

import numpy as np
import xxhash

from sentria.llm.components import components
from sentria.llm.simhash import fingerprint, linked, near_duplicates, representatives

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    groups = {}
    for (doc_id, _), k in zip(rows, label):
        if doc_id is not None:
            groups[k] = min(groups.get(k, doc_id), doc_id)
    return sorted(((d, f"{f:016x}", groups.get(k)) for (d, _), f, k in zip(rows, fps, label)), key=str)


def texts(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    rows = [(100, None), (101, ""), (102, " \t\n"), (7, "one"), (8, "ONE two"), (9, "one two"), (None, "one two"), (8, "ONE two")]
    for i in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 60, 400]))]
        for _ in range(rng.choice([1, 1, 3])):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((len(rows) * 3 % 131 + 200 * len(rows), " ".join(copy)))
    rows.append((5000, "the same " * 70_000))  # over one block of shingles
    return rows


def test_fingerprint_equals_plain_count():
    for _, t in texts():
        if t is None or len(t) < 20_000:
            assert fingerprint(t) == plain_fingerprint(t)
    long = " ".join(str(i % 977) for i in range(70_000))
    assert fingerprint(long) == plain_fingerprint(long)


def test_components_equal_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)
    stay = {r.doc_id for r in representatives(docs).collect()}
    assert stay == {c for _, _, c in brute(rows)} | {None}


def test_texts_that_share_an_id_stay_or_go_by_themselves(spark):
    text, other = "a text of a few words which others have", "something that nobody else has written down so far"
    rows = [(3, text), (8, text), (8, other), (8, text), (3, text), (9, None), (9, ""), (None, text), (10, other + " in all")]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    kept = representatives(docs)
    assert kept.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in rows]
    assert sorted({bin(fps[2] ^ f).count("1") for f in fps})[:2] > [0, 3]  # no other is near it
    assert got == sorted([(3, text), (3, text), (8, other), (None, text), (9, None), (10, other + " in all")], key=str)


def test_tiles_of_a_full_cell_meet_in_parts(spark, monkeypatch):
    """A cell of many tiles gives the links that a comparison of all gives."""
    import sentria.llm.simhash as module

    monkeypatch.setattr(module, "TILE", 4)
    rng = np.random.default_rng(4)
    low = [int(sum(1 << int(b) for b in rng.choice(16, 3, replace=False))) for _ in range(150)]
    fps = sorted({a << 48 | b << 32 | 7 << 16 | 7 for a, b in zip(low, reversed(low))} | {7 << 16 | 6, 7 << 16 | 7, 0})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    links = {tuple(sorted(map(int, (r.a, r.b)))) for r in module._near_links(df, 3).collect()}
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in links:
        a, b = (int(np.int64(x).view(np.uint64)) for x in (a, b))
        root[find(a)] = find(b)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 3:
                assert find(a) == find(b)
    want = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            want[a] = min(want[b] for b in fps if bin(a ^ b).count("1") <= 3)
    assert len({find(f) for f in fps}) == len(set(want.values())) < len(fps)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tiles_find_every_link():
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    near = np.array([b ^ (1 << int(rng.integers(0, 62))) for b in base[:30]])
    left, right = np.concatenate([base, near]), np.concatenate([near, base[:10]])
    nodes, roots = linked(left, right, 3, False)
    links = {(int(a), int(b)) for a in left for b in right if bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") <= 3 and a != b}
    assert links and {x for ab in links for x in ab} == {int(x) for x in np.concatenate([nodes, roots])}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (2, 1)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 160)}
