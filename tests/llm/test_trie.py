import hashlib
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from sentria.llm import trie as op
from sentria.llm.trie import conversation_trie, end_digests, merged, partial_tries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n string"


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(found, key=lambda t: t[:2])] for c, found in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, found in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(found) - 1) * (len(node[-1][1]) if node else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(repr((min(m), len(x), min(members[x[:-1]]) if x else None, len(m), kids[x], leaves[x], saved[x], digest(ends[x]))) for x, m in members.items())


def rows():
    rng = random.Random(6)
    said = ["yes", "no", "", None, "é😀", "well"]
    out = []
    for c in list(range(0, 140)) + [200, 201, 305, 307, 999]:  # 300 and 900 are absent
        if c % 7 == 3:
            base = [("user", "hello"), ("assistant", "hi"), ("user", "well")]  # many conversations are alike
        else:
            base = [(rng.choice(["user", "assistant", None]), rng.choice(said)) for _ in range(rng.randrange(1, 9))]
        out += [(c, i * 2, *t) for i, t in enumerate(base)]
    for i in range(12):  # each continues the one before, ids rising
        out += [(400 + i, k, "user", f"step {k}") for k in range(6 + i)]
    out += [(450, k, "user", f"step {k}") for k in range(60)]
    out += [(12, None, "system", "first of all"), (None, 1, "user", "of nobody"), (8, 50, "user", "twice"), (8, 50, "user", "twice")]
    rng.shuffle(out)
    return out


def result(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_equals_plain_python(spark):
    """Nulls, repeated rows, absent hosts, conversations that continue each other,
    partial tries merged in several rounds, parents of many children by broadcast."""
    found = rows()
    df = spark.createDataFrame([(*r, "d", "n") for r in found], SCHEMA).repartition(3)
    want = plain(found)
    assert result(conversation_trie(df)) == want
    assert result(conversation_trie(df, fan=2, wide=2, wide_share=3)) == want


def test_an_empty_table_has_no_node(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_end_lists_are_cut_and_read_in_order(spark):
    ids = random.Random(2).sample(range(-5000, 5000), 4000)
    rows = [(3, 7, 9, i, 3) if i % 3 else (3, 7, 8, i, 3) for i in ids] + [(2, 1, 1, 5, 3)]
    df = spark.createDataFrame(rows, "depth long, a long, b long, conv long, length long").repartition(4)
    got = {(r.depth, r.a, r.b): r.ends_sha256 for r in end_digests(df, piece=7).collect()}
    digest = lambda own: hashlib.sha256(",".join(map(str, sorted(own))).encode()).hexdigest()
    assert got == {(3, 7, 9): digest(i for i in ids if i % 3), (3, 7, 8): digest(i for i in ids if not i % 3)}


@pytest.mark.parametrize("fan", [2, 16])
def test_partial_tries_merge_to_the_whole(spark, fan):
    rng = np.random.default_rng(4)
    rows = [(int(c), int(d), int(a), 1, 0, 0, 5, int(n)) for c, d, a, n in zip(range(900), rng.integers(0, 3, 900), rng.integers(0, 4, 900), rng.integers(3, 6, 900))]
    df = spark.createDataFrame(rows, "conv long, depth long, a long, b long, up_a long, up_b long, chars long, length long").repartition(20)
    parts = partial_tries(df)
    assert parts.count() <= 20 * 12
    got = {(r.depth, r.a): (r.n, r.conv, r.rep, r.length) for r in merged(parts, 20, fan).collect()}
    want = {}
    for key in {(r[1], r[2]) for r in rows}:
        own = [r for r in rows if (r[1], r[2]) == key]
        length, rep = max((r[7], -r[0]) for r in own)
        want[key] = len(own), min(r[0] for r in own), -rep, length
    assert got == want


def test_combining_sums_members():
    cols = {c: np.arange(40) for c in op._NAMES}
    both = op._combined({c: np.concatenate([v, v]) for c, v in cols.items()} | {"n": np.ones(80, np.int64)})
    assert both["n"].tolist() == [2] * 40 and both["conv"].tolist() == list(range(40))
