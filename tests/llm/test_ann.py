import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sentria.llm.ann import BITS, Directory, _ranked, _within, bounds, build, hashes, nearest, shared_bits, usable

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, every, k):
    sound = {(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)}
    out = {}
    for q, a in sorted(sound):
        if q % every == 0 and q not in out:
            near = sorted((math.dist(map(float, a), map(float, b)), i) for i, b in sound if i != q and len(a) == len(b))
            out[q] = near[:k]
    return out


def mixed_rows():
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(1000 + i, [1.0] * 6) for i in range(40)]  # a group of copies larger than k
    rows += [(500, None), (501, [0.0] * 6), (502, [1.0, None] * 3), (503, [math.nan] + [1.0] * 5), (504, [math.inf] + [1.0] * 5), (None, [1.0] * 6)]
    return rows + [(600, [1.0, 2.0]), (601, [1.5, 2.0]), (40, rows[40][1]), (2000, [1.0] * 6)]


def test_all_shown_is_an_exact_search(spark):
    """With everything shown the result is brute force's, whatever the blocks and ranges."""
    rows = mixed_rows()
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    got = {}
    for r in nearest(df, every=20, k=10, block=32, entries=50, shown=10**9).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    want = brute(rows, 20, 10)
    assert set(got) == {q for q, near in want.items() if near}
    for q, near in want.items():
        assert [got[q][i + 1][1] for i in range(len(near))] == [v for _, v in near]
        assert np.allclose([got[q][i + 1][0] for i in range(len(near))], [d for d, _ in near], atol=1e-12)
    assert {r.id for r in usable(df, "vec_id", "embedding").collect()}.isdisjoint({500, 501, 502, 503, 504})
    assert nearest(df.limit(0)).collect() == []


def test_fewer_vectors_than_asked_for_are_all_found(spark):
    """String ids; every vector a query; no more than k others."""
    df = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(8)] + [("x", [3.5, 1.0])], "vec_id string, embedding array<double>")
    got = {}
    for r in nearest(df, every=1, k=10).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {str(i) for i in range(8)} and all(len(v) == 8 for v in got.values()) and got["4"][0] == "x"


def measured(df, every=100, k=10, **kw):
    """(recall against brute force, share of the vectors seen, share of blocks met, result)"""
    ids, m = map(np.array, zip(*((r.vec_id, r.embedding) for r in df.collect())))
    got, seen, met = {}, {}, {}
    for r in nearest(df, every, k, **kw).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
        seen[r.query_id], met[r.query_id] = r.seen, r.blocks
    hits, queries = 0, ids[ids % every == 0]
    for q in queries:
        d = ((m - m[ids == q][0]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits += len(set(got[int(q)].values()) & set(ids[np.argsort(d, kind="stable")[:k]].tolist()))
    blocks = build(usable(df, "vec_id", "embedding"), k + 1, kw.get("block", 4096)).blocks.count() if "block" in kw else 1
    return hits / (k * len(queries)), sum(seen.values()) / len(seen) / len(ids), sum(met.values()) / len(met) / blocks, got


def test_recall_on_the_tables(spark):
    """At least 0.9 against brute force; what is enough is learned from other vectors."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert measured(df)[0] >= 0.9


def cloud(spark, n, clusters, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] + 0.15 * rng.standard_normal((n, dim))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m.astype(np.float32))], "vec_id long, embedding array<float>").repartition(4).cache()


def test_clusters_are_seen_alone(spark):
    """50,000 vectors: recall on queries that nothing was learned from, few vectors
    compared, few blocks met, and a smaller share of them than of a smaller table."""
    found, share, met, _ = measured(cloud(spark, 50_000, 500), every=200, block=1024, entries=4096)
    small = measured(cloud(spark, 8_000, 80), every=200, block=1024, entries=4096)
    assert found >= 0.9 and small[0] >= 0.9
    assert share < 0.05 and share < small[1]
    assert met < 0.35


def test_blocks_and_ranges_change_nothing(spark):
    df = cloud(spark, 3000, 30)
    assert measured(df, block=200, entries=300)[3] == measured(df)[3]


def test_a_directory_finds_ranks_and_ranges():
    """Against plain counting, over ranges that equal strings go through."""
    rng = np.random.default_rng(0)
    strings = np.sort(np.concatenate([rng.integers(0, 1 << BITS, 300), np.full(90, 12345), rng.integers(0, 1 << 12, 200)]).astype(np.uint32))
    parts = [strings[i : i + 40] for i in range(0, len(strings), 40)]
    directory = Directory([(8, 0, 10 * i, int(p[0]), len(p)) for i, p in enumerate(parts)])
    asked = np.concatenate([strings[::50], rng.integers(0, 1 << BITS, 20).astype(np.uint32)])
    for depth in (0, 1, 5, 20, 31, 32):
        least, after = bounds(asked, depth)
        want = [((strings >> np.uint64(BITS - depth)) == (int(a) >> (BITS - depth))).sum() for a in asked]
        ranks = []
        for values in (least, after):
            place = directory.meeting(8, 0, values)
            before = directory.trees[8, 0][2]
            ranks.append([0 if p < 0 else before[p] + np.searchsorted(parts[p], v, "left") for p, v in zip(place, values)])
        assert (np.array(ranks[1]) - np.array(ranks[0])).tolist() == want
        rows, places = _within(directory, 8, 0, asked, np.full(len(asked), depth))
        met = [0] * len(asked)
        for row, place in zip(rows, places):
            met[row] += int(((parts[place] >> np.uint64(BITS - depth)) == (int(asked[row]) >> (BITS - depth))).sum())
        assert met == want
    rows, places = _ranked(directory, 8, 0, asked)
    assert set(rows.tolist()) == set(range(len(asked))) and places.min() >= 0


@pytest.mark.parametrize("bits", [32])
def test_shared_bits(bits):
    rng = np.random.default_rng(0)
    strings = hashes(rng.standard_normal((50, 8)), np.zeros(8))
    found = shared_bits(strings, strings[0])
    assert (found[0] == bits).all()
    for row, n in zip(strings[1:], found[1:]):
        for s, own, got in zip(row.tolist(), strings[0].tolist(), n.tolist()):
            a, b = f"{s:032b}", f"{own:032b}"
            assert got == next((i for i in range(bits) if a[i] != b[i]), bits)


def test_only_the_ranges_of_a_prefix_are_read(spark):
    """A query's routes to ranges of its trees, at the depth where it stands, are few."""
    df = cloud(spark, 4000, 40)
    forest = build(usable(df, "vec_id", "embedding"), 11, 256, 256)
    per_tree = forest.ranges.groupBy("tree").agg(F.sum("n").alias("n"), F.count("*").alias("ranges")).collect()
    assert all(r.n == 4000 and r.ranges >= 16 for r in per_tree)
    strings = np.frombuffer(forest.vectors.select("strings").head()[0], np.uint32)
    for tree in range(48):
        rows, _ = _within(forest.directory, 24, tree, strings[tree : tree + 1], np.array([8]))
        assert len(rows) <= 4
