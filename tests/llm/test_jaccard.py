import random

from pyspark.sql import functions as F

import corpus_pipeline
from sentria.llm.jaccard import groups, near_copies
from sentria.llm.simhash import representatives

SCHEMA = "doc_id long, text string, key string, root string"


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """{id: smallest id of its group}, every pair compared; also the links, by id."""
    sets = [shingled(t) for _, t in rows]
    label, links = list(range(len(rows))), []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links.append((rows[i][0], rows[j][0]))
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if k == old else k for k in label]
    least = {}
    for (d, _), k in zip(rows, label):
        if d is not None:
            least[k] = min(least.get(k, d), d)
    return {d: least[k] for (d, _), k in zip(rows, label) if d is not None}, links


def near_rows(seed=5):
    """Copies with a stretch of words replaced, of similarities around 0.8."""
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    rows = [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "one two"), (None, "one two")]
    for _ in range(60):
        base = some(rng.choice([12, 60, 300]))
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([1, 2])):
            n = int(len(base) * rng.uniform(0, 0.12))
            at = rng.randrange(len(base) - n + 1)
            rows.append((len(rows), " ".join(base[:at] + some(n) + base[at + n :])))
    return rows


def test_near_copies_equal_exact_jaccard(spark):
    rows = near_rows()
    want, links = brute(rows)
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    found = near_copies(docs).collect()
    got = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert len(found) == len(rows) and got == want
    assert len(links) > 60 and all(got[a] == got[b] for a, b in links if None not in (a, b))  # recall 1
    assert {r.component_id for r in found if r.doc_id is None} == {9005}
    stay = {r.doc_id for r in representatives(docs, groups=groups).collect()}
    assert stay == set(want.values()) | {None}
    assert near_copies(docs.limit(0)).collect() == []


def test_tiles_of_a_full_band(spark, monkeypatch):
    """A band of more texts than a tile is compared whole."""
    import sentria.llm.jaccard as j

    monkeypatch.setattr(j, "TILE", 8)
    rng = random.Random(2)
    base = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(base[i * 2 :] + [f"u{i}_{k}" for k in range(i * 2)])) for i in range(40)]
    rows += [(100 + i, " ".join(rng.sample(base, 150))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == brute(rows)[0]


def parts_of(docs):
    import sentria.llm.jaccard as j

    sketches = j.written(j._sketches(docs, "doc_id", "text", 5), "sketches")
    distinct = sketches.groupBy("key").agg(F.min("row").alias("row"))
    banded = j._banded(sketches)
    return j, banded, j._texts(sketches, distinct, banded)


def test_a_chain_costs_no_more_than_its_band_pairs(spark):
    """Each text is 0.7 like the next, so bands connect long chains, and none is a near copy."""
    words = [f"w{i}" for i in range(1200 + 21 * 400)]
    docs = spark.createDataFrame([(i, " ".join(words[21 * i : 21 * i + 120])) for i in range(400)], "doc_id long, text string")
    j, banded, texts = parts_of(docs)
    pairs = banded.groupBy("band").count().selectExpr("sum(count * (count - 1) / 2)").head()[0]
    found = j._compared(j._rooted(banded, None), texts, 5)
    assert found.where("a is not null").count() == 0
    assert 0 < found.agg(F.sum("compares")).head()[0] <= pairs < 3000
    assert near_copies(docs).select("component_id").distinct().count() == 400


def test_near_copies_are_connected_by_few_compares(spark):
    """400 versions of one text: what is left for pair by pair is next to nothing."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(400):
        at = rng.randrange(390)
        rows.append((i, " ".join(base[:at] + [f"x{i}"] + base[at + 1 :])))
    j, banded, texts = parts_of(spark.createDataFrame(rows, "doc_id long, text string"))
    stars = j._stars(j._rooted(banded, None), True)
    links = j._confirmed(stars, texts, 5)
    assert stars.count() < 400 and links.count() > 380
    left = j._compared(j._rooted(banded, j.components(links)), texts, 5)
    assert left.agg(F.sum("compares")).head()[0] < 400


def test_only_the_first_common_band_compares():
    import numpy as np

    from sentria.llm.jaccard import cross

    same = np.arange(10, dtype=np.uint64)
    tile = [(1, 1, same, [5, 7]), (2, 2, same, [5, 7]), (3, 3, same + np.uint64(100), [5, 8]), (4, 1, same, [6, 7])]
    assert cross(5, tile, tile, True) == ([(1, 2)], 3)
    assert cross(7, tile, tile, True) == ([(2, 4)], 1)  # 1 and 4 are connected; 1 and 2 met before


def test_stage_removes_near_copies(spark, sf):
    """The pipeline's stage leaves what exact Jaccard leaves, on real documents too."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = max((r.text for r in docs.select("text").collect() if r.text and len(r.text) < 1200), key=len)
    more = [(9100, f"{text} more"), (9101, " ".join([*text.split()[:-6], "a", "few", "other", "words"]))]
    docs = docs.unionByName(spark.createDataFrame([(d, t, "en", "odd", 0) for d, t in more], docs.schema))
    want, _ = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert got.dtypes == docs.dtypes
    stay = {r.doc_id for r in got.collect()}
    assert stay == set(want.values()) and not {9100, 9101} & stay
