"""The pipeline's near copies go through SimHash, and leave no working table."""

import random

from sentria.llm import jaccard as j
from sentria.llm.simhash import representatives
from sentria.shared import shared_folder


def test_fingerprints_find_and_exact_similarity_decides(spark, monkeypatch):
    """Without a single band: near copies by their fingerprints, and no chance links."""
    draw = random.Random(4)
    words = [f"w{draw.randrange(5000)}" for _ in range(1500)]
    other = [f"v{draw.randrange(5000)}" for _ in range(1500)]
    near = words[:700] + ["changed"] + words[701:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(other)), (4, "")], "doc_id long, text string")
    banded = j._banded
    monkeypatch.setattr(j, "_banded", lambda sketches: banded(sketches).where("false"))
    assert {r.doc_id: r.component_id for r in j.near_copies(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    monkeypatch.setattr(j, "near_links", lambda fps, radius: fps.crossJoin(fps.withColumnRenamed("fp", "b")).withColumnRenamed("fp", "a").where("a > b"))
    assert {r.doc_id: r.component_id for r in j.near_copies(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_only_what_goes_is_left_on_disk(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l")], "doc_id long, text string")
    folder = shared_folder(spark)
    fs = spark._jvm.org.apache.hadoop.fs
    tables = lambda: {f.getPath().getName() for f in fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs.Path(folder))}
    before = tables()
    kept = representatives(docs, groups=j.groups)
    assert sorted(n.rpartition("-")[0] for n in tables() - before) == ["gone"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
