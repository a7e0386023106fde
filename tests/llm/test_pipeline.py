"""The pipeline against a brute-force version of its stages, in plain Python."""

import hashlib

import pytest
from test_decontam import plain_tiling
from test_jaccard import brute as groups
from test_linededup import brute_spans, key
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from sentria.llm import langid
from sentria.llm.decontam import COVERAGE, tokens
from sentria.llm.linededup import cut
from sentria.llm.queries import TOKENIZER


def plain_pipeline(rows, crf, items):
    """(doc_id, text) rows -> {doc_id: (n_tokens, ids digest, decoded digest)}."""
    kept = [r for r, (lang, score) in zip(rows, langid.Tagger(crf).read([t for _, t in rows])) if lang != "und" and score >= langid.MIN_SCORE]
    first, _ = groups(kept)
    kept = sorted(r for r in kept if first[r[0]] == r[0])
    spans = brute_spans(kept, min_words=1)
    texts = [(d, cut(text, [s[:2] for s in spans.get((d, key(text)), [])])) for d, text in kept]
    library, out = Tokenizer.from_file(TOKENIZER), {}
    for d, text in texts:
        words = tokens(text)
        held = set(words)
        hit = False
        for item in items:
            if len(item) >= 5 and len(set(item) & held) >= COVERAGE * len(set(item)):
                # only words of the item can be in a tile
                near = [w if w in set(item) else "" for w in words]
                part = [w for i, w in enumerate(near) if w or (i and near[i - 1])]
                hit = hit or sum(n for *_, n in plain_tiling(part, item, 5)) >= COVERAGE * len(item)
        if not hit:
            ids = library.encode(text, add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            out[d] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    return out


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Short documents of the smallest tables, and rows of every awkward kind."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1200")
    text = docs.orderBy("doc_id").first().text
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    odd = [(9001, None), (9002, ""), (9003, "123 !!"), (9004, text), (9005, text + " more"), (9006, f"{text[:150]}\n{item}\nand so on"), (9007, " ".join(item.split()[::-1]))]
    odd = spark.createDataFrame([(i, t, "en", "odd", 0) for i, t in odd], docs.schema)
    docs.unionByName(odd).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [tokens(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = plain_pipeline(rows, langid.learn(docs), items)
    got = entry.queries()["pipeline"](spark, small).collect()
    assert len(got) == len(want) and {r.doc_id: tuple(r)[1:4] for r in got} == want
    assert 0 < len(want) < len(rows) and not {9001, 9002, 9003, 9004, 9006} & set(want)


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), small).collect() == []
    assert len(corpus_pipeline.STAGES) == 5
