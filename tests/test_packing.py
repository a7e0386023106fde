"""What a build and a batch cost at size: packed without a shuffle, no pass of a single task."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from sentria.functions.text import LINE_END, WHITE, normalize, query_trigrams
from sentria.operators.index import BLOCK, SentenceIndex, distinct_trigrams, posting_blocks, statistics, trigram_sizes
from sentria.plans import registry
from sentria.shared import listed
from sentria.sources import corpus as corpus_source
from sentria.sources.corpus import from_text_tree


def corpus(spark, texts):
    rows = [(t, t, f"s{i % 3}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "original_sentence string, normalized_sentence string, source_text string, offset int")


def some_texts(n, letters):
    draw = random.Random(3)
    return ["".join(draw.choices(letters, k=draw.randrange(0, 30))) for _ in range(n)]


def test_trigrams_of_many_texts():
    wide = [chr(c) for c in range(0x400, 0x400 + 3 * BLOCK)] + ["\U0001f600", "a"]
    for texts in (some_texts(300, "ab \x00é"), some_texts(3000, wide), ["", "ab"], []):
        grams, ends, places = distinct_trigrams(pa.array(texts, pa.string()))
        got = {g: places[a:b].tolist() for g, a, b in zip(grams.to_pylist(), ends, ends[1:])}
        want = {}
        for i, t in enumerate(texts):
            for g in query_trigrams(t):
                want.setdefault(g, []).append(i)
        assert got == want


def test_blocks_are_packed_without_a_shuffle(spark, tmp_path):
    texts = some_texts(BLOCK + 500, "abcd ")
    built = SentenceIndex.build(spark, corpus(spark, texts), str(tmp_path / "i"))
    assert "Exchange" not in posting_blocks(built.sentences, built.KEY)._jdf.queryExecution().executedPlan().toString()
    held = built.sentences.collect()
    want = sorted((g, r.source_text, r.offset) for r in held for g in query_trigrams(r.normalized_sentence))
    assert sorted(map(tuple, built.located("source_text", "offset").collect())) == want
    ids = {(r.source_text, r.offset): r.sentence_id for r in held}
    assert {(r.trigram, r.sentence_id) for r in built.postings.collect()} == {(g, ids[s, o]) for g, s, o in want}


def test_sizes_without_postings_as_rows(spark):
    texts = some_texts(500, "abé ")
    counts = {}
    for t in texts:
        for g in query_trigrams(t):
            counts[g] = counts.get(g, 0) + 1
    df = corpus(spark, texts)
    assert {r.trigram: r.postings for r in trigram_sizes(df).collect()} == counts | {None: len(texts)}
    assert tuple(statistics(df).head()) == (len(texts), len(counts), sum(counts.values()))
    assert tuple(statistics(df.limit(0)).head()) == (0, 0, 0)


def test_the_quick_classes_are_the_plain_ones(spark):
    chars = [(c, f"x{chr(c)}y") for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    plain = F.trim(F.regexp_replace(F.lower("t"), f"[{WHITE}\\p{{Punct}}]+", " "))
    assert spark.createDataFrame(chars, "c int, t string").where(normalize("t") != plain).count() == 0
    for t in ("", "a\n\nb", "a\r\n\r\nb\r\rc\n\rd\r\n", "\r", "\n"):
        assert re.split(LINE_END, t) == re.split(r"\r\n|\r|\n", t)


def test_sessions_and_archives_are_written_by_many_tasks(spark, sf, monkeypatch):
    paths = []
    monkeypatch.setattr(registry, "new_path", lambda s, name, make=registry.new_path: paths.append(make(s, name)) or paths[-1])
    registry.QUERIES["session_stream"](spark, sf)
    archives = registry._archives(spark, sf)
    cores = spark.sparkContext.defaultParallelism
    assert spark.read.text(f"{paths[0]}/in").select("_metadata.file_path").distinct().count() > 3
    assert len(listed(spark, archives)) >= cores


def test_small_files_share_tasks(spark, tmp_path):
    """Some hundred small files are a few tasks, not one for each 32 of them."""
    for i in range(300):
        (tmp_path / f"{i}.txt").write_text(f"line {i}\n\nlast")
    made = []
    plain = corpus_source.written
    try:
        corpus_source.written = lambda df, name, **o: made.append(df.rdd.getNumPartitions()) or plain(df, name, **o)
        found = from_text_tree(spark, str(tmp_path)).collect()
    finally:
        corpus_source.written = plain
    assert made[0] <= spark.sparkContext.defaultParallelism + 1
    assert sorted(r.offset for r in found) == [1] * 300 + [3] * 300
