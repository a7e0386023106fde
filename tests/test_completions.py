import json
import random
import time

import pytest
from plain import best
from pyspark.sql import Row

from sentria.cli import interact
from sentria.functions.text import normalize_query, query_trigrams
from sentria.operators.complete import complete, complete_batch, complete_indexed, complete_stored, sessions
from sentria.operators.index import SentenceIndex, candidates, postings
from sentria.service import Completion, Session
from sentria.shared import shared_folder
from sentria.sources.corpus import from_table
from sentria.streaming.completions import stream_completions
from sentria.streaming.sessions import session_stream

KEY = ("source_text", "offset")


def mutated(text, rng):
    """``text`` after one edit at a random place."""
    i = rng.randrange(len(text) + 1)
    return rng.choice([text[:i] + rng.choice("aeé ") + text[i:], text[:i] + text[i + 1 :], text[:i] + rng.choice("oux") + text[i + 1 :]])


def made_lines(seed=7):
    """Sentences of made-up words. What the tests need of them: some begin like others, or
    are others after one edit, or again the same; some are one character repeated, or
    nothing but punctuation; case, punctuation and characters beyond 16 bits occur."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["sa", "mi", "lor", "ten", "qua", "ib", "ré"]) for _ in range(rng.randrange(1, 4)))
    plain = [" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(16)]
    lines = plain + [f"{line} {word()}" for line in plain[:4]] + [mutated(line, rng) for line in plain[:8]] + plain[2:5]
    lines += [rng.choice("tw") * n for n in (4, 11)] + ["?!", "😀 " + plain[0] + " 😀"]
    lines += [plain[1].title() + ", " + plain[5].upper() + "; yes!"]
    rng.shuffle(lines)
    return [line for line in lines if line.strip()]


def made_queries(lines, seed=20):
    """Parts of lines, exact or after one or two edits; empty, too short, found nowhere."""
    rng, out = random.Random(seed), ["", " ?", "t", "wt", "é", "😀", "zzkx jjvw", lines[3].upper() + "!"]
    for i in range(36):
        line = rng.choice(lines)
        at = rng.randrange(len(line))
        part = line[at : at + rng.randrange(1, 18)]
        for _ in range(i % 3):
            part = mutated(part, rng)
        out.append(part)
    return out


LINES = made_lines()
QUERIES = made_queries(LINES)
#: A whole line of some length, and its first words.
WHOLE = max((line for line in LINES if line.islower() and LINES.count(line) == 1 and not any(o != line and line in o for o in LINES)), key=len)
START = " ".join(WHOLE.split()[:2])


@pytest.fixture(scope="module")
def corpus(spark):
    half = len(LINES) // 2
    df = spark.createDataFrame([(1, "\n".join(LINES[:half])), (2, "\n".join(LINES[half:]))], "id long, text string")
    return from_table(df, "id", "text", "t").cache()


@pytest.fixture(scope="module")
def posts(corpus):
    return postings(corpus, *KEY).cache()


@pytest.fixture(scope="module")
def rows(corpus):
    return [(r.original_sentence, r.source_text, r.offset) for r in corpus.collect()]


def test_completions_equal_the_definition(corpus, posts, rows):
    rng = random.Random(1)
    for q in QUERIES:
        want = best(q, rows)
        assert [tuple(r) for r in complete(corpus, q).collect()] == want, q
        assert [tuple(r) for r in complete_indexed(corpus, posts, q, *KEY, share=rng.choice([0.0, 9.0])).collect()] == want, q


def test_exact_first_changes_nothing(corpus, rows):
    for q in (START, "sa", WHOLE, "qx", ""):
        assert [tuple(r) for r in complete(corpus, q, exact_first=False).collect()] == best(q, rows)
    assert len(complete(corpus, "a", k=3).collect()) == 3


def test_batches_equal_single_queries(spark, corpus, posts, rows):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(QUERIES)], "query_id long, prefix string")
    got = {}
    for r in complete_batch(corpus, posts, df, *KEY).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(tuple(r)[2:])
    assert got == {i: best(q, rows) for i, q in enumerate(QUERIES) if best(q, rows)}
    assert complete_batch(corpus, posts, df.limit(0), *KEY).collect() == []


def test_candidates_have_no_false_negatives(spark, corpus, posts, rows):
    for q in QUERIES:
        query = normalize_query(spark, q)
        found = {(r.original_sentence, r.source_text, r.offset) for r in candidates(corpus, posts, query, *KEY).collect()}
        assert {b[:3] for b in best(q, rows, k=99)} <= found
        if query and len(query_trigrams(query)) <= 3:
            assert len(found) == len(rows)
    assert WHOLE in {r.original_sentence for r in candidates(corpus, posts, WHOLE, *KEY).collect()}


def test_plan_scores_only_candidates(corpus, posts):
    """The CASE must not sink below the join to every sentence."""
    plan = complete_indexed(corpus, posts, WHOLE, *KEY, share=9.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "LIKE" not in plan.split("Join Inner")[-1].split("InMemoryRelation")[0] and "shared" in plan


def test_stored_index(spark, corpus, tmp_path):
    built = SentenceIndex.build(spark, corpus, str(tmp_path / "i"))
    opened = SentenceIndex.open(spark, str(tmp_path / "i"))
    stats = built.stats().head()
    assert stats == opened.stats().head() and stats.record_count == len(LINES)
    assert stats.build_seconds > 0 and stats.index_bytes > 1000
    assert stats.total_postings == sum(len(query_trigrams(normalize_query(spark, s))) for s in LINES)
    assert WHOLE in {r.original_sentence for r in opened.candidates(WHOLE.title() + "!").collect()}
    assert opened.candidates("").collect() == []
    ids = sorted((r.sentence_id, (r.source_text, r.offset)) for r in opened.sentences.collect())
    assert [i for i, _ in ids] == list(range(len(LINES))) and [k for _, k in ids] == sorted(k for _, k in ids)
    unpacked = {(r.trigram, r.sentence_id) for r in opened.postings.collect()}
    assert unpacked == {(g, r.sentence_id) for r in opened.sentences.collect() for g in query_trigrams(r.normalized_sentence)}
    empty = SentenceIndex.build(spark, corpus.limit(0), str(tmp_path / "e"))
    assert tuple(empty.stats().head())[:3] == (0, 0, 0)
    with pytest.raises(FileNotFoundError):
        SentenceIndex.open(spark, str(tmp_path / "none"))


def test_a_new_version_leaves_readers_of_the_old_one_alone(spark, corpus, tmp_path):
    path = str(tmp_path / "i")
    first = SentenceIndex.build(spark, corpus, path)
    second = SentenceIndex.build(spark, corpus.limit(4), path)
    assert first.sentences.count() == len(LINES) and SentenceIndex.open(spark, path).path == second.path
    third = SentenceIndex.build(spark, corpus.limit(3), path)
    assert second.postings.count() > 0 and third.stats().head().record_count == 3
    assert len(list((tmp_path / "i").iterdir())) == 2


def test_stored_index_equals_the_definition(spark, corpus, tmp_path, rows, monkeypatch):
    """By scan, by named ids, by the merge of lists with and without broadcast."""
    import sentria.operators.complete as c

    opened = SentenceIndex.build(spark, corpus, str(tmp_path / "i")).keep()
    for n, q in enumerate(QUERIES):
        monkeypatch.setattr(c, "NAMED_POSTINGS", 10**6 if n % 3 == 0 else 0)
        monkeypatch.setattr(c, "LISTED_POSTINGS", 10**6 if n % 3 == 1 else 0)
        assert [tuple(r) for r in complete_stored(opened, q, share=9.0 if n % 4 else 0.05).collect()] == best(q, rows), q


def test_the_merge_equals_counting_all_lists(spark, corpus, tmp_path):
    """Blocks of few ids, so that long lists have blocks that need not be opened."""
    import sentria.operators.index as ix

    opened = SentenceIndex.build(spark, corpus, str(tmp_path / "i"))
    lists = {}
    for r in opened.postings.collect():
        lists.setdefault(r.trigram, set()).add(r.sentence_id)
    for q in QUERIES:
        grams = query_trigrams(normalize_query(spark, q))
        if len(grams) > ix.DAMAGE:
            want = {(i, n) for i in range(len(LINES)) if (n := sum(i in lists.get(g, ()) for g in grams)) >= len(grams) - ix.DAMAGE}
            got = ix.merged(opened.blocks, opened.sizes_of(grams), opened.KEY).collect()
            assert {(r.sentence_id, r.shared) for r in got} == want, q


def test_stream_leaves_no_working_table(spark, corpus, tmp_path, rows):
    index = SentenceIndex.build(spark, corpus, str(tmp_path / "i"))
    asked = [(1, START), (2, "zzkx jjvw"), (3, "t"), (4, WHOLE)]
    for i, one in enumerate(asked):
        spark.createDataFrame([one], "query_id long, prefix string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    folder = shared_folder(spark)
    fs = spark._jvm.org.apache.hadoop.fs
    tables = lambda: {f.getPath().getName() for f in fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs.Path(folder))}
    before = tables()
    stream = spark.readStream.schema("query_id long, prefix string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    stream_completions(stream, index, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination(240)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.completed_sentence, r.source_text, r.offset, r.score))
    assert got == {i: best(q, rows) for i, q in asked if best(q, rows)}
    assert tables() == before


def test_many_short_queries_are_joined(spark, corpus, posts, rows):
    """Beyond ``listed`` queries are not named in the plan; the result is the same."""
    df = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, prefix string")
    few, many = (sorted(map(tuple, complete_batch(corpus, posts, df, *KEY, listed=n).collect())) for n in (1000, 2))
    assert few == many and len(few) > 50


def test_sessions(spark):
    df = spark.createDataFrame([Row(s=1, i=1, line="to be"), Row(s=1, i=2, line="unknown"), Row(s=1, i=3, line="x#"), Row(s=1, i=4, line="y"), Row(s=2, i=1, line="z")])
    got = [(r.s, r.i, r.query_number, r.searched, r.current_input) for r in sessions(df, "s", "i").orderBy("s", "i").collect()]
    assert got == [(1, 1, 0, True, "to be"), (1, 2, 0, True, "unknown"), (1, 3, 1, False, ""), (1, 4, 1, True, "y"), (2, 1, 0, True, "z")]


BATCHES = [[("a", 2, "to"), ("a", 1, "x#"), ("b", 1, "one")], [("b", 2, "# now"), ("b", 3, "two")], [("a", 3, "more"), ("b", 4, "#")]]


def streamed_sessions(spark, path, idle_ms):
    """What comes of the batches, one run of the stream for each."""
    (path / "in").mkdir()
    lines = spark.readStream.schema("s string, i long, line string").option("maxFilesPerTrigger", 1).json(str(path / "in"))
    found = session_stream(lines, "s", "i", idle_ms=idle_ms)
    stream = found.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "cp")).outputMode("append")
    for n, batch in enumerate(BATCHES):
        (path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("s", "i", "line"), r))) for r in batch))
        if idle_ms is None:
            stream.trigger(availableNow=True).start().awaitTermination(120)
            continue
        q = stream.trigger(processingTime="0 seconds").start()
        try:  # timers are looked at in batches without a line
            end = time.monotonic() + 90
            while time.monotonic() < end and sum(p.numInputRows == 0 for p in q.recentProgress if any(o.numInputRows for o in q.recentProgress)) < 2:
                time.sleep(0.5)
        finally:
            q.stop()
    return [tuple(r) for r in spark.read.schema(found.schema).parquet(str(path / "out")).orderBy("s", "i").collect()]


def test_session_stream(spark, tmp_path):
    """Lines of two sessions that come over several batches."""
    assert streamed_sessions(spark, tmp_path, None) == [
        ("a", 1, "x#", 1, False, ""), ("a", 2, "to", 1, True, "to"), ("a", 3, "more", 1, True, "more"),
        ("b", 1, "one", 0, True, "one"), ("b", 2, "# now", 1, False, ""), ("b", 3, "two", 1, True, "two"), ("b", 4, "#", 2, False, ""),
    ]


def test_idle_sessions_are_forgotten(spark, tmp_path):
    assert [r[3] for r in streamed_sessions(spark, tmp_path, 0)] == [1, 1, 0, 0, 1, 1, 1]


def test_terminal(capsys):
    typed, shown = ["sami", "tenqua", "a # b"], []

    def read(current):
        shown.append(current)
        if not typed:
            raise EOFError
        return typed.pop(0)

    interact(Session(lambda line: [Completion("Sami.", "h.txt", 3, 8)] if line == "sami" else []), read)
    assert shown == ["", "sami", "tenqua", ""]
    assert capsys.readouterr().out.splitlines() == ["The system is ready. Enter your text:", "Here are 1 suggestions:", "1. Sami. (h.txt:3, score=8)", "No suggestions found."]


def test_a_failed_search_is_logged_and_raised(caplog):
    def fail(_):
        raise ValueError("broken")

    session = Session(fail)
    with pytest.raises(ValueError), caplog.at_level("INFO", logger="sentria"):
        session.answer("x")
    assert session.current == "x" and '"x"' in caplog.text and "broken" in caplog.text
    assert session.answer("#") is None and session.current == ""
