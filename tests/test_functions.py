import itertools
import random

import pytest
from plain import normalize as plain_normalize
from plain import score as plain_score
from pyspark.sql import functions as F

from sentria.functions.scoring import best_match, best_match_columns, extra_character_score, insertion_deletion_penalty, missing_character_score, partition_filter, patterns, score_pair, split_filter, split_filter_columns, substitution_penalty, substitution_score
from sentria.functions.text import is_blank, normalize, normalize_query, query_trigrams, trigrams

CASES = ["Hello World", "hello,world", "hello   \t world", "Python 3.5.0 alpha 1", " \t ", "", "don't", "’ — «É»", "A\x1cB\x85C\xa0D　E", "!!!", "a_b%c\\d'e", "ΑΣ", "x😀 Y"]


def test_normalize(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "t string").select("t", normalize("t").alias("n"), normalize(normalize("t")).alias("twice"))
    for r in df.collect():
        assert r.n == plain_normalize(r.t) == r.twice == normalize_query(spark, r.t)


def test_blank_lines(spark):
    rows = spark.createDataFrame([("",), (" \t\x1c　",), ("!",), (" a ",)], "t string").select(is_blank("t").alias("b")).collect()
    assert [r.b for r in rows] == [True, True, False, False]


def test_trigrams(spark):
    rows = spark.createDataFrame([("",), ("ab",), ("abc",), ("aaaa",), ("a b c",)], "t string").select("t", trigrams("t").alias("g")).collect()
    assert {r.t: sorted(r.g) for r in rows} == {"": [], "ab": [], "abc": ["abc"], "aaaa": ["aaa"], "a b c": [" b ", "a b", "b c"]}
    assert all(sorted(r.g) == query_trigrams(r.t) for r in rows)


@pytest.mark.parametrize("position,sub,indel", [(1, 5, 10), (2, 4, 8), (3, 3, 6), (4, 2, 4), (5, 1, 2), (6, 1, 2), (10, 1, 2)])
def test_penalties(spark, position, sub, indel):
    r = spark.range(1).select(substitution_penalty(position).alias("s"), insertion_deletion_penalty(position).alias("i"), substitution_score(9, position).alias("a"), extra_character_score(9, position).alias("b"), missing_character_score(9, position).alias("c")).head()
    assert (r.s, r.i, r.a, r.b, r.c) == (sub, indel, 16 - sub, 16 - indel, 18 - indel)


#: Queries, sentences and their scores.
KNOWN = [
    ("abc", "abcdef", 6), ("abc", "xxabcxx", 6), ("abcde", "zzabxdezz", 5), ("abxcd", "zzabcdzz", 2), ("abcd", "zzabxcdzz", 2),
    ("hxlpo", "hello", None), ("abcdef", "abc", None), ("abc", "xbc ayc", 0), ("abxc", "abc", 0), ("xabc", "abc", -4),
    ("aaab", "aab", 0), ("a", "x", -5), ("a", "xa", 2), ("", "abc", None), ("abc", "", None),
]


def both_ways(spark, pairs):
    df = spark.createDataFrame(pairs, "q string, s string").select("q", "s", best_match_columns(F.col("q"), F.col("s")).alias("v"))
    return {(r.q, r.s): r.v for r in df.collect()}


def test_known_scores(spark):
    got = both_ways(spark, [(q, s) for q, s, _ in KNOWN])
    for q, s, v in KNOWN:
        assert got[q, s] == v == plain_score(q, s)
        assert spark.createDataFrame([(s,)], "s string").select(best_match(q, "s")).head()[0] == v


def test_all_short_strings_against_the_definition(spark):
    strings = ["".join(c) for n in range(6) for c in itertools.product("ab ", repeat=n)]
    queries = ["".join(c) for n in range(1, 4) for c in itertools.product("ab", repeat=n)] + ["a b", "abab", "aaab", "ab ba"]
    s = spark.createDataFrame([(x,) for x in strings], "s string").cache()
    for q in queries:
        for r in s.select("s", best_match(q, "s").alias("v"), partition_filter(q, "s").alias("p"), split_filter(q, "s").alias("h")).collect():
            assert r.v == plain_score(q, r.s), (q, r.s)
            assert r.v is None or (r.p and r.h)


def test_random_edits_against_the_definition(spark):
    rng, pairs = random.Random(9), []
    for _ in range(3000):
        s = "".join(rng.choices("abcé ", k=rng.randrange(1, 16)))
        q = s[rng.randrange(len(s)) :][: rng.randrange(1, 12)]
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(q) + 1)
            q = rng.choice([q[:i] + "z" + q[i:], q[:i] + q[i + 1 :], q[:i] + "b" + q[i + 1 :]])
        pairs.append((q, s))
    got = both_ways(spark, pairs)
    assert all(got[q, s] == plain_score(q, s) == score_pair(q, s) for q, s in pairs)
    df = spark.createDataFrame(pairs, "q string, s string")
    missed = df.where(best_match_columns(F.col("q"), F.col("s")).isNotNull() & ~split_filter_columns(F.col("q"), F.col("s")))
    assert missed.count() == 0


def test_a_query_has_at_most_ten_scores():
    assert all(len(patterns("x" * n)) <= 10 for n in range(1, 60)) and patterns("") == {}


@pytest.mark.parametrize("q,s,passes", [("abcde", "xxabcdeyy", 1), ("abcde", "xxabxdeyy", 1), ("abcd", "xxabxcdyy", 1), ("abxcd", "xxabcdyy", 1), ("aaab", "xxaabyy", 1), ("to be", "xxto bx yy", 1), ("a", "", 1), ("abcd", "axyd", 0)])
def test_partition_filter(spark, q, s, passes):
    assert spark.createDataFrame([(s,)], "s string").select(partition_filter(q, "s")).head()[0] == bool(passes)
