"""Queries over a table whose scan has parts without rows: more splits than row groups."""

import pytest

import __spark_entry__ as e


@pytest.fixture
def folder(spark, tmp_path):
    df = spark.createDataFrame([(i, f"line {i}\n\nother {i * 7}") for i in range(8, 12)], "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    yield str(tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


SENTENCES = sorted((f"{i}.txt", n, line) for i in range(8, 12) for n, line in ((1, f"line {i}"), (3, f"other {i * 7}")))


def test_zip_sentences(spark, folder):
    assert sorted((r.source_text, r.offset, r.original_sentence) for r in e.queries()["zip_sentences"](spark, folder).collect()) == SENTENCES


def test_zip_source_members(spark, folder):
    found = e.queries()["zip_source_members"](spark, folder)
    assert sorted(map(tuple, found.collect())) == [("10.txt", len("line 10\n\nother 70")), ("11.txt", len("line 11\n\nother 77"))]


def test_zip_source_sentences(spark, folder):
    assert sorted((r.source_text, r.offset, r.original_sentence) for r in e.queries()["zip_source_sentences"](spark, folder).collect()) == SENTENCES
