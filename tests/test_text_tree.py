"""Text trees: files are listed and cut to parts by tasks, with the rows of Spark's own reader."""

import random
import re

import pytest

from sentria.sources import corpus
from sentria.sources.corpus import from_text_tree


@pytest.fixture
def small_parts(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def rows(df):
    return sorted((r.source_text, r.offset, r.original_sentence, r.normalized_sentence) for r in df.collect())


FILES = {
    "a.txt": b"one\n\n   \nfour\n",
    "docs/deep er/b%+\xc3\xa9.txt": b"CR LF\r\nlone\rnext\x0bsame\n",
    "docs/big.txt": b"".join(b"line %d\n" % i if i % 7 else b"\n" for i in range(900)),
    "docs/long.txt": b"x" * 3000 + b"\r" + b"y" * 20 + b"\n\n" + b"z" * 2500,
    "bom.txt": b"\xef\xbb\xbffirst\nsecond",
    "bytes.txt": b"not \xff UTF-8 \xe2\x82\nend",
    "empty.txt": b"",
    "_k=1/c.txt": b"read",
    "_metadata.txt": b"hidden",
    "_no.txt": b"hidden",
    ".no.txt": b"hidden",
    "_no/d.txt": b"hidden",
    "notes.md": b"not read",
}


def tree(folder):
    for name, content in FILES.items():
        path = folder / name.encode("latin-1").decode("utf-8")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(folder)


@pytest.mark.parametrize("size", [1000, 128 << 20])
def test_rows_are_those_of_sparks_reader(spark, tmp_path, small_parts, size):
    root = tree(tmp_path / "a b%+é")
    small_parts(size)
    want = rows(corpus._tree_by_spark(spark, root))
    assert rows(from_text_tree(spark, root)) == want and len(want) > 780


def test_the_driver_lists_no_files(spark, tmp_path):
    """Files that Spark's driver finds are those of working tables, however many texts there are."""
    for i in range(400):
        (tmp_path / f"{i % 5}").mkdir(exist_ok=True)
        (tmp_path / f"{i % 5}" / f"{i}.txt").write_text(f"line {i}")
    found = spark._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics.METRIC_FILES_DISCOVERED()
    before = found.getCount()
    assert from_text_tree(spark, str(tmp_path)).count() == 400
    assert found.getCount() - before < 40


def test_parts_of_any_size_are_whole_lines(spark, tmp_path, small_parts):
    """Ends of two characters are not cut in two, and a line may be longer than many parts."""
    rng = random.Random(5)
    texts = {f"{i}.txt": "".join(rng.choice(["a", "bé", "\n", "\r", "\r\n", "word " * 9]) for _ in range(60)) for i in range(12)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = sorted((name, n, line) for name, text in texts.items() for n, line in enumerate(re.split("\r\n|\r|\n", text), 1) if line.strip())
    for size in (1, 3, 8):
        small_parts(size)
        assert [r[:3] for r in rows(from_text_tree(spark, str(tmp_path)))] == want


def test_a_line_end_at_the_end_of_a_block(tmp_path):
    from pyarrow import fs

    block = 64 << 10
    for end, first in ((b"\r\n", 2), (b"\rx", 1), (b"\r", 1)):
        (tmp_path / "x").write_bytes(b"x" * (block - 1) + end)
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as source:
            assert corpus._line_from(source, 1) == block - 1 + first


def test_a_store_that_only_spark_knows(spark, tmp_path):
    root = tree(tmp_path / "t")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.trees.link./t", f"file://{root}")
    assert rows(from_text_tree(spark, "viewfs://trees/t")) == rows(from_text_tree(spark, root))
