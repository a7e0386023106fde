import zipfile

import pytest

from sentria.sources.corpus import from_text_tree, from_zip
from sentria.sources.zipsource import NAME, register, zip_sentences


def archive(path, files, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return str(path)


def rows(df):
    return sorted((r.source_text, r.offset, r.original_sentence, r.normalized_sentence) for r in df.collect())


FILES = {f"d{i % 3}/t{i}.txt": f"line {i}\n\nother {i * 7}\r\nlast" * (i % 4) for i in range(40)} | {"notes.md": "not read", "d/": ""}


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_the_source_reads_what_from_zip_reads(spark, tmp_path, method):
    path = archive(tmp_path / "a.zip", FILES, method)
    want = rows(from_zip(spark, path))
    assert rows(zip_sentences(spark, path)) == want and len(want) > 80


def test_partitions_are_ranges_of_members(spark, tmp_path):
    archive(tmp_path / "a.zip", FILES)
    archive(tmp_path / "b.zip", {"x.txt": "one"})
    register(spark)
    df = spark.read.format(NAME).option("taskBytes", 200).load(f"{tmp_path}/*.zip")
    assert df.rdd.getNumPartitions() > 4
    got = {(r.archive.rsplit("/", 1)[1], r.member): r.text for r in df.collect()}
    assert got == {("a.zip", n): t for n, t in FILES.items() if n.endswith(".txt")} | {("b.zip", "x.txt"): "one"}


def test_names_are_filtered_before_members_are_inflated(spark, tmp_path):
    """A damaged member that the pattern leaves out is never read."""
    path = archive(tmp_path / "a.zip", {"a.txt": "fine text", "b.txt": "some text that is stored"}, zipfile.ZIP_STORED)
    content = bytearray((tmp_path / "a.zip").read_bytes())
    content[content.index(b"some text")] ^= 1
    (tmp_path / "a.zip").write_bytes(content)
    register(spark)
    assert [r.text for r in spark.read.format(NAME).option("members", "a*").load(path).collect()] == ["fine text"]
    with pytest.raises(Exception, match="CRC|Bad"):
        spark.read.format(NAME).load(path).collect()


def test_unsafe_and_missing(spark, tmp_path):
    register(spark)
    with pytest.raises(Exception, match="Unsafe path"):
        spark.read.format(NAME).load(archive(tmp_path / "x.zip", {"ok.txt": "fine", "../up.txt": "bad"})).collect()
    with pytest.raises(FileNotFoundError):
        zip_sentences(spark, str(tmp_path / "none.zip"))
    assert spark.read.format(NAME).load(archive(tmp_path / "e.zip", {"a.md": "x"})).collect() == []


def test_large_text_files_are_read_in_splits(spark, tmp_path):
    """Line numbers run through splits, whatever ends the lines."""
    ends = ["\n", "\r\n", "\r"]
    lines = [f"line {i} é" if i % 5 or i % 3 == 0 else "" for i in range(4000)]  # no end is cut in two
    text = "".join(line + ends[i % 3] for i, line in enumerate(lines))
    (tmp_path / "t" / "deep").mkdir(parents=True)
    (tmp_path / "t" / "big.txt").write_bytes(text.encode())
    (tmp_path / "t" / "deep" / "no end.txt").write_bytes(b"one\n\ntwo")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = from_text_tree(spark, str(tmp_path / "t")).select("source_text", "offset", "original_sentence").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [("big.txt", i + 1, line) for i, line in enumerate(lines) if line] + [("deep/no end.txt", 1, "one"), ("deep/no end.txt", 3, "two")]
    assert sorted(map(tuple, got)) == sorted(want)
