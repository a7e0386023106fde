import zipfile

import pytest

from sentria.service import Completion, CompletionService, configure_logging, initialize_corpus, shutdown_logging
from sentria.sources.corpus import SENTENCES, UnsafeMember, from_table, from_text_tree, from_zip, to_text_tree, to_zip


def rows(df):
    return sorted((r.source_text, r.offset, r.original_sentence, r.normalized_sentence) for r in df.collect())


FILES = {
    "a.txt": "one\n\n   \nfour\n",
    "docs/deep er/b%+é.txt": "CR LF\r\nlone\rnext\x0bsame\n",
    "notes.md": "not read",
    "marks.txt": "!!!\n  Kept, as it is  \n",
    "empty.txt": "",
}
WANT = [
    ("a.txt", 1, "one", "one"),
    ("a.txt", 4, "four", "four"),
    ("docs/deep er/b%+é.txt", 1, "CR LF", "cr lf"),
    ("docs/deep er/b%+é.txt", 2, "lone", "lone"),
    ("docs/deep er/b%+é.txt", 3, "next\x0bsame", "next same"),
    ("marks.txt", 1, "!!!", ""),
    ("marks.txt", 2, "  Kept, as it is  ", "kept as it is"),
]


def test_text_tree(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    assert rows(from_text_tree(spark, str(tmp_path))) == WANT
    assert rows(from_text_tree(spark, f"file://{tmp_path}/")) == WANT


def archive(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return str(path)


def test_zip(spark, tmp_path):
    assert rows(from_zip(spark, archive(tmp_path / "x.zip", FILES))) == WANT


def test_large_archives_are_dealt_to_tasks(spark, tmp_path):
    """Members of many archives, of every method, in several tasks."""
    files = {f"d{i}/t{i}.txt": f"line {i}\n\nother {i * 7}\n" * (i % 5) for i in range(60)}
    for at, method in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2)):
        with zipfile.ZipFile(tmp_path / f"{at}.zip", "w", method) as z:
            for i, (name, text) in enumerate(files.items()):
                if i % 3 == at:
                    z.writestr(name, text)
    got = from_zip(spark, str(tmp_path / "*.zip"))
    assert got.rdd.getNumPartitions() > 1
    want = [(name, n + 1, line, line) for name, text in files.items() for n, line in enumerate(text.split("\n")) if line]
    assert rows(got) == sorted(want)


def test_damaged_members(spark, tmp_path):
    path = archive(tmp_path / "x.zip", {"a.txt": "some text that is stored"})
    content = bytearray((tmp_path / "x.zip").read_bytes())
    content[content.index(b"some text")] ^= 1
    (tmp_path / "x.zip").write_bytes(content)
    with pytest.raises(Exception, match="damaged"):
        from_zip(spark, path).collect()


def test_written_archives_and_trees_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", "one\ntwo"), ("é.txt", "drei"), ("n.txt", None), ("a/e.txt", "")], "name string, text string")
    to_zip(df.repartition(2), str(tmp_path / "z"), "name", "text")
    to_text_tree(df, str(tmp_path / "t"), "name", "text")
    want = [("a/b.txt", 1, "one", "one"), ("a/b.txt", 2, "two", "two"), ("é.txt", 1, "drei", "drei")]
    assert rows(from_zip(spark, str(tmp_path / "z" / "*.zip"))) == want == rows(from_text_tree(spark, str(tmp_path / "t")))


@pytest.mark.parametrize("name", ["../escaped.txt", "a/../../b.txt", "/abs.txt"])
def test_unsafe_members(spark, tmp_path, name):
    with pytest.raises(UnsafeMember):
        from_zip(spark, archive(tmp_path / "x.zip", {"ok.txt": "fine", name: "bad"}))


def test_missing_archive(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        from_zip(spark, str(tmp_path / "none.zip"))


def test_tables(spark):
    df = spark.createDataFrame([(1, "x\n\ny"), (2, None), (3, "")], "doc_id long, text string")
    assert [(f.name, f.dataType) for f in from_table(df, "doc_id", "text", "documents").schema] == [(f.name, f.dataType) for f in SENTENCES]
    assert rows(from_table(df, "doc_id", "text", "documents")) == [("documents/1.txt", 1, "x", "x"), ("documents/1.txt", 3, "y", "y")]


def test_archive_to_completions(spark, tmp_path):
    path = archive(tmp_path / "x.zip", {"docs/a.txt": "Computer Science\nHello World", "docs/b.txt": "Unrelated"})
    service = CompletionService()
    with pytest.raises(RuntimeError):
        service.completions("")
    service.configure(initialize_corpus(spark, path, str(tmp_path / "index")))
    assert service.completions("puter sci") == [Completion("Computer Science", "docs/a.txt", 1, 18)]
    assert service.completions("HELLO!") == [Completion("Hello World", "docs/a.txt", 2, 10)]
    assert service.completions(" ?! ") == []


def test_log(tmp_path):
    path = tmp_path / "logs" / "x.log"
    assert configure_logging(str(path)) is configure_logging(str(path))
    assert len(configure_logging(str(path)).handlers) == 1
    configure_logging(str(path)).info("said once")
    shutdown_logging()
    (line,) = path.read_text().splitlines()
    assert line.endswith("| INFO | said once")


def test_a_corpus_of_which_an_archive_is_empty(spark, tmp_path):
    archive(tmp_path / "a.zip", {})
    archive(tmp_path / "b.zip", {"docs/a.txt": "Computer Science\nHello World"})
    service = CompletionService(initialize_corpus(spark, str(tmp_path / "*.zip"), str(tmp_path / "index")))
    assert service.completions("puter sci") == [Completion("Computer Science", "docs/a.txt", 1, 18)]
    assert rows(from_zip(spark, str(tmp_path / "a.zip"))) == []
