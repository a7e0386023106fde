"""Corpora: tables, text trees and ZIP archives as sentences.

A sentence is a line that is not blank: (original_sentence, normalized_sentence,
source_text, offset), offset counted from 1 with blank lines included.
"""

from __future__ import annotations

import bz2
import lzma
import os
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager, suppress
from functools import partial, reduce
from itertools import batched
from pathlib import PurePosixPath
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentria.functions.text import LINE_END, is_blank, normalize
from sentria.session import ship_code
from sentria.shared import listed, qualified, setting, uri, written

SENTENCES = T.StructType(
    [
        T.StructField("original_sentence", T.StringType(), False),
        T.StructField("normalized_sentence", T.StringType(), False),
        T.StructField("source_text", T.StringType(), False),
        T.StructField("offset", T.IntegerType(), False),
    ]
)


def sentences(texts: DataFrame, source: Column, text: Column, *keep: str) -> DataFrame:
    """The sentences of whole texts. Null texts have none. Line ends are \\n, \\r\\n
    and \\r alone; a line of punctuation is kept and normalises to nothing."""
    # each line is normalised once, before the lines part: whatever later filters and
    # scores say of the normalised text, the optimizer cannot repeat the work there
    cut = F.transform(F.split(text, LINE_END, -1), lambda line: F.struct(line.alias("original_sentence"), normalize(line).alias("normalized_sentence")))
    lines = texts.select(*keep, source.alias("source_text"), F.posexplode(cut).alias("pos", "line")).select(*keep, "source_text", "pos", "line.*")
    return lines.where(~is_blank("original_sentence")).select(*keep, "original_sentence", "normalized_sentence", "source_text", (F.col("pos") + 1).alias("offset"))


def dealt(df: DataFrame) -> DataFrame:
    """A table in fewer parts than there are cores is dealt to all of them before its
    texts are cut; one of many parts stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def from_table(df: DataFrame, id_col: str, text_col: str, folder: str, keep_id: bool = False) -> DataFrame:
    """A table's rows as the files ``folder/<id>.txt``."""
    source = F.concat(F.lit(f"{folder}/"), F.col(id_col).cast("string"), F.lit(".txt"))
    kept = [id_col] if keep_id else []
    return sentences(dealt(df.select(*dict.fromkeys([id_col, text_col]))), source, F.col(text_col), *kept)


#: What opening a file counts as, when files are dealt to tasks: for Spark, and here.
OPEN_COST, SMALL_FILE, OPEN_BYTES = "spark.sql.files.openCostInBytes", str(64 << 10), 16 << 10
#: Names that Spark does not read, of files and of folders.
_HIDDEN = re.compile(r"\.|_[^=]*\Z|.*\._COPYING_/?\Z", re.DOTALL)
_ANY_END = re.compile(rb"\r\n?|\n")
_ENTRIES = pa.schema([("name", pa.string()), ("size", pa.int64())])
_COUNTED = pa.schema([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("lines", pa.int64())])
_TEXTS = pa.schema([("name", pa.string()), ("before", pa.int64()), ("text", pa.string())])


def from_text_tree(spark: SparkSession, root: str) -> DataFrame:
    """All ``*.txt`` files below a folder; ``source_text`` is the path from there.

    The driver holds no list of files: folders are listed by tasks, a level of the tree at
    a time, and files are dealt to tasks by name. A large one is many parts of whole lines;
    a line's number is its place in its part and the lines of the parts before, which are
    counted first. Names that begin with ``_`` or ``.`` are skipped, bytes that are not
    UTF-8 read as U+FFFD and a byte order mark is dropped, as Spark does. What pyarrow
    can't open as a folder here (a store that only Spark knows) is read by Spark's own
    reader, for which the driver lists all files.
    """
    folder = uri(spark, root)
    if not _is_folder(folder):
        return _tree_by_spark(spark, root)
    ship_code(spark)
    files = _files(spark, folder)
    n, size, largest = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).head()
    part = min(BATCH_BYTES, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    tasks = max(spark.sparkContext.defaultParallelism, (size + n * OPEN_BYTES) // TASK_BYTES + 1)
    parts = files.where(F.col("size").between(1, part)).select("name", F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(0).cast("long").alias("before"))
    if largest > part:
        cut = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(part).cast("long"))).alias("start")
        end = F.when(F.col("start") + part < F.col("size"), F.col("start") + part).alias("end")  # null: to the end of the file
        large = files.where(F.col("size") > part).select("name", "size", cut).select("name", "start", end)
        counted = large.repartition(tasks, "name", "start").mapInArrow(partial(_counted, folder), "name string, start long, end long, lines long")
        earlier = Window.partitionBy("name").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.union(written(counted.select("name", "start", "end", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before")), "parts"))
    texts = parts.repartition(tasks, "name", "start").mapInArrow(partial(_texts, folder), "name string, before long, text string")
    found = sentences(texts, F.col("name"), F.col("text"), "before")
    return found.select("original_sentence", "normalized_sentence", "source_text", (F.col("offset") + F.col("before")).cast("int").alias("offset"))


def _is_folder(folder: str) -> bool:
    try:
        store, at = fs.FileSystem.from_uri(folder)
        return store.get_file_info(at).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size) of the text files below a folder; a task lists a folder."""
    level, found = spark.range(0, 1, 1, 1).select(F.lit("").alias("name")), []
    while True:
        entries = written(level.mapInArrow(partial(_entries, folder), "name string, size long"), "entries")
        found.append(entries.where("size IS NOT NULL"))
        below = entries.where("size IS NULL")
        if below.isEmpty():
            return reduce(DataFrame.union, found)
        level = below.select("name").repartition(spark.sparkContext.defaultParallelism)


def _entries(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in folders: text files with their sizes, and folders, which end in a slash, with none."""
    store, at = fs.FileSystem.from_uri(folder)
    for row in _rows(batches):
        inside = ((row["name"] + name, size) for name, size in _inside(store, f"{at}/{row['name']}".rstrip("/") or "/") if not _HIDDEN.match(name))
        for some in batched(inside, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), _ENTRIES.types)], schema=_ENTRIES)


def _inside(store: fs.FileSystem, at: str) -> Iterator[tuple[str, int | None]]:
    """A local folder is not held whole, however many files it has."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(at) as found:
            for x in found:
                if x.is_dir():
                    yield f"{x.name}/", None
                elif x.name.endswith(".txt"):
                    with suppress(FileNotFoundError):  # gone, or a link to nothing
                        yield x.name, x.stat().st_size
    else:
        for x in store.get_file_info(fs.FileSelector(at)):
            if x.type == fs.FileType.Directory:
                yield f"{x.base_name}/", None
            elif x.base_name.endswith(".txt"):
                yield x.base_name, x.size


def _line_from(source: pa.NativeFile, at: int, until: int | None = None) -> int:
    """Where the first line begins that begins at a place or after; the end of the file, if
    none does. If none begins before ``until``, a place there or after: a long line is not
    read through again for each part that it covers."""
    if not at:
        return 0
    at -= 1
    source.seek(at)
    returned = False
    while block := source.read(64 << 10):
        if returned:
            return at + block.startswith(b"\n")
        if found := _ANY_END.search(block):
            if found.end() < len(block) or block.endswith(b"\n"):
                return at + found.end()
            returned = True  # its \n may be in the next block
        at += len(block)
        if until is not None and at >= until:
            return at
    return at


def _cut(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    """Parts of files and the lines that begin in them."""
    store, at = fs.FileSystem.from_uri(folder)
    for row in _rows(batches):
        with store.open_input_file(f"{at}/{row['name']}") as source:
            first, end = _line_from(source, row["start"], row["end"]), row["end"]
            last = None if end is None else first if first >= end else _line_from(source, end)
            source.seek(first)
            content = source.read(None if last is None else last - first)
        yield row, content if row["start"] else content.removeprefix(b"\xef\xbb\xbf")


def _counted(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts with the number of line ends in each."""
    for row, content in _cut(folder, batches):
        lines = content.count(b"\n") + content.count(b"\r") - content.count(b"\r\n")
        yield pa.RecordBatch.from_pylist([row | {"lines": lines}], _COUNTED)


def _texts(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    held = 0
    for row, content in _cut(folder, batches):
        rows.append({"name": row["name"], "before": row["before"], "text": content.decode("utf-8", "replace")})
        held += len(content) + OPEN_BYTES // 16  # a row is something too
        if held >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, _TEXTS)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _TEXTS)


def _tree_by_spark(spark: SparkSession, root: str) -> DataFrame:
    """A text tree in Spark's splits: a line's number is its place in its split and the
    lines of the splits before."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root)
    # rows of a split follow each other, and so do these numbers
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
    with setting(spark, OPEN_COST, SMALL_FILE):  # at Spark's 4 MB a file, 32 small files are a task
        lines = written(lines, "lines", compression="zstd")
    splits = lines.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(splits.select("path", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift")), "splits")
    full = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    base = unquote(PurePosixPath(root.split(":", 1)[-1]).as_posix()).lstrip("/").rstrip("/")
    found = lines.where(~is_blank("value")).join(starts, ["path", "split"])
    return found.select(
        F.col("value").alias("original_sentence"), normalize("value").alias("normalized_sentence"), F.substring_index(full, f"/{base}/", -1).alias("source_text"), (F.col("place") + F.col("shift")).cast("int").alias("offset")
    )


class UnsafeMember(ValueError):
    """A ZIP member whose name leads out of the archive."""


def _leads_out(name: Column) -> Column:
    """An absolute path, or one with a ``..`` in it, with either slash."""
    path = F.translate(name, "\\", "/")
    return path.startswith("/") | path.rlike("^[A-Za-z]:") | F.array_contains(F.split(path, "/"), "..")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


class _Sought:
    """A file of pyarrow for zipfile, which looks for a record of 64 bits before the end of
    each archive: in one without members that is before its beginning, and no OSError to pyarrow."""

    def __init__(self, file: pa.NativeFile):
        self._file = file

    def __getattr__(self, name: str):
        return getattr(self._file, name)

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        try:
            return self._file.seek(offset, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e


@contextmanager
def opened_archive(uri: str) -> Iterator[zipfile.ZipFile]:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as source, zipfile.ZipFile(_Sought(source)) as archive:
        yield archive


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What an archive's central directory says of its members; no member is read."""
    for row in _rows(batches):
        with opened_archive(row["archive"]) as archive:
            found = [(row["archive"], m.filename, m.header_offset, m.compress_size, m.compress_type, m.CRC, bool(m.flag_bits & 1)) for m in archive.infolist() if not m.is_dir()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * len(_MEMBER), _MEMBER.types)], schema=_MEMBER)


_MEMBER = pa.schema([("archive", pa.string()), ("member", pa.string()), ("place", pa.int64()), ("packed", pa.int64()), ("method", pa.int32()), ("crc", pa.int64()), ("locked", pa.bool_())])
#: Bytes of a task, packed, and of a batch of texts, about.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
_LOCAL_HEADER = struct.Struct("<4s22xHH")


def _unpacked_lzma(packed: bytes) -> bytes:
    """A member's LZMA: two bytes of version, the length of five bytes of properties (literal
    bits, size of the dictionary), those, and the stream."""
    size = int.from_bytes(packed[2:4], "little")
    if size != 5:
        raise zipfile.BadZipFile("LZMA properties of an unknown form")
    first, dictionary = packed[4], int.from_bytes(packed[5:9], "little")
    kind = {"id": lzma.FILTER_LZMA1, "lc": first % 9, "lp": first // 9 % 5, "pb": first // 45, "dict_size": max(dictionary, 4096)}
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[kind]).decompress(packed[9:])


def _inflated(source, row: dict) -> str:
    """The text of one member, from its own place in the archive."""
    source.seek(row["place"])
    mark, name, extra = _LOCAL_HEADER.unpack(source.read(_LOCAL_HEADER.size))
    if mark != b"PK\x03\x04" or row["locked"]:
        raise zipfile.BadZipFile(f"{row['member']} in {row['archive']} cannot be read")
    source.seek(name + extra, os.SEEK_CUR)
    packed = source.read(row["packed"])
    if row["method"] == zipfile.ZIP_STORED:
        content = packed
    elif row["method"] == zipfile.ZIP_DEFLATED:
        content = zlib.decompress(packed, -zlib.MAX_WBITS)
    elif row["method"] == zipfile.ZIP_BZIP2:
        content = bz2.decompress(packed)
    elif row["method"] == zipfile.ZIP_LZMA:
        content = _unpacked_lzma(packed)
    else:
        raise NotImplementedError(f"{row['member']} is compressed by method {row['method']}")
    if zlib.crc32(content) != row["crc"]:
        raise zipfile.BadZipFile(f"{row['member']} in {row['archive']} is damaged")
    return content.decode("utf-8")  # not UTF-8: an error


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a task's members; members of one archive follow each other."""
    names: list[str] = []
    texts: list[str] = []
    held, archive, source = 0, None, None

    def batch():
        return pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["member", "text"])

    with ExitStack() as files:
        for row in _rows(batches):
            if row["archive"] != archive:
                files.close()
                archive = row["archive"]
                store, path = fs.FileSystem.from_uri(archive)
                source = files.enter_context(store.open_input_file(path))
            names.append(row["member"])
            texts.append(_inflated(source, row))
            held += len(texts[-1])
            if held >= BATCH_BYTES:
                yield batch()
                names, texts, held = [], [], 0
    if names:
        yield batch()


def from_zip(spark: SparkSession, path: str) -> DataFrame:
    """The ``*.txt`` members of one archive, or of all that a glob names.

    Nothing is extracted and no archive is read whole. A task per archive reads its
    central directory; members are then dealt to tasks by their place and packed
    size, and each is inflated from its own place, so one large archive, of more
    than 2 GB too, is read by many tasks. A member is a row. FileNotFoundError
    without an archive; UnsafeMember, a ValueError, if any member would lie outside,
    before any is read.
    """
    ship_code(spark)
    archives = listed(spark, path)
    if not archives:
        raise FileNotFoundError(f"Archive not found: {path}")
    each = spark.createDataFrame([(a,) for a in archives], "archive string").repartition(len(archives))
    members = written(each.mapInArrow(_listed, "archive string, member string, place long, packed long, method int, crc long, locked boolean"), "members")
    unsafe = members.where(_leads_out(F.col("member"))).take(1)
    if unsafe:
        raise UnsafeMember(f"Unsafe path inside ZIP: {unsafe[0].member}")
    texts = members.where(F.col("member").endswith(".txt"))
    packed = texts.agg(F.coalesce(F.sum("packed"), F.lit(0))).head()[0]
    tasks = max(spark.sparkContext.defaultParallelism, packed // TASK_BYTES + 1)
    placed = texts.repartitionByRange(tasks, "archive", "place").sortWithinPartitions("archive", "place")
    return sentences(placed.mapInArrow(_read, "member string, text string"), F.col("member"), F.col("text"))


def to_zip(texts: DataFrame, path: str, name_col: str, text_col: str) -> None:
    """Write (name, text) rows as members of archives below ``path``, one for each
    partition. A task that runs again writes its archive again; null texts are left out."""
    ship_code(texts.sparkSession)
    folder = qualified(texts.sparkSession, path)

    def run(batches):
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        name = f"{at}/part-{TaskContext.get().partitionId():05d}.zip"
        with store.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for batch in batches:
                for member, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    archive.writestr(member, text)
        yield pa.record_batch([pa.array([name])], names=["archive"])

    texts.select(name_col, text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, "archive string").count()


def to_text_tree(texts: DataFrame, path: str, name_col: str, text_col: str) -> None:
    """Write (name, text) rows as the files ``path/<name>``; null texts are left out."""
    ship_code(texts.sparkSession)
    folder = qualified(texts.sparkSession, path)

    def run(batches):
        store, at = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (under := f"{at}/{name}".rpartition("/")[0]) not in made:
                    store.create_dir(under, recursive=True)
                    made.add(under)
                with store.open_output_stream(f"{at}/{name}") as out:
                    out.write(text.encode("utf-8"))
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["files"])

    texts.select(name_col, text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, "files long").count()
