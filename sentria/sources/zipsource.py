"""ZIP archives as a data source: spark.read.format("ziptext").load("texts/*.zip").

A row is a ``*.txt`` member. The planner reads central directories only and keeps no
names: a partition is a range of an archive's members of about so many packed
bytes, so one large archive is read by many tasks. The option ``members``, a pattern,
is tested on names, before a member is inflated. (Filters are not pushed into the source:
Spark 4.1 keeps those of a table's first query for later queries that have none.)
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from contextlib import AbstractContextManager
from dataclasses import dataclass
from fnmatch import fnmatchcase
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sentria.session import ship_code
from sentria.sources.corpus import BATCH_BYTES, TASK_BYTES, UnsafeMember, opened_archive, sentences
from sentria.shared import listed

NAME = "ziptext"
def unsafe(name: str) -> bool:
    """An absolute path, or one with a ``..`` in it, with either slash."""
    path = name.replace("\\", "/")
    return path.startswith("/") or path[1:2] == ":" and path[:1].isalpha() or ".." in path.split("/")


@dataclass
class MemberRange(InputPartition):
    archive: str
    first: int
    last: int


def _opened(uri: str) -> AbstractContextManager[zipfile.ZipFile]:
    return opened_archive(uri if "://" in uri else f"file://{uri}")


def _archives(path: str) -> list[str]:
    """One archive, several with commas between, or what a pattern names in a folder."""
    out = []
    for part in path.split(","):
        store, at = fs.FileSystem.from_uri(part if "://" in part else f"file://{part}")
        if "*" in at or "?" in at:
            folder = at.rpartition("/")[0]
            scheme = part[: len(part) - len(at)] if part.endswith(at) else "file://"
            found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            out += sorted(scheme + f.path for f in found if f.is_file and PurePosixPath(f.path).match(PurePosixPath(at).name))
        elif store.get_file_info(at).type != fs.FileType.NotFound:
            out.append(part)
    if not out:
        raise FileNotFoundError(f"Archive not found: {path}")
    return out


class ZipTextReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int, names: str):
        self.path, self.task_bytes, self.names = path, task_bytes, names

    def wanted(self, info: zipfile.ZipInfo) -> bool:
        return not info.is_dir() and info.filename.endswith(".txt") and fnmatchcase(info.filename, self.names)

    def partitions(self) -> list[MemberRange]:
        """Ranges of members. All names are looked at before any member is read."""
        out = []
        for uri in _archives(self.path):
            first = size = last = 0
            with _opened(uri) as archive:
                for last, info in enumerate(archive.infolist(), 1):
                    if unsafe(info.filename):
                        raise UnsafeMember(f"Unsafe path inside ZIP: {info.filename}")
                    size += info.compress_size if self.wanted(info) else 0
                    if size >= self.task_bytes:
                        out.append(MemberRange(uri, first, last))
                        first, size = last, 0
            if size:
                out.append(MemberRange(uri, first, last))
        return out

    def read(self, partition: MemberRange) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, str]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["archive", "member", "text"])

        if partition is None:  # no archive has a member that is wanted
            return
        with _opened(partition.archive) as archive:
            for info in archive.infolist()[partition.first : partition.last]:
                if not self.wanted(info):
                    continue
                rows.append((partition.archive, info.filename, archive.read(info).decode("utf-8")))  # not UTF-8, or damaged: an error
                held += len(rows[-1][2])
                if held >= BATCH_BYTES:
                    yield batch()
                    rows.clear()
                    held = 0
        if rows:
            yield batch()


class ZipText(DataSource):
    """(archive, member, text). Options: ``path``; ``taskBytes``, packed bytes of a partition;
    ``members``, a pattern of the names that are read."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "archive string, member string, text string"

    def reader(self, schema) -> ZipTextReader:
        return ZipTextReader(self.options["path"], int(self.options.get("taskBytes", TASK_BYTES)), self.options.get("members", "*"))


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("ziptext")`` known."""
    ship_code(spark)
    spark.dataSource.register(ZipText)


def zip_sentences(spark: SparkSession, path: str) -> DataFrame:
    """``from_zip`` by way of the data source."""
    register(spark)
    archives = listed(spark, path)
    if not archives:
        raise FileNotFoundError(f"Archive not found: {path}")
    return sentences(spark.read.format(NAME).load(",".join(archives)), F.col("member"), F.col("text"))
