"""WARC archives: writing them, giving every record a gzip member of its own, and
reading records back by offset.

Spark's text writer makes each archive one gzip stream from end to end. Nothing in
such a file can be reached without inflating all before it, so the normaliser
inflates each file once, as a stream, writes every record as a member of its own,
and puts a sidecar beside it that says where each member lies.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm.common import new_path, slices, written

CRLF, GAP = "\r\n", "\r\n\r\n"
#: Records in an archive at most; an archive is what one task inflates.
RECORDS_PER_FILE = 4000
#: Bytes inflated at a time, and the effort of deflating a member.
CHUNK, LEVEL = 1 << 20, 3
SIDECAR = ".offsets.csv"
INDEX = "archive string, start long, size long, record_id string"

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs


def payload_digest(payload: bytes) -> str:
    """Bare base32 SHA-1, as WARC digests are written."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """The same page has the same id whenever it is written."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{url}|{digest}')}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def render(page_id: int | None, url: str | None, html: str | None, first: int | None, first_url: str | None = None) -> str:
    """A record without the gap that ends it. ``first``: the page that has the same
    payload already; then only the response's head is kept."""
    payload = (html or "").encode("utf-8")
    digest = payload_digest(payload)
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{GAP}"
    body = html or "" if first is None else ""
    fields = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": record_id(page_id, url, digest),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else _clean(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": None if first is None else "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
        "X-Page-ID": page_id,
        "WARC-Refers-To": None if first is None else record_id(first, first_url, digest),
        "X-Refers-To-Page-ID": first,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(head) + (len(payload) if first is None else 0),
    }
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    return CRLF.join(lines) + GAP + head + body


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record per page, as archives that are one gzip stream each.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the
    smallest id is the response, the others revisit it. Payloads are compared by
    SHA-1 and length. A page without an id is always a response.
    """
    rows = pages.select("page_id", "url", "html")
    size = F.octet_length(F.coalesce("html", F.lit("")))
    keyed = rows.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).withColumn("bytes", size)
    # combined before the shuffle: a very common payload is a few rows there
    groups = keyed.where((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha", "bytes").agg(F.min(F.struct("page_id", "url")).alias("response"), F.max("page_id").alias("last"))
    groups = groups.select("sha", "bytes", F.col("response.page_id").alias("first"), F.col("response.url").alias("first_url"), "last")
    groups = written(groups.where("first < last").drop("last"), "payloads")
    # both sides are plain tables: a partition with a very common payload can be split
    known = keyed.join(groups, ["sha", "bytes"], "left").withColumn("first", F.when(F.col("page_id") != F.col("first"), F.col("first")))

    def run(batches):
        for batch in slices(batches):
            out = [render(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(5)))]
            yield pa.record_batch([pa.array(out, pa.string())], names=["value"])

    records = known.select("page_id", "url", "html", "first", "first_url").mapInArrow(run, "value string")
    records.write.option("compression", "gzip").option("lineSep", GAP).option("maxRecordsPerFile", records_per_file).text(path)


def inflated(source, chunk: int = CHUNK) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, piece by piece. One that
    ends within a member, its checksum included, is an error."""
    inflate, within = zlib.decompressobj(31), False
    while data := source.read(chunk):
        while data:
            within = True
            out = inflate.decompress(data, chunk)
            if out:
                yield out
            data = inflate.unconsumed_tail
            if inflate.eof:
                data = inflate.unused_data
                inflate, within = zlib.decompressobj(31), False
    while tail := inflate.decompress(inflate.unconsumed_tail, chunk):
        yield tail
    if within and not inflate.eof:
        raise EOFError("the archive ends within a gzip member")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, the gap included, from a stream of bytes; holds one record."""
    held = bytearray()
    gap = GAP.encode()
    need = -1
    for piece in pieces:
        held += piece
        while True:
            if need < 0:
                end = held.find(gap)
                if end < 0:
                    break
                need = end + len(gap) + int(fields(bytes(held[:end]))["content-length"]) + len(gap)
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held:
        raise ValueError("the archive ends within a record")


def fields(head: bytes) -> dict[str, str]:
    """Header fields, names in lower case."""
    out = {}
    for line in head.decode("utf-8").split(CRLF)[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path) of the files in a folder, as Spark lists them; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")


def _normalise_file(source: str, target: str) -> int:
    """One archive, inflated once, to one with a member per record, and its sidecar.

    Both are written under other names first and moved when they are whole, so a
    task that is lost or runs twice leaves nothing half done.
    """
    store, at = fs.FileSystem.from_uri(source)
    _, folder = fs.FileSystem.from_uri(target)
    name = at.rsplit("/", 1)[-1].split(".")[0] + ".warc.gz"
    draft = f"{folder}/_{uuid.uuid4().hex}"
    done, lines = 0, []
    with store.open_input_stream(at, compression=None) as inp, store.open_output_stream(draft, compression=None) as out:
        for record in records(inflated(inp)):
            deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = deflate.compress(record) + deflate.flush()
            out.write(member)
            known = fields(record[: record.find(GAP.encode())])
            lines.append(f"{name},{done},{len(member)},{known['warc-record-id']}\n")
            done += len(member)
    with store.open_output_stream(f"{draft}{SIDECAR}") as out:
        out.write("".join(lines).encode())
    for suffix in ("", SIDECAR):
        _publish(store, draft + suffix, f"{folder}/{name}{suffix}")
    return len(lines)


def _publish(store: fs.FileSystem, draft: str, final: str) -> None:
    """Give a whole file its name. If another run of the task has done so, its file
    holds the same bytes, and stays: not every store moves onto a file."""
    if store.get_file_info(final).type == fs.FileType.NotFound:
        store.move(draft, final)
    else:
        store.delete_file(draft)


def normalise(spark: SparkSession, source: str, target: str) -> int:
    """Rewrite every archive in ``source`` into ``target``; returns the records.

    A task takes one archive at a time and holds one record and its sidecar. The
    folders are ones that all executors reach, by a URI that pyarrow knows.
    """
    store, folder = fs.FileSystem.from_uri(target)
    store.create_dir(folder, recursive=True)
    paths = _files(spark, source, "*.gz")

    def run(batches):
        for batch in batches:
            counts = [_normalise_file(_uri(p), target) for p in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(counts, pa.int64())], names=["records"])

    return paths.repartition(max(1, paths.count())).mapInArrow(run, "records long").agg(F.sum("records")).head()[0] or 0


def _uri(path: str) -> str:
    return re.sub(r"^file:/(?!/)", "file:///", path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecars of a folder: (archive, start, size, record_id)."""
    return spark.read.schema(INDEX).option("pathGlobFilter", f"*{SIDECAR}").csv(path)


def _page(record: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload)."""
    gap = GAP.encode()
    end = record.find(gap)
    known = fields(record[:end])
    block = record[end + len(gap) : end + len(gap) + int(known["content-length"])]
    cut = block.find(gap)
    payload = block[cut + len(gap) :]
    size, digest = int(fields(block[:cut])["content-length"]), known["warc-payload-digest"].removeprefix("sha1:")
    if known["warc-type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {known['warc-record-id']} is damaged")
    number = lambda k: int(known[k]) if k in known else None
    return number("x-page-id"), size, digest, known["warc-type"], number("x-refers-to-page-id"), payload


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record of a normalised folder, reached by its offset: (page_id,
    payload_bytes, payload_digest, record_type, refers_to), with ``payloads`` also
    the payload (null for revisits). A response's payload is held against its digest."""

    def run(batches):
        name, source = None, None
        with ExitStack() as files:  # one archive is open at a time
            for batch in slices(batches):
                rows = []
                for archive, start, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    if archive != name:
                        files.close()
                        store, at = fs.FileSystem.from_uri(f"{path}/{archive}")
                        name, source = archive, files.enter_context(store.open_input_file(at))
                    rows.append(_page(zlib.decompress(source.read_at(size, start), 31)))
                cols = list(zip(*rows)) if rows else [()] * 6
                out = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                if payloads:
                    out.append(pa.array([p if t == "response" else None for p, t in zip(cols[5], cols[3])], pa.binary()))
                    names.append("payload")
                yield pa.record_batch(out, names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")
    return index(spark, path).select("archive", "start", "size").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives, normalise them, read them.

    One row per page. A null html is an empty payload; equal empty payloads count as
    equal. A null url has no target field; control characters in a url are written
    as percent codes. Pages without an id come back as responses without one; a page
    repeated under one id comes back as often, as a response if it is the first of
    its payload. An empty table gives an empty result. Other columns are not read.
    """
    spark = pages.sparkSession
    whole, single = new_path(spark, "warc-whole"), new_path(spark, "warc")
    write_archives(pages, whole, min_bytes)
    normalise(spark, whole, single)
    store, folder = fs.FileSystem.from_uri(_uri(whole) if ":" in whole else f"file://{whole}")
    store.delete_dir(folder)  # the streams have served their purpose
    return read_archives(spark, single, payloads)
