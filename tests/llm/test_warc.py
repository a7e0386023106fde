import gzip
import zlib

import pytest
from pyarrow import fs

from sentria.llm.common import new_path
from sentria.llm.warc import archive_round_trip, index, inflated, normalise, payload_digest, read_archives, record_id, records, render, write_archives

SCHEMA = "page_id long, url string, html string, payload_digest string, first string"
ROWS = [
    (5, "http://a/x", "<p>é\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n</p>"),
    (3, "http://a/y y\n", "same"),
    (9, None, "same"),
    (4, "http://b", None),
    (8, "http://b", ""),
    (7, "http://c", "x" * 3_000_000),
    (3, "http://a/y y\n", "same"),
    (None, "http://d", "same"),
]


def want(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        f = first.get(h or "", i) if i is not None else i
        out.append((i, len((h or "").encode()), payload_digest((h or "").encode()), "response" if f == i else "revisit", None if f == i else f))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, "a", "b") for r in ROWS], SCHEMA)
    got = archive_round_trip(pages, least, payloads=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want(ROWS, least)
    sources = {i: h or "" for i, _, h in ROWS}
    assert all(bytes(r.payload).decode() == sources[r.page_id] for r in got if r.payload is not None)


def test_streams_become_members_that_stand_alone(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * i) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    whole, single = new_path(spark, "whole"), new_path(spark, "single")
    write_archives(pages, whole, records_per_file=70)
    assert normalise(spark, whole, single) == 200
    store, folder = fs.FileSystem.from_uri(single)
    rows = index(spark, single).collect()
    for r in rows:
        data = store.open_input_file(f"{folder}/{r.archive}").read_at(r.size, r.start)
        d = zlib.decompressobj(31)
        record = d.decompress(data)
        assert d.eof and not d.unused_data and record.startswith(b"WARC/1.0\r\n") and r.record_id.encode() in record
    assert len({r.archive for r in rows}) >= 3
    assert sorted(r.page_id for r in read_archives(spark, single).collect()) == list(range(200))
    # what has members already is read like one stream
    with store.open_input_stream(f"{folder}/{rows[0].archive}", compression=None) as f:
        assert len(list(records(inflated(f, 100)))) == sum(r.archive == rows[0].archive for r in rows)


def test_empty_table_and_cut_archive(spark):
    assert archive_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        list(records(iter([b"WARC/1.0\r\nContent-Length: 10\r\n\r\nshort"])))


def test_cut_streams_are_errors():
    import io

    whole = gzip.compress(b"WARC/1.0 one") + gzip.compress(b"two")
    assert b"".join(inflated(io.BytesIO(whole), 4)) == b"WARC/1.0 onetwo"
    for cut in (1, 4, 8, len(gzip.compress(b"two")) - 1):
        with pytest.raises(EOFError):
            list(inflated(io.BytesIO(whole[:-cut]), 4))


def test_revisits_name_the_record_they_refer_to():
    digest = payload_digest(b"x")
    text = render(7, "http://b", "x", 3, "http://a")
    assert f"WARC-Refers-To: {record_id(3, 'http://a', digest)}" in text
    assert f"WARC-Record-ID: {record_id(3, 'http://a', digest)}" in render(3, "http://a", "x", None)
