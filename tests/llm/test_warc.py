import base64
import gzip
import hashlib
import io

import pytest

from newsloom.llm.warc import (
    WarcError,
    archived_pages,
    page_record,
    read_archives,
    read_records,
    records_of,
    write_archives,
)

SCHEMA = "page_id long, url string, html string, digest string, first_id long"


def pages():
    rows = [
        (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two</p>"), (3, "http://b/\n3 ü", "<p>one</p>"), (4, None, None),
        (5, "http://a/5", ""), (6, "", "x" * 300_000), (7, "http://a/7", "x" * 300_000), (None, "http://n", "<p>one</p>"),
        (None, None, "alone"), (8, "http://a/8", "日本 \r\n\r\n WARC/1.1\r\n"), (2, "http://a/2", "<p>two</p>"),
    ]
    return [(*r, "d", 5) for r in rows]


def want(rows, least=0):
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        first = min(same, default=None) if len(data) >= least else None
        revisit = first is not None and i != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 10])
def test_written_and_read_back(spark, least):
    found = archived_pages(spark.createDataFrame(pages(), SCHEMA), least)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want(pages(), least)


def test_payloads_and_rolling_over(spark, tmp_path):
    folder = tmp_path.as_uri()
    archives = write_archives(spark.createDataFrame(pages(), SCHEMA).coalesce(1), folder, roll=400)
    assert archives.count() == len(list(tmp_path.glob("*.warc.gz"))) > 1
    rows = read_archives(archives, folder, payloads=True).collect()
    full = {bytes(r["payload"]) for r in rows if r["record_type"] == "response"}
    assert full == {(p[2] or "").encode() for p in pages()}
    with gzip.open(next(tmp_path.glob("*.warc.gz"))) as f:
        assert f.read(8) == b"WARC/1.1"


def test_empty_table(spark):
    assert archived_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def archive():
    return page_record(1, "http://a", b"payload " * 50_000, None, False) + page_record(2, None, b"", 1, True)


def test_records_in_order():
    first, second = records_of(archive())
    assert first.payload == b"payload " * 50_000 and first.kind == "response"
    assert second.kind == "revisit" and second.headers["warc-refers-to"] == "<urn:x-page:1>"


def test_small_reads():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7))

    assert [r.payload_bytes for r in read_records(Slow(archive()))] == [400_000, 0]


@pytest.mark.parametrize(
    "spoil",
    [
        lambda d: d[:-9],
        lambda d: gzip.compress(gzip.decompress(d).replace(b"payload ", b"payloads", 1)),
        lambda d: gzip.compress(gzip.decompress(d).replace(b"Content-Length: 400", b"Content-Length: 399", 1)),
        lambda d: gzip.compress(gzip.decompress(d).replace(b"WARC/1.1", b"HTTP/1.1", 1)),
        lambda d: gzip.compress(gzip.decompress(d) + b"more"),
        lambda d: b"not gzip at all",
    ],
)
def test_spoiled_archives_are_refused(spoil):
    with pytest.raises(WarcError):
        records_of(spoil(page_record(1, "http://a", b"payload " * 50_000, None, False)))
