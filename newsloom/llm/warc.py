"""WARC archives: writing pages, and a sequential reader.

Writing: every task writes archives of its own, one gzip member per record, and rolls over to the next archive at
ROLL_BYTES. An archive is written under a temporary name and moved into place whole, under a name that depends on
the task's partition only, so a task that runs again replaces what it wrote before. Of records with equal payloads
of ``min_bytes`` and more, that with the smallest page_id is a response and the others revisit it.

Reading: an archive is read once, in chunks. A member is inflated incrementally; its record is framed by its
Content-Length, must end with the member, and its block and payload digests are verified as the bytes pass. Memory
is bounded by a chunk and, where payloads are asked for, one record.

Null html is an empty payload. Null urls: no target address. Null ids count after all others; a group without any
id is all response, and so are records that share the smallest id. Repeated rows are records of their own. Columns
other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.tables import small_batches, stored
from newsloom.session import scratch_path, shared_files

ROLL_BYTES = 256 << 20
CHUNK = 1 << 16
DATE = "1970-01-01T00:00:00Z"  # the tables say nothing of when a page was fetched
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that is cut off, badly framed, or whose digests do not match."""


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def _clean(url: str) -> str:
    """An address on one line, in ASCII."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def record_bytes(kind: str, name: str, fields: list[tuple[str, str]], block: bytes, content_type: str) -> bytes:
    """One record as one gzip member."""
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", name),
        ("WARC-Date", DATE),
        *fields,
        ("WARC-Block-Digest", "sha1:" + digest_text(hashlib.sha1(block, usedforsecurity=False).digest())),
        ("Content-Type", content_type),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode()) + packer.compress(block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", _clean(url))] if url else []
    fields.append(("WARC-Payload-Digest", "sha1:" + digest_text(hashlib.sha1(payload, usedforsecurity=False).digest())))
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _name(first))]
    kind = "revisit" if revisit else "response"
    return record_bytes(
        kind, _name(page_id), fields, http if revisit else http + payload, "application/http;msgtype=response"
    )


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int  # of the full payload; of a revisit, as its response's header gives it
    payload: bytes | None


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        key, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"no header field: {line[:60]!r}")
        out[key.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


class _Member:
    """The inflated bytes of one gzip member."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.unpacker, self.waiting, self.buffer = stream, zlib.decompressobj(31), rest, b""

    def more(self) -> bool:
        """Inflates the next chunk into the buffer; False at the member's end."""
        while not self.unpacker.eof:
            packed = self.waiting or self.stream.read(CHUNK)
            if not packed:
                raise WarcError("archive ends within a member")
            try:
                got = self.unpacker.decompress(packed, CHUNK)
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            self.waiting = self.unpacker.unconsumed_tail
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes, limit: int = 1 << 20) -> bytes:
        while (at := self.buffer.find(mark)) < 0:
            if len(self.buffer) > limit or not self.more():
                raise WarcError("header without end")
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise WarcError("record is shorter than its Content-Length")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            yield part

    def rest(self) -> bytes:
        while self.more():
            if len(self.buffer) > 4:
                break
        return self.buffer


def read_records(stream, payloads: bool = False) -> Iterator[Record]:
    """The records of an archive in order, verified; ``stream`` needs ``read(n)`` only."""
    rest = stream.read(CHUNK)
    while rest:
        member = _Member(stream, rest)
        version, *lines = member.until(b"\r\n\r\n").split(b"\r\n")
        if not version.startswith(b"WARC/1."):
            raise WarcError(f"not a WARC record: {version[:40]!r}")
        headers = _fields(lines)
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("record without Content-Length") from e
        kind = headers.get("warc-type", "")
        whole, own = hashlib.sha1(usedforsecurity=False), hashlib.sha1(usedforsecurity=False)
        http: dict[str, str] = {}
        head, kept, size = b"" if kind in ("response", "revisit") else None, [], 0
        for part in member.take(length):
            whole.update(part)
            if head is not None:
                head += part
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                http = _fields(head[:at].split(b"\r\n")[1:])
                part, head = head[at + 4 :], None
            own.update(part)
            size += len(part)
            if payloads:
                kept.append(part)
        if head is not None and length:
            raise WarcError("HTTP header without end")
        if member.rest() != b"\r\n\r\n":
            raise WarcError("record does not end with its member")
        for name, found in (("warc-block-digest", whole), ("warc-payload-digest", own)):
            said = headers.get(name)
            if said and not (kind == "revisit" and name == "warc-payload-digest"):
                if said.removeprefix("sha1:") != digest_text(found.digest()):
                    raise WarcError(f"{name} does not match")
        if kind == "response" and "content-length" in http and int(http["content-length"]) != size:
            raise WarcError("payload is not as long as its header says")
        full = int(http.get("content-length", size)) if kind == "revisit" else size
        yield Record(kind, headers, http, full, b"".join(kept) if payloads else None)
        rest = member.unpacker.unused_data or stream.read(CHUNK)


def _write_archives(folder: str, roll: int):
    def step(batches):
        system, base = shared_files(folder)
        system.create_dir(base, recursive=True)
        part, turn, written, records = TaskContext.get().partitionId(), uuid.uuid4().hex, [], 0
        sink, temporary, size = None, "", 0

        def finish():
            nonlocal sink
            sink.close()
            name = f"{base}/pages-{part:06d}-{len(written):04d}.warc.gz"
            system.move(temporary, name)
            written.append((name, records))
            sink = None

        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    temporary, records = f"{base}/.{part:06d}-{len(written):04d}-{turn}", 0
                    sink = system.open_output_stream(temporary, compression=None)
                    size = sink.write(
                        record_bytes("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(part))}>", [],
                                     b"format: WARC File Format 1.1\r\n", "application/warc-fields")
                    ) or 0
                packed = page_record(
                    row["page_id"], row["url"], (row["html"] or "").encode("utf-8", "surrogatepass"),
                    row["first_id"], row["revisit"],
                )
                sink.write(packed)
                size += len(packed)
                records += 1
                if size >= roll:
                    finish()
        if sink is not None:
            finish()
        yield pa.record_batch(
            [pa.array([w[0] for w in written], pa.string()), pa.array([w[1] for w in written], pa.int64())],
            names=["path", "records"],
        )

    return step


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, roll: int = ROLL_BYTES) -> DataFrame:
    """Writes the pages to archives in ``folder``, which all executors reach; ``(path, records)`` of each."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        "html",
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).alias("size"),
    )
    first = keyed.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    typed = keyed.join(first, "digest", "left").select(
        "page_id",
        "url",
        "html",
        "first_id",
        (F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit"),
    )
    return stored(small_batches(typed).mapInArrow(_write_archives(folder, roll), "path string, records long"), "archives")


def _read_archives(folder: str, payloads: bool):
    def step(batches):
        system, _ = shared_files(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out: list[tuple] = []
                held = 0

                def made():
                    columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
                    return pa.record_batch(
                        [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names
                    )

                with system.open_input_stream(path, compression=None, buffer_size=CHUNK) as stream:
                    for record in read_records(stream, payloads):
                        if record.kind not in ("response", "revisit"):
                            continue
                        out.append(
                            (
                                _page_of(record.headers["warc-record-id"]),
                                record.payload_bytes,
                                record.headers["warc-payload-digest"].removeprefix("sha1:"),
                                record.kind,
                                _page_of(record.headers.get("warc-refers-to")),
                                record.headers.get("warc-target-uri"),
                                record.payload,
                            )
                        )
                        held += len(record.payload or b"")
                        if len(out) == 4096 or held > (8 << 20):
                            yield made()
                            out, held = [], 0
                yield made()

    return step


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of ``(path, ...)``: ``(page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    payload)``; payload is null for revisits' and where it is not asked for."""
    return (
        archives.select("path")
        # as many tasks as archives: rows of paths are too few for the adaptive plan to keep them apart
        .repartitionByRange(max(archives.count(), 1), "path")
        .mapInArrow(
            _read_archives(folder, payloads),
            "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
            "payload binary",
        )
    )


def archived_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    archives = write_archives(pages, folder, min_bytes)
    return read_archives(archives, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def records_of(data: bytes, payloads: bool = True) -> list[Record]:
    """The records of an archive held in memory."""
    return list(read_records(io.BytesIO(data), payloads))
