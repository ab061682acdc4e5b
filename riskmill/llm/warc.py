"""Web archives: records written as one gzip member each, and read back one after the other.

Writing: the page with the smallest identifier of those with equal payloads is a response, the others are revisits that
name it and repeat its headers without the payload. Each task fills archives of bounded size in the shared folder, under
names that no other attempt uses; only archives that a finished task reports are in the manifest, so a lost or repeated
task leaves nothing behind that is read.

Reading: a task streams an archive through an incremental decompressor, member by member. A record's head ends at the
first empty line, its content length frames the block, and the block and payload digests are verified.
Memory is bounded by one record.

Defined cases: a null html is an empty payload; a null url gives a record without a target; pages without an identifier
are responses; rows that repeat an identifier with the same payload are responses alike; an empty table gives an empty
manifest and no records; extra columns are ignored. A digest or length that doesn't fit is an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.session import materialize, new_folder

RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
)
ARCHIVE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    number = record.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: its head, an HTTP head that tells the payload's length, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=-._~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records below ``folder``; the written manifest (path, records, bytes)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id"), F.col("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Only repeated payloads are looked up, by their digests; a payload without a partner needs no answer.
    joined = rows.join(first.select("digest", "first"), "digest", "left")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    manifest_schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
            fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        out, name, records, size = None, "", 0, 0
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    page_id, url, data, refers_to = (batch.column(c)[i].as_py() for c in range(4))
                    if out is None:
                        name, records, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(name, compression=None)
                    packed = member(make_record(page_id, url, data, base32_sha1(data), refers_to))
                    out.write(packed)
                    records += 1
                    size += len(packed)
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        yield pa.RecordBatch.from_pydict(
                            {"path": [name], "records": [records], "bytes": [size]}, schema=manifest_schema)
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [records], "bytes": [size]}, schema=manifest_schema)

    written = joined.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(
        run, "path string, records long, bytes long"
    )
    return materialize(written, "manifest")


def members(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The decompressed members of a gzip stream, one at a time."""
    packer, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(chunk)
        rest = b""
        if not data:
            if parts or packer.unconsumed_tail:
                raise ValueError("archive ends inside a member")
            return
        parts.append(packer.decompress(data))
        if packer.eof:
            rest = packer.unused_data
            yield b"".join(parts)
            packer, parts = zlib.decompressobj(31), []


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; lengths and digests are verified."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not gap or not version.startswith("WARC/"):
        raise ValueError("not a record")
    headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
    length = int(headers["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError("content length does not frame the block")
    if headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    kind, size = headers["warc-type"], int(fields["Content-Length"])
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("payload digest or length differs")
    refers = headers.get("warc-refers-to")
    url = headers.get("warc-target-uri")
    return {
        "page_id": page_of(headers["warc-record-id"]), "url": None if url is None else unquote(url),
        "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": None if refers is None else page_of(refers),
        "html": payload.decode() if kind == "response" else None,
    }


def read_archives(manifest: DataFrame, with_html: bool = True) -> DataFrame:
    """A row per record of the manifest's archives, one archive after the other within a task."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("html", pa.string())][: 7 if with_html else 6])

    def run(batches):
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                held, size, seen = [], 0, 0
                with system.open_input_stream(name, compression=None) as stream:
                    for data in members(stream):
                        held.append(parse_record(data))
                        seen += 1
                        size += len(data)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if seen != expected:
                    raise ValueError(f"{path} has {seen} records, its manifest says {expected}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    # An archive is the unit of work.
    spread = manifest.select("path", "records").repartition("path")
    return spread.mapInArrow(run, RECORDS if with_html else RECORDS.removesuffix(", html string"))


def archive_folder(spark) -> str:
    return new_folder(spark, "warc")
