"""WARC bundles of independent Zstandard frames with a seek table.

A bundle is a file of frames, each with the WARC records of about
`FRAME_BYTES`, and a skippable frame at its end that lists the frames' sizes
(the public seekable format). The index maps a record to its file, frame, and
offset and length within the frame, so a record is read by decompressing one
frame.

Records with equal payloads: the one with the smallest page_id is the
response, others are revisits that refer to it and carry no body.

Tasks write files under names of their own attempt, and the index, written
once by Spark, names only files of attempts that succeeded; a lost executor's
half-written files are never read.

Nulls and others: a null html is an empty payload; a null url becomes an empty
target; null ids come after all others (they revisit an equal payload with an
id, and are responses else); rows that repeat id and payload are of one type;
empty tables give no bundles and an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 256 << 20
#: Fixed values of the seekable format: a skippable frame's magic, the footer's magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, file string, frame int, start int, size int"


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1, built from hex: five bytes make eight letters."""
    hexed = F.sha1(payload)
    parts = [F.translate(F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for i in (1, 11, 21, 31)]
    return F.concat(*parts)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record; `first` is the page_id of the response that this one revisits, or None."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first, digest)}", f"X-Refers-To-Page-ID: {first}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, dict[str, str]]:
    """WARC headers, payload and HTTP headers of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, payload, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])


class BundleWriter:
    """Frames of records, then the seek table."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.filled, self.written = [], 0, 0

    def add(self, raw: bytes) -> tuple[int, int, int]:
        """Frame, offset within it, and length."""
        if self.filled and self.filled + len(raw) > FRAME_BYTES:
            self.flush()
        at = (len(self.frames), self.filled, len(raw))
        self.buffer.append(raw)
        self.filled += len(raw)
        return at

    def flush(self) -> None:
        if self.filled:
            packed = self.zstd.compress(b"".join(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), self.filled))
            self.written += len(packed)
            self.buffer, self.filled = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads frames by the seek table."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        end = source.seek(0, io.SEEK_END) or source.tell()
        source.seek(end - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        source.seek(end - 9 - 8 * count)
        sizes = struct.unpack(f"<{2 * count}I", source.read(8 * count))
        self.at, offset = [], 0
        for packed, plain in zip(sizes[::2], sizes[1::2], strict=True):
            self.at.append((offset, packed, plain))
            offset += packed
        self.now, self.data = -1, b""

    def record(self, frame: int, start: int, size: int) -> bytes:
        if frame != self.now:
            offset, packed, plain = self.at[frame]
            self.source.seek(offset)
            self.data, self.now = self.zstd.decompress(self.source.read(packed), max_output_size=plain), frame
        return self.data[start : start + size]


def decide(pages: DataFrame, scratch: Scratch, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, digest, first: the smallest id among equal payloads, one row for each id and payload."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    light = scratch.table(pages.select(F.col(key).alias("page_id"), payload_digest(payload).alias("digest")).distinct(), "digests")
    first = scratch.table(light.groupBy("digest").agg(F.min("page_id").alias("first")), "first")
    return light.join(first, "digest")


def write_bundles(pages: DataFrame, folder: str, scratch: Scratch, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes bundles into the folder; returns the index, a written table."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("url"), payload.alias("payload"), payload_digest(payload).alias("d"))
    told = decide(pages, scratch, key=key, html=html)
    rows = rows.join(told, rows["k"].eqNullSafe(told["page_id"]) & (rows["d"] == told["digest"])).select("k", "url", "payload", "digest", "first")

    def write(stream):
        place, base = pafs.FileSystem.from_uri(folder)
        place.create_dir(base, recursive=True)
        task = TaskContext.get()
        writer, name, files = None, None, 0
        for batch in stream:
            out = []
            for k, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files}.warc.zst"
                    writer, files = BundleWriter(place.open_output_stream(f"{base}/{name}", compression=None)), files + 1
                out.append((k, name, *writer.add(record(k, url, payload, digest, None if first is None or first == k else first))))
                if writer.written > BUNDLE_BYTES:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["page_id", "file", "frame", "start", "size"])
        if writer:
            writer.close()

    return scratch.table(rows.mapInArrow(write, INDEX), "index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read from the bundles.

    A response's length and digest are taken from its payload; a revisit has
    no payload, so its headers tell them.
    """

    def read(stream):
        place, base = pafs.FileSystem.from_uri(folder)
        name, reader = None, None
        for batch in stream:
            out = []
            for file, frame, start, size in zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "start", "size")), strict=True):
                if file != name:
                    name, reader = file, BundleReader(place.open_input_file(f"{base}/{file}"))
                headers, payload, http = parse(reader.record(frame, start, size))
                told = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                number = lambda x: int(x) if x else None
                if headers["WARC-Type"] == "response":
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if digest != told:
                        raise ValueError(f"{file}: a payload's digest is {digest}, its header says {told}")
                    out.append((number(headers["X-Page-ID"]), len(payload), digest, "response", None))
                else:
                    out.append((number(headers["X-Page-ID"]), int(http["Content-Length"]), told, "revisit", number(headers["X-Refers-To-Page-ID"])))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def bundle_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.root}/bundles"
    return read_records(write_bundles(pages, folder, scratch), folder)
