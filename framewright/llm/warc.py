"""WARC records in seekable Zstandard archives, and reading them back by frame.

Each task writes one archive: records are grouped into independent frames of about
``frame_bytes``, and a skippable frame at the end holds the seek table (the compressed and
plain size of every frame). The index gives for each record its archive, frame, and offset
inside the plain frame, so a record is read by decompressing one frame.

Of records with equal payloads the one with the smallest id is the response and the others
are revisits without payload, if the payload has ``least_bytes`` at least.

Archives are written through the file system that the folder's address names (a local or
shared path, or a store that pyarrow knows). A task that is run again writes a file of
another name; only files of finished tasks are in the index.

Defined results: a null payload is empty. Rows that repeat the smallest id are responses each.
A null id is written as ``null``; it revisits any other id of an equal payload. Control
characters and spaces in a url are percent-encoded in its header.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import materialise

# Of the seekable format and of the record headers.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ROW = pa.schema([("page_id", pa.int64()), ("archive", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                  ("refers_to", pa.int64()), ("payload", pa.binary())])
INDEX_DDL = "page_id long, archive string, frame int, offset long, length long"
READ_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _place(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", address))


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def records_of(plain: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records of a plain frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        yield at, headers, plain[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Archive:
    """An archive opened for reading: its seek table is read once, frames one by one."""

    def __init__(self, address: str):
        system, path = _place(address)
        self.file = system.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{address} has no seek table")
        sizes = list(struct.iter_unpack("<II", self.file.read_at(8 * n, size - 9 - 8 * n)))
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)


def read_record(archive: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index."""
    opened = Archive(archive)
    (_, headers, block), = records_of(opened.frame(frame)[offset : offset + length])
    opened.file.close()
    return headers, block


def _writer(folder: str, frame_bytes: int, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _place(folder)
        address = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
        out, frames, held, rows, size = None, [], [], [], 0

        def flush():
            nonlocal held, size
            packed = zstandard.ZstdCompressor(level=level).compress(b"".join(held))
            out.write(packed)
            frames.append((len(packed), size))
            held, size = [], 0

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    system.create_dir(top, recursive=True)
                    out = system.open_output_stream(_place(address)[1], compression=None)  # frames are compressed here
                digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                made = record(row["page_id"], row["url"], row["payload"], digest, row["refers_to"], row["revisit"])
                rows.append({"page_id": row["page_id"], "archive": address, "frame": len(frames), "offset": size, "length": len(made)})
                held.append(made)
                size += len(made)
                if size >= frame_bytes:
                    flush()
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, ROW)
                rows = []
        if out is not None:
            if held:
                flush()
            out.write(seek_table(frames))
            out.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ROW)

    return write


def written(pages: DataFrame, folder: str, payload: str = "html", least_bytes: int = 0, frame_bytes: int = 1 << 20, level: int = 3) -> DataFrame:
    """Write a record for each row of ``pages`` and return the index of all records."""
    raw = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"), F.sha1(raw).alias("sha"))
    narrow = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "sha")
    heads = narrow.groupBy("sha").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1 and head is not null")
    again = narrow.join(heads, "sha").where(~F.col("page_id").eqNullSafe(F.col("head"))).select(
        F.col("page_id").alias("again_id"), F.col("sha").alias("again_sha"), F.col("head").alias("refers_to")).distinct()
    again = materialise(again, "revisits")
    marked = rows.join(again, rows.page_id.eqNullSafe(F.col("again_id")) & (rows.sha == F.col("again_sha")), "left").select(
        "page_id", "url", "payload", "sha", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return materialise(marked.mapInArrow(_writer(folder, frame_bytes, level), INDEX_DDL), "index")


def _page(text: str) -> int | None:
    name = text.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives of an index; the digest is taken from the payload where there is one."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened = None, None
        for batch in batches:
            for archive, frame in zip(batch.column("archive").to_pylist(), batch.column("frame").to_pylist()):
                if archive != name:
                    name, opened = archive, Archive(archive)
                rows = []
                for _, headers, block in records_of(opened.frame(frame)):
                    http, _, body = block.partition(b"\r\n\r\n")
                    size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = headers["WARC-Type"] == "revisit"
                    if not revisit and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                        raise ValueError(f"{archive}: the payload of {headers['WARC-Record-ID']} is damaged")
                    rows.append({"page_id": _page(headers["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": headers["WARC-Type"],
                                 "refers_to": _page(headers["WARC-Refers-To"]) if revisit else None, "payload": None if revisit or not payloads else body})
                yield pa.RecordBatch.from_pylist(rows, READ)

    units = index.select("archive", "frame").distinct().repartition("archive", F.floor(F.col("frame") / 16)).sortWithinPartitions("archive", "frame")
    return units.mapInArrow(frames, READ_DDL)
