"""Seekable Zstandard bundles of WARC records.

Records are grouped into frames that are compressed independently; a bundle is
a row of frames and, in a skippable frame at its end, the seek table: the
compressed and uncompressed size of every frame, their number and the magic
number of the seekable format.  A plain ``zstd -d`` reads a bundle; a reader
that wants one record reads the last nine bytes, the table and one frame.

Bundles are made where the pages are: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame

from dagbag.llm import frames

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
LEVEL = 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

SCHEMA = "bundle string, n_records bigint, n_frames bigint, raw_bytes bigint, content binary, records array<struct<page_id:bigint,url:string,frame:int,offset:bigint,length:bigint>>"
_ARROW = pa.schema([
    ("bundle", pa.string()), ("n_records", pa.int64()), ("n_frames", pa.int64()), ("raw_bytes", pa.int64()), ("content", pa.binary()),
    ("records", pa.list_(pa.struct([("page_id", pa.int64()), ("url", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))),
])


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A WARC 1.1 resource record; what is null is left out, null html is empty.

    The identifier is made from the content alone, so that a task that is run
    again writes the same bytes.
    """
    body = (html or "").encode()
    digest = hashlib.sha1(body).hexdigest()
    uid = uuid.UUID(hashlib.md5(f"{page_id}\0{url}\0{digest}".encode()).hexdigest())
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uid}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "%20" for c in url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", c, d) for c, d in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


class Bundle:
    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.out, self.buffer, self.sizes, self.records, self.raw = io.BytesIO(), bytearray(), [], [], 0

    def add(self, page_id, url, html) -> None:
        data = record(page_id, url, html)
        self.records.append({"page_id": page_id, "url": url, "frame": len(self.sizes), "offset": len(self.buffer), "length": len(data)})
        self.buffer += data
        self.raw += len(data)
        if len(self.buffer) >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.buffer:
            frame = self.packer.compress(bytes(self.buffer))
            self.sizes.append((len(frame), len(self.buffer)))
            self.out.write(frame)
            self.buffer = bytearray()

    def row(self) -> pa.RecordBatch:
        self.flush()
        self.out.write(seek_table(self.sizes))
        content = self.out.getvalue()
        name = hashlib.sha256(content).hexdigest()[:32]
        return pa.RecordBatch.from_pylist(
            [{"bundle": name, "n_records": len(self.records), "n_frames": len(self.sizes), "raw_bytes": self.raw, "content": content, "records": self.records}], schema=_ARROW
        )


def bundles(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a bundle: its bytes and the map from record ids to frame-relative
    offsets (``frame`` of the bundle, ``offset`` and ``length`` in the frame once
    uncompressed).

    A bundle ends when its records reach ``bundle_bytes``; a record is never
    split, so a very long one makes a long frame.  Null ids and urls are kept as
    null, null html is an empty body; repeated rows are records each; an empty
    table has no bundles; other columns are ignored.
    """
    rows = frames.inputs(pages, (id_col, "bigint"), (url_col, "string"), (html_col, "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Bundle(frame_bytes, level)
        for batch in batches:
            for i in range(batch.num_rows):
                b.add(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                if b.raw >= bundle_bytes:
                    yield b.row()
                    b = Bundle(frame_bytes, level)
        if b.records:
            yield b.row()

    return rows.mapInArrow(run, SCHEMA)


def frame_index(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, uncompressed size) of each frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entries = content[-9 - 8 * n : -9]
    out, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", entries, 8 * i)
        out.append((at, c, d))
        at += c
    return out


def read_record(content: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record; only its frame is decompressed."""
    start, size, raw = frame_index(content)[frame]
    data = zstandard.ZstdDecompressor().decompress(content[start : start + size], max_output_size=raw)
    return data[offset : offset + length]


def write_files(bundled: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as ``<bundle>.warc.zst`` to a folder that all executors
    reach: a path or a URL that Arrow's file systems know; gives (page_id, url, path, frame, offset, length).

    Names come from the content and a file appears by renaming, so a task that
    is run twice, or at once on two executors, leaves one whole file.
    """

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for b in batches:
            paths = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                path = f"{root.rstrip('/')}/{name}.warc.zst"
                part = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(content.as_buffer())
                store.move(part, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), b.column(2)], ["path", "records"])

    records = bundled.schema["records"].dataType.simpleString()
    done = bundled.select("bundle", "content", "records").mapInArrow(run, f"path string, records {records}")
    return done.selectExpr("path", "inline(records)").select("page_id", "url", "path", "frame", "offset", "length")
