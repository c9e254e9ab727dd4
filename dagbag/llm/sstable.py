"""Sorted-string-table shards of documents, keyed by identifier.

A shard is a run of blocks, a sparse index, a Bloom filter and a footer:

* block: entries ``shared, unshared, value length`` (varints), the unshared end
  of the key, the value; every ``RESTART`` entries the key is whole and its
  place is in the block's restart array.  Blocks are compressed one by one.
* index: the last key of each block with the block's place.
* Bloom filter: ``BLOOM_BITS`` bits a key, probed by double hashing.
* footer: places of index and filter, number of entries, magic number.

A lookup asks the filter, searches the index and then the block's restarts by
halving, and scans at most ``RESTART`` entries.  A key is one byte (0 for null,
else 1) and the identifier, big-endian with its sign flipped, so that byte order
is numeric order.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagbag.llm import frames
from dagbag.llm import text as tx

BLOCK_BYTES = 64 << 10
SHARD_BYTES = 32 << 20
RESTART = 16
BLOOM_BITS, PROBES = 10, 7
MAGIC = 0x31545353_47414244
_FOOTER = struct.Struct("<QQQQQQ")

SCHEMA = "shard string, first_id bigint, last_id bigint, n_entries bigint, n_blocks bigint, content binary"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = int(tx.mix(np.array([int.from_bytes(key, "big") & ((1 << 64) - 1)], np.uint64))[0])
    a, b = h & 0xFFFFFFFF, (h >> 32) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


def bloom(keys: list[bytes]) -> bytes:
    bits = max(64, len(keys) * BLOOM_BITS)
    h = tx.mix(np.array([int.from_bytes(k, "big") & ((1 << 64) - 1) for k in keys], np.uint64))
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    mask = np.zeros(-(-bits // 8) * 8, dtype=bool)
    for i in range(PROBES):
        mask[(a + np.uint64(i) * b) % np.uint64(bits)] = True
    return struct.pack("<Q", bits) + np.packbits(mask, bitorder="little").tobytes()


def value_of(text: str | None, lang: str | None, source: str | None) -> bytes:
    """Fields as a null flag or length (varint, plus one) and UTF-8 bytes."""
    out = []
    for x in (lang, source, text):
        raw = None if x is None else x.encode()
        out += [_varint(0)] if raw is None else [_varint(len(raw) + 1), raw]
    return b"".join(out)


def fields_of(value: bytes) -> dict[str, str | None]:
    out, at = {}, 0
    for name in ("lang", "source", "text"):
        n, at = _read_varint(value, at)
        out[name] = None if n == 0 else bytes(value[at : at + n - 1]).decode()
        at += max(0, n - 1)
    return out


class Writer:
    def __init__(self, block_bytes: int = BLOCK_BYTES, level: int = 1):
        self.block_bytes, self.packer = block_bytes, zstandard.ZstdCompressor(level=level)
        self.out, self.block, self.restarts, self.index, self.keys = bytearray(), bytearray(), [], [], []
        self.in_block, self.last, self.raw, self.ids = 0, b"", 0, []

    def add(self, doc_id: int | None, value: bytes) -> None:
        key, shared = key_of(doc_id), 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            top = min(len(key), len(self.last))
            while shared < top and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.in_block += 1
        self.last = key
        self.keys.append(key)
        self.ids.append(doc_id)
        self.raw += len(key) + len(value)
        if len(self.block) >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.in_block:
            self.block += b"".join(struct.pack("<I", r) for r in self.restarts) + struct.pack("<I", len(self.restarts))
            packed = self.packer.compress(bytes(self.block))
            self.index.append((self.last, len(self.out), len(packed)))
            self.out += packed
            self.block, self.restarts, self.in_block = bytearray(), [], 0

    def finish(self) -> bytes:
        self.flush()
        at = len(self.out)
        for key, start, size in self.index:
            self.out += _varint(len(key)) + key + _varint(start) + _varint(size)
        filter_at = len(self.out)
        self.out += bloom(self.keys)
        self.out += _FOOTER.pack(at, filter_at - at, filter_at, len(self.out) - filter_at, len(self.keys), MAGIC)
        return bytes(self.out)

    def row(self) -> pa.RecordBatch:
        content = self.finish()
        ids = [i for i in self.ids if i is not None]
        name = f"{self.keys[0].hex()}-{hashlib.sha256(content).hexdigest()[:16]}"
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([min(ids, default=None)], pa.int64()), pa.array([max(ids, default=None)], pa.int64()), pa.array([len(self.keys)]), pa.array([len(self.index)]), pa.array([content], pa.binary())],
            ["shard", "first_id", "last_id", "n_entries", "n_blocks", "content"],
        )


class Shard:
    """Reader of one shard's bytes."""

    def __init__(self, content: bytes):
        at, size, self.filter_at, _, self.n_entries, magic = _FOOTER.unpack(content[-_FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.content, self.last_keys, self.places, end = content, [], [], at + size
        while at < end:
            n, at = _read_varint(content, at)
            self.last_keys.append(content[at : at + n])
            start, at = _read_varint(content, at + n)
            length, at = _read_varint(content, at)
            self.places.append((start, length))
        self.bits = struct.unpack_from("<Q", content, self.filter_at)[0]

    def may_have(self, doc_id: int | None) -> bool:
        at = self.filter_at + 8
        return all(self.content[at + (p >> 3)] >> (p & 7) & 1 for p in _probes(key_of(doc_id), self.bits))

    def _block(self, i: int) -> bytes:
        start, size = self.places[i]
        return zstandard.ZstdDecompressor().decompress(self.content[start : start + size])

    @staticmethod
    def _entries(block: bytes, at: int, end: int, key: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
        while at < end:
            shared, at = _read_varint(block, at)
            rest, at = _read_varint(block, at)
            size, at = _read_varint(block, at)
            key = key[:shared] + block[at : at + rest]
            yield key, block[at + rest : at + rest + size]
            at += rest + size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.places)):
            block = self._block(i)
            n = struct.unpack("<I", block[-4:])[0]
            yield from self._entries(block, 0, len(block) - 4 - 4 * n)

    def get(self, doc_id: int | None) -> list[dict]:
        """All values of an identifier, in the order of the shard."""
        key, out = key_of(doc_id), []
        if not self.may_have(doc_id):
            return out
        for i in range(bisect_left(self.last_keys, key), len(self.places)):
            block = self._block(i)
            n = struct.unpack("<I", block[-4:])[0]
            end = len(block) - 4 - 4 * n
            restarts = struct.unpack_from(f"<{n}I", block, end)
            first = bisect_left(restarts, key, key=lambda r: next(self._entries(block, r, end))[0])
            for k, v in self._entries(block, restarts[max(0, first - 1)], end):
                if k == key:
                    out.append(fields_of(v))
                elif k > key:
                    return out
        return out


def shards(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a shard; shards' ranges of identifiers follow each other and meet only
    where the rows of one identifier fill several shards.

    The documents are range-partitioned by identifier once and sorted where they
    land; a partition makes a shard for every ``shard_bytes``.  Null identifiers
    sort first.  Rows of the same identifier are all kept, sorted by the other
    columns.  Null fields come back null, empty texts empty; a very long text is
    one long entry.  An empty table has no shards.  Other columns are ignored.
    """
    rows = frames.inputs(docs, (id_col, "bigint"), (lang_col, "string"), (source_col, "string"), (text_col, "string")).toDF("id", "lang", "source", "text")
    # all columns and a number count for the ranges, so that very many rows of one id, or equal ones, are several partitions
    order = ["id", "lang", "source", "h", "no"]
    rows = rows.withColumns({"h": F.xxhash64("text"), "no": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("id", "lang", "source", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Writer(block_bytes)
        for b in batches:
            for i, lang, source, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                w.add(i, value_of(text, lang, source))
                if w.raw >= shard_bytes:
                    yield w.row()
                    w = Writer(block_bytes)
        if w.keys:
            yield w.row()

    return rows.mapInArrow(run, SCHEMA)


def lookup(table: DataFrame, ids: list[int]) -> DataFrame:
    """(doc_id, lang, source, text) of some identifiers.

    The ranges in the table's columns leave out all shards that can't hold one.
    """
    wanted = sorted(set(ids))
    cond = F.lit(False)
    for i in wanted:
        cond = cond | F.col("first_id").isNotNull() & (F.col("first_id") <= i) & (F.col("last_id") >= i)

    def run(batches):
        for b in batches:
            rows = [{"doc_id": i, **v} for c in b.column(0) for s in [Shard(c.as_py())] for i in wanted for v in s.get(i)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), *((n, pa.string()) for n in ("lang", "source", "text"))]))

    return table.filter(cond).select("content").mapInArrow(run, "doc_id bigint, lang string, source string, text string")
