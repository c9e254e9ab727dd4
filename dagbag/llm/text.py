"""Vectorised text kernels over Arrow string buffers.

Every operator that reads words goes through :func:`words`.  A batch of texts
is one UTF-8 buffer plus offsets, so token borders and token hashes are numpy
passes over bytes; no Python string is made for a token.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes
of the case-folded text (``mode="word"``), or a maximal run of bytes above
0x20 of the text as it is (``mode="space"``).  Folding keeps every byte in its
place, so borders are byte offsets into the original text.  A null text has no
words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; eight-byte work arrays are this times eight.
CHUNK_BYTES = 3 << 20

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def _class(word: bool) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    if word:
        t[128:] = True
        for lo, hi in ((48, 58), (97, 123), (65, 91)):
            t[lo:hi] = True
    else:
        t[33:] = True
    return t


_CLASS = {"word": _class(True), "space": _class(False)}
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """B**0 .. B**(n-1) (or of its inverse) modulo 2**64."""
    key, base = ("i", _BINV) if inverse else ("p", _B)
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK_BYTES:
            _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; feed to :func:`range_hash`."""
    p = np.empty(len(data) + 1, dtype=np.uint64)
    p[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=p[1:])
    return p


def range_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for arrays of borders."""
    h = (p[end] - p[start]) * powers(len(p), inverse=True)[start]
    return mix(h + (end - start).astype(np.uint64) * _M2)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64 if large else np.int32)
    offs = offs[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    data = data[offs[0] : offs[-1]] if len(offs) else data
    return offs - (offs[0] if len(offs) else 0), data


def _lower_table() -> np.ndarray:
    """Lower case by code point, where it is one character of as many bytes."""
    table = np.arange(0x20000, dtype=np.uint32)
    for c in range(0x80, 0x20000):
        low = chr(c).lower()
        if len(low) == 1 and ord(low) != c and len(low.encode()) == len(chr(c).encode()):
            table[c] = ord(low)
    return table


_LOWER: list[np.ndarray] = []


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of all letters; every byte keeps its place.

    The few letters whose lower case has another number of bytes (a dotted capital
    I, the signs for kelvin, ohm and angstrom, a dozen of phonetic use) stay.
    """
    out = data.copy()
    np.add(out, 32, out=out, where=(data >= 65) & (data <= 90))
    lead = np.flatnonzero(data >= 0xC3)  # nothing below U+00C0 has a lower case
    if not len(lead):
        return out
    if not _LOWER:
        _LOWER.append(_lower_table())
    first = data[lead]
    for size, low, high in ((2, 0xC3, 0xDF), (3, 0xE1, 0xEF), (4, 0xF0, 0xF0)):
        at = lead[(first >= low) & (first <= high)]
        if not len(at):
            continue
        code = (data[at] & (0xFF >> (size + 1))).astype(np.uint32)
        for k in range(1, size):
            code = code << np.uint32(6) | (data[at + k] & 0x3F)
        new = np.where(code < 0x20000, _LOWER[0][np.minimum(code, 0x1FFFF)], code)
        changed = new != code
        at, new = at[changed], new[changed]
        for k in range(size - 1, 0, -1):
            out[at + k] = (new & 0x3F | 0x80).astype(np.uint8)
            new = new >> np.uint32(6)
        out[at] = (new | np.uint32(0xFF00 >> size & 0xFF)).astype(np.uint8)
    return out


def chars(data: np.ndarray) -> np.ndarray:
    """For each byte offset (and the end) the number of characters before it."""
    c = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=c[1:])
    return c


@dataclass
class Words:
    """Words of a batch; ``first[d]:first[d+1]`` are those of text d."""

    data: np.ndarray  # bytes that the borders refer to (folded in mode "word")
    doc: np.ndarray  # byte offset of each text, one more at the end
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def hashes(self) -> np.ndarray:
        return range_hash(prefix_hash(self.data), self.start, self.end)

    def owner(self) -> np.ndarray:
        """Number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: pa.Array, mode: str = "word") -> Words:
    doc, data = buffers(pc.fill_null(texts, ""))
    if mode == "word":
        data = fold(data)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _CLASS[mode][data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a run must not go on over the border of two texts
    cut = doc[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return Words(data, doc, np.searchsorted(start, doc), start, end)


def sum_by_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[d]:first[d+1]] for each d, 0 where there is none."""
    c = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def pieces(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """Cut Arrow batches so that one piece holds about ``limit`` bytes of text.

    A text longer than that is a piece of its own; no text is ever cut.
    """
    for b in batches:
        if not b.num_rows:
            continue
        i = b.schema.get_field_index(column)
        size = pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size)
        at = 0
        while at < b.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield b.slice(at, to - at)
            at = to


def splitmix(n: np.ndarray) -> np.ndarray:
    return mix(n.astype(np.uint64) * _B + _M1)
