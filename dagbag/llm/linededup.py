"""Line dedup by a segment-partition edit join.

A line goes if an earlier line (by document id, text, line number) is equal to it
or within few character edits: ``EDITS`` at most, and one for ``PER_EDIT`` characters
of the shorter line.  Two lines within t edits share one of t + 1 segments into which
one of them is cut, at nearly the same place; so every
line is indexed by its segments, under its length, and probes with the few
substrings that can match a segment of a line as long as it or up to t shorter
(the multi-match-aware selection: 12 substrings for 2 edits).  Lines that share
a key are verified: letter counts first, then a banded bit-parallel edit distance
that runs over all pairs at once and gives up on a pair when it exceeds t.

A segment that very many lines share (a template with a number in it) is no key to
compare all of them under.  Of the match that the selection promises it is known how
many edits are left of it and right of it; so lines under such a key are keyed anew,
by segments of what is left of the key or right of it, and so on until keys are rare
(:func:`split`).  No link is lost, and no task gets a group of unbounded size.

Shuffled are: a number of 16 bytes for each key, in blocks by bucket; one small
row a line; and the text of those lines only that share a key with another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagbag.llm import frames
from dagbag.llm import text as tx

EDITS, PER_EDIT = 2, 8
#: Numbers of candidate lines (8 bytes each) up to which they are broadcast.
BROADCAST_LINES = 2_000_000
#: Keys of a block (16 bytes each), of which a bucket has a quarter, at least; both grow
#: with the root of the number of keys, so that a row of a block and bucket has ``ROW_KEYS``.
FLUSH, ROW_KEYS, KEYS_PER_LINE = 1 << 20, 64, 12
#: Lines under one key above which they are keyed anew; how often at most.
HOT, ROUNDS = 4096, 7
#: Lines under one key of one block from which on the key is counted over all blocks.
HEAVY = 64
BINS = 32
_ONE = np.uint64(1)


class Lines:
    """Lines of a batch of texts that hold more than white space."""

    def __init__(self, texts: pa.Array):
        offs, data = tx.buffers(pc.fill_null(texts, ""))
        self.codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        offs = tx.chars(data)[offs]
        breaks = np.flatnonzero(self.codes == 10)
        start = np.sort(np.concatenate([offs[:-1], breaks + 1]))
        end = np.sort(np.concatenate([breaks, offs[1:]]))
        # borders of texts and breaks pair up in order, an empty text has one line
        first = np.arange(len(offs)) + np.searchsorted(breaks, offs)
        owner = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        number = np.arange(len(start)) - first[owner]
        black = np.concatenate([[0], np.cumsum(self.codes > 32)])
        ok = black[end] > black[start]
        self.start, self.end, self.owner, self.number = start[ok], end[ok], owner[ok], number[ok]
        self.size = self.end - self.start
        self.prefix = tx.prefix_hash(self.codes)
        self.hash = tx.range_hash(self.prefix, self.start, self.end)


def segments(size: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of the edits + 1 nearly equal segments of lines of each size."""
    k = edits + 1
    short, longer = size // k, size % k
    return [(i * short + np.maximum(0, i - (k - longer)), short + (i >= k - longer)) for i in range(k)]


def allowed(shorter: np.ndarray, edits: int, per_edit: int) -> np.ndarray:
    """Edits that two lines may be apart, by the length of the shorter one."""
    return np.minimum(edits, shorter // per_edit)


def substrings(x: Lines, once: np.ndarray, edits: int, per_edit: int) -> Iterator[tuple]:
    """(lines, edits, length of the indexed line, segment, its start there and length,
    start here, role) of all index (3, which probe, too) and probe (2) substrings."""
    size = x.size[once]
    for t in range(1, edits + 1):
        for delta in range(t + 1):
            other = size - delta  # length of the shorter line, which is indexed
            may = np.flatnonzero(allowed(other, edits, per_edit) == t)
            if not len(may):
                continue
            for i, (at, length) in enumerate(segments(other[may], t)):
                low = max(-i, delta - (t - i))
                high = min(i, delta + (t - i))
                for shift in range(low, high + 1):
                    ok = (at + shift >= 0) & (at + shift + length <= size[may])
                    yield once[may[ok]], t, other[may[ok]], i, at[ok], length[ok], at[ok] + shift, 3 if delta == 0 and shift == 0 else 2


def _key(x: Lines, line: np.ndarray, other: np.ndarray, i: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    a = x.start[line] + at
    h = tx.range_hash(x.prefix, a, a + length)
    return tx.splitmix(h + other.astype(np.uint64) * np.uint64(64) + np.uint64(i)) & ~np.uint64(3)


def entries(x: Lines, edits: int = EDITS, per_edit: int = PER_EDIT) -> tuple[np.ndarray, np.ndarray]:
    """(key, line hash): the lowest two bits of a key say index (1) and probe (2)."""
    keys, lines = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    _, once = np.unique(x.hash, return_index=True)
    for line, _, other, i, _, length, at, role in substrings(x, once, edits, per_edit):
        keys.append(_key(x, line, other, i, at, length) | np.uint64(role))
        lines.append(x.hash[line])
    return np.concatenate(keys), np.concatenate(lines)


#: What of a line isn't matched yet: slots of (start, end, length in the indexed line, edits).
SLOTS = ROUNDS + 1


def first_slots(x: Lines, key: np.ndarray, edits: int, per_edit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, role, slots) of the lines of x (one a row) whose substrings have the row's key."""
    rows, roles, slots = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((0, SLOTS, 4), np.int32)]
    every = np.arange(len(x.size))
    for line, t, other, i, there, length, at, role in substrings(x, every, edits, per_edit):
        mine = _key(x, line, other, i, at, length) >> np.uint64(2) == key[line]
        line, other, there, length, at = (v[mine] for v in (line, other, there, length, at))
        new = np.zeros((len(line), SLOTS, 4), np.int32)
        new[:, 0] = np.stack([np.zeros(len(line), np.int64), at, there, np.full(len(line), i)], axis=1)
        new[:, 1] = np.stack([at + length, x.size[line], other - there - length, np.full(len(line), t - i)], axis=1)
        rows.append(line)
        roles.append(np.full(len(line), role))
        slots.append(new)
    return np.concatenate(rows), np.concatenate(roles), np.concatenate(slots)


def split(x: Lines, row: np.ndarray, key: np.ndarray, role: np.ndarray, slots: np.ndarray):
    """Keys below those of lines: (row, key, role, slots, final).

    The slot with the longest segments is cut; all lines under a key have the same
    slots but for starts and ends.  Lines that have no slot to cut stay as they are,
    ``final``.
    """
    n, t = slots[:, :, 2], slots[:, :, 3]
    worth = np.where(n > t, n / (t + 1), 0.0)
    which = worth.argmax(axis=1)
    here = np.arange(len(row))
    go = worth[here, which] > 0
    out = [(row[~go], key[~go], role[~go], slots[~go], np.ones((~go).sum(), bool))]
    row, key, role, slots, which = row[go], key[go], role[go], slots[go], which[go]
    lo, hi, n, t = slots[np.arange(len(row)), which].T.astype(np.int64)
    free = np.argmin(np.where(np.arange(SLOTS) == which[:, None], 1, slots[:, :, 2]), axis=1)  # an empty slot
    delta = hi - lo - n
    for k in np.unique(t).tolist():
        at_k = np.flatnonzero(t == k)
        for i, (at, length) in enumerate(segments(n[at_k], k)):
            d = delta[at_k]
            for shift in range(-min(i, k), min(i, k) + 1):
                ok = (shift >= d - (k - i)) & (shift <= d + (k - i)) & (at + shift >= 0) & (at + shift + length <= (hi - lo)[at_k])
                r, a, size, there = at_k[ok], at[ok] + shift, length[ok], at[ok]
                begin = x.start[row[r]] + lo[r] + a
                h = tx.range_hash(x.prefix, begin, begin + size)
                new = slots[r].copy()
                pick = np.arange(len(r))
                new[pick, which[r]] = np.stack([lo[r], lo[r] + a, there, np.full(len(r), i)], axis=1)
                new[pick, free[r]] = np.stack([lo[r] + a + size, hi[r], n[r] - there - size, np.full(len(r), k - i)], axis=1)
                same = (role[r] == 3) & (shift == 0)
                out.append((row[r], tx.splitmix(key[r] + tx.splitmix(h + np.uint64(8 * i + 1)) + which[r].astype(np.uint64)), np.where(same, 3, 2), new, np.zeros(len(r), bool)))
    return tuple(np.concatenate(c) for c in zip(*out))


def shared_keys(key: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Places (one for each line and role) under keys that two lines share, one
    of them by a segment."""
    bare = key >> np.uint64(2)
    order = np.lexsort((key & np.uint64(3), line, bare))
    k, l, r = bare[order], line[order], key[order] & np.uint64(3)
    # of the same line under the same key the strongest role stays (it comes last)
    last = np.append((k[1:] != k[:-1]) | (l[1:] != l[:-1]), True) if len(k) else np.empty(0, bool)
    order, k, r = order[last], k[last], r[last]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    size = np.diff(np.append(head, len(k)))
    if not len(head):
        return order
    ok = (size > 1) & (np.add.reduceat((r & _ONE).astype(np.int64), head) > 0)
    return order[np.repeat(ok, size)]


def bounded_distance(codes: np.ndarray, s1: np.ndarray, n1: np.ndarray, s2: np.ndarray, n2: np.ndarray, limit: int) -> np.ndarray:
    """Edit distances of codes[s1:s1+n1] and codes[s2:s2+n2]; above ``limit`` limit + 1.

    Banded bit-vectors: at column i the highest bit stands for row i + limit, so
    the band moves down with the diagonal and one word holds it.  Lengths must
    differ by at most ``limit`` and exceed it.
    """
    out = np.full(len(s1), limit + 1, np.int64)
    live = np.arange(len(s1))
    score = np.full(len(s1), limit, np.int64)
    vp = np.full(len(s1), (~0 << (63 - limit)) & ((1 << 64) - 1), np.uint64)
    vn = np.zeros(len(s1), np.uint64)
    last = len(codes) - 1
    for i in range(int(n2.max(initial=0))):
        a, m, b = s1[live], n1[live], s2[live]
        c = codes[b + i]
        pm = np.zeros(len(live), np.uint64)
        for down in range(2 * limit + 1):
            row = i + limit - down
            if row >= 0:
                hit = (codes[np.minimum(a + row, last)] == c) & (row < m)
                pm |= hit.astype(np.uint64) << np.uint64(63 - down)
        d0 = (((pm & vp) + vp) ^ vp) | pm | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        bottom = i - (m - limit)  # columns since the band met the last row
        bit = np.uint64(1) << (62 - np.maximum(bottom, 0)).astype(np.uint64)
        score += np.where(bottom < 0, (d0 >> np.uint64(63)) == 0, (hp & bit != 0).astype(np.int64) - (hn & bit != 0))
        half = d0 >> _ONE
        vp, vn = hn | ~(half | hp), half & hp
        over = n2[live] == i + 1
        out[live[over]] = np.minimum(score[over], limit + 1)
        go = ~over & (score <= 2 * limit + n2[live] - m)
        if not go.all():
            live, score, vp, vn = live[go], score[go], vp[go], vn[go]
            if not len(live):
                break
    return out


def near(codes: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, edits: int, per_edit: int, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(pair, edits) of those pairs (a, b) of lines that are near."""
    if count is None:
        count = letter_counts(codes, start, size)
    limit = allowed(np.minimum(size[a], size[b]), edits, per_edit)
    ok = (np.abs(size[a] - size[b]) <= limit) & (np.abs(count[a] - count[b]).sum(1) <= 2 * limit)
    at = np.flatnonzero(ok)
    d = bounded_distance(codes, start[a[at]], size[a[at]], start[b[at]], size[b[at]], edits)
    ok = d <= limit[at]
    return at[ok], d[ok]


def letter_counts(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(start)), size)
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(owner))
    return np.bincount(owner * BINS + codes[at] % BINS, minlength=len(start) * BINS).reshape(-1, BINS).astype(np.int32)


def _lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = frames.col(docs, text_col).cast("string")
    return docs.select(frames.col(docs, id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _occurrences(rows: DataFrame) -> DataFrame:
    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        x = Lines(b.column(2))
        own = pa.array(x.owner)
        return pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(x.number.astype(np.int32)), pa.array(x.hash.view(np.int64))], ["doc_id", "th", "line", "h"])

    return frames.with_text(rows, make, "doc_id bigint, th bigint, line int, h bigint")


def plan(lines: int, flush: int = FLUSH) -> tuple[int, int]:
    """(keys of a block, buckets) for so many lines."""
    keys = KEYS_PER_LINE * lines
    bucket = max(flush // 4, math.ceil(math.sqrt(ROW_KEYS / 2 * keys)))
    return max(flush, 2 * bucket), max(1, math.ceil(keys / bucket))


def _blocks(rows: DataFrame, edits: int, per_edit: int, flush: int, buckets: int, heavy: int) -> DataFrame:
    """(bucket, keys, lines) of blocks; bucket -1 has keys of many lines in a block and how many."""

    def blocks(keys: list[np.ndarray], lines: list[np.ndarray]) -> pa.RecordBatch:
        key, line = np.concatenate(keys), np.concatenate(lines)
        bucket = (key >> np.uint64(32)) % np.uint64(buckets)
        order = np.lexsort((key, bucket))
        key, line, bucket = key[order], line[order], bucket[order]
        bare = key >> np.uint64(2)
        heads = np.flatnonzero(np.append(True, bare[1:] != bare[:-1]))
        size = np.diff(np.append(heads, len(key)))
        many = size >= heavy
        heads_b = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(heads_b[1:], len(key))
        raw = lambda x: [x[s:e].tobytes() for s, e in zip(heads_b, ends)]
        often = [[bare[heads[many]].tobytes()], [size[many].astype(np.uint64).tobytes()]] if many.any() else [[], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(bucket[heads_b].astype(np.int32), np.full(len(often[0]), -1, np.int32))), pa.array(raw(key) + often[0], pa.binary()), pa.array(raw(line) + often[1], pa.binary())],
            ["bucket", "keys", "lines"],
        )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lines, n = [], [], 0
        for piece in tx.pieces(batches):
            k, l = entries(Lines(piece.column(0)), edits, per_edit)
            keys.append(k)
            lines.append(l)
            n += len(k)
            if n >= flush:
                yield blocks(keys, lines)
                keys, lines, n = [], [], 0
        if n:
            yield blocks(keys, lines)

    return rows.select("text").mapInArrow(spread, "bucket int, keys binary, lines binary")


def _numbers(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.uint64)


_SHARED = "key bigint, h bigint, role int, many boolean"


def _shared_rows(k: np.ndarray, h: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array((k >> np.uint64(2)).view(np.int64)), pa.array(h.view(np.int64)), pa.array((k & np.uint64(3)).astype(np.int32)), pa.array(many)], ["key", "h", "role", "many"])


def _shared(blocked: DataFrame, most: int, hot: int) -> DataFrame:
    """(key, h, role, many) of lines that share a key; many: that more than ``hot`` have.

    Keys of more than about ``most`` lines don't go to a bucket at all.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(_numbers(k).view(np.int64)), pa.array(_numbers(n).view(np.int64))], ["key", "n"])

    often = blocked.filter("bucket < 0").select("keys", "lines").mapInArrow(counted, "key bigint, n bigint")
    often = often.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("key").toArrow()["key"]  # at most keys / most
    sc = blocked.sparkSession.sparkContext
    shared = sc.broadcast(np.sort(often.to_numpy().view(np.uint64))) if len(often) else None

    def parted(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, k, l in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                k, l = _numbers(k), _numbers(l)
                it = _among(k >> np.uint64(2), shared.value)
                if keep and it.any():
                    yield _shared_rows(k[it], l[it], np.ones(it.sum(), bool))
                elif not keep and not it.all():
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([k[~it].tobytes()], pa.binary()), pa.array([l[~it].tobytes()], pa.binary())], ["bucket", "keys", "lines"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lines, bucket = [], [], None

        def found() -> pa.RecordBatch:
            k, l = np.concatenate(keys), np.concatenate(lines)
            at = shared_keys(k, l)
            _, which, size = np.unique(k[at] >> np.uint64(2), return_inverse=True, return_counts=True)
            return _shared_rows(k[at], l[at], size[which] > hot)

        for b in batches:
            for own, k, l in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if own != bucket and keys:
                    yield found()
                    keys, lines = [], []
                bucket = own
                keys.append(_numbers(k))
                lines.append(_numbers(l))
        if keys:
            yield found()

    plain = blocked.filter("bucket >= 0")
    rest = plain if shared is None else plain.mapInArrow(lambda b: parted(b, False), "bucket int, keys binary, lines binary")
    out = rest.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(match, _SHARED)
    return out if shared is None else out.unionAll(plain.mapInArrow(lambda b: parted(b, True), _SHARED).distinct())


def _texts(rows: DataFrame, wanted: DataFrame, broadcast_lines: int) -> DataFrame:
    """(h, text) of the lines of which ``wanted`` (h) has the hash.

    Few wanted hashes go to every executor; more are joined.
    """
    few = wanted.count() <= broadcast_lines
    shared = None
    if few:
        shared = wanted.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow()["h"].to_numpy()))

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        x = Lines(b.column(0))
        h, at = np.unique(x.hash.view(np.int64), return_index=True)
        if shared is not None:
            ok = np.isin(h, shared.value, assume_unique=True) if len(h) > len(shared.value) else _among(h, shared.value)
            h, at = h[ok], at[ok]
        raw = x.codes
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array([raw[s:e].tobytes().decode("utf-32-le") for s, e in zip(x.start[at], x.end[at])], pa.string())], ["h", "line"])

    lines = frames.with_text(rows.select("text"), make, "h bigint, line string")
    if not few:
        lines = lines.join(wanted, "h", "left_semi")
    # pieces repeat lines
    return lines.groupBy("h").agg(F.min("line").alias("line"))


def _among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(h), bool)
    return ordered[np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)] == h


_SPLIT = "key bigint, h bigint, role int, line string, slots binary, final boolean"


def _split(rows: DataFrame, edits: int, per_edit: int, first: bool) -> DataFrame:
    """:func:`split` of rows (key, h, role, line, slots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 13):
                b = batch.slice(i, 1 << 13)
                x = Lines(b.column(3))
                key = b.column(0).to_numpy().view(np.uint64)
                if first:
                    row, role, slots = first_slots(x, key, edits, per_edit)
                else:
                    row, role = np.arange(b.num_rows), b.column(2).to_numpy().astype(np.int64)
                    slots = np.frombuffer(b"".join(s.as_py() for s in b.column(4)), np.int32).reshape(-1, SLOTS, 4)
                row, key, role, slots, final = split(x, row, key[row], role, slots)
                own, raw = pa.array(row), [s.tobytes() for s in slots]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(1).take(own), pa.array(role.astype(np.int32)), b.column(3).take(own), pa.array(raw, pa.binary()), pa.array(final)], ["key", "h", "role", "line", "slots", "final"])

    return rows.select("key", "h", "role", "line", "slots").mapInArrow(run, _SPLIT)


def _rare(rows: DataFrame, edits: int, per_edit: int, hot: int) -> DataFrame:
    """(key, h, role, line) under keys of few lines, for ``rows`` (key, h, role, line)
    under keys of many.  Keys that can't be split (all but a few characters match)
    are left."""
    now, done = rows.withColumn("slots", F.lit(b"")), None
    for k in range(ROUNDS):
        now = frames.cut(_split(now, edits, per_edit, k == 0).dropDuplicates(["key", "h", "role", "slots"]))
        many = frames.cut(now.filter("not final").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("key", F.lit(True).alias("again")))
        n = many.count()
        marked = now.join(F.broadcast(many) if n <= BROADCAST_LINES else many, "key", "left")
        ready = marked.filter("final or again is null").select("key", "h", "role", "line")
        done = ready if done is None else done.unionAll(ready)
        if not n:
            return done
        now = marked.filter("again and not final")
    return done.unionAll(now.select("key", "h", "role", "line"))


def _verified(shared: DataFrame, texts: DataFrame, edits: int, per_edit: int, hot: int) -> DataFrame:
    """(h1, h2, edits) of lines that are near."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def linked(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, h, role = (t.column(i).to_numpy() for i in range(3))
            ids, at = np.unique(h, return_index=True)  # lines repeat under keys and (from parts) at all
            line_of = np.searchsorted(ids, h)
            offs, data = tx.buffers(t.column(3).combine_chunks().take(pa.array(at)))
            codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            offs = tx.chars(data)[offs]
            start, size = offs[:-1], np.diff(offs)
            count = letter_counts(codes, start, size)
            pair = np.unique(np.stack([key, line_of, role], axis=1), axis=0)
            key, line, role = pair.T
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            left: list[np.ndarray] = []
            right: list[np.ndarray] = []
            n = 0
            for s, e in zip(heads, np.append(heads[1:], len(key))):
                probes, index = line[s:e], line[s:e][role[s:e] & 1 == 1]
                rows = max(1, (1 << 19) // max(1, len(index)))
                for i in range(0, len(probes), rows):
                    p = probes[i : i + rows]
                    a, b = np.repeat(p, len(index)), np.tile(index, len(p))
                    # equals meet twice, so only in one order
                    ok = (size[a] > size[b]) | (size[a] == size[b]) & (a < b)
                    left.append(a[ok])
                    right.append(b[ok])
                    n += len(left[-1])
                    if n >= 1 << 18:
                        yield near_rows(ids, codes, start, size, count, left, right)
                        left, right, n = [], [], 0
            if n:
                yield near_rows(ids, codes, start, size, count, left, right)

        def near_rows(ids, codes, start, size, count, left, right) -> pa.RecordBatch:
            p = np.unique(np.concatenate(left) * np.int64(len(ids)) + np.concatenate(right))
            a, b = p // len(ids), p % len(ids)
            ok, d = near(codes, start, size, a, b, edits, per_edit, count)
            return pa.RecordBatch.from_arrays([pa.array(ids[a[ok]]), pa.array(ids[b[ok]]), pa.array(d.astype(np.int32))], ["h1", "h2", "edits"])

        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if rows + whole >= 1 << 15 and (whole or rest):
                t = pa.Table.from_batches([*rest, b.slice(0, whole)])
                first = keys[-1] if whole == 0 else None
                if first is None:
                    yield from linked(t)
                    rest, rows = [], 0
                    b = b.slice(whole)
            rest.append(b)
            rows += b.num_rows
        if rest:
            yield from linked(pa.Table.from_batches(rest))

    rows = shared.join(texts, "h")
    if shared.filter("many").isEmpty():
        rows = rows.select("key", "h", "role", "line")
    else:
        rows = frames.cut(rows)
        rows = rows.filter("not many").select("key", "h", "role", "line").unionAll(_rare(rows.filter("many").select("key", "h", "role", "line"), edits, per_edit, hot))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(check, "h1 bigint, h2 bigint, edits int").distinct()


def removed(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT, id_col: str = "doc_id", text_col: str = "text", broadcast_lines: int = BROADCAST_LINES, flush: int = FLUSH, hot: int = HOT, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, th, line, keep, edits) of every line that goes; see :func:`report`."""
    rows = _lines_of(docs, id_col, text_col)
    occ = frames.cut(_occurrences(rows))
    place = F.struct("doc_id", "th", "line")
    firsts = occ.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    flush, buckets = plan(occ.count(), flush)
    blocked = frames.cut(_blocks(rows, edits, per_edit, flush, buckets, heavy), "none")
    shared = frames.cut(_shared(blocked, flush // 8, hot))
    frames.drop(blocked)
    texts = _texts(rows, shared.select("h").distinct(), broadcast_lines)
    pairs = frames.cut(_verified(shared, texts, edits, per_edit, hot))
    frames.drop(shared)
    firsts = frames.cut(firsts.filter("n > 1").unionAll(firsts.filter("n = 1").join(pairs.select(F.explode(F.array("h1", "h2")).alias("h")).distinct(), "h", "left_semi")))
    one = firsts.select(F.col("h").alias("h1"), F.col("first").alias("p1"))
    two = firsts.select(F.col("h").alias("h2"), F.col("first").alias("p2"))
    placed = pairs.join(one, "h1").join(two, "h2")
    later = placed.select(
        F.when(F.col("p1") < F.col("p2"), F.col("h2")).otherwise(F.col("h1")).alias("h"),
        F.struct(F.least("p1", "p2").alias("p"), F.col("edits")).alias("keep"),
    )
    near_keep = later.groupBy("h").agg(F.min("keep").alias("near"))
    gone = firsts.join(near_keep, "h", "left").filter("n > 1 or near is not null")
    hit = occ.join(gone, "h").select("doc_id", "th", "line", F.coalesce("near.p", "first").alias("keep"), F.coalesce("near.edits", F.lit(0)).alias("edits"))
    return hit.filter("not (doc_id <=> keep.doc_id and th = keep.th and line = keep.line)")


def report(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT, **more) -> DataFrame:
    """(doc_id, line, keep_id, keep_line, edits) of every line that goes.

    Lines are cut at line feeds and numbered from 0; lines of white space only
    are no lines here, they stay and match nothing.  ``keep`` is the earliest
    line within ``edits`` and one for ``per_edit`` characters of the shorter of the
    two (the earliest equal one where none is nearer in the order); it may itself go
    because of an earlier one.  Null and empty texts have no lines; texts and lines of
    any length are read whole; a null id comes before all others; rows that repeat id
    and text are one document given several times: their lines stand at the same place
    and none goes because of the other.  An empty table gives no rows; other columns
    are ignored.
    """
    out = removed(docs, edits, per_edit, **more)
    return out.select("doc_id", "line", F.col("keep.doc_id").alias("keep_id"), F.col("keep.line").alias("keep_line"), "edits")


def clean(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs``, all columns, without the lines that :func:`report` lists.

    A row that had lines and has none left goes.
    """
    own, th, gone, my_own, my_th = frames.fresh_names(docs, "own", "th", "gone", "my_own", "my_th")
    marks = removed(docs, edits, per_edit, id_col, text_col, **more).groupBy(F.col("doc_id").alias(own), F.col("th").alias(th)).agg(F.array_sort(F.collect_set("line")).alias(gone))
    names = [frames.quoted(c) for c in docs.columns]
    text, kind = F.col(frames.quoted(text_col)), docs.schema[text_col].dataType
    keyed = docs.select(*names, frames.col(docs, id_col).cast("bigint").alias(my_own), F.xxhash64(frames.col(docs, text_col).cast("string")).alias(my_th))
    joined = keyed.join(marks, (F.col(my_th) == F.col(th)) & F.col(my_own).eqNullSafe(F.col(own)), "left")
    # what lies between one line that goes and the next
    lines, at = F.split(text.cast("string"), "\n"), F.col(gone)
    kept = F.zip_with(F.concat(F.array(F.lit(-1)), at), F.concat(at, F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    new = F.when(at.isNull(), text).otherwise(F.array_join(F.flatten(kept), "\n").cast(kind))
    out = joined.select(*[new.alias(c) if c == text_col else F.col(frames.quoted(c)) for c in docs.columns], at.isNull().alias(my_th))
    return out.filter(F.col(my_th) | text.rlike("[^\\x00-\\x20]")).select(*names)


#: The same report in DuckDB, by comparing all lines of like length.
ORACLE = r"""
with pieces as (
  select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as line from documents
), lines as (
  select doc_id, line, x, length(x) as n from pieces where regexp_matches(x, '[^\x00-\x20]')
), firsts as (
  select x, any_value(n) as n, min(struct_pack(d := doc_id, l := line)) as p from lines group by x
), near as (
  select b.x, min(struct_pack(p := a.p, e := levenshtein(a.x, b.x))) as k from firsts a join firsts b
  on a.n between b.n - 2 and b.n + 2 and a.p < b.p and a.n >= 8 and b.n >= 8 and levenshtein(a.x, b.x) <= least(2, least(a.n, b.n) // 8) group by b.x
)
select doc_id, cast(line as int) as line, coalesce(k.p.d, f.p.d) as keep_id, cast(coalesce(k.p.l, f.p.l) as int) as keep_line, cast(coalesce(k.e, 0) as int) as edits
from lines join firsts f using (x) left join near using (x)
where k is not null or f.p <> struct_pack(d := doc_id, l := line)
"""
