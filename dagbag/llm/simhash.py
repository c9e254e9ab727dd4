"""SimHash near-duplicates with a Gray-order hierarchical index.

A document's fingerprint has 128 bits: each different word of its folded text
votes once on every bit.  Documents whose fingerprints differ in at most
``DISTANCE`` bits are near-duplicates; groups are connected components.

The index has two storeys, and finds every pair.

* Upper nodes are groups of fingerprints that agree in a masked pattern, another
  mask in each table.  The 128 bits are cut into ``DISTANCE + 1`` parts and these
  taken by ``PARTS`` as blocks: a pair within the distance differs in fewer bits of
  some block than the block has parts, and so agrees in one of these.  Each part is
  a mask.  Where nodes would have more than ``NODE`` fingerprints on average, what a
  mask leaves of its block is cut into as many parts again, one of which must agree.
  A node of more than ``BIG`` (fingerprints crowd round some patterns) is cut into
  slices, every two of which meet in a node of their own.
* In an upper node fingerprints are sorted by Gray rank from the block's first bit
  on, so that neighbours share long patterns, and factored into a tree: an inner
  node keeps the mask of the bits that all below it share, and their values.  All
  fingerprints of a node go down the tree side by side, their differences from the
  shared bits accumulate, a group is left out as soon as they exceed the distance or,
  within the block, what the table has to find, and linked whole if even all its
  free bits can't make it exceed.  What comes out is a spanning forest, not pairs.

Of random fingerprints groups are pruned by their block, copies are pruned or linked
by whole groups.

Only fingerprints are shuffled, and equal ones are collapsed first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagbag.llm import frames
from dagbag.llm import text as tx
from dagbag.plans.components import star_forest

DISTANCE = 20
#: Parts of a block, at least.
PARTS = 3
#: Fingerprints that upper nodes are planned for, and above which one is sliced.
NODE, BIG = 1 << 18, 1 << 19
#: Children of inner nodes from the leaves up; the last number goes on.
FANS = (2, 8)
#: Upper nodes to slice (16 bytes each) up to which their list is broadcast.
BROADCAST_NODES = 200_000
#: Rows to leave out (16 bytes each) up to which :func:`dedup` broadcasts them.
BROADCAST_ROWS = 1_000_000
#: Fingerprints that a worker joins at once, and (fingerprint, inner node) pairs.
BATCH, FRONT = 1 << 15, 1 << 19
#: Bits of an upper node's key below its table's number.
TABLE = 48

_LANES = np.zeros((2, 256), np.uint64)  # four 16-bit counters for half a byte's bits
for _b in range(256):
    for _i in range(8):
        if _b >> _i & 1:
            _LANES[_i // 4, _b] |= np.uint64(1) << np.uint64(16 * (_i % 4))


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((n, 2) words of the fingerprints, number of different words)."""
    w = tx.words(texts)
    n = len(w.first) - 1
    out = np.zeros((n, 2), np.uint64)
    if not len(w.start):
        return out, np.zeros(n, np.int64)
    # a word's votes follow from its whole hash, whatever other texts are in the batch
    owner, feature = w.owner(), w.hashes()
    feature = feature[np.lexsort((feature, owner))]
    once = np.append(True, (feature[1:] != feature[:-1]) | (owner[1:] != owner[:-1]))
    feature, size = feature[once], np.bincount(owner[once], minlength=n)
    first = np.concatenate([[0], np.cumsum(size)])
    some = np.flatnonzero(size)
    # counters of 16 bits: a longer text is summed in parts
    part = 1 << 15
    cuts = np.concatenate([np.arange(first[d], first[d + 1], part) for d in some]) if size.max() > part else first[some]
    text_of = np.searchsorted(first, cuts, side="right") - 1
    for k in range(2):
        votes = tx.splitmix(feature + np.uint64(k) * np.uint64(0x632BE59BD9B4E019)).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            for half in range(2):
                sums = np.add.reduceat(_LANES[half][votes[:, j]], cuts).view(np.uint16).reshape(-1, 4).astype(np.int64)
                if len(cuts) != len(some):
                    total = np.zeros((n, 4), np.int64)
                    np.add.at(total, text_of, sums)
                    sums = total[some]
                win = 2 * sums > size[some, None]
                for i in range(4):
                    out[some, k] |= win[:, i].astype(np.uint64) << np.uint64(8 * j + 4 * half + i)
    return out, size


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each 128-bit word in Gray order, as (high, low)."""
    high, low = fp[:, 0].copy(), fp[:, 1].copy()
    for s in (1, 2, 4, 8, 16, 32):
        high ^= high >> np.uint64(s)
        low ^= low >> np.uint64(s)
    low = np.where(high & np.uint64(1), ~low, low)  # parity of the high word carries over
    return np.stack([high, low], axis=1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.bitwise_count(a ^ b)
    return x[..., 0].astype(np.int64) + x[..., 1]


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the sets of a and b; ``label`` is the least place of each one's set."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


class GrayForest:
    """Trees over the fingerprints of several upper nodes, in Gray order.

    ``key`` names the upper node of each; :meth:`join` links what is within the
    limit inside a node.  Pairs that differ in more than ``most`` of the bits
    ``block`` of the first word may be left to other tables.  ``seen`` and ``pruned``
    count (fingerprint, group) pairs that were looked at and that were left out or
    linked whole.
    """

    def __init__(self, key: np.ndarray, fp: np.ndarray, block: int = 0, most: int = 0):
        self.block, self.most = np.uint64(block), most
        rank = gray_rank(fp)
        self.order = np.lexsort((rank[:, 1], rank[:, 0], key))
        self.fp, key = fp[self.order], key[self.order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        self.node = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(key))))
        self.seen = self.pruned = 0
        ones, zeros, ends = self.fp, ~self.fp, np.arange(1, len(fp) + 1)
        # from the leaves up: (shared mask, pattern, free bits, first child, end of children, last fingerprint)
        self.levels = []
        self.lead, self.leads = self.fp[:, 0] & self.block, []  # the block's part of them
        while len(ones) > len(heads):
            fan = FANS[min(len(self.levels), len(FANS) - 1)]
            place = np.arange(len(ones)) - np.repeat(heads, np.diff(np.append(heads, len(ones))))
            at = np.flatnonzero(place % fan == 0)
            stop = np.append(at[1:], len(ones))
            ends = ends[stop - 1]
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            mask = ones | zeros
            self.levels.append((mask, ones, 128 - np.bitwise_count(mask).sum(1).astype(np.int64), at, stop, ends))
            self.leads.append((mask[:, 0] & self.block, ones[:, 0] & self.block))
            heads = np.searchsorted(at, heads)

    def join(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a spanning forest of the pairs within ``limit``; exact but for the block's."""
        n = len(self.fp)
        label = np.arange(n)
        for i in range(0, n if self.levels else 0, FRONT // 8):
            rows = np.arange(i, min(n, i + FRONT // 8))
            self._down(label, len(self.levels) - 1, rows, self.node[rows], limit)
        child = np.flatnonzero(label != np.arange(n))
        return self.order[label[child]], self.order[child]

    def _down(self, label: np.ndarray, depth: int, row: np.ndarray, group: np.ndarray, limit: int) -> None:
        """Fingerprints ``row`` meet groups of a level; each pair meets once, at its lesser place."""
        mask, pattern, free, first, stop, end = self.levels[depth]
        after = end[group] > row + 1  # else the group has none behind the fingerprint
        row, group = row[after], group[after]
        self.seen += len(row)
        if self.block:
            shared, lead = self.leads[depth]
            here = np.bitwise_count((lead[group] ^ self.lead[row]) & shared[group]) <= self.most
            self.pruned += len(row) - int(here.sum())
            row, group = row[here], group[here]
        diff = np.bitwise_count((pattern[group] ^ self.fp[row]) & mask[group])
        diff = diff[:, 0].astype(np.int64) + diff[:, 1]
        whole = diff + free[group] <= limit
        if whole.any():
            # the fingerprints behind it in the group, all linked to this one
            r, g = row[whole], group[whole]
            for d in range(depth, 0, -1):
                g = self.levels[d][3][g]
            lo = np.maximum(self.levels[0][3][g], r + 1)
            size = end[group[whole]] - lo
            at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            spanning(label, np.repeat(r, size), at)
        go = (diff <= limit) & ~whole
        self.pruned += len(row) - int(go.sum())
        row, group = row[go], group[go]
        width = int((stop - first).max(initial=1))
        for i in range(0, len(row), max(1, FRONT // width)):
            r, g = row[i : i + FRONT // width], group[i : i + FRONT // width]
            size = stop[g] - first[g]
            below = np.repeat(first[g] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            r = np.repeat(r, size)
            if depth:
                self._down(label, depth - 1, r, below, limit)
            else:
                ok = below > r
                r, below = r[ok], below[ok]
                self.seen += len(r)
                if self.block:
                    ok = np.bitwise_count(self.lead[r] ^ self.lead[below]) <= self.most
                    r, below = r[ok], below[ok]
                near = distance(self.fp[r], self.fp[below]) <= limit
                spanning(label, r[near], below[near])


def masks(m: int, limit: int = DISTANCE) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(bits, block, most) of each table, with ``m`` bits if its block has them.

    Of any two fingerprints within ``limit`` some table's ``bits`` are equal and at
    most ``most`` of its ``block`` differ.  Bits count from the first word's highest.
    """
    if limit >= 128:
        return [(np.empty(0, np.int64), np.empty(0, np.int64), limit)]
    parts = np.array_split(np.arange(128), limit + 1)
    out = []
    for some in np.array_split(np.arange(limit + 1), max(1, (limit + 1) // PARTS)):
        block, most = np.concatenate([parts[i] for i in some]), len(some) - 1
        found = [np.empty(0, np.int64)]
        while True:
            found = [np.concatenate([f, p]) for f in found for p in np.array_split(np.setdiff1d(block, f), most + 1)]
            # the differing bits are among the others, so one of ``most + 1`` parts of these is equal
            if min(map(len, found)) >= m or len(block) - max(map(len, found)) <= most:
                break
        out += [(f, block, most) for f in found]
    return out


def plan_tables(n: int, limit: int = DISTANCE, node: int = NODE) -> tuple[int, int]:
    """(m, T) for n different fingerprints: bits of the masks (see :func:`masks`), and how many there are."""
    m = max(math.ceil(math.log2(max(1, n / node))), min(len(bits) for bits, _, _ in masks(0, limit)))
    return m, len(masks(m, limit))


def table_keys(fp: np.ndarray, m: int, tables: int, limit: int = DISTANCE) -> np.ndarray:
    """(tables, n) upper nodes: the table's number and, in the lower ``TABLE`` bits, those of its mask."""
    plan = masks(m, limit)
    assert len(plan) == tables
    out = np.empty((tables, len(fp)), np.int64)
    for t, (bits, _, _) in enumerate(plan):
        key = np.zeros(len(fp), np.uint64)
        for i, c in enumerate(bits):
            if i and i % TABLE == 0:
                key = tx.splitmix(key)
            key = key << np.uint64(1) | fp[:, c // 64] >> np.uint64(63 - c % 64) & np.uint64(1)
        if len(bits) > TABLE:  # nodes of equal hash are one
            key = tx.splitmix(key) >> np.uint64(64 - TABLE)
        out[t] = key.view(np.int64) | t << TABLE
    return out


def rotated(fp: np.ndarray, by: int) -> np.ndarray:
    """The same bits, beginning with bit ``by``."""
    if by % 64:
        a, b = np.uint64(by % 64), np.uint64(64 - by % 64)
        fp = np.stack([fp[:, 0] << a | fp[:, 1] >> b, fp[:, 1] << a | fp[:, 0] >> b], axis=1)
    return np.ascontiguousarray(fp[:, ::-1]) if by % 128 >= 64 else fp


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, a, b) of rows that have words; th stands for the text."""
    text = frames.col(docs, text_col).cast("string")
    rows = docs.select(frames.col(docs, id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        fp, size = fingerprints(b.column(2))
        out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64))], ["doc_id", "th", "a", "b"])
        return out.filter(pa.array(size > 0))

    return frames.with_text(rows, make, "doc_id bigint, th bigint, a bigint, b bigint")


def _prints(b: pa.RecordBatch, at: int = 0) -> np.ndarray:
    return np.stack([b.column(at + k).to_numpy().view(np.uint64) for k in range(2)], axis=1)


def _keyed(kinds: DataFrame, m: int, tables: int, limit: int) -> DataFrame:
    """(key, a, b): every fingerprint under its upper node of each table."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 13):
                fp = np.ascontiguousarray(_prints(batch.slice(i, 1 << 13)))
                a, b = (np.tile(fp[:, k].view(np.int64), tables) for k in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(table_keys(fp, m, tables, limit).ravel()), pa.array(a), pa.array(b)], ["key", "a", "b"])

    return kinds.mapInArrow(spread, "key bigint, a bigint, b bigint")


def _sliced(rows: DataFrame, big: int) -> DataFrame:
    """(key, a, b) of ``rows`` (key, a, b, n) under a node for every two slices of a node of n fingerprints."""
    slices = F.ceil(2 * F.col("n") / big)
    rows = rows.withColumns({"slices": slices, "own": F.pmod(F.xxhash64("a", "b"), slices)})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1))).filter("own <> other")
    below = F.shiftrightunsigned(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")), 64 - TABLE)
    return rows.select(F.shiftleft(F.shiftright("key", TABLE), TABLE).bitwiseOR(below).alias("key"), "a", "b")


def _joined(keyed: DataFrame, m: int, limit: int) -> DataFrame:
    """(a1, b1, a2, b2): links inside upper nodes."""
    plan = [(int(block[0]) if len(block) else 0, (1 << 64) - (1 << 64 - min(64, len(block))), most) for _, block, most in masks(m, limit)]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        rows = 0

        def linked(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            for x in np.split(x, np.flatnonzero(np.diff(x[:, 0] >> TABLE)) + 1):
                start, block, most = plan[int(x[0, 0] >> TABLE)]
                i, j = GrayForest(x[:, 0], rotated(np.ascontiguousarray(x[:, 1:]).view(np.uint64), start), block, most).join(limit)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x[i, 1], x[i, 2], x[j, 1], x[j, 2])], ["a1", "b1", "a2", "b2"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            whole = np.searchsorted(x[:, 0], x[-1, 0])  # the last node may go on
            if rest and rows + whole >= BATCH and (whole or rest[-1][-1, 0] != x[0, 0]):
                yield from linked(np.concatenate([*rest, x[:whole]]))
                rest, rows, x = [], 0, x[whole:]
            rest.append(x)
            rows += len(x)
        if rest:
            yield from linked(np.concatenate(rest))

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a1 bigint, b1 bigint, a2 bigint, b2 bigint")


def links(kinds: DataFrame, n: int, limit: int = DISTANCE, node: int = NODE, big: int = BIG, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(u, v): linked fingerprints, as structs, among the n ``kinds`` (a, b).

    They connect all that pairs within ``limit`` connect.
    """
    m, tables = plan_tables(n, limit, node)
    keyed = _keyed(kinds, m, tables, limit)
    if n > big:
        hot = frames.cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > big))
        many = hot.count()
        if many:
            hot = F.broadcast(hot) if many <= broadcast_nodes else hot
            keyed = keyed.join(hot, "key", "left_anti").unionAll(_sliced(keyed.join(hot, "key").select("key", "a", "b", "n"), big))
    found = _joined(keyed, m, limit).distinct()
    return found.select(F.struct(F.col("a1").alias("a"), F.col("b1").alias("b")).alias("u"), F.struct(F.col("a2").alias("a"), F.col("b2").alias("b")).alias("v"))


def _grouped(docs: DataFrame, limit: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, a, b) that have words; (a, b, keep, size) of fingerprints
    in groups of two rows or more."""
    rows = frames.cut(_rows(docs, id_col, text_col))
    kinds = frames.cut(rows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "th", "a", "b")).alias("best"), F.count(F.lit(1)).alias("n")))
    stars = star_forest(links(kinds.select("a", "b"), kinds.count(), limit))
    stars = stars.select(F.col("u.a").alias("a"), F.col("u.b").alias("b"), F.col("v").alias("group"))
    own = F.struct("a", "b")
    # what is alone in its group needs no further look
    linked = stars.select("a", "b").unionAll(stars.select("group.a", "group.b")).unionAll(kinds.filter("n > 1").select("a", "b")).distinct()
    some = frames.cut(kinds.join(linked, ["a", "b"], "left_semi").join(stars, ["a", "b"], "left").withColumn("group", F.coalesce("group", own)))
    totals = some.groupBy("group").agg(F.min("best").alias("keep"), F.sum("n").alias("size"))
    return rows, some.join(totals, "group").select("a", "b", "keep", "size")


def groups(docs: DataFrame, limit: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, bits) for each row of a near-duplicate group.

    ``keep_id`` is the least id of the group, the document that stays (of equal
    ids the row of the least text hash); ``bits`` is the distance from its
    fingerprint, over ``limit`` where a third row links the two.  Rows that aren't
    listed have no near duplicate.  Texts without words (null and empty ones too)
    are no duplicates of anything; a null id is the least; repeated rows are members
    each, so that two equal rows are a group; a text of any length is read whole; an
    empty table has no groups; other columns are ignored.
    """
    rows, found = _grouped(docs, limit, id_col, text_col)
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("keep.a"))) + F.bit_count(F.col("b").bitwiseXOR(F.col("keep.b")))
    return rows.join(found, ["a", "b"]).select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"), bits.cast("int").alias("bits"))


def dedup(docs: DataFrame, limit: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs``, all columns, with one row of each group of :func:`groups`.

    Of rows with the same id and text one stays, whichever; rows without words
    all stay.
    """
    rows, found = _grouped(docs, limit, id_col, text_col)
    listed = rows.join(found, ["a", "b"]).select("doc_id", "th", F.expr("not (doc_id <=> keep.doc_id and th = keep.th)").alias("gone"))
    # what goes, and what stays but is given several times
    listed = listed.groupBy("doc_id", "th").agg(F.max("gone").alias("gone"), F.count(F.lit(1)).alias("n")).filter("gone or n > 1")
    listed = frames.cut(listed.select("doc_id", "th", "gone"))
    own, th, gone, my_own, my_th = frames.fresh_names(docs, "own", "th", "gone", "my_own", "my_th")
    marks = listed.select(F.col("doc_id").alias(own), F.col("th").alias(th), F.col("gone").alias(gone))
    if listed.count() <= broadcast_rows:
        marks = F.broadcast(marks)
    names = [frames.quoted(c) for c in docs.columns]
    keyed = docs.select(*names, frames.col(docs, id_col).cast("bigint").alias(my_own), F.xxhash64(frames.col(docs, text_col).cast("string")).alias(my_th))
    cond = (F.col(my_th) == F.col(th)) & F.col(my_own).eqNullSafe(F.col(own))
    out = keyed.join(marks, cond, "left_anti").select(*names)
    if listed.filter("not gone").isEmpty():
        return out
    again = keyed.join(marks.filter(~F.col(gone)), cond)
    return out.unionAll(again.groupBy(own, th).agg(F.first(F.struct(*names)).alias(gone)).select(f"{gone}.*"))
