"""Chroma audio fingerprints and alignment of recordings.

A recording is a row of frames, each the energy of the twelve pitch classes.
Frames are smoothed over time and normalised; sixteen filters, differences of
rectangles of the time-pitch image that an integral image sums in constant time,
are quantised to two bits each: one packed 32-bit integer for every frame.

Recordings that share integers are candidates.  Postings are all integers of a
recording, and under every posting all recordings are compared with each other, each
pair at the offset where they share it; only of recordings with equal fingerprints one
stands for all.  Postings that the same recordings share at the same offsets are one
list.  Most pairs of a list are left out by a bound on how many frames can match
(:func:`near`).  For a pair the histogram of offsets gives the alignments, and bit
errors along each the frames that match.

:func:`from_pcm` makes frames of sampled audio, :func:`from_words` of a text
that is played as a melody, a note a word.
"""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagbag.llm import frames as fr
from dagbag.llm import text as tx
from dagbag.plans.components import star_forest

#: Integers of a posting: one and the one so many frames later.
AHEAD = 3
#: Mean bits (of 32) that may differ over ``BLUR`` frames of a match.
BIT_ERROR, BLUR = 4.0, 9
#: Frames that must match, and share of the shorter recording if that is less.
MIN_FRAMES, MIN_SHARE = 24, 0.5
#: Bytes of media that are worked on at once, so that all arrays stay in cache.
PIECE = 256 << 10
BROADCAST_IDS = 2_000_000
#: Recordings with one posting above which they are compared in slices, and the share
#: of recordings that is looked at to find such postings.
HOT, LOOK = 10_000, 1 / 64
#: Integers of a list that are laid side by side if they are no more, and that are compared at once.
LAID, CELLS = 1 << 24, 1 << 18

#: (kind, first pitch class, pitch classes, frames)
FILTERS = [
    (0, 0, 3, 4), (0, 6, 3, 4), (1, 0, 4, 3), (1, 4, 4, 3), (1, 8, 4, 3), (1, 2, 8, 2), (2, 0, 4, 4), (2, 4, 4, 4),
    (2, 8, 4, 4), (2, 0, 12, 6), (3, 0, 6, 4), (3, 6, 6, 4), (4, 0, 6, 3), (4, 5, 6, 3), (5, 1, 5, 6), (5, 6, 5, 6),
]
WIDTH = max(f[3] for f in FILTERS)
_SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
_ONE = 1 << 20  # 1 in the integral image


def _sums(frames: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each filter ``_ONE`` more than the sums of its two regions, by position.

    What is quantised is the logarithm of their ratio; thresholds are compared
    with the ratio itself, which orders alike.
    """
    n = len(frames) - len(_SMOOTH) + 1
    pitch = np.ascontiguousarray(frames.T, dtype=np.float64)
    image = sum(c * pitch[:, i : i + n] for i, c in enumerate(_SMOOTH))
    image *= _ONE / (np.sqrt(sum(row * row for row in image)) + 1e-6)
    # whole numbers: sums don't depend on the recordings before in the batch
    whole = np.zeros((13, n + 1), np.int64)
    np.cumsum(np.cumsum(np.rint(image).astype(np.int64), axis=0), axis=1, out=whole[1:, 1:])
    m = n - WIDTH + 1

    def box(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return whole[y1, t1 : t1 + m] - whole[y0, t1 : t1 + m] - whole[y1, t0 : t0 + m] + whole[y0, t0 : t0 + m]

    for kind, y, h, w in FILTERS:
        total = box(0, w, y, y + h)
        if kind == 0:
            a = total
        elif kind == 1:
            a = box(0, w, y + h // 2, y + h)
        elif kind == 2:
            a = box(w // 2, w, y, y + h)
        elif kind == 3:
            a = box(0, w // 2, y + h // 2, y + h) + box(w // 2, w, y, y + h // 2)
        elif kind == 4:
            a = box(0, w, y + h // 3, y + h - h // 3)
        else:
            a = box(w // 3, w - w // 3, y, y + h)
        yield _ONE + a, _ONE + total - a


def from_notes(pitch: np.ndarray, loud: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Frames of notes with a fifth above and a second voice."""
    at = np.arange(len(pitch))
    out = np.zeros((len(pitch), 12), np.float32)
    out[at, pitch] += loud
    out[at, (pitch + 7) % 12] += 0.4 * loud
    out[at, second] += 0.5
    return out


def _quartiles() -> np.ndarray:
    """Thresholds: quartiles of the responses to a long seeded random melody."""
    rng = np.random.default_rng(12)
    n = 20_000
    frames = from_notes(rng.integers(0, 12, n), rng.uniform(0.5, 1.5, n).astype(np.float32), rng.integers(0, 12, n))
    return np.array([np.quantile(a / b, [0.25, 0.5, 0.75]) for a, b in _sums(frames)])


THRESHOLDS = _quartiles()
_GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Frames from one integer's first to its last.
SPAN = len(_SMOOTH) + WIDTH - 1


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One packed integer for each frame but the last ``SPAN - 1``."""
    out = np.zeros(max(0, len(frames) - SPAN + 1), np.uint32)
    for k, (a, b) in enumerate(_sums(frames) if len(out) else ()):
        t = THRESHOLDS[k]
        level = (a > t[0] * b).view(np.int8) + (a > t[1] * b) + (a > t[2] * b)
        out |= _GRAY[level] << np.uint32(2 * k)
    return out


def from_pcm(samples: np.ndarray, rate: int, size: int = 4096, hop: int = 1365, low: float = 55.0, high: float = 3520.0) -> np.ndarray:
    """Frames of sampled audio: energies of a short-time spectrum by pitch class."""
    n = max(0, 1 + (len(samples) - size) // hop)
    if not n:
        return np.zeros((0, 12), np.float32)
    at = np.arange(n)[:, None] * hop + np.arange(size)
    power = np.abs(np.fft.rfft(samples[at] * np.hanning(size), axis=1)) ** 2
    freq = np.fft.rfftfreq(size, 1 / rate)
    use = (freq >= low) & (freq <= high)
    pitch = np.round(12 * np.log2(freq[use] / 440.0)).astype(int) % 12
    out = np.zeros((n, 12), np.float32)
    for p in range(12):
        out[:, p] = power[:, use][:, pitch == p].sum(1)
    return out / (out.sum(1, keepdims=True) + 1e-9)


def from_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(frames, first frame of each text): every word is a note."""
    w = tx.words(texts)
    h = tx.splitmix(w.hashes())
    loud = (np.float32(0.5) + (h >> np.uint64(40) & np.uint64(255)).astype(np.float32) / 255)
    return from_notes((h % np.uint64(12)).astype(np.int64), loud, ((h >> np.uint64(20)) % np.uint64(12)).astype(np.int64)), w.first


def from_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Frames stored as 12 bytes each; bytes beyond the last whole frame are dropped."""
    raw = [x.as_py() or b"" for x in column]
    size = [len(r) // 12 for r in raw]
    data = b"".join(r[: 12 * n] for r, n in zip(raw, size))
    return np.frombuffer(data, np.uint8).reshape(-1, 12).astype(np.float32) / 255, np.cumsum([0, *size])


def fingerprints(frames: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Fingerprint of each recording of a batch; they are computed at once."""
    whole = fingerprint(frames)
    return [whole[s : max(s, e - SPAN + 1)] for s, e in zip(first[:-1], first[1:])]


def _identity(fp: np.ndarray) -> int:
    return int(tx.range_hash(tx.prefix_hash(fp), np.array([0]), np.array([len(fp)])).view(np.int64)[0])


def postings(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, first frame) of the postings of a recording."""
    if len(fp) <= AHEAD:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    kinds, at = np.unique(tx.mix(fp[:-AHEAD].astype(np.uint64) << np.uint64(32) | fp[AHEAD:]), return_index=True)
    return kinds.view(np.int64), at.astype(np.int32)


def _along(a: np.ndarray, b: np.ndarray, offset: int, limit: float, blur: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(first frame of a that plays with one of b, bit errors from there on, which of these frames match)."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 0, np.empty(0), np.empty(0, bool)
    err = np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).astype(np.float64)
    c = np.concatenate([[0.0], np.cumsum(err)])
    i = np.arange(len(err))
    s, e = np.maximum(0, i - blur // 2), np.minimum(len(err), i + blur // 2 + 1)
    return lo, err, (c[e] - c[s]) / (e - s) <= limit


def align(a: np.ndarray, b: np.ndarray, offset: int, limit: float = BIT_ERROR, blur: int = BLUR) -> tuple[int, float]:
    """(frames, mean bit errors) that match when frame i + offset of b plays with i of a."""
    _, err, good = _along(a, b, offset, limit, blur)
    return int(good.sum()), float(err[good].mean()) if good.any() else 32.0


def alignments(a: np.ndarray, b: np.ndarray, offsets: np.ndarray, places: np.ndarray, least: float, limit: float = BIT_ERROR, blur: int = BLUR) -> list[tuple[int, int, float]]:
    """(offset, frames, mean bit errors) of each offset with ``least`` matching frames.

    ``places`` are the frames of a whose postings vote for ``offsets``.  Offsets
    go by votes; one whose places all match along others before it is merged
    with these.
    """
    kinds, which, votes = np.unique(offsets, return_inverse=True, return_counts=True)
    by_kind = np.split(places[np.argsort(which, kind="stable")], np.cumsum(votes)[:-1])
    heard, out = np.zeros(len(a), bool), []
    for k in np.lexsort((kinds, np.abs(kinds), -votes)):
        if heard[by_kind[k]].all():
            continue
        lo, err, good = _along(a, b, int(kinds[k]), limit, blur)
        if good.any() and good.sum() >= least:
            out.append((int(kinds[k]), int(good.sum()), float(err[good].mean())))
            heard[lo : lo + len(good)] |= good
    return out


def _floor(least: np.ndarray) -> np.ndarray:
    """Frames with at most twice the limit of bit errors if ``least`` match.

    More than half of the frames round a matching one are such, or its mean were
    over the limit: 5 of 9, two, one and one less for the three first and last of an
    overlap; and each is round ``BLUR`` frames at most.
    """
    half = BLUR // 2
    lost = 2 * sum(half + 1 - ((half + 1 + k) // 2 + 1) for k in range(half))
    return np.maximum(1, np.ceil((np.ceil(least) * (half + 1) - lost) / (2 * half + 1)))


def near(fps: list[np.ndarray], at: np.ndarray, limit: float, min_frames: int, min_share: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those after it that may match it) when frame ``at[i]`` of each plays with that of the others.

    None that has enough matching frames is left out.
    """
    size = np.array([len(f) for f in fps])
    start = at.max() - at
    laid = None
    if len(fps) > 2 and len(fps) * int((start + size).max()) <= LAID:
        laid = np.zeros((len(fps), int((start + size).max())), np.uint32)
        for row, s, f in zip(laid, start, fps):
            row[s : s + len(f)] = f
    for i in range(len(fps) - 1):
        x = fps[i]
        rows = max(1, CELLS // len(x))
        for j0 in range(i + 1, len(fps), rows):
            js = np.arange(j0, min(len(fps), j0 + rows))
            # all of x's frames, and what plays with them
            if laid is not None:
                y = laid[j0 : j0 + rows, start[i] : start[i] + size[i]]
            elif len(js) > 1:
                y = np.tile(~x, (len(js), 1))
                for row, j in zip(y, js):
                    lo, hi = max(0, start[j] - start[i]), min(len(x), start[j] - start[i] + size[j])
                    row[lo:hi] = fps[j][lo + start[i] - start[j] : hi + start[i] - start[j]]
            else:
                yield i, js
                continue
            good = (np.bitwise_count(y ^ x) <= 2 * limit).sum(axis=1)
            may = good >= _floor(np.minimum(min_frames, min_share * np.minimum(size[i], size[js])))
            if may.any():
                yield i, js[may]


OUT = "doc_id bigint, match_id bigint, offset int, frames int, bit_error double"


def matches(media: DataFrame, id_col: str = "doc_id", media_col: str = "text", reader: Callable = from_words, limit: float = BIT_ERROR, min_frames: int = MIN_FRAMES, min_share: float = MIN_SHARE, broadcast_ids: int = BROADCAST_IDS, hot: int = HOT, look: float = LOOK) -> DataFrame:
    """(doc_id, match_id, offset, frames, bit_error) of recordings that align.

    Frame ``i`` of ``doc_id`` plays with frame ``i + offset`` of ``match_id``;
    ``frames`` of them match, with ``bit_error`` differing bits on average.  A
    recording is linked to every earlier one (by id) with which it shares a posting and
    matches where that plays, with a row for each offset at which parts of the two
    match.  Recordings with equal fingerprints are all linked to the first of them,
    and only that one to others.

    Null, empty and short media (up to ``SPAN + AHEAD`` frames) match nothing; long
    media are heard whole; a null id comes first, of equal ids the least content hash;
    repeated rows are recordings each, so the second matches the first; offsets with
    as many votes go by the lesser shift; an empty table gives no rows; other columns
    are ignored.
    """
    kind = "binary" if reader is from_binary else "string"
    content = fr.col(media, media_col).cast(kind)
    rows = media.select(fr.col(media, id_col).cast("bigint").alias("doc_id"), F.xxhash64(content).alias("th"), content.alias("text"))

    def sketch(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = fingerprints(*reader(b.column(2)))
        use = [i for i, f in enumerate(fps) if len(f) > AHEAD]
        own = pa.array(use, pa.int64())
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(own), b.column(1).take(own), pa.array([_identity(fps[i]) for i in use], pa.int64()), pa.array([len(fps[i]) for i in use], pa.int32()), pa.array([fps[i].tobytes() for i in use], pa.binary())],
            ["doc_id", "th", "fh", "n", "fp"],
        )

    heard = fr.with_text(rows, sketch, "doc_id bigint, th bigint, fh bigint, n int, fp binary", "text", PIECE)
    heard = fr.cut(heard.withColumn("no", F.monotonically_increasing_id()))
    reps = fr.cut(heard.groupBy("fh").agg(F.min(F.struct("doc_id", "th", "no", "n")).alias("r"), F.count(F.lit(1)).alias("copies")))
    # all copies but the first match it, and their postings aren't needed
    copies = heard.select("doc_id", "fh", "no", "n").join(reps.filter("copies > 1").select("fh", "r"), "fh").filter("no <> r.no")
    exact = copies.select("doc_id", F.col("r.doc_id").alias("match_id"), F.lit(0).alias("offset"), F.col("n").alias("frames"), F.lit(0.0).alias("bit_error"))
    gone = fr.cut(copies.select("no"))
    firsts = heard.join(F.broadcast(gone) if gone.count() <= broadcast_ids else gone, "no", "left_anti").select("no", "doc_id", "th", "fp")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                posts = [postings(np.frombuffer(f, np.uint32)) for f in b.column(1).to_pylist()]
                no = np.repeat(b.column(0).to_numpy(), [len(v) for v, _ in posts])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.concatenate([v for v, _ in posts]), no, np.concatenate([p for _, p in posts]))], ["v", "no", "at"])

    posts = firsts.select("no", "fp").mapInArrow(spread, "v bigint, no bigint, at int")
    # a posting of very many is found in a share of the recordings; every two of its slices meet in a list
    some = firsts.filter(F.pmod(F.xxhash64("no"), F.lit(round(1 / look))) == 0).select("no", "fp").mapInArrow(spread, "v bigint, no bigint, at int")
    crowd = fr.cut(some.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot * look).select("v", F.ceil(2 * F.col("n") / (hot * look)).alias("slices")))
    n = crowd.count()
    if n:
        crowd = F.broadcast(crowd) if n <= broadcast_ids else crowd
        many = posts.join(crowd, "v").withColumn("own", F.pmod(F.xxhash64("no"), "slices"))
        many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1))).filter("own <> other")
        many = many.select(F.xxhash64("v", F.least("own", "other"), F.greatest("own", "other")).alias("v"), "no", "at")
        posts = posts.join(crowd.select("v"), "v", "left_anti").unionByName(many)
    lists = posts.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("no", "at"))).alias("m")).filter(F.size("m") > 1)
    # passages give many postings that the same recordings share at the same offsets
    lists = lists.select(F.expr("transform(m, x -> struct(x.no as no, x.at - m[0].at as at))").alias("m")).distinct()
    lists = fr.cut(lists.withColumn("list", F.monotonically_increasing_id()))
    members = lists.select("list", F.explode("m").alias("p")).select("list", "p.no", "p.at").join(firsts, "no")
    members = members.select("list", "doc_id", "th", "no", "at", "fp").repartition("list").sortWithinPartitions("list", "doc_id", "th", "no")

    def least(x: np.ndarray, y: np.ndarray) -> float:
        return min(min_frames, min_share * min(len(x), len(y)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found() -> Iterator[pa.RecordBatch]:
            fps, at = [np.frombuffer(m[3], np.uint32) for m in held], np.array([m[2] for m in held])
            out = []
            for i, js in near(fps, at, limit, min_frames, min_share):
                for j in js.tolist():
                    x, y, offset = fps[j], fps[i], int(at[i] - at[j])
                    frames, err = align(x, y, offset, limit)
                    if frames and frames >= least(x, y) and held[i][1] != held[j][1]:
                        out.append((held[j][0], held[j][1], held[i][0], held[i][1], offset, frames, err))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(),) * 4 + (pa.int32(),) * 2 + (pa.float64(),))], ["doc_id", "no", "match_id", "other", "offset", "frames", "bit_error"])

        last = None
        for b in batches:
            for m in zip(b.column(0).to_pylist(), *(b.column(k).to_pylist() for k in (1, 3, 4, 5))):
                if m[0] != last and held:
                    yield from found()
                    held.clear()
                last = m[0]
                held.append(m[1:])
        if held:
            yield from found()

    hits = members.mapInArrow(compare, "doc_id bigint, no bigint, match_id bigint, other bigint, offset int, frames int, bit_error double").distinct()
    pairs = fr.cut(hits.groupBy("no", "other").agg(F.first("doc_id").alias("doc_id"), F.first("match_id").alias("match_id"), F.collect_list(F.struct("offset", "frames", "bit_error")).alias("o")))
    once = pairs.filter(F.size("o") == 1).selectExpr("doc_id", "match_id", "o[0].offset as offset", "o[0].frames as frames", "o[0].bit_error as bit_error")
    # several offsets may play the same
    both = pairs.filter(F.size("o") > 1).select("no", "other", "doc_id", "match_id").join(firsts.select("no", F.col("fp").alias("x")), "no").join(firsts.select(F.col("no").alias("other"), F.col("fp").alias("y")), "other")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, match, x, y in zip(*(b.column(k).to_pylist() for k in range(4))):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                (u, i), (v, j) = postings(x), postings(y)
                _, p, q = np.intersect1d(u, v, assume_unique=True, return_indices=True)
                found = alignments(x, y, j[q].astype(np.int64) - i[p], i[p], least(x, y), limit)
                out += [(doc, match, *f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], ["doc_id", "match_id", "offset", "frames", "bit_error"])

    several = both.select("doc_id", "match_id", "x", "y").mapInArrow(check, OUT)
    return once.unionByName(several).unionByName(exact)


#: Postings of a bucket and frames of a chunk; bits of a posting that are kept beyond those that number all.
BUCKET, CHUNK, SPARE = 1 << 20, 1 << 20, 6
#: Recordings of a crowded list that meet as many others at once; lists up to ``FEW`` aren't bounded first.
SLICE, FEW = 1024, 64
#: Bits of a frame beyond the limit within which it counts for the bound, and frames of a block.
SLACK, BLOCK = 6, 200
#: Frames of pairs that are aligned at once, and bytes of fingerprints that a task keeps.
ALIGNED, KEPT = 1 << 18, 64 << 20
#: Pairs that a task of the comparison has on average at most, and that one collects before they are aligned.
TASK, PAIRS = 5_000_000, 300_000
_ZSTD = pa.Codec("zstd", 1)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte from the lowest, in as many bytes as the largest takes."""
    k = max(1, (int(x.max()).bit_length() + 7) // 8)
    return _ZSTD.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T), asbytes=True)


def _unpacked(raw: bytes, n: int, k: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = np.frombuffer(_ZSTD.decompress(raw, n * k), np.uint8).reshape(k, n).T
    return out.view("<i8")[:, 0]


def chunk_postings(fps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, recording, first frame) of all postings of some recordings, by value."""
    size = np.array([len(f) for f in fps], np.int64)
    flat, end = np.concatenate([np.empty(0, np.uint32), *fps]), np.cumsum(size)
    owner = np.repeat(np.arange(len(fps)), size)
    at = np.flatnonzero(np.arange(len(flat)) + AHEAD < end[owner])
    v = tx.mix(flat[at].astype(np.uint64) << np.uint64(32) | flat[at + AHEAD])
    order = np.argsort(v, kind="stable")
    v, at = v[order], at[order]
    own = owner[at]
    first = np.append(True, (v[1:] != v[:-1]) | (own[1:] != own[:-1]))[: len(v)]
    v, at, own = v[first], at[first], own[first]
    return v, own, at - (end - size)[own]


def shared(v: np.ndarray, no: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, recording, frame) of the postings that several recordings have.

    Lists of the same recordings at the same offsets are one.
    """
    order = np.argsort(v, kind="stable")
    v, no, at = v[order], no[order], at[order]
    same = v[1:] == v[:-1]
    use = (np.append(False, same) | np.append(same, False))[: len(v)]
    v, no, at = v[use], no[use], at[use]
    if not len(v):
        return v.astype(np.int64), no, at
    order = np.lexsort((at, no, v))
    v, no, at = v[order], no[order], at[order]
    heads = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    size = np.diff(np.append(heads, len(v)))
    at = at - np.repeat(at[heads], size)
    kind = np.add.reduceat(tx.splitmix(tx.splitmix(no.view(np.uint64)) + at.view(np.uint64)), heads)
    keep = np.zeros(len(heads), bool)
    keep[np.unique(kind, return_index=True)[1]] = True
    use = np.repeat(keep, size)
    return np.repeat(np.arange(int(keep.sum())), size[keep]), no[use], at[use]


def bound(fps: list[np.ndarray], at: np.ndarray, side: np.ndarray, limit: float = BIT_ERROR) -> np.ndarray:
    """For each two recordings of different sides (any two if there is one) what their frames
    have less than ``limit + SLACK`` bit errors, in all; a triangle of it is filled.

    Frame ``at[i]`` of each plays with that of the others.
    """
    top, n, one = np.uint8(_top(limit)), len(fps), not side.any()
    out = np.zeros((n, n), np.int32)
    for back in (True, False):
        # before the common frame, and from it on: all that one of fewer frames has there plays with the others
        half = [f[:a][::-1] if back else f[a:] for f, a in zip(fps, at.tolist())]
        size = np.array([len(h) for h in half])
        order = np.argsort(size, kind="stable")
        for c in range(0, int(size[order[-2]]), BLOCK):
            use = order[np.searchsorted(size[order], c, "right") :]
            laid = np.zeros((BLOCK, len(use)), np.uint32)
            for row, k in enumerate(use.tolist()):
                h = half[k][c : c + BLOCK]
                laid[: len(h), row] = h
            width = np.minimum(size[use] - c, BLOCK).tolist()
            places = [np.arange(len(use))] if one else [np.flatnonzero(side[use] != s) for s in (0, 1)]
            parts = [laid] if one else [np.ascontiguousarray(laid[:, p]) for p in places]
            after = [np.searchsorted(p, np.arange(len(use)), "right").tolist() for p in places]
            for i, (k, w) in enumerate(zip(use.tolist(), width)):
                s = int(side[k])
                others = use[places[s][after[s][i] :]]
                if not len(others):
                    continue
                err = np.bitwise_count(parts[s][:w, after[s][i] :] ^ laid[:w, i : i + 1])
                np.minimum(err, top, out=err)
                lost = np.full(len(others), int(top) * w, np.int32)
                for r in range(0, w, 25):  # what a byte can hold
                    lost -= np.add.reduce(err[r : r + 25], axis=0, dtype=np.uint8)
                out[k, others] += lost
    return np.triu(out + out.T, 1)


def _top(limit: float) -> int:
    return min(10, int(limit + SLACK))


def needed(least: np.ndarray, limit: float = BIT_ERROR) -> np.ndarray:
    """What :func:`bound` gives at least for two recordings of which ``least`` frames match.

    ``m`` frames round a matching one have ``m * (top - limit)`` together; each is round
    ``BLUR`` at most, and a frame k from an end of the overlap lacks ``BLUR // 2 - k`` there.
    """
    half, slack = BLUR // 2, max(0.0, _top(limit) - limit)
    return slack * np.maximum(1 / BLUR, np.ceil(least) - half * (half + 1) / BLUR) - 1e-6


def aligned(fps: list[np.ndarray], x: np.ndarray, y: np.ndarray, offset: np.ndarray, limit: float = BIT_ERROR) -> tuple[np.ndarray, np.ndarray]:
    """(frames that match, whether a posting is shared) of recordings x and y of ``fps``, as :func:`align` has it."""
    n = np.array([len(f) for f in fps], np.int64)
    low = np.maximum(0, -offset)
    size = np.maximum(0, np.minimum(n[x], n[y] - offset) - low)
    frames, shares = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    use = np.flatnonzero(size)
    half = BLUR // 2
    for k in np.split(use, np.flatnonzero(np.diff(np.cumsum(size[use]) // ALIGNED)) + 1) if len(use) else []:
        last = np.cumsum(size[k])
        first = last - size[k]
        a = [fps[i][s : s + m] for i, s, m in zip(x[k].tolist(), low[k].tolist(), size[k].tolist())]
        b = [fps[i][s : s + m] for i, s, m in zip(y[k].tolist(), (low[k] + offset[k]).tolist(), size[k].tolist())]
        err = np.bitwise_count(np.concatenate(a) ^ np.concatenate(b))
        c = np.zeros(len(err) + 1, np.int32)
        np.cumsum(err, out=c[1:])
        good = np.zeros(len(err), bool)
        if len(err) >= 2 * half + 1:
            good[half : len(err) - half] = c[2 * half + 1 :] - c[: -2 * half - 1] <= limit * (2 * half + 1)
        equal = err == 0
        equal[:-AHEAD] &= equal[AHEAD:]
        for d in range(max(half, AHEAD)):
            some = size[k] > d
            s, e = first[some], last[some]
            if d < half:
                to = np.minimum(e, s + d + half + 1)
                good[s + d] = c[to] - c[s] <= limit * (to - s)
                of = np.maximum(s, e - 1 - d - half)
                good[e - 1 - d] = c[e] - c[of] <= limit * (e - of)
            if d < AHEAD:
                equal[e - 1 - d] = False
        frames[k] = np.add.reduceat(good, first, dtype=np.int32)
        shares[k] = np.logical_or.reduceat(equal, first)
    return frames, shares


def _kept(fold: str, name: str, fps: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, str, int, int]]:
    """(key, file, first byte, frames) of fingerprints, written one after the other to a file of the shared folder."""
    system, path = pafs.FileSystem.from_uri(fold)
    at = 0
    with system.open_output_stream(f"{path}/{name}") as f:
        for key, fp in fps:
            f.write(fp.tobytes())
            yield key, name, at, len(fp)
            at += 4 * len(fp)


class Shelf:
    """Fingerprints of the shared folder, the last ones read at hand."""

    def __init__(self, fold: str, kept: int = KEPT):
        self.system, self.path = pafs.FileSystem.from_uri(fold)
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.have: OrderedDict[int, np.ndarray] = OrderedDict()
        self.size, self.kept = 0, kept

    def get(self, key: int, name: str, at: int, n: int) -> np.ndarray:
        fp = self.have.get(key)
        if fp is not None:
            self.have.move_to_end(key)
            return fp
        f = self.files.get(name)
        if f is None:
            f = self.files[name] = self.system.open_input_file(f"{self.path}/{name}")
            if len(self.files) > 64:
                self.files.popitem(last=False)[1].close()
        fp = self.have[key] = np.frombuffer(f.read_at(4 * n, at), np.uint32)
        self.size += fp.nbytes
        while self.size > self.kept and len(self.have) > 1:
            self.size -= self.have.popitem(last=False)[1].nbytes
        return fp


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is written meanwhile go when it is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def links(media: DataFrame, id_col: str = "doc_id", media_col: str = "text", reader: Callable = from_words, limit: float = BIT_ERROR, min_frames: int = MIN_FRAMES, min_share: float = MIN_SHARE, broadcast_ids: int = BROADCAST_IDS, chunk: int = CHUNK, bucket: int = BUCKET, part: int = SLICE, few: int = FEW) -> DataFrame:
    """(doc_id, class_id, links) of every row.

    ``links`` is the number of other rows that :func:`matches` finds for the recording, at
    whichever offset and copies included; ``class_id`` the least id of all that are connected
    by links, its own if there are none.  Every two recordings that share a posting are
    compared where it plays, as there.

    Null, empty and short media link nothing and are classes of their own; a null id is the
    least; repeated rows are rows each, and link each other; an empty table gives no rows; other
    columns are ignored.  ``media`` must give the same rows when it is read again.
    """
    spark = media.sparkSession
    kind = "binary" if reader is from_binary else "string"
    content = fr.col(media, media_col).cast(kind)
    rows = media.select(fr.col(media, id_col).cast("bigint").alias("doc_id"), F.xxhash64(content).alias("th"), content.alias("text"))
    # a frame is some eight bytes
    total = max(1, (media.agg(F.sum(F.octet_length(content))).first()[0] or 0) // 8)
    top = max(0, math.ceil(math.log2(total / bucket)))
    bits = max(32, math.ceil(math.log2(total)) + SPARE) - top

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, heads, frames = TaskContext.get().partitionId() << 20, [], [], 0

        def full() -> Iterator[pa.RecordBatch]:
            v, who, at = chunk_postings(held)
            v >>= np.uint64(64 - top - bits)
            which, own = (v >> np.uint64(bits)).astype(np.int64), v & np.uint64((1 << bits) - 1)
            edge = np.searchsorted(which, np.arange((1 << top) + 1)).tolist()
            out: list[tuple] = []
            for k in np.unique(which).tolist():
                s, e = edge[k], edge[k + 1]
                x = (np.diff(own[s:e], prepend=np.uint64(0)), who[s:e], at[s:e])
                out.append((k, number, e - s, [max(1, (int(c.max()).bit_length() + 7) // 8) for c in x], *map(_packed, x)))
            # what is known of the recordings goes to a bucket of its own
            doc, th, fh = (pa.concat_arrays(c) for c in zip(*heads))
            size = np.array([len(f) for f in held], np.int64)
            known = np.stack([doc.is_valid().to_numpy(False).astype(np.int64), doc.fill_null(0).to_numpy(), th.to_numpy(), fh.to_numpy(), size])
            out.append((-1 - hash(number) % 1021, number, len(size), [], known.tobytes(), b"", b""))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["bucket", "chunk", "n", "bytes", "v", "who", "at"])

        for piece in tx.pieces(batches, "text", PIECE):
            fps = [f if len(f) > AHEAD else f[:0] for f in fingerprints(*reader(piece.column(2)))]
            held += [f.copy() for f in fps]
            heads.append((piece.column(0), piece.column(1), pa.array([_identity(f) for f in fps], pa.int64())))
            frames += sum(map(len, fps))
            if frames >= chunk or len(held) >= 1 << 20:
                yield from full()
                held, heads, frames, number = [], [], 0, number + 1
        if held:
            yield from full()

    made = ["no", "doc_id", "th", "fh", "n", "list", "at"]

    def meet(t: pa.Table) -> pa.Table:
        number, count = t["chunk"].to_pylist(), t["n"].to_pylist()
        if t["bucket"][0].as_py() < 0:
            valid, doc, th, fh, size = np.concatenate([np.frombuffer(v, np.int64).reshape(5, -1) for v in t["v"].to_pylist()], axis=1)
            no = np.concatenate([(c << 22) + np.arange(n) for c, n in zip(number, count)])
            return pa.table([pa.array(no), pa.array(doc, mask=valid == 0), pa.array(th), pa.array(fh), pa.array(size), *[pa.nulls(len(no), pa.int64())] * 2], names=made)
        wide = t["bytes"].to_pylist()
        v, who, at = ([_unpacked(r, n, w[i]) for r, n, w in zip(t[c].to_pylist(), count, wide)] for i, c in enumerate(("v", "who", "at")))
        v, no, at = np.concatenate([np.cumsum(x) for x in v]), np.concatenate([(c << 22) + x for c, x in zip(number, who)]), np.concatenate(at)
        which, no, at = shared(v, no, at)
        none = [pa.nulls(len(no), pa.int64())] * 4
        return pa.table([pa.array(no), *none, pa.array(which + (t["bucket"][0].as_py() << 32)), pa.array(at)], names=made)

    with _cleaned(spark):
        sent = rows.mapInArrow(spread, "bucket bigint, chunk bigint, n bigint, bytes array<int>, v binary, who binary, at binary")
        found = fr.cut(sent.groupBy("bucket").applyInArrow(meet, ", ".join(f"{c} bigint" for c in made)))
        heads = found.filter("list is null").select("no", "doc_id", "th", "fh", "n")
        reps = heads.filter("n > 0").groupBy("fh").agg(F.min(F.struct("doc_id", "th", "no")).alias("r"), F.count(F.lit(1)).alias("copies"))
        reps = fr.cut(reps.select("fh", "r.doc_id", "r.th", F.col("r.no").alias("rep"), "copies"))
        # copies are one, and what they share among themselves is no list
        known = heads.filter("n > 0").join(reps.select("fh", "rep"), "fh").select("no", "rep")
        members = found.filter("list is not null").select("list", "no", "at").join(known, "no").select("list", "rep", "at").distinct()
        lists = members.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("rep", "at"))).alias("m")).filter("m[0].rep < m[size(m) - 1].rep")
        lists = lists.select(F.expr("transform(m, x -> struct(x.rep as rep, x.at - m[0].at as at))").alias("m")).distinct()
        lists = fr.cut(lists.withColumn("list", F.monotonically_increasing_id()))
        heads = fr.cut(heads.select("doc_id", "fh", "n"))
        fr.drop(found)
        wanted = fr.cut(lists.select(F.explode("m.rep").alias("rep")).distinct().join(reps, "rep").select("rep", "copies", F.col("doc_id").alias("d"), F.col("th").alias("t")))

        fold = f"{fr.shared_dir(spark)}/dagbag-{uuid.uuid4().hex}"
        system, path = pafs.FileSystem.from_uri(fold)
        system.create_dir(path)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = tx.pieces(batches, "text", PIECE)
            fps = ((key, f) for p in pieces for key, f in zip(p.column(0).to_pylist(), fingerprints(*reader(p.column(1)))))
            out = list(_kept(fold, uuid.uuid4().hex, fps))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["rep", "file", "first", "n"])

        few_wanted = F.broadcast(wanted) if wanted.count() <= broadcast_ids else wanted
        some = rows.join(few_wanted, F.expr("th = t and doc_id <=> d")).select("rep", "text")
        # of equal rows one will do
        where = some.mapInArrow(keep, "rep bigint, file string, first bigint, n bigint").groupBy("rep").agg(F.min(F.struct("file", "first", "n")).alias("w"))
        where = fr.cut(where.join(wanted, "rep").select("rep", "copies", "w.*"))

        # lists of very many are cut into slices, every two of which meet
        size = F.size("m")
        work = lists.agg(F.sum(size * size / 2)).first()[0] or 0
        slices = F.ceil(size / part)
        each = lists.select("list", F.col("m")[0]["rep"].alias("part"), slices.alias("s"), F.posexplode("m").alias("i", "p")).withColumn("own", F.col("i") % F.col("s"))
        each = each.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("s") - 1)))
        pair = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
        each = each.select(F.when(F.col("s") > 1, F.xxhash64("list", *pair)).otherwise(F.col("part")).alias("part"), "list", *pair, (F.col("own") > F.col("other")).cast("int").alias("side"), F.col("p.rep").alias("rep"), F.col("p.at").alias("at"))
        each = each.join(where, "rep").select("part", "list", "i", "j", "side", "rep", "at", "copies", "file", "first", "n")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(work / TASK))
        each = each.repartition(tasks, "part").sortWithinPartitions("part", "list", "i", "j")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shelf = Shelf(fold)
            use: dict[int, tuple[int, int, np.ndarray]] = {}
            pairs: list[np.ndarray] = []

            def least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return np.minimum(min_frames, min_share * np.minimum(x, y))

            def item(rows: list[tuple]) -> None:
                own = [use.get(r[5]) or use.setdefault(r[5], (len(use), r[7], shelf.get(r[5], *r[8:]))) for r in rows]
                keys, side, at = (np.array([r[k] for r in rows]) for k in (5, 4, 6))
                fps, which = [f for _, _, f in own], np.array([k for k, _, _ in own])
                i, j = np.triu_indices(len(rows), 1)
                if len(rows) > few:
                    n = np.array([len(f) for f in fps])
                    # the least frame that all have, at these offsets
                    may = bound(fps, at - at.min(), side, limit)[i, j] >= needed(least(n[i], n[j]), limit)
                    i, j = i[may], j[may]
                if side.any():
                    i, j = (x[side[i] != side[j]] for x in (i, j))
                i, j = np.where(keys[i] < keys[j], i, j), np.where(keys[i] < keys[j], j, i)
                i, j = (x[keys[i] != keys[j]] for x in (i, j))
                pairs.append(np.stack([which[i], which[j], at[j] - at[i]]))

            def full() -> Iterator[pa.RecordBatch]:
                keys, copies, fps = np.array(list(use)), np.array([c for _, c, _ in use.values()]), [f for _, _, f in use.values()]
                n = np.array([len(f) for f in fps])
                x, y, off = (p := np.concatenate(pairs, axis=1))[:, np.lexsort(p)]
                once = np.append(True, (np.diff(x) != 0) | (np.diff(y) != 0) | (np.diff(off) != 0))[: len(x)]
                x, y, off = x[once], y[once], off[once]
                frames, play = aligned(fps, x, y, off, limit)
                good = play & (frames > 0) & (frames >= least(n[x], n[y]))
                x, y = np.divmod(np.unique(x[good] * len(n) + y[good]), len(n))
                root, tree = list(range(len(n))), np.zeros(len(x), bool)
                for k, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
                    while root[a] != a:
                        root[a] = a = root[root[a]]
                    while root[b] != b:
                        root[b] = b = root[root[b]]
                    if a != b:
                        tree[k], root[max(a, b)] = True, min(a, b)
                use.clear()
                pairs.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys[x], keys[y], copies[x], copies[y], tree)], ["a", "b", "na", "nb", "tree"])

            rows: list[tuple] = []
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns)):
                    if rows and r[:4] != rows[-1][:4]:
                        item(rows)
                        rows.clear()
                        if sum(p.shape[1] for p in pairs) > PAIRS or len(use) > 4 * part:
                            yield from full()
                    rows.append(r)
            if rows:
                item(rows)
                yield from full()

        hits = fr.cut(each.mapInArrow(compare, "a bigint, b bigint, na bigint, nb bigint, tree boolean"))
        system.delete_dir(path)
        # the trees of all tasks connect what the links connect
        stars = star_forest(hits.filter("tree").select(F.col("a").alias("u"), F.col("b").alias("v")))
        both = F.array(F.struct(F.col("a").alias("rep"), F.col("nb").alias("n")), F.struct(F.col("b").alias("rep"), F.col("na").alias("n")))
        count = hits.select("a", "b", "na", "nb").distinct().select(F.explode(both).alias("x")).groupBy("x.rep").agg(F.sum("x.n").alias("links"))
        groups = reps.join(count, "rep", "left").join(stars.select(F.col("u").alias("rep"), F.col("v").alias("group")), "rep", "left")
        groups = fr.cut(groups.select("fh", "doc_id", F.coalesce("group", "rep").alias("group"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
        fr.drop(hits)
    least_id = groups.groupBy("group").agg(F.min(F.struct("doc_id")).alias("c"))
    groups = groups.join(least_id, "group").select("fh", F.col("c.doc_id").alias("class_id"), "links")
    some = heads.filter("n > 0").join(groups, "fh").select("doc_id", "class_id", "links")
    return some.unionByName(heads.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("links")))
