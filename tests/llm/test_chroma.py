import random

import numpy as np
import pyarrow as pa

from dagbag.llm import chroma
from tests.llm.conftest import CLASHES, WORDS, prose


def tune(seed, n, rate=11025):
    t = np.arange(rate // 3) / rate
    out = []
    for k in np.random.default_rng(seed).integers(40, 76, n):
        f = 440 * 2 ** ((k - 69) / 12)
        out.append(np.sin(2 * np.pi * f * t) + 0.3 * np.sin(4 * np.pi * f * t))
    return np.concatenate(out)


def test_noisy_excerpt_of_a_recording_aligns():
    song = tune(0, 60)
    part = song[1365 * 7 :] + np.random.default_rng(1).normal(0, 0.05, len(song) - 1365 * 7)
    a, b = (chroma.fingerprint(chroma.from_pcm(x, 11025)) for x in (song, part))
    n, err = chroma.align(b, a, 7)
    assert n == len(b) and err < 1
    other = chroma.fingerprint(chroma.from_pcm(tune(9, 60), 11025))
    assert chroma.align(b, other, 7)[0] < 5 and chroma.align(b, a, 3)[0] < 5


def test_filters_match_plain_sums():
    rng = np.random.default_rng(3)
    frames = rng.random((40, 12)).astype(np.float32)
    c = [0.25, 0.75, 1.0, 0.75, 0.25]
    image = np.array([sum(c[k] * frames[i + k].astype(float) for k in range(5)) for i in range(36)])
    image /= np.sqrt((image**2).sum(1, keepdims=True)) + 1e-6
    want = []
    for i in range(36 - chroma.WIDTH + 1):
        word = 0
        for k, (kind, y, h, w) in enumerate(chroma.FILTERS):
            x = image[i : i + w, y : y + h]
            a = {
                0: x.sum(), 1: x[:, h // 2 :].sum(), 2: x[w // 2 :].sum(), 3: x[: w // 2, h // 2 :].sum() + x[w // 2 :, : h // 2].sum(),
                4: x[:, h // 3 : h - h // 3].sum(), 5: x[w // 3 : w - w // 3].sum(),
            }[kind]
            ratio = np.log((1 + a) / (1 + x.sum() - a))
            level = int((ratio > np.log(chroma.THRESHOLDS[k])).sum())
            word |= (0, 1, 3, 2)[level] << 2 * k
        want.append(word)
    assert chroma.fingerprint(frames).tolist() == want


def test_recordings_of_a_batch_dont_mix():
    texts = [prose(1, 50), "a b c", None, prose(2, 40), ""]
    batch = chroma.fingerprints(*chroma.from_words(pa.array(texts)))
    for t, fp in zip(texts, batch):
        alone = chroma.fingerprints(*chroma.from_words(pa.array([t], pa.string())))[0]
        assert (fp == alone).all()
    # sums over a long batch are as exact as over a short one
    many = pa.array([prose(i % 50, 200) for i in range(2000)])
    fps = chroma.fingerprints(*chroma.from_words(many))
    for i in range(50):
        assert (fps[i] == fps[1950 + i]).all()


def test_recall_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for g in range(25):
        base = prose(300 + g, 120).split(" ")
        for c in range(1 + g % 4):
            x = [r.choice(WORDS) + "q" if c and r.random() < 0.03 else w for w in base]
            rows.append((len(rows), " ".join((prose(900 + len(rows), 5 * c).split(" ") if c else []) + x)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = chroma.matches(df).collect()
    fps = chroma.fingerprints(*chroma.from_words(pa.array([t for _, t in rows])))
    want = set()
    for a in range(len(rows)):
        for b in range(a):
            best = max(chroma.align(fps[a], fps[b], o)[0] for o in range(-30, 31))
            if best >= chroma.MIN_FRAMES:
                want.add((a, b))
    root = {i: i for i, _ in rows}
    for x in sorted(got, key=lambda x: x.doc_id):
        root[x.doc_id] = min(root[x.doc_id], root[x.match_id])
    assert len(want) > 25
    assert np.mean([root[a] == root[b] for a, b in want]) >= 0.9
    assert all((max(x.doc_id, x.match_id), min(x.doc_id, x.match_id)) in want for x in got)
    for x in got:
        assert chroma.align(fps[x.doc_id], fps[x.match_id], x.offset) == (x.frames, x.bit_error)
    # joined instead of broadcast; with most postings kept out of the windows
    for more in ({"broadcast_ids": 0}, {"hot": 2, "look": 1}, {"hot": 2, "look": 1, "broadcast_ids": 0}):
        assert sorted(map(tuple, chroma.matches(df, **more).collect())) == sorted(map(tuple, got))


def test_every_run_of_a_match_has_a_shared_posting():
    part = prose(7, 34)
    for seed in range(60):
        texts = [" ".join([prose(1000 + 2 * seed + k, 400 + 90 * k), part, prose(3000 + 2 * seed + k, 500)]) for k in range(2)]
        a, b = (set(chroma.postings(f)[0].tolist()) for f in chroma.fingerprints(*chroma.from_words(pa.array(texts))))
        assert a & b


def test_all_pairs_that_match_where_they_share_a_posting(spark):
    r = random.Random(8)
    # every recording has the words of the first one; others share more with each other
    short, parts = prose(40, 15), [prose(41 + k, 60).split(" ") for k in range(4)]
    rows = [(0, prose(60, 40) + " " + short)]
    for i in range(1, 17):
        part = [w + "q" if r.random() < 0.04 else w for w in parts[i % 4]]
        rows.append((i, " ".join([prose(70 + i, 5 * (i % 7) + 1), short, *part, prose(90 + i, 30)])))
    fps = chroma.fingerprints(*chroma.from_words(pa.array([t for _, t in rows])))
    want = set()
    for a in range(len(rows)):
        for b in range(a):
            (u, i), (v, j) = (chroma.postings(fps[k]) for k in (a, b))
            _, p, q = np.intersect1d(u, v, return_indices=True)
            want |= {(a, b, o) for o in set((j[q] - i[p]).tolist()) if chroma.align(fps[a], fps[b], o)[0] >= chroma.MIN_FRAMES}
    assert {(a, b) for a, b, _ in want} >= {(a, b) for a in range(1, 17) for b in range(1, a) if a % 4 == b % 4}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for more in ({}, {"hot": 2, "look": 1}):
        assert {tuple(x)[:3] for x in chroma.matches(df, **more).collect()} == want


def test_no_pair_with_enough_frames_is_left_out_before_it_is_aligned(monkeypatch):
    rng = np.random.default_rng(9)
    for seed in range(60):
        n = int(rng.integers(2, 90))
        base = rng.integers(0, 2**32, 120, dtype=np.uint32)
        fps, at = [], rng.integers(0, 20, 12)
        for k in range(12):
            noise = np.packbits(rng.random((140, 32)) < rng.choice([0.03, 0.1, 0.13, 0.2]), axis=1).view(np.uint32)[:, 0]
            fps.append((np.concatenate([rng.integers(0, 2**32, 20, dtype=np.uint32)[: at[k]], base]) ^ noise[: at[k] + 120])[: at[k] + n])
        for laid in (0, 1 << 24):
            monkeypatch.setattr(chroma, "LAID", laid)
            got = {(i, j) for i, js in chroma.near(fps, at, 4.0, 24, 0.5) for j in js.tolist()}
            for i in range(12):
                for j in range(i + 1, 12):
                    enough = chroma.align(fps[i], fps[j], int(at[j] - at[i]))[0] >= min(24, 0.5 * min(len(fps[i]), len(fps[j])))
                    assert (i, j) in got or not enough


def test_passages_inside_long_texts(spark):
    rows = []
    for g in range(24):
        # two words more than 24 frames take, on either side, for the blur
        part = prose(500 + g, (38, 45, 50, 60)[g % 4])
        for c in range(2):
            rows.append((len(rows), " ".join([prose(5000 + len(rows), 300 + 70 * c), part, prose(7000 + len(rows), 400)])))
    got = {(r.doc_id, r.match_id) for r in chroma.matches(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(d + 1, d) for d in range(0, len(rows), 2)}


def test_parts_at_several_offsets(spark):
    head, tail, long = prose(11, 80), prose(12, 60), prose(13, 150)
    rows = [
        (1, " ".join([head, tail])), (2, " ".join([head, prose(14, 40), tail])),
        (3, " ".join([prose(15, 90), long, prose(16, 50), prose(17, 70)])), (4, " ".join([prose(17, 70), prose(18, 33), long])),
    ]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id bigint, text string")
    got = sorted(tuple(r)[:3] for r in chroma.matches(df).collect())
    assert got == [(2, 1, -40), (2, 1, 0), (4, 3, -13), (4, 3, 290), (4, 4, 0)]


def test_offsets_are_tried_after_one_that_fails_and_merged_if_they_play_the_same():
    a, b = chroma.fingerprints(*chroma.from_words(pa.array([prose(21, 90), prose(22, 30) + " " + prose(21, 90)])))
    votes = np.array([[7, 1], [7, 2], [7, 3], [30, 20], [31, 40]])
    assert chroma.alignments(a, b, votes[:, 0], votes[:, 1], 24) == [(30, *chroma.align(a, b, 30))]
    # a tune of 5 notes over and over again plays at many offsets, and is one alignment
    (c,) = chroma.fingerprints(*chroma.from_words(pa.array(["ka lo mi nu per " * 40])))
    at = np.arange(50, 100)
    assert len(chroma.alignments(c, c, np.repeat([0, 5, -5, 10], 50), np.tile(at, 4), 24)) == 1


def test_binary_frames(spark):
    frames = (np.random.default_rng(5).random((80, 12)) * 255).astype(np.uint8).tobytes()
    rows = [(1, bytearray(frames)), (2, bytearray(frames[12 * 20 :])), (3, None), (4, bytearray(b"abc"))]
    df = spark.createDataFrame(rows, "id bigint, audio binary")
    (m,) = chroma.matches(df, "id", "audio", chroma.from_binary).collect()
    assert (m.doc_id, m.match_id, m.offset, m.bit_error) == (2, 1, 20, 0.0)


def test_odd_rows(odd_docs, no_docs):
    clash = odd_docs.selectExpr("*", *CLASHES)
    assert {(r.doc_id, r.match_id, r.offset, r.bit_error) for r in chroma.matches(clash).collect()} == {(6, 1, 0, 0.0), (7, 7, 0, 0.0)}
    assert chroma.matches(no_docs).count() == 0


def test_links_and_classes_are_those_of_all_matches(spark, odd_docs, no_docs):
    r = random.Random(18)
    short, parts = prose(40, 15), [prose(41 + k, 60).split(" ") for k in range(4)]
    rows = [(None, prose(60, 40) + " " + short), (50, "a b"), (51, "a b"), (52, None), (53, "")]
    for i in range(1, 25):
        part = [w + "q" if r.random() < 0.04 else w for w in parts[i % 4]]
        rows.append((i, " ".join([prose(70 + i, 5 * (i % 7) + 1), short, *part, prose(90 + i, 30)])))
    rows += [(i + 30, rows[i + 4][1]) for i in (1, 2, 3, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    fps = chroma.fingerprints(*chroma.from_words(pa.array([t for _, t in rows], pa.string())))
    ids, near = [i for i, _ in rows], [{k} for k in range(len(rows))]
    for a in range(len(rows)):
        for b in range(a):
            (u, i), (v, j) = (chroma.postings(fps[k]) for k in (a, b))
            _, p, q = np.intersect1d(u, v, return_indices=True)
            if any(chroma.align(fps[a], fps[b], o)[0] >= chroma.MIN_FRAMES for o in set((j[q] - i[p]).tolist())):
                near[a].add(b), near[b].add(a)
    of = {k: {k} for k in range(len(rows))}
    for _ in rows:
        of = {k: set().union(*(of[m] for m in near[k])) for k in of}
    least = [min((ids[m] is not None, ids[m] or 0) for m in of[k]) for k in range(len(rows))]
    want = sorted((str(i), str(c if known else None), len(n) - 1) for i, (known, c), n in zip(ids, least, near))
    assert max(w[2] for w in want) > 5
    # small chunks, buckets and slices, and a join for what is broadcast else
    for more in ({}, {"chunk": 100, "bucket": 64, "part": 3, "few": 2, "broadcast_ids": 0}):
        assert sorted((str(x.doc_id), str(x.class_id), x.links) for x in chroma.links(df, **more).collect()) == want
    clash = odd_docs.selectExpr("*", *CLASHES)
    got = {(x.doc_id, x.class_id, x.links) for x in chroma.links(clash).collect()}
    assert {g for g in got if g[2]} == {(1, 1, 1), (6, 1, 1), (7, 7, 1)} and chroma.links(clash).count() == odd_docs.count()
    assert chroma.links(no_docs).count() == 0


def test_all_postings_of_a_query_take_little_disk():
    # 22 million postings of 0.10 GB took more than 0.3 GB as rows; 1.5 x input is 7 bytes each
    fps = chroma.fingerprints(*chroma.from_words(pa.array([prose(2000 + i, 400) for i in range(500)])))
    v, who, at = chroma.chunk_postings(fps)
    assert len(v) == sum(len(chroma.postings(f)[0]) for f in fps)
    gaps = np.diff(v >> np.uint64(32), prepend=np.uint64(0))
    for x in (gaps, who, at):
        k = (int(x.max()).bit_length() + 7) // 8
        assert (chroma._unpacked(chroma._packed(x), len(x), k) == x).all()
    assert sum(len(chroma._packed(x)) for x in (gaps, who, at)) < 6 * len(v)


def test_bound_leaves_out_no_pair_that_matches():
    rng = np.random.default_rng(19)
    for seed in range(40):
        n = int(rng.integers(2, 90))
        base = rng.integers(0, 2**32, 120, dtype=np.uint32)
        fps, at = [], rng.integers(0, 20, 12)
        for k in range(12):
            noise = np.packbits(rng.random((140, 32)) < rng.choice([0.03, 0.1, 0.13, 0.2]), axis=1).view(np.uint32)[:, 0]
            fps.append((np.concatenate([rng.integers(0, 2**32, 20, dtype=np.uint32)[: at[k]], base]) ^ noise[: at[k] + 120])[: at[k] + n])
        at = np.minimum(at, [len(f) for f in fps])
        i, j = np.triu_indices(12, 1)
        size = np.array([len(f) for f in fps])
        frames, _ = chroma.aligned(fps, i, j, at[j] - at[i])
        assert frames.tolist() == [chroma.align(fps[a], fps[b], int(at[b] - at[a]))[0] for a, b in zip(i, j)]
        least = np.minimum(24, 0.5 * np.minimum(size[i], size[j]))
        for side in (np.zeros(12, int), np.arange(12) % 2):
            may = chroma.bound(fps, at, side)[i, j] >= chroma.needed(least)
            assert (may | (side.any() & (side[i] == side[j])) | (frames < least) | (frames == 0)).all()
