import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from dagbag.llm import simhash
from tests.llm.conftest import CLASHES, WORDS, prose


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + "x" if r.random() < share else w for w in text.split(" "))


def groups_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_fingerprint_is_the_majority_of_word_votes():
    text = prose(1, 300)
    (fp,), (n,) = simhash.fingerprints(pa.array([text]))
    parts = [simhash.fingerprints(pa.array([w]))[0][0] for w in set(text.lower().replace(".", " ").replace(",", " ").split())]
    bits = np.array([np.unpackbits(p.view(np.uint8)) for p in parts])
    assert n == len(parts) and bits.shape == (n, 128)
    assert (np.unpackbits(fp.view(np.uint8)) == (2 * bits.sum(0) > n)).all()
    same = simhash.fingerprints(pa.array([text.upper() + " " + text, "x"]))[0][0]
    assert simhash.distance(same, simhash.fingerprints(pa.array([text, "x"]))[0][0]) == 0


def test_fingerprint_does_not_depend_on_the_batch():
    text = prose(1, 300)
    (alone,), (n,) = simhash.fingerprints(pa.array([text]))
    for others in (1, 6, 70, 3000):
        rest = [prose(2 + i % 9, 40) + f" w{i}" for i in range(others)]
        for at in (0, others // 2, others):
            fp, size = simhash.fingerprints(pa.array(rest[:at] + [text] + rest[at:]))
            assert (fp[at] == alone).all() and size[at] == n


def test_long_texts_are_summed_in_parts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(40_000))
    a = simhash.fingerprints(pa.array([text, "b c"]))[0]
    b = simhash.fingerprints(pa.array([" ".join(reversed(text.split())), "c b"]))[0]
    assert (a == b).all()


def crowd(seed, n=160, rounds=24):
    """Fingerprints round six centres."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, (6, 2)).astype(np.uint64)
    fp = centres[rng.integers(0, 6, n)]
    for _ in range(int(rng.integers(0, rounds + 1))):
        at = rng.integers(0, n, n // 2)
        fp[at, rng.integers(0, 2)] ^= np.uint64(1) << rng.integers(0, 64, n // 2).astype(np.uint64)
    return fp


def near_pairs(fp, limit=20):
    d = simhash.distance(fp[:, None, :], fp[None, :, :])
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(d <= limit)) if a < b]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([64, 1 << 19]))
def test_index_matches_brute_force(seed, front):
    fp = crowd(seed)
    key = np.repeat([3, 1, 9, 2], [30, 29, 1, 100])
    old, simhash.FRONT = simhash.FRONT, front
    try:
        i, j = simhash.GrayForest(key, fp).join(20)
    finally:
        simhash.FRONT = old
    same = lambda g: {(a, b) for a in range(160) for b in range(a) if g[a] == g[b]}
    inside = [(a, b) for a, b in near_pairs(fp) if key[a] == key[b]]
    assert same(groups_of(160, zip(i.tolist(), j.tolist()))) == same(groups_of(160, inside))
    assert len(i) == 160 - len(set(groups_of(160, inside)))  # a forest: one edge for each but the roots


def test_index_prunes_groups():
    rng = np.random.default_rng(1)
    random = rng.integers(0, 2**63, (256, 2)).astype(np.uint64)
    g = simhash.GrayForest(np.zeros(256, np.int64), random)
    g.join(20)
    assert g.pruned > 0.5 * g.seen and g.seen < 0.8 * 256 * 255 / 2
    # 20 documents with 200 copies each: whole groups go
    copies = np.repeat(random[:20], 200, axis=0)
    copies[:, 0] ^= rng.integers(0, 8, 4000).astype(np.uint64)
    g = simhash.GrayForest(np.zeros(4000, np.int64), copies)
    a, _ = g.join(20)
    assert len(a) == 4000 - 20 and g.seen < 0.05 * 4000 * 3999 / 2


def test_nodes_with_too_many_are_split_and_lose_no_link(spark):
    fp = np.unique(np.concatenate([crowd(s, 400, 12) for s in range(4)]), axis=0)
    kinds = spark.createDataFrame([tuple(map(int, x)) for x in fp.view(np.int64)], "a bigint, b bigint")
    at = {tuple(map(int, x)): i for i, x in enumerate(fp.view(np.int64))}
    want = groups_of(len(fp), near_pairs(fp))
    for few in (0, 10**6):  # the list of such nodes is joined or broadcast
        found = simhash.links(kinds, len(fp), node=16, big=40, broadcast_nodes=few).collect()
        pairs = [(at[r.u.a, r.u.b], at[r.v.a, r.v.b]) for r in found]
        assert all(simhash.distance(fp[a], fp[b]) <= 20 for a, b in pairs)
        got = groups_of(len(fp), pairs)
        near = near_pairs(fp)
        assert np.mean([got[a] == got[b] for a, b in near]) >= 0.99
    assert len(set(want)) < len(fp)


def test_gray_rank_orders_as_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    code = np.stack([n >> np.uint64(2), (n << np.uint64(62))], axis=1)
    gray = np.stack([code[:, 0] ^ code[:, 0] >> np.uint64(1), code[:, 1] ^ (code[:, 1] >> np.uint64(1) | code[:, 0] << np.uint64(63))], axis=1)
    rank = simhash.gray_rank(gray)
    assert (rank == code).all()


def test_recall_against_brute_force_and_clean_documents(spark):
    rows, truth = [], {}
    for g in range(40):
        base = prose(100 + g, 150)
        for c in range(1 + g % 5):
            truth[len(rows)] = g
            rows.append((len(rows), base if c == 1 else edited(base, 0.03 * c, g * 10 + c)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.keep_id for r in simhash.groups(df).collect()}
    fp = simhash.fingerprints(pa.array([t for _, t in rows]))[0]
    d = simhash.distance(fp[:, None, :], fp[None, :, :])
    near = [(a, b) for a, b in zip(*np.nonzero(d <= simhash.DISTANCE)) if a < b]
    assert len(near) > 50
    assert np.mean([got.get(a) == got.get(b) is not None for a, b in near]) >= 0.9
    assert all(truth[d] == truth[k] for d, k in got.items())
    left = {r.doc_id for r in simhash.dedup(df).collect()}
    assert left == {d for d, _ in rows} - {d for d, k in got.items() if d != k}


def test_pairs_at_the_full_distance_share_a_table():
    for n in (10, 47_000, 240_000, 10**6, 14 * 10**6, 10**8):
        m, t = simhash.plan_tables(n)
        assert n / 2**m <= simhash.NODE
        hit = np.prod([(128 - simhash.DISTANCE - i) / (128 - i) for i in range(m)])
        assert 1 - (1 - hit) ** t >= 0.99
        rng = np.random.default_rng(n)
        a = rng.integers(0, 2**63, (1000, 2)).astype(np.uint64)
        flip = np.packbits(np.argsort(rng.random((1000, 128)), axis=1) < simhash.DISTANCE, axis=1).view(np.uint64)
        assert (simhash.distance(a, a ^ flip) == simhash.DISTANCE).all()
        assert (simhash.table_keys(a, m, t) == simhash.table_keys(a ^ flip, m, t)).any(axis=0).mean() >= 0.98
    assert simhash.plan_tables(1000, 0)[1] == 1


def at_distance(bits, n, seed):
    """n random fingerprints, and others that differ from them in so many bits."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**64, (n, 2), dtype=np.uint64)
    return a, a ^ np.packbits(np.argsort(rng.random((n, 128)), axis=1) < bits, axis=1).view(np.uint64)


def test_some_table_has_every_pair_within_its_block():
    for limit in (0, 1, 3, 18, 20, 50, 127, 128):
        a, b = at_distance(limit, 20_000, limit)
        for n in (10, 10**8, 10**9):
            m, t = simhash.plan_tables(n, limit)
            found = np.zeros(len(a), bool)
            for x, y, (_, block, most) in zip(simhash.table_keys(a, m, t, limit), simhash.table_keys(b, m, t, limit), simhash.masks(m, limit)):
                if len(block):
                    lead = (1 << 64) - (1 << 64 - min(64, len(block)))
                    u, v = (simhash.rotated(z, int(block[0])) for z in (a, b))
                    found |= (x == y) & (np.bitwise_count((u ^ v)[:, 0] & np.uint64(lead)) <= most)
                else:
                    found |= x == y
            assert found.all()


def test_no_pair_at_the_full_distance_is_lost(spark):
    a, b = at_distance(simhash.DISTANCE, 3000, 5)
    c, d = at_distance(simhash.DISTANCE + 1, 300, 6)
    fp = np.concatenate([a, b, c, d]).view(np.int64)
    kinds = spark.createDataFrame([tuple(map(int, x)) for x in fp], "a bigint, b bigint")
    at = {tuple(map(int, x)): i for i, x in enumerate(fp)}
    for sizes in ({}, {"node": 20}, {"big": 60}):  # planned nodes, smaller ones, nodes cut into slices
        found = {tuple(sorted((at[r.u.a, r.u.b], at[r.v.a, r.v.b]))) for r in simhash.links(kinds, len(fp), **sizes).collect()}
        assert found == {(i, i + 3000) for i in range(3000)}


def test_odd_rows(odd_docs, no_docs):
    out = {(r.doc_id, r.keep_id, r.group_size) for r in simhash.groups(odd_docs).collect()}
    assert out == {(1, 1, 2), (6, 1, 2), (7, 7, 2)}
    clash = odd_docs.selectExpr("*", *CLASHES)
    for few in (0, 10**6):
        left = simhash.dedup(clash, broadcast_rows=few)
        assert left.columns == clash.columns
        assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "2", "3", "4", "None", "5", "7", "8", "9", "None"])
    assert simhash.groups(no_docs).count() == 0 and simhash.dedup(no_docs).count() == 0
