import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from dagbag.llm import linededup
from tests.llm.conftest import CLASHES, prose


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def mutate(s, k, r):
    s = list(s)
    for _ in range(k):
        i = r.randrange(len(s))
        op = r.randrange(3)
        if op == 0:
            s[i] = r.choice("abé")
        elif op == 1:
            s.insert(i, r.choice("abé"))
        else:
            del s[i]
    return "".join(s)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4))
def test_banded_distance(seed, k):
    r = random.Random(seed)
    pairs = []
    while len(pairs) < 30:
        a = "".join(r.choice("abé") for _ in range(r.randrange(k + 3, 40)))
        b = mutate(a, r.randrange(0, k + 3), r)
        if abs(len(a) - len(b)) <= k < len(b):
            pairs.append((a, b))
    both = [a for a, _ in pairs] + [b for _, b in pairs]
    size = np.array([len(x) for x in both])
    start = np.cumsum(size) - size
    codes = np.frombuffer("".join(both).encode("utf-32-le"), np.uint32)
    n = len(pairs)
    got = linededup.bounded_distance(codes, start[:n], size[:n], start[n:], size[n:], k)
    assert got.tolist() == [min(lev(a, b), k + 1) for a, b in pairs]


def linked(x, key, line):
    """Pairs of line hashes under a key, one of them by a segment."""
    found, by_key = set(), {}
    for k, l in zip(key.tolist(), line.tolist()):
        by_key.setdefault(k >> 2, []).append((l, k & 1))
    for v in by_key.values():
        found |= {frozenset((p, q)) for p, _ in v for q, index in v if index and p != q}
    return found


def near_pairs(lines, k, per_edit):
    return {(i, j) for i in range(len(lines)) for j in range(i) if lev(lines[i], lines[j]) <= min(k, min(len(lines[i]), len(lines[j])) // per_edit)}


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3), st.integers(2, 5))
def test_no_pair_is_missed(seed, k, per_edit):
    r = random.Random(seed)
    lines = ["".join(r.choice("ab") for _ in range(r.randrange(k + 1, 14))) for _ in range(40)]
    lines = sorted({x for x in lines + [mutate(x, r.randrange(1, k + 1), r) for x in lines] if x})
    x = linededup.Lines(pa.array(["\n".join(lines)]))
    key, line = linededup.entries(x, k, per_edit)
    at = linededup.shared_keys(key, line)
    h = [int(v) for v in x.hash]
    assert {frozenset((h[i], h[j])) for i, j in near_pairs(lines, k, per_edit)} <= linked(x, key[at], line[at])


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3))
def test_no_pair_is_missed_when_keys_are_split(seed, k):
    r = random.Random(seed)
    lines = ["".join(r.choice("ab") for _ in range(r.randrange(14, 18))) for _ in range(12)] + [f"order {r.randrange(10**4)} has been sent" for _ in range(12)]
    lines = sorted({x for x in lines + [mutate(x, r.randrange(1, k + 1), r) for x in lines]})
    x = linededup.Lines(pa.array(lines))
    assert len(x.size) == len(lines)
    key, line = linededup.entries(x, k, 3)
    row_of = {int(h): i for i, h in enumerate(x.hash)}
    rows = np.array([row_of[int(h)] for h in line])
    # every row of every key, given once
    pick = np.unique(np.stack([rows.astype(np.uint64), key >> np.uint64(2)], axis=1), axis=0)
    given_, bare = pick[:, 0].astype(np.int64), pick[:, 1]
    y = linededup.Lines(pa.array([lines[i] for i in given_]))
    row, role, slots = linededup.first_slots(y, bare, k, 3)
    want = {frozenset((int(x.hash[i]), int(x.hash[j]))) for i, j in near_pairs(lines, k, 3)}
    keys = bare[row]
    for _ in range(linededup.ROUNDS):
        row, keys, role, slots, final = linededup.split(y, row, keys, role, slots)
        assert want <= linked(y, keys << np.uint64(2) & ~np.uint64(3) | role.astype(np.uint64), y.hash[row])
        u = np.unique(np.concatenate([row[:, None], keys.view(np.int64)[:, None], role[:, None], slots.reshape(len(row), -1)], axis=1), axis=0, return_index=True)[1]
        row, keys, role, slots = row[u], keys[u], role[u], slots[u]
        if len(row) > 200_000:
            break


def brute(rows, edits, per_edit=8):
    """(doc, line, keep doc, keep line) over (doc, text) in order."""
    lines = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if any(ord(c) > 32 for c in x)]
    first = {}
    for d, i, x in lines:
        first.setdefault(x, (d, i))
    out = set()
    for d, i, x in lines:
        near = [first[y] for y in first if y != x and abs(len(x) - len(y)) <= edits and first[y] < first[x] and lev(x, y) <= min(edits, min(len(x), len(y)) // per_edit)]
        if near:
            out.add((d, i, *min(near)))
        elif first[x] != (d, i):
            out.add((d, i, *first[x]))
    return out


def test_matches_brute_force(spark):
    r = random.Random(5)
    pool = [prose(i, 8) for i in range(25)]
    rows = [(d, "\n".join(r.choice([x, mutate(x, r.randrange(1, 4), r), x[:10], ""]) for x in r.choices(pool, k=6))) for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows, 2)
    assert len(want) > 60
    # candidates joined or broadcast; keys of more than 3 lines split; keys of many lines kept out of buckets
    for more in ({"broadcast_lines": 0}, {}, {"hot": 3}, {"flush": 64, "hot": 5, "heavy": 2}):
        got = {tuple(x)[:4] for x in linededup.report(df, **more).collect()}
        assert got == want
    kept = {x.doc_id: x.text for x in linededup.clean(df).collect()}
    gone = {(d, i) for d, i, *_ in want}
    for d, t in rows:
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        assert kept.get(d, "") == (left if left.strip() or t.strip() == "" else "")


def test_short_lines_have_fewer_edits(spark):
    texts = ["See also the index", "See also the indez", "Part one", "Part onz", "Chapter", "Chaptes", "abcdefghijklmnop", "abcdefghijklmnXX"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {(r.doc_id, r.keep_id, r.edits) for r in linededup.report(df).collect()} == {(1, 0, 1), (3, 2, 1), (7, 6, 2)}


def test_very_many_lines_share_a_segment(spark):
    """100 000 lines of a template: all but the number is alike."""
    r = random.Random(3)
    numbers = sorted({r.randrange(10**10) for _ in range(100_000)})
    known = [f"Order number {n:010d} has been sent to you" for n in numbers]
    twins = [x[:15] + ("0" if x[15] != "0" else "1") + x[16:] for x in known[::5000]]
    rows = [(i, "\n".join(known[i * 1000 : i * 1000 + 1000])) for i in range(100)] + [(100, "\n".join(twins))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = {(x.doc_id, x.line): (x.keep_id, x.keep_line, x.edits) for x in linededup.report(df).collect()}
    for k in range(len(twins)):
        i = k * 5000
        assert (100, k) in got and got[100, k] <= (i // 1000, i % 1000, 2)
    # by deletions of two characters: numbers within two edits share one
    seen, near = {}, set()
    for i, n in enumerate(numbers):
        d = f"{n:010d}"
        for v in {d[:a] + d[a + 1 : b] + d[b + 1 :] for a in range(10) for b in range(a + 1, 10)}:
            near |= {(i, j) for j in seen.get(v, ())}
            seen.setdefault(v, []).append(i)
    want = {i for i, j in near if lev(f"{numbers[i]:010d}", f"{numbers[j]:010d}") <= 2}
    assert {d * 1000 + line for d, line in got if d < 100} == want


def test_blocks_follow_the_corpus():
    for lines in (10**3, 10**6, 10**8, 10**10, 5 * 10**11):
        size, buckets = linededup.plan(lines)
        rows = 12 * lines / size * buckets
        assert rows <= max(4, 2 * 12 * lines / linededup.ROW_KEYS) and size <= 30_000_000


def test_odd_rows(spark, odd_docs, no_docs):
    out = linededup.report(odd_docs).collect()
    assert {(r.doc_id, r.keep_id) for r in out} == {(6, 1)}
    clash = odd_docs.selectExpr("*", *CLASHES)
    kept = linededup.clean(clash)
    assert kept.columns == clash.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(["1", "2", "3", "4", "None", "5", "7", "7", "8", "9", "None"])
    assert linededup.report(no_docs).count() == 0 and linededup.clean(no_docs).count() == 0
    long = next(r.text for r in odd_docs.collect() if r.doc_id == 5)
    assert next(r.text for r in kept.collect() if r.doc_id == 5) == long
