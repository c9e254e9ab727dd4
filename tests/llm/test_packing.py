from collections import defaultdict

from dagbag.llm import packing
from tests.llm.conftest import CLASHES


def brute(rows, capacity, quadratic):
    """Dearest first, each to the cheapest sequence with room."""
    cost = lambda n: n + n * n / quadratic
    room = [capacity] * max(1, -(-sum(n for _, _, n in rows) // capacity))
    load, out = [0.0] * len(room), {}
    for key in sorted(rows, key=lambda r: (-cost(r[2]), r[0] is not None, r[0], r[1])):
        fit = [j for j in range(len(room)) if room[j] >= key[2]]
        j = min(fit, key=lambda j: (load[j], j)) if fit else len(room)
        if not fit:
            room.append(capacity), load.append(0.0)
        room[j] -= key[2]
        load[j] += cost(key[2])
        out[key[0], key[1]] = j
    return out


def test_greedy_matches_brute_force(spark):
    rows = [(i, "w " * ((i * 37) % 90 + 1)) for i in range(60)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=128, quadratic=64, shard_sequences=1000).collect()
    want = brute([(r.doc_id, r.piece, r.n_tokens) for r in got], 128, 64)
    assert {(r.doc_id, r.piece): r.sequence for r in got} == want


def check(rows, capacity):
    used, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        if r.n_tokens:
            used[r.shard, r.sequence] += r.n_tokens
            slots[r.shard, r.sequence].append(r.slot)
        else:
            assert r.sequence is None and r.slot is None
    assert max(used.values()) <= capacity
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows_and_long_documents(odd_docs):
    rows = packing.pack(odd_docs, capacity=1000, shard_sequences=8).collect()
    check(rows, 1000)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    long = sorted(by_doc[5], key=lambda r: r.piece)
    assert [r.token_start for r in long] == list(range(0, 60_000, 1000)) and sum(r.n_tokens for r in long) == 60_000
    assert len(by_doc[7]) == 2 and len(by_doc[None]) == 2 and by_doc[2][0].n_tokens == 0
    assert len({r.shard for r in rows}) > 1


def test_many_rows_of_one_id_and_size_go_to_all_shards(spark):
    df = spark.createDataFrame([(None, "a b c d")] * 3000 + [(i, "a b") for i in range(50)], "doc_id bigint, text string")
    rows = packing.pack(df, capacity=20, shard_sequences=10, crowded=100).collect()
    check(rows, 20)
    assert len(rows) == 3050 and sum(r.doc_id is None for r in rows) == 3000
    per_shard = defaultdict(int)
    for r in rows:
        per_shard[r.shard] += 1
    assert len(per_shard) > 50 and max(per_shard.values()) < 150


def test_empty_table_other_columns_and_own_counts(spark, no_docs, odd_docs):
    assert packing.pack(no_docs).count() == 0
    clash = odd_docs.selectExpr("*", *CLASHES)
    assert packing.pack(clash).count() == 13  # the long text makes two pieces
    counts = spark.createDataFrame([(1, 7), (2, 3)], "doc_id bigint, n_tokens bigint")
    assert {r.doc_id: r.n_tokens for r in packing.pack(None, counts=counts).collect()} == {1: 7, 2: 3}
