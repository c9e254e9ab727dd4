from hypothesis import given, settings
from hypothesis import strategies as st

from dagbag.llm import sstable


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1), st.integers(0, 30)), st.one_of(st.none(), st.text(max_size=40))), min_size=1, max_size=80))
def test_lookup_matches_a_dictionary(rows):
    rows.sort(key=lambda r: sstable.key_of(r[0]))
    w = sstable.Writer(block_bytes=120)
    want = {}
    for i, t in rows:
        w.add(i, sstable.value_of(t, None, "s"))
        want.setdefault(i, []).append(t)
    shard = sstable.Shard(w.finish())
    assert shard.n_entries == len(rows)
    for i, ts in want.items():
        assert [x["text"] for x in shard.get(i)] == ts
    assert [k for k, _ in shard.scan()] == [sstable.key_of(i) for i, _ in rows]
    for i in (*range(-5, 40), None):
        if i not in want:
            assert shard.get(i) == []


def test_rows_of_one_identifier_fill_several_shards(spark):
    df = spark.createDataFrame([(7, f"text {i % 3}") for i in range(900)] + [(i, "x") for i in range(20)], "doc_id bigint, text string").selectExpr("*", "'en' as lang", "'s' as source")
    table = sstable.shards(df.repartition(4), shard_bytes=4000)
    rows = table.collect()
    assert len(rows) > 2 and sum(r.n_entries for r in rows) == 920
    found = sstable.lookup(table, [7]).collect()
    assert len(found) == 901 and sum(r.text == "text 1" for r in found) == 300
    spread = sorted((r.first_id, r.last_id) for r in rows)
    assert all(a[1] <= b[0] for a, b in zip(spread, spread[1:]))


def test_filter_keeps_most_strangers_out():
    w = sstable.Writer()
    for i in range(0, 4000, 2):
        w.add(i, b"\0\0\0")
    shard = sstable.Shard(w.finish())
    assert all(shard.may_have(i) for i in range(0, 4000, 2))
    assert sum(shard.may_have(i) for i in range(1, 4000, 2)) < 60


def test_shards_hold_all_rows_in_order(spark, odd_docs, no_docs):
    table = sstable.shards(odd_docs.selectExpr("*", "1 as content", "2 as shard"), block_bytes=200, shard_bytes=2000)
    rows = table.collect()
    back = [(k, sstable.fields_of(v)) for r in sorted(rows, key=lambda r: r.first_id if r.first_id is not None else -1) for k, v in sstable.Shard(bytes(r.content)).scan()]
    assert [k for k, _ in back] == sorted(k for k, _ in back)
    want = sorted((sstable.key_of(r.doc_id), str(r.lang), str(r.source), str(r.text)) for r in odd_docs.collect())
    assert sorted((k, str(v["lang"]), str(v["source"]), str(v["text"])) for k, v in back) == want
    found = sstable.lookup(table, [7, 5, 9, 1234]).collect()
    assert sorted(r.doc_id for r in found) == [5, 7, 7, 9]
    assert sstable.shards(no_docs).count() == 0
