import random

import pytest

import corpus_pipeline
from dagbag.llm import queries
from tests.llm.conftest import SCHEMA, WORDS, prose


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Good and junk documents, copies, shared lines and leaked items."""
    folder = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(1)
    docs, labels = [], []

    def add(text, quality=None):
        docs.append((len(docs), text, "en", "s", len(text or "")))
        if quality is not None:
            labels.append((docs[-1][0], quality, 0))

    shared = prose(77, 12).replace("\n", " ")
    items = [(i, prose(400 + i, 18).replace("\n", " ")) for i in range(3)]
    for i in range(40):
        add(prose(i, 120), 1)
        add(" ".join(w + "###" for w in prose(900 + i, 60).split()), 0)
    for i in range(3):
        add(shared + "\n" + prose(200 + i, 100))  # 80 81 82: the line goes from two
    for i in range(3):
        add(" ".join(r.choice(WORDS) if r.random() < 0.02 else w for w in docs[0][1].replace("\n", " ").split(" ")))  # 83 84 85
    add(docs[2][1])  # 86
    for i in range(3):
        add(prose(300 + i, 90) + " " + items[i][1])  # 87 88 89
    add(items[0][1])  # 90
    add(None), add("")  # 91 92
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    good = stages["quality classifier"](spark, docs, sf_dir)
    assert good.columns == docs.columns
    junk = set(range(1, 80, 2))
    kept = {r.doc_id for r in good.collect()}
    assert not kept & junk and kept >= set(range(93)) - junk - {91, 92}
    lines = {r.doc_id: r for r in stages["line dedup"](spark, good, sf_dir).collect()}
    first = prose(77, 12).replace("\n", " ")
    assert [i for i in (80, 81, 82) if first in lines[i].text] == [80] and 86 not in lines
    assert all(r.n_chars == len(r.text) for r in lines.values())
    near = {r.doc_id for r in stages["simhash near-dedup"](spark, docs, sf_dir).collect()}
    assert len(near & {0, 83, 84, 85}) == 1 and len(near & {2, 86}) == 1 and {91, 92, 87, 88, 89, 80, 81, 82} <= near
    clean = {r.doc_id: r.text for r in stages["benchmark decontamination"](spark, docs, sf_dir).collect()}
    assert set(range(93)) - set(clean) == {90} and all(clean[87 + i].strip() == prose(300 + i, 90).strip() for i in range(3))
    packed = stages["packing"](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == 93


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {r.doc_id for r in rows}
    assert kept & set(range(1, 80, 2)) == set() and {4, 6, 8, 80, 81, 82, 87, 88, 89} <= kept
    assert not kept & {83, 84, 85, 86, 90}


def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    """What each stage's docstring says of nulls, empties, repeats and other columns."""
    odd = odd_docs.selectExpr("*", "1 as `a.b`", "2 as th", "3 as gone")
    ids = ["1", "2", "3", "4", "5", "6", "7", "7", "8", "9", "None", "None"]
    words = {"1", "5", "6", "7", "9", "None"}
    want = {
        "line dedup": sorted(set(ids) - {"6"}) + ["7", "None"],  # 6 is 1 again, 7 is given twice
        "simhash near-dedup": sorted(set(ids) - {"6"}) + ["None"],
        "benchmark decontamination": ids,
    }
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, no_docs, sf_dir)
        assert empty.count() == 0
        out = stage(spark, odd, sf_dir)
        got = out.collect()
        if name == "packing":
            assert sorted({str(r.doc_id) for r in got}) == sorted(set(ids)) and sum(r.n_tokens for r in got if r.doc_id == 5) == 60_000
            continue
        assert out.columns == odd.columns and empty.columns == no_docs.columns
        assert all(r.n_chars == len(r.text) for r in got if r.text is not None) or name in ("quality classifier", "simhash near-dedup")
        if name == "quality classifier":
            # odd ids are labelled bad there, so only what has no words is sure to go
            assert {str(r.doc_id) for r in got} <= words | {"8"} and got and all(r.text for r in got)
        else:
            assert sorted(str(r.doc_id) for r in got) == sorted(want[name])


SIZES = {  # rows of the fixture above, and what all of them must be
    "op1_packing": (93, lambda r: r.n_tokens == 0 or r.sequence is not None),
    "op2_toxicity": (93, lambda r: r.score == 0 and not r.toxic),  # no labels of toxic documents
    "op4_lm": (93, lambda r: (r.n_tokens == 0) == (r.mean_log_score is None)),
    "op9_quality": (93, lambda r: r.keep == (r.p_good >= 0.5)),
}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op8_warc"}))
def test_queries_run(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    if name in SIZES:
        n, holds = SIZES[name]
        assert len(rows) == n and all(map(holds, rows))
    elif name == "op10_sstable":
        assert sum(r.n_entries for r in rows) == 93
    elif name == "op3_linededup":
        assert {(81, 80), (82, 80), (86, 2)} <= {(r.doc_id, r.keep_id) for r in rows}
    elif name == "op7_decontaminate":
        assert {r.doc_id for r in rows} == {87, 88, 89, 90}
    else:  # copies are found
        pairs = {(r.doc_id, r.keep_id if name == "op5_simhash" else r.match_id) for r in rows}
        assert (86, 2) in pairs and {d for d, k in pairs if k == 0} >= {83, 84, 85}
