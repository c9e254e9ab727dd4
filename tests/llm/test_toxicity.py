import numpy as np
import pyarrow as pa

from dagbag.llm import frames, toxicity
from dagbag.llm import text as tx
from tests.llm.conftest import CLASHES, prose

BAD = ["scumbug", "moronic", "trashman", "vequla", "vequta", "vequir"]


def toxic(seed):
    words = prose(seed, 70).split(" ")
    r = np.random.default_rng(seed)
    for w in r.choice(BAD, 4):
        words.insert(int(r.integers(1, len(words))), w)
    return " ".join(words)


def corpus(n):
    return [toxic(i) for i in range(n)] + [prose(5000 + i, 70) for i in range(2 * n)], np.array([1] * n + [0] * 2 * n)


def tagged(texts, model):
    """{number: spans} of the toxic texts."""
    score, toxic, n_tokens, n_toxic, spans = (c.to_pylist() for c in toxicity.tag(pa.array(texts), model))
    return {i: spans[i] for i in range(len(texts)) if toxic[i]}


def test_marginals_match_the_textbook_recursion():
    rng = np.random.default_rng(1)
    first = np.array([0, 5, 5, 400, 401, 1000])
    psi, trans = np.exp(rng.normal(-1, 2, 1000)), np.array([0.05, 0.7, 0.9])
    o = toxicity.odds(psi, first, trans) * toxicity.odds_back(psi, first, trans)
    a = np.array([[1, trans[0]], [trans[1], trans[2]]])
    for s, e in zip(first[:-1], first[1:]):
        forward, v = [], np.array([1.0, 0.0])
        for t in range(s, e):
            v = (v @ a) * [1, psi[t]]
            v /= v.sum()
            forward.append(v)
        v = np.ones(2)
        for t in range(e - 1, s - 1, -1):
            both = forward[t - s] * v
            assert np.isclose(both[1] / both.sum(), o[t] / (1 + o[t]))
            v = a @ (np.array([1, psi[t]]) * v)
            v /= v.sum()


def test_held_out_documents_and_offsets():
    texts, y = corpus(120)
    train = np.arange(len(y)) % 3 > 0
    model = toxicity.fit_texts(pa.array([t for t, k in zip(texts, train) if k]), y[train])
    held = [t for t, k in zip(texts, train) if not k]
    found = tagged(held, model)
    truth = y[~train]
    assert np.mean([i in found for i in np.flatnonzero(truth)]) > 0.95
    assert np.mean([i in found for i in np.flatnonzero(truth == 0)]) < 0.02
    words = {w.strip(".,\n") for i in found for s in found[i] for w in held[i][s["start"] : s["end"]].split()}
    assert words <= set(BAD)


def test_copies_of_a_toxic_text_dont_make_its_words_toxic():
    texts, y = corpus(60)
    rare = toxic(999) + " quixotic zebra unicorn"
    copies = [rare.replace("per", "lok", i) for i in range(40)]
    model = toxicity.fit_texts(pa.array(texts + copies), np.concatenate([y, np.ones(40, int)]))
    assert tagged(["a quixotic zebra unicorn " + prose(7, 30)], model) == {}


def test_scores_follow_from_the_marginals():
    texts, y = corpus(60)
    model = toxicity.fit_texts(pa.array(texts), y)
    some = ["", toxic(7), "vequla", prose(1, 30), "  ", toxic(8) + " moronic"]
    w = tx.words(pa.array(some))
    p = model.marginals(toxicity.Tokens.of(w).features(model.bits), w.first)
    score, bad, n_tokens, n_toxic, spans = (c.to_pylist() for c in toxicity.tag(pa.array(some), model))
    for d in range(len(some)):
        mine = p[w.first[d] : w.first[d + 1]].tolist()
        runs = [[]]
        for x in mine:
            runs[-1].append(x) if x >= 0.5 else runs.append([])
        highs = [max(r) for r in runs if r]
        assert n_tokens[d] == len(mine) and n_toxic[d] == sum(x >= 0.5 for x in mine) and np.allclose([s["p"] for s in spans[d]], highs)
        want = 1 - np.prod([1 - h for h in highs]) if highs else max(mine, default=0)
        assert np.isclose(score[d], want) and bad[d] == (score[d] >= 0.9)


def test_sample_is_bounded_by_rows_and_bytes(spark):
    texts, y = corpus(40)
    texts[0] += " " + prose(3, 40_000)  # a very long one is used, too
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, "a")] * 30, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id bigint, toxic int")
    whole = frames.sample(docs, labels, "toxic", (100, 100), (1 << 30, 1 << 30))
    assert whole.num_rows == len(texts) and max(map(len, whole["text"].to_pylist())) == len(texts[0])
    assert frames.sample(docs, labels, "toxic", (5, 3), (1 << 30, 1 << 30)).num_rows == 8
    few = frames.sample(docs, labels, "toxic", (100, 100), (2000, 2000)).to_pylist()
    for c in (0, 1):
        sizes = [len(r["text"]) for r in few if r["y"] == c]
        assert sizes and sum(sizes) - max(sizes) < 2000


def test_odd_rows(spark, odd_docs, no_docs):
    texts, y = corpus(60)
    model = toxicity.fit_texts(pa.array(texts), y)
    clash = odd_docs.selectExpr("*", *CLASHES)
    out = toxicity.score(clash, model).collect()
    assert len(out) == 12 and not any(r.toxic for r in out) and sum(r.doc_id is None for r in out) == 2
    assert all(r.score == 0 and r.spans == [] and r.n_tokens == 0 for r in out if r.doc_id in (2, 3, 4))
    assert next(r.n_tokens for r in out if r.doc_id == 5) == 60_000
    assert all(r.score == 0 and not r.toxic for r in toxicity.score(odd_docs, None).collect())
    assert toxicity.score(no_docs, model).count() == 0
    bad = "ÉÉ moronic vequla, " + prose(1, 20) + " scumbug!"
    rows = spark.createDataFrame([(None, bad, 1), (7, bad, 2), (7, bad, 2)], "doc_id bigint, text string, score int")
    out = toxicity.score(rows, model).collect()
    assert sorted(str(r.doc_id) for r in out if r.toxic) == ["7", "7", "None"]
    assert {bad[s.start : s.end] for s in out[0].spans} == {"moronic vequla", "scumbug"}


def test_fit_needs_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert toxicity.fit(docs, spark.createDataFrame([(1, 1), (None, 0)], "doc_id bigint, toxic int")) is None
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int")) is None
    texts, y = corpus(40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id bigint, toxic int")
    assert toxicity.fit(docs, labels) is not None
