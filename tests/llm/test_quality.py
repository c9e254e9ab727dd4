import numpy as np
import pyarrow as pa

from dagbag.llm import quality
from dagbag.llm import text as tx
from tests.llm.conftest import CLASHES, prose


def corpus(n):
    good = [prose(i, 60) for i in range(n)]
    junk = [" ".join(w + "###" for w in prose(1000 + i, 60).split()) if i % 2 else " ".join(w for w in prose(2000 + i, 12).split() for _ in range(5)) for i in range(n)]
    return good + junk, np.array([1] * n + [0] * n)


def test_held_out_accuracy():
    texts, y = corpus(120)
    train = np.arange(len(y)) % 3 > 0
    model = quality.train([b for b, t in zip(quality.bags(pa.array(texts)), train) if t], y[train])
    p = model.score(pa.array(texts))
    assert ((p[~train] >= 0.5) == y[~train]).mean() > 0.97


def test_score_is_softmax_of_the_mean_embedding():
    texts, y = corpus(6)
    bags = quality.bags(pa.array(texts))
    model = quality.train(bags, y, epochs=2)
    z = np.array([(model.margin[f] * s).sum() for f, s in bags])
    assert np.allclose(model.score(pa.array(texts)), 1 / (1 + np.exp(-z)), atol=1e-5)


def plain_features(text):
    """Features of a text and how often each counts, without arrays."""
    tokens, count = text.split(), {}

    def add(f, by=1.0):
        count[f] = count.get(f, 0.0) + by

    for i, t in enumerate(tokens):
        raw = t.encode()
        data = np.frombuffer(raw, np.uint8)
        p = tx.prefix_hash(data)
        h = lambda a, b: int(tx.range_hash(p, np.array([a]), np.array([b]))[0])  # noqa: B023, E731
        add(h(0, len(raw)) >> 64 - quality.BITS)
        for n in quality.NGRAMS:
            for a in range(len(raw) - n + 1):
                mark = (a == 0) + 2 * (a == len(raw) - n)
                add(int(tx.splitmix(np.array([(h(a, a + n) + mark + n) % 2**64], np.uint64))[0]) >> 64 - quality.BITS)
        if i and tokens[i - 1] == t:
            add(quality.REPEAT, quality.REPEAT_SHARE)
    return count


def test_bags_match_plain_counting():
    for text in (prose(3, 50), "aa aa aa b", "élan élan ab abc", "x"):
        want = plain_features(text)
        ((f, share),) = quality.bags(pa.array([text]))
        total = sum(want.values())
        got = dict(zip(f.tolist(), share.tolist()))
        assert {k for k, v in got.items() if v > 0} == set(want)
        assert all(np.isclose(got[k], v / max(1.0, total), atol=1e-6) for k, v in want.items())


def test_training_follows_the_gradient_of_softmax_loss():
    """One document, one step: against a numeric gradient of an independent loss."""
    ((f, share),) = quality.bags(pa.array(["ab cd ab"]), 8)
    bits, dim, seed = 8, 4, 7
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32).astype(float)
    out = rng.uniform(-0.1, 0.1, (dim, 2)).astype(np.float32).astype(float)

    def loss(table, out, y):
        z = sum(s * table[k] for k, s in zip(f, share)) @ out
        return np.log(np.exp(z).sum()) - z[y]

    order = [0, 1]
    for y in order:
        grad = np.zeros_like(out)
        for i in np.ndindex(out.shape):
            step = np.zeros_like(out)
            step[i] = 1e-5
            grad[i] = (loss(table, out + step, y) - loss(table, out - step, y)) / 2e-5
        rows = np.zeros((len(f), dim))
        for k, j in np.ndindex(rows.shape):
            step = np.zeros_like(table)
            step[f[k], j] = 1e-5
            rows[k, j] = (loss(table + step, out, y) - loss(table - step, out, y)) / 2e-5
        h = sum(s * table[k] for k, s in zip(f, share))
        prob = np.exp(h @ out) / np.exp(h @ out).sum()
        g = -prob
        g[y] += 1
        assert np.allclose(grad, -np.outer(h, g), atol=1e-6) and np.allclose(rows, -share[:, None] * (out @ g)[None, :], atol=1e-6)
    # the same steps, in the trainer's order, by hand
    samples, y = [(f, share), (f, share)], np.array([0, 1])
    model = quality.train(samples, y, bits, dim, epochs=1, rate=0.5, seed=seed)
    perm = np.random.default_rng(seed)
    perm.uniform(-1 / dim, 1 / dim, (1 << bits, dim)), perm.uniform(-0.1, 0.1, (dim, 2))
    for step, i in enumerate(perm.permutation(2)):
        lr = 0.5 * (1 - step / 2)
        h = sum(s * table[k] for k, s in zip(f, share))
        prob = np.exp(h @ out) / np.exp(h @ out).sum()
        g = -prob
        g[y[i]] += 1
        back = out @ g
        out = out + lr * np.outer(h, g)
        table[f] += (lr * share / share.max())[:, None] * back
    assert np.allclose(model.margin, table @ (out[:, 1] - out[:, 0]), atol=1e-4)


def test_fit_and_keep(spark):
    texts, y = corpus(40)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, p_good bigint")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(None, 1), (3, None), (4, 1)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.keep for r in quality.score(docs, model).collect()}
    assert got == {i: bool(v) for i, v in enumerate(y)}
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, v in enumerate(y) if v}
    # the sample is bounded
    assert quality.fit(docs, labels, per_class=3) is not None


def test_labelled_documents_without_tokens_teach_nothing(spark):
    texts, y = corpus(20)
    rows = list(enumerate(texts)) + [(900, ""), (901, None), (902, " \n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(900, 1), (901, 0), (902, 1)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    assert np.isfinite(model.margin).all()
    got = {r.doc_id: r.keep for r in quality.score(docs, model).collect()}
    assert np.mean([got[i] == bool(v) for i, v in enumerate(y)]) > 0.95 and not any(got[i] for i in (900, 901, 902))


def test_odd_rows_and_no_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.fit(odd_docs, none) is None
    assert all(r.p_good == 1.0 and r.keep for r in quality.score(odd_docs, None).collect())
    texts, y = corpus(10)
    model = quality.train(quality.bags(pa.array(texts)), y)
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == 12 and sum(r.doc_id is None for r in rows) == 2
    assert all(r.p_good == 0.0 for r in rows if r.doc_id in (2, 3, 4))
    clash = odd_docs.selectExpr("*", *CLASHES)
    assert sorted(map(str, quality.score(clash, model).collect())) == sorted(map(str, rows))
    kept = quality.keep_good(clash, model)
    assert kept.columns == clash.columns and kept.count() == sum(r.keep for r in rows)
    assert quality.score(no_docs, model).count() == 0 and quality.keep_good(no_docs, model).count() == 0
