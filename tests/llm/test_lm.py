import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dagbag.llm import lm
from tests.llm.conftest import CLASHES


def brute(rows):
    """Each word by the counts of all other occurrences."""
    words = [re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (t or "").lower()) for _, t in rows]
    c = Counter(tuple(w[i - n + 1 : i + 1]) for w in words for n in (1, 2, 3) for i in range(n - 1, len(w)))
    total = sum(map(len, words))
    out = []
    for w in words:
        s = 0.0
        for i in range(len(w)):
            tri, bi = tuple(w[i - 2 : i + 1]), tuple(w[i - 1 : i + 1])
            if i >= 2 and c[tri] - 1 > 0:
                s += math.log((c[tri] - 1) / (c[tri[:2]] - 1))
            elif i >= 1 and c[bi] - 1 > 0:
                s += math.log((c[bi] - 1) / (c[bi[:1]] - 1)) + (math.log(0.4) if i >= 2 else 0)
            else:
                s += math.log(max(c[w[i],] - 1, 1) / max(total - 1, 1)) + math.log(0.4) * min(i, 2)
        out.append((len(w), s))
    return out


def test_matches_brute_force_with_many_chunks_and_buckets(spark, odd_docs):
    more = spark.createDataFrame([(20, "Привет МИР, привет мир! ΣΟΦΙΑ σοφια Éa éA"), (21, "привет МИР σοφια"), (21, "привет МИР σοφια"), (22, "x"), (None, "x")], "doc_id bigint, text string")
    df = odd_docs.selectExpr("*", *CLASHES).unionByName(more, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = lm.score(df, chunk_tokens=3000, bucket_keys=2000).collect()
    key = lambda x: (str(x[0]), x[1], round(x[2], 4))
    want = sorted(key((d, n, s)) for (d, _), (n, s) in zip(rows, brute(rows)))
    assert sorted(key((r.doc_id, r.n_tokens, r.log_score)) for r in got) == want
    for r in got:
        assert r.mean_log_score is None if r.n_tokens == 0 else math.isclose(r.mean_log_score, r.log_score / r.n_tokens)


def test_rows_follow_the_corpus_and_not_its_square():
    for total in (1, 10**5, 10**8, 5 * 10**9, 10**11, 17 * 10**12):
        chunks, bits = lm.plan(total)
        keys = lm.CHUNK_KINDS * total
        assert chunks << bits <= max(4, 2 * keys / lm.ROW_KEYS)
        assert total / chunks <= max(lm.CHUNK_TOKENS, 30_000_000)
    assert lm.plan(0) == (1, 0)


def test_repeated_rows_are_dealt_to_all_chunks(spark):
    df = spark.createDataFrame([(1, "a b c d")] * 400 + [(i, f"e f {i}") for i in range(100)], "doc_id bigint, text string")
    got = lm.score(df, chunk_tokens=100, bucket_keys=10).collect()
    want = dict(zip(["1", "x"], [brute([(1, "a b c d")] * 400 + [(i, f"e f {i}") for i in range(100)])[i][1] for i in (0, 450)]))
    assert len(got) == 500 and sum(round(r.log_score, 6) == round(want["1"], 6) for r in got if r.doc_id == 1) == 400


def test_empty_table(no_docs):
    assert lm.score(no_docs).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**60), min_size=1, max_size=50), st.lists(st.integers(1, 1000), max_size=50))
def test_packed_blocks_come_back(keys, counts):
    k = np.array(sorted(keys), np.uint64)
    assert (lm.unpack_keys(lm.pack_keys(k)) == k).all()
    c = np.array(counts, np.int64)
    assert (lm.unpack_counts(lm.pack_counts(c), len(c)) == c).all()
