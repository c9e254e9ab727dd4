"""Quality classifier: supervised subword embeddings.

Every white-space token has a vector, and so has each of its byte n-grams
(lengths 3 and 4, with marks for the token's ends); all are hashed into one
table.  A token that repeats the one before it adds the vector of a mark, which
counts as ``REPEAT_SHARE`` features.  A document is the mean of the vectors of all its tokens and n-grams;
softmax over two classes; trained by stochastic gradient descent in numpy on a
bounded sample of labelled documents.

As the mean is linear, the output weights are multiplied into the table once
after training: scoring looks up one number a feature, and n-grams are made
only for the different tokens of a batch.  The scores are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagbag.llm import frames
from dagbag.llm import text as tx

BITS = 17
DIM = 12
NGRAMS = (3, 4)
#: Bound of the training sample: labelled documents of each class.
PER_CLASS = 1200
EPOCHS = 12
RATE = 0.6
#: Feature of a token that repeats its predecessor, and how much it counts.
REPEAT, REPEAT_SHARE = 0, 4.0
#: Documents whose probability of good quality is below this are rejected.
THRESHOLD = 0.5


def token_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray, p: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, token) pairs of tokens data[start:end]: the word and its n-grams."""
    shift = np.uint64(64 - bits)
    own = np.arange(len(start))
    feats, owners = [word >> shift], [own]
    size = end - start
    for n in NGRAMS:
        count = np.maximum(size - n + 1, 0)
        owner = np.repeat(own, count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        a = start[owner] + at
        h = tx.range_hash(p, a, a + n)
        ends = (at == 0).astype(np.uint64) + np.uint64(2) * (at == count[owner] - 1).astype(np.uint64)
        feats.append(tx.splitmix(h + ends + np.uint64(n)) >> shift)
        owners.append(owner)
    return np.concatenate(feats).astype(np.int64), np.concatenate(owners)


def _distinct(texts: pa.Array):
    """Words of the texts, their different tokens and each word's token."""
    w = tx.words(texts, "space")
    p = tx.prefix_hash(w.data)
    h = tx.range_hash(p, w.start, w.end)
    kinds, first, token = np.unique(h, return_index=True, return_inverse=True)
    again = np.zeros(len(h))
    again[1:] = h[1:] == h[:-1]
    heads = w.first[:-1]
    again[heads[heads < len(h)]] = 0
    return w, p, kinds, first, token, tx.sum_by_doc(again, w.first)


def bags(texts: pa.Array, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its features and their shares (which sum to 1)."""
    w, p, kinds, first, token, again = _distinct(texts)
    feats, owner = token_features(w.data, w.start[first], w.end[first], kinds, p, bits)
    order = np.argsort(owner, kind="stable")
    feats = feats[order]
    border = np.searchsorted(owner[order], np.arange(len(kinds) + 1))
    out = []
    for d in range(len(w.first) - 1):
        ts, n = np.unique(token[w.first[d] : w.first[d + 1]], return_counts=True)
        size = border[ts + 1] - border[ts]
        at = np.repeat(border[ts] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        f, inv = np.unique(np.append(feats[at], REPEAT), return_inverse=True)
        share = np.bincount(inv, weights=np.append(np.repeat(n, size), REPEAT_SHARE * again[d]), minlength=len(f))
        out.append((f.astype(np.int32), (share / max(1.0, share.sum())).astype(np.float32)))
    return out


@dataclass
class Model:
    """``margin[f]``: what feature f adds to logit(good) - logit(bad)."""

    margin: np.ndarray
    bits: int = BITS

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of good quality; of a text without tokens 0."""
        w, p, kinds, first, token, again = _distinct(texts)
        feats, owner = token_features(w.data, w.start[first], w.end[first], kinds, p, self.bits)
        total = np.bincount(owner, weights=self.margin[feats], minlength=len(kinds))
        count = np.bincount(owner, minlength=len(kinds))
        n = tx.sum_by_doc(count[token], w.first) + REPEAT_SHARE * again
        z = (tx.sum_by_doc(total[token], w.first) + REPEAT_SHARE * again * self.margin[REPEAT]) / np.maximum(n, 1)
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -60, 60))), 0.0)


def train(samples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model | None:
    """Fit embeddings and output weights; None where a class has no sample.

    Classes count alike, whatever their sizes.
    """
    y = np.asarray(y, dtype=np.int64)
    if len(np.unique(y)) < 2:
        return None
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out = rng.uniform(-0.1, 0.1, (dim, 2)).astype(np.float32)
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    weight = np.minimum(weight, 5.0).astype(np.float32)
    step, steps = 0, epochs * len(y)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f, share = samples[i]
            lr = rate * weight[y[i]] * (1 - step / steps)
            step += 1
            if not share.any():  # no tokens
                continue
            rows = table[f]
            hidden = share @ rows
            z = hidden @ out
            prob = np.exp(z - z.max())
            prob /= prob.sum()
            g = -prob
            g[y[i]] += 1
            back = out @ g
            out += lr * np.outer(hidden, g)
            # shares are tiny, so rows move by share over the largest share
            table[f] = rows + (lr * share / share.max())[:, None] * back[None, :]
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float32), bits)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Model | None:
    """Train on at most ``per_class`` labelled documents of each class (1 is good).

    Of an id that several rows have the least text is used.
    """
    chosen = frames.first_labels(labels, label, per_class, id_col)
    rows = frames.inputs(docs, (id_col, "bigint"), (text_col, "string")).toDF("id", "text")
    rows = rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # at most 2 * per_class rows

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        found = bags(b.column(b.schema.get_field_index("text")))
        return pa.RecordBatch.from_arrays(
            [b.column(b.schema.get_field_index("id")), b.column(b.schema.get_field_index("y")), pa.array([f.tobytes() for f, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())],
            ["id", "y", "f", "s"],
        )

    got = frames.with_text(rows, make, "id bigint, y int, f binary, s binary").toArrow().sort_by([("id", "ascending"), ("f", "ascending")])
    samples = [(np.frombuffer(f.as_py(), np.int32), np.frombuffer(s.as_py(), np.float32)) for f, s in zip(got["f"], got["s"])]
    return train(samples, got["y"].to_numpy())


def _scores(model, texts: pa.Array) -> np.ndarray:
    return model.score(texts) if model else np.ones(len(texts))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_good, keep) of every row.

    Null and empty texts have p_good 0; a p_good of just ``threshold`` is kept; a
    text of any length is scored whole.  Without a model (no labelled document
    of some class) every row has p_good 1.  Null ids stay null, repeated rows
    are scored each, other columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        p = _scores(shared.value, b.column(1))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(p >= threshold)], ["doc_id", "p_good", "keep"])

    rows = frames.inputs(docs, (id_col, "bigint"), (text_col, "string"))
    return frames.with_text(rows, make, "doc_id bigint, p_good double, keep boolean", text_col)


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`score` would keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(_scores(shared.value, pc.cast(b.column(at), pa.string())) >= threshold))

    return frames.with_text(docs, make, docs.schema, text_col)
