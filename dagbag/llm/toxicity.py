"""Toxic spans by a linear-chain conditional random field.

Two labels, toxic and other.  The emission of a token is a sum of learned
weights of hashed features (the word, its first 3, 4 and 5 bytes, its last 3,
the words beside it); the chain has weights for the four transitions.  Training
maximises the conditional likelihood of labelled tokens, with exact gradients
from the forward-backward pass; scoring computes the same marginals for every
token of every document.

With two labels each forward or backward step is a fractional linear map of one
number, the odds.  Maps compose, so a document is cut into lanes of ``LANE``
tokens: lanes are composed side by side, their starts follow from the composed
maps, and a second pass fills in the odds.  That is exact and takes as many
numpy steps for one very long text as for a thousand short ones.

Where only documents are labelled, :func:`token_labels` derives token labels: a
token of a toxic document is toxic where its word or one of its beginnings
hardly occurs in clean documents but does, between different neighbours, in
toxic ones.  Counting neighbours instead of documents keeps the ordinary words
of a toxic text with many copies from being taken for toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagbag.llm import frames
from dagbag.llm import text as tx

BITS = 21
LANE = 128
PREFIXES = (3, 4, 5)
#: Bounds of the training sample, for each class (other, toxic): labelled documents,
#: and bytes of text, after which no further document is taken.
PER_CLASS = (3500, 1200)
SAMPLE_BYTES = (36 << 20, 18 << 20)
EPOCHS = 5
#: A token of this marginal or more is in a span; a document of this score or
#: more is toxic.
THRESHOLD, DOC_THRESHOLD = 0.5, 0.9


@dataclass
class Tokens:
    """Hashes of the words of texts, of their beginnings and of their ends;
    ``first[d]:first[d+1]`` are those of text d."""

    first: np.ndarray
    word: np.ndarray
    heads: list[np.ndarray]
    tail: np.ndarray

    @classmethod
    def of(cls, w: tx.Words) -> Tokens:
        p = tx.prefix_hash(w.data)
        heads = [tx.range_hash(p, w.start, np.minimum(w.end, w.start + k)) for k in PREFIXES]
        return cls(w.first, tx.range_hash(p, w.start, w.end), heads, tx.range_hash(p, np.maximum(w.start, w.end - 3), w.end))

    @classmethod
    def of_many(cls, texts: pa.Array) -> Tokens:
        """The same, by pieces: arrays of eight bytes a character stay small."""
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [cls.of(tx.words(p.column(0))) for p in tx.pieces([batch], limit=1 << 20)]
        if not parts:
            parts = [cls.of(tx.words(texts))]
        size = np.concatenate([np.diff(p.first) for p in parts])
        join = lambda xs: np.concatenate(list(xs))
        return cls(np.concatenate([[0], np.cumsum(size)]), join(p.word for p in parts), [join(p.heads[i] for p in parts) for i in range(len(PREFIXES))], join(p.tail for p in parts))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def features(self, bits: int) -> list[np.ndarray]:
        """Feature numbers of every token, one array a template."""
        shift = np.uint64(64 - bits)
        edge = np.zeros(len(self.word), bool)
        edge[self.first[:-1][np.diff(self.first) > 0]] = True
        before, after = np.roll(self.word, 1), np.roll(self.word, -1)
        before[edge] = 0
        after[np.roll(edge, -1)] = 0
        return [(tx.splitmix(h + np.uint64(i + 1)) >> shift).astype(np.int32) for i, h in enumerate([self.word, *self.heads, self.tail, before, after])]


@dataclass
class Lanes:
    """Tokens of several texts cut into lanes, longest lanes first."""

    start: np.ndarray  # first token of each lane
    size: np.ndarray
    rank: np.ndarray  # number of the lane within its text
    before: np.ndarray  # lane (by place in this order) that it continues, or -1
    active: np.ndarray  # how many lanes are longer than t

    @classmethod
    def of(cls, first: np.ndarray) -> Lanes:
        n = np.diff(first)
        lanes = -(-n // LANE)
        text = np.repeat(np.arange(len(n)), lanes)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = first[text] + rank * LANE
        size = np.minimum(LANE, first[text + 1] - start)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(rank > 0, place[np.maximum(np.arange(len(text)) - 1, 0)], -1)
        size = size[order]
        active = np.searchsorted(-size, -np.arange(1, LANE + 1), side="right")
        return cls(start[order], size, rank[order], before[order], active)


def odds(psi: np.ndarray, first: np.ndarray, trans: np.ndarray, lanes: Lanes | None = None) -> np.ndarray:
    """Forward odds of toxic against other after each token.

    ``trans`` has the factors (other to toxic, toxic to other, toxic to toxic);
    other to other counts 1.  Every text starts from other.
    """
    ot, to, tt = trans
    lanes = lanes or Lanes.of(first)
    starts = _starts(psi, lanes, np.array([[tt, ot], [to, 1.0]]), False, 0.0)
    out, r = np.empty(len(psi)), starts
    for t, k in enumerate(lanes.active):
        if not k:
            break
        at = lanes.start[:k] + t
        r = r[:k]
        r = psi[at] * (tt * r + ot) / (to * r + 1)
        out[at] = r
    return out


def odds_back(psi: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Backward odds at each token, its own emission left out; 1 at the end."""
    ot, to, tt = trans
    total = int(first[-1])
    mirrored = (total - first)[::-1]
    lanes, back = Lanes.of(mirrored), psi[::-1]
    out, q = np.empty(total), _starts(back, lanes, np.array([[tt, to], [ot, 1.0]]), True, 1.0)
    for t, k in enumerate(lanes.active):
        if not k:
            break
        at = lanes.start[:k] + t
        q = q[:k]
        out[at] = q
        u = back[at] * q
        q = (tt * u + to) / (ot * u + 1)
    return out[::-1]


def _starts(psi: np.ndarray, lanes: Lanes, m: np.ndarray, inner: bool, zero: float) -> np.ndarray:
    """Odds at the start of every lane.

    A token's map is m with psi on the first row, or (``inner``) first column.
    """
    starts = np.full(len(lanes.start), zero)
    if not (lanes.before >= 0).any():
        return starts
    have = np.zeros(len(starts), bool)
    have[lanes.before[lanes.before >= 0]] = True  # these are full lanes
    which = np.flatnonzero(have)
    a, b, c, d = np.ones(len(which)), np.zeros(len(which)), np.zeros(len(which)), np.ones(len(which))
    for t in range(LANE):
        x = psi[lanes.start[which] + t]
        if inner:
            a, b, c, d = m[0, 0] * x * a + m[0, 1] * c, m[0, 0] * x * b + m[0, 1] * d, m[1, 0] * x * a + m[1, 1] * c, m[1, 0] * x * b + m[1, 1] * d
        else:
            a, b, c, d = x * (m[0, 0] * a + m[0, 1] * c), x * (m[0, 0] * b + m[0, 1] * d), m[1, 0] * a + m[1, 1] * c, m[1, 0] * b + m[1, 1] * d
        s = a + b + c + d
        a, b, c, d = a / s, b / s, c / s, d / s
    place = np.full(len(starts), -1)
    place[which] = np.arange(len(which))
    order = np.argsort(lanes.rank, kind="stable")
    border = np.searchsorted(lanes.rank[order], np.arange(lanes.rank.max() + 2))
    for j in range(1, len(border) - 1):
        mine = order[border[j] : border[j + 1]]
        prev = lanes.before[mine]
        p, r = place[prev], starts[prev]
        starts[mine] = (a[p] * r + b[p]) / (c[p] * r + d[p])
    return starts


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray  # logarithms of the three factors
    bits: int = BITS

    def emissions(self, feats: list[np.ndarray]) -> np.ndarray:
        s = self.weights[feats[0]].astype(np.float64)
        for f in feats[1:]:
            s += self.weights[f]
        return np.clip(s, -25, 25)

    def marginals(self, feats: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        psi, trans = np.exp(self.emissions(feats)), np.exp(self.trans)
        o = odds(psi, first, trans) * odds_back(psi, first, trans)
        return o / (1 + o)


def train(feats: list[np.ndarray], first: np.ndarray, y: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, rate: float = 0.5, batch: int = 64, seed: int = 3) -> Model:
    """Maximise the conditional likelihood of y by AdaGrad over batches of texts."""
    rng = np.random.default_rng(seed)
    m = Model(np.zeros(1 << bits, np.float32), np.array([-3.0, 0.0, 0.0]), bits)
    seen_w, seen_t = np.full(1 << bits, 1e-2, np.float32), np.full(3, 1e-2)
    m.weights[:] = -0.3 / len(feats)
    n = len(first) - 1
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            docs = order[i : i + batch]
            size = first[docs + 1] - first[docs]
            own = np.concatenate([[0], np.cumsum(size)])
            if not own[-1]:
                continue
            at = np.repeat(first[docs] - own[:-1], size) + np.arange(own[-1])
            f, t = [x[at] for x in feats], y[at].astype(np.float64)
            psi, tr = np.exp(m.emissions(f)), np.exp(m.trans)
            r, q = odds(psi, own, tr), odds_back(psi, own, tr)
            p = r * q / (1 + r * q)
            r0, t0 = np.roll(r, 1), np.roll(t, 1)  # odds and label before
            heads = own[:-1][size > 0]
            r0[heads], t0[heads] = 0.0, 0.0
            u = psi * q
            w = np.stack([tr[0] * u, r0 * tr[1], r0 * tr[2] * u])
            want = np.array([((1 - t0) * t).sum(), (t0 * (1 - t)).sum(), (t0 * t).sum()])
            g = want - (w / (1 + w.sum(0))).sum(1)
            seen_t += g * g
            m.trans = np.clip(m.trans + rate * g / np.sqrt(seen_t), -8, 8)
            d = (t - p).astype(np.float32)
            where = np.concatenate(f)
            uniq, inv = np.unique(where, return_inverse=True)
            gw = np.bincount(inv, weights=np.tile(d, len(f)), minlength=len(uniq)).astype(np.float32)
            seen_w[uniq] += gw * gw
            m.weights[uniq] += rate * gw / np.sqrt(seen_w[uniq])
    return m


def token_labels(x: Tokens, toxic: np.ndarray, ratio: float = 10.0, level: float = 20.0) -> np.ndarray:
    """Token labels from labels of texts.

    A word or beginning found in c1 of n1 toxic and c0 of n0 clean texts counts
    as toxic if its rate is ``ratio`` times as high in toxic ones and c0 or fewer
    have a probability under ``exp(-level)`` at the rate of the toxic ones.  For
    c1, occurrences between the same two neighbours count once.
    """
    owner, word = x.owner(), x.word
    n = [max(1, int((toxic == k).sum())) for k in (0, 1)]
    context = tx.mix(np.roll(word, 1) * np.uint64(3) + np.roll(word, -1))
    mine = toxic[owner] == 1
    y = np.zeros(len(word), bool)
    for h in (word, *x.heads[1:]):
        key, inv = np.unique(h, return_inverse=True)
        docs = np.unique(inv * np.int64(len(toxic)) + owner)
        bad = toxic[docs % len(toxic)] == 1
        c0, c1 = (np.bincount(docs[bad == k] // len(toxic), minlength=len(key)) for k in (False, True))
        seen = np.sort(inv[mine].astype(np.uint64) << np.uint64(40) | context[mine] >> np.uint64(24))
        seen = (seen[np.append(True, seen[1:] != seen[:-1])] >> np.uint64(40)).astype(np.int64) if len(seen) else seen.astype(np.int64)
        c1 = np.minimum(c1, np.bincount(seen, minlength=len(key)))
        want = c1 * (n[0] / n[1])  # clean texts that should have it
        ok = np.flatnonzero((c1 >= 3) & (want > ratio * c0))
        p = np.zeros(len(ok))
        term = np.ones(len(ok))
        for k in range(int(c0[ok].max(initial=0)) + 1):
            p += np.where(k <= c0[ok], term, 0)
            term = term * want[ok] / (k + 1)
        ok = ok[np.log(p) - want[ok] < -level]
        found = np.zeros(len(key), bool)
        found[ok] = True
        y |= found[inv] & mine
    return y


def unlike(x: Tokens) -> np.ndarray:
    """Texts of which none before has the same three smallest hashes of word pairs."""
    seen, keep = set(), []
    h = tx.mix(np.roll(x.word, 1) * np.uint64(5) + x.word)
    for d in range(len(x.first) - 1):
        sketch = tuple(np.unique(h[x.first[d] : x.first[d + 1]])[:3].tolist())
        if sketch not in seen:
            keep.append(d)
        seen.add(sketch)
    return np.array(keep, np.int64)


def fit_texts(texts: pa.Array, toxic: np.ndarray, bits: int = BITS) -> Model | None:
    """Model from labelled texts; None where a class is missing or no token stands
    out.  Of near copies one is used."""
    toxic = np.asarray(toxic)
    keep = unlike(Tokens.of_many(texts))
    texts, toxic = texts.take(pa.array(keep)), toxic[keep]
    if len(np.unique(toxic)) < 2:
        return None
    x = Tokens.of_many(texts)
    y = token_labels(x, toxic)
    if not y.any():
        return None
    return train(x.features(bits), x.first, y, bits)


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS, sample_bytes: tuple[int, int] = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Model | None:
    """Train on at most ``per_class`` labelled documents of the classes 0 and 1.

    Documents of a class are taken whole, in the order of a hash of their ids, as
    long as those before have fewer than ``sample_bytes``.
    """
    got = frames.sample(docs, labels, label, per_class, sample_bytes, id_col, text_col)
    return fit_texts(got["text"].combine_chunks(), got["y"].to_numpy()) if got.num_rows else None


SCHEMA = "doc_id bigint, score double, toxic boolean, n_tokens bigint, n_toxic bigint, spans array<struct<start:bigint,end:bigint,p:double>>"


def tag(texts: pa.Array, model: Model | None, threshold: float = THRESHOLD, doc_threshold: float = DOC_THRESHOLD) -> list[pa.Array]:
    """Columns of :func:`score` but for the id."""
    w = tx.words(texts)
    n = len(w.first) - 1
    p = model.marginals(Tokens.of(w).features(model.bits), w.first) if model is not None and len(w.start) else np.zeros(len(w.start))
    at = np.flatnonzero(p >= threshold)
    owner = np.searchsorted(w.first, at, side="right") - 1
    head = np.ones(len(at), bool)  # first token of its span
    head[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(at))[: len(heads)] - 1
    doc = owner[heads]
    high = np.maximum.reduceat(p[at], heads) if len(heads) else np.empty(0)
    char = tx.chars(w.data)
    start, end = (char[x] - char[w.doc[doc]] for x in (w.start[at[heads]], w.end[at[tails]]))
    # a text without spans has the highest marginal of its tokens
    miss = np.ones(n)
    np.multiply.at(miss, doc, 1 - high)
    score = 1 - miss
    none = np.flatnonzero((np.bincount(doc, minlength=n) == 0) & (np.diff(w.first) > 0))
    if len(none):
        some = np.flatnonzero(np.diff(w.first) > 0)
        top = np.zeros(n)
        top[some] = np.maximum.reduceat(p, w.first[some])
        score[none] = top[none]
    first = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64)), pa.array(high)], ["start", "end", "p"])
    return [pa.array(score), pa.array(score >= doc_threshold), pa.array(np.diff(w.first)), pa.array(np.bincount(owner, minlength=n)), pa.ListArray.from_arrays(pa.array(first), spans)]


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, doc_threshold: float = DOC_THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, toxic, n_tokens, n_toxic, spans) of every row of ``docs``.

    ``spans`` are runs of tokens whose marginal is ``threshold`` or more, as
    character offsets with the highest marginal inside.  ``score`` is the
    probability that some span is toxic, taken as independent; without spans it is
    the highest marginal of a token, which is under ``threshold``.  ``toxic`` says
    that the score is ``doc_threshold`` or more; a score or marginal just at its
    threshold counts.

    Null and empty texts have score 0 and no spans; a null id stays null; repeated
    rows are scored each; a text of any length is tagged as one chain; without a
    model all scores are 0; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), *tag(b.column(1), shared.value, threshold, doc_threshold)], ["doc_id", "score", "toxic", "n_tokens", "n_toxic", "spans"])

    rows = frames.inputs(docs, (id_col, "bigint"), (text_col, "string"))
    return frames.with_text(rows, make, SCHEMA, text_col)
