"""Stupid-backoff language-model scores of documents under their own corpus.

``S(w | u v)`` is ``c(u v w) / c(u v)`` if ``c(u v w) > 0``, else ``BACKOFF * S(w |
v)``, and so on down to ``c(w) / N``.  A document's score is the sum of ``ln S`` over
its words.

A corpus has seen every n-gram of its own documents, so that nothing would ever
back off.  Each word is therefore scored by the rest of the corpus: the counts of
the n-grams that end at it (and of their beginnings, and ``N``) leave out this one
occurrence.  A word that is found nowhere else counts as one of ``N``.

The count table is a relation partitioned by n-gram hash, and so are the documents'
n-grams that are joined to it; both have their rows packed in blocks:

1. Documents are dealt to chunks.  A chunk's n-grams of all orders become one
   sorted list of keys with counts, cut by bucket (the first bits of the key): rows
   (chunk, bucket, keys, counts), shuffled by bucket.
2. Each bucket adds up the counts of its keys over all chunks, which is its part of
   the count table, and joins it to the rows that it was made of: every chunk is
   answered with the counts of the keys that it sent, in their order.  As a relation
   of its own the table would be shuffled once more (2 x the input), because Spark
   can't know that its rows are where their n-grams are.
3. A chunk puts the answers beside its n-grams and sums the scores by document.

Every n-gram occurrence is counted and looked up, but what is shuffled is one
difference of about five bytes for each different n-gram of a chunk on the way there, and
about a byte on the way back.  Steps 1 and 3 read one shuffle of the documents.

Chunks and buckets have a million words and n-grams, beyond some 20 thousand million
words more (:func:`plan`), so that a row holds ``ROW_KEYS`` keys or more: the number
of rows grows with the corpus, not with its square.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagbag.llm import frames
from dagbag.llm import text as tx

BACKOFF = 0.4
#: Least words of a chunk and different n-grams of a bucket; each is one group in a
#: Python worker (about 100 bytes a word: 3 GB at 100 TB).
CHUNK_TOKENS = 1_000_000
BUCKET_KEYS = 1_000_000
#: Keys that a row of a chunk and bucket has at least on average; different n-grams
#: of a chunk, and of the corpus, for each word.
ROW_KEYS, CHUNK_KINDS, KINDS = 64, 2.3, 1.7
#: Bits of a key within its bucket; with those of the bucket they are at least 48
#: and 64 at most.  Of n different n-grams one shares its key with another with
#: probability n / 2**(WIDTH + bits): under 1e-6 from thousands to 10**13.
WIDTH = 48
_LOW = np.uint64((1 << WIDTH) - 1)
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def ngram_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text, place in its text, hashes of the 1-, 2- and
    3-grams that end at each word); the last two mean nothing at places below 1, 2."""
    hashes, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for piece in tx.pieces([pa.RecordBatch.from_arrays([texts], ["text"])], limit=1 << 20):
        w = tx.words(piece.column(0))  # eight bytes a character, so by pieces
        hashes.append(w.hashes())
        sizes.append(np.diff(w.first))
    h1, size = tx.splitmix(np.concatenate(hashes)), np.concatenate(sizes)
    first = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(len(h1)) - np.repeat(first[:-1], size)
    h2, h3 = h1.copy(), h1.copy()
    h2[1:] = tx.mix(h1[:-1] * _A + h1[1:])
    h3[1:] = tx.mix(h2[:-1] * _B + h1[1:])
    return first, place, h1, h2, h3


def chunk_keys(texts: pa.Array, bits: int):
    """((first, place), keys of every n-gram: ``bits`` of bucket, then ``WIDTH``)."""
    first, place, *h = ngram_hashes(texts)
    keys = []
    for n, x in enumerate(h):
        x = x[place >= n] if n else x
        keys.append((x >> np.uint64(64 - bits) << np.uint64(WIDTH) if bits else np.zeros(len(x), np.uint64)) | (x & _LOW))
    return first, place, keys


def pack_counts(c: np.ndarray) -> bytes:
    small = np.minimum(c, 255).astype(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(small.tobytes() + c[c >= 255].astype(np.int64).tobytes())


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(raw) if n else b""
    c = np.frombuffer(data, np.uint8, n).astype(np.int64)
    c[c == 255] = np.frombuffer(data, np.int64, offset=n)
    return c


def pack_keys(k: np.ndarray) -> bytes:
    """Sorted different keys: how many bytes a difference needs, the first, the differences."""
    d = np.diff(k)
    width = max(1, -(-int(d.max(initial=np.uint64(0))).bit_length() // 8))
    return bytes([width]) + k[:1].tobytes() + d.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    width = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    d = np.zeros((len(body) + 1, 8), np.uint8)
    d[0] = np.frombuffer(raw, np.uint8, 8, offset=1)
    d[1:, :width] = body
    return np.cumsum(d.view(np.uint64).ravel(), dtype=np.uint64)


def log_scores(first: np.ndarray, place: np.ndarray, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, total: int, backoff: float) -> np.ndarray:
    """Sum of ln S of each text, from the counts at each word, itself included."""
    log = lambda x: np.log(np.maximum(x, 1))
    step = math.log(backoff)
    s = log(c1 - 1) - math.log(max(total - 1, 1)) + step * np.minimum(place, 2)
    before1, before2 = np.roll(c1, 1), np.roll(c2, 1)
    two = (place >= 1) & (c2 > 1)
    s[two] = log(c2[two] - 1) - log(before1[two] - 1) + step * (place[two] >= 2)
    three = (place >= 2) & (c3 > 1)
    s[three] = log(c3[three] - 1) - log(before2[three] - 1)
    return tx.sum_by_doc(s, first)


def plan(total: int, chunk_tokens: int = CHUNK_TOKENS, bucket_keys: int = BUCKET_KEYS) -> tuple[int, int]:
    """(chunks, bits of the bucket) for so many words."""
    # chunks * buckets rows have CHUNK_KINDS * total keys
    side = math.sqrt(ROW_KEYS * KINDS / CHUNK_KINDS * total)
    chunks = max(1, math.ceil(total / max(chunk_tokens, side)))
    return chunks, max(0, math.ceil(math.log2(max(1, KINDS * total / max(bucket_keys, side)))))


def _count_words(docs: DataFrame, text_col: str) -> int:
    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([len(tx.words(b.column(0)).start)])], ["n"])

    rows = frames.with_text(frames.inputs(docs, (text_col, "string")), count, "n bigint", text_col)
    return rows.agg(F.sum("n")).first()[0] or 0


def answers_of(t: pa.Table) -> pa.Table:
    """(chunk, bucket, counts) for the rows (chunk, bucket, keys, counts) of a bucket."""
    lists = [unpack_keys(x.as_buffer()) for x in t["keys"]]
    border = np.cumsum([0, *map(len, lists)])
    own = np.concatenate([unpack_counts(x.as_buffer(), len(k)) for x, k in zip(t["counts"], lists)])
    kinds, inv = np.unique(np.concatenate(lists), return_inverse=True)
    table = np.bincount(inv, weights=own, minlength=len(kinds)).astype(np.int64)
    back = [pack_counts(table[inv[s:e]]) for s, e in zip(border[:-1], border[1:])]
    return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "counts": pa.array(back, pa.binary())})


def score(docs: DataFrame, backoff: float = BACKOFF, chunk_tokens: int = CHUNK_TOKENS, bucket_keys: int = BUCKET_KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score) of every row.

    Words are folded to lower case (``text.fold``), punctuation is dropped, n-grams
    don't cross documents; a text of any length is scored whole.  Null and empty
    texts have 0 tokens, log_score 0 and a null mean.  Null ids stay null, repeated
    rows are counted and scored each, equal scores are no special case, other columns
    are ignored, an empty table gives no rows.

    Rows are dealt to chunks by their order, not by what they hold, so that many
    equal rows make no large chunk; ``docs`` must give the same order when a task is
    repeated, as files do.
    """
    total = _count_words(docs, text_col)
    chunks, bits = plan(total, chunk_tokens, bucket_keys)
    rows = frames.inputs(docs, (id_col, "bigint"), (text_col, "string")).toDF("doc_id", "text")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int")).repartition("chunk")

    def ask(t: pa.Table) -> pa.Table:
        _, _, keys = chunk_keys(t["text"].combine_chunks(), bits)
        k, c = np.unique(np.concatenate(keys), return_counts=True)
        bucket = (k >> np.uint64(WIDTH)).astype(np.int32)
        heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(k) else np.empty(0, np.int64)
        ends = np.append(heads[1:], len(k))
        return pa.table({
            "chunk": pa.array(np.repeat(t["chunk"][0].as_py(), len(heads)).astype(np.int32)), "bucket": pa.array(bucket[heads]),
            "keys": pa.array([pack_keys(k[s:e]) for s, e in zip(heads, ends)], pa.binary()), "counts": pa.array([pack_counts(c[s:e]) for s, e in zip(heads, ends)], pa.binary()),
        })

    def put(docs: pa.Table, answers: pa.Table) -> pa.Table:
        first, place, keys = chunk_keys(docs["text"].combine_chunks(), bits)
        sizes = np.cumsum([0, *map(len, keys)])
        every = np.concatenate(keys)
        del keys
        kinds, inv = np.unique(every, return_inverse=True)
        del every
        counts = np.zeros(len(kinds), np.int64)
        bucket = (kinds >> np.uint64(WIDTH)).astype(np.int64)
        for b, raw in zip(answers["bucket"].to_pylist(), answers["counts"]):
            s, e = np.searchsorted(bucket, [b, b + 1])
            counts[s:e] = unpack_counts(raw.as_py(), e - s)
        by_order = []
        for n in range(3):
            c = np.zeros(len(place), np.int64)
            c[place >= n] = counts[inv[sizes[n] : sizes[n + 1]]]
            by_order.append(c)
        s = log_scores(first, place, *by_order, total, backoff)
        size = np.diff(first)
        mean = np.divide(s, size, out=np.zeros(len(s)), where=size > 0)
        return pa.table({"doc_id": docs["doc_id"], "n_tokens": pa.array(size), "log_score": pa.array(s), "mean_log_score": pa.array(mean, mask=size == 0)})

    asked = rows.groupBy("chunk").applyInArrow(ask, "chunk int, bucket int, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(answers_of, "chunk int, bucket int, counts binary")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(put, "doc_id bigint, n_tokens bigint, log_score double, mean_log_score double")


#: The same scores in DuckDB.
ORACLE = """
with words as (
  select doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10ffff}]+') as w from documents
), t as (
  select doc_id, unnest(w) as w3, unnest(range(len(w))) as i from words
), g as (
  select doc_id, i, w3, lag(w3) over d as w2, lag(w3, 2) over d as w1 from t window d as (partition by doc_id order by i)
), c as (
  select *, count(*) over (partition by w3) as c1, count(*) over (partition by w2, w3) as c2, count(*) over (partition by w1, w2, w3) as c3 from g
), x as (
  select *, lag(c1) over d as b1, lag(c2) over d as b2 from c window d as (partition by doc_id order by i)
), s as (
  select doc_id, case
    when i >= 2 and c3 > 1 then ln((c3 - 1) / (b2 - 1))
    when i >= 1 and c2 > 1 then ln((c2 - 1) / (b1 - 1)) + ln(0.4) * (case when i >= 2 then 1 else 0 end)
    else ln(greatest(c1 - 1, 1) / (select greatest(count(*) - 1, 1) from t)) + ln(0.4) * least(i, 2) end as s from x
)
select d.doc_id, count(s.s) as n_tokens, round(coalesce(sum(s.s), 0), 4) as log_score, round(sum(s.s) / count(s.s), 6) as mean_log_score
from documents d left join s using (doc_id) group by d.doc_id
"""
