"""Cost-balanced packing of documents into training sequences.

A document of n tokens costs ``n + n * n / quadratic`` (linear layers plus
attention).  Documents go, dearest first, each to the cheapest sequence that
still has room for it; a new sequence is opened where none has.

Sequences are filled shard by shard.  A shard is a hash share of the documents
that fills about ``shard_sequences`` sequences, so the number of shards follows
the corpus and each shard is one small task; shards are alike because the hash
deals documents of all lengths to each.  Only ids and token counts are shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagbag.llm import frames
from dagbag.llm import text as tx

CAPACITY = 32_768
QUADRATIC = 12_288
SHARD_SEQUENCES = 256
#: Rows of the same id and size above which they are dealt to all shards.
CROWDED = 10_000

SCHEMA = "doc_id bigint, piece int, n_pieces int, token_start bigint, n_tokens bigint, cost double, shard int, sequence int, slot int"


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): tokens are runs of bytes above 0x20; null text has 0."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        n = np.diff(tx.words(b.column(1), "space").first)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    rows = frames.inputs(docs, (id_col, "bigint"), (text_col, "string"))
    return frames.with_text(rows, count, "doc_id bigint, n_tokens bigint", text_col)


def fill(n_tokens: np.ndarray, cost: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and slot of each piece; pieces come dearest first."""
    room = np.full(max(1, math.ceil(int(n_tokens.sum()) / capacity)), capacity, dtype=np.int64)
    load = np.zeros(len(room))
    used = np.zeros(len(room), dtype=np.int64)
    seq, slot = np.empty(len(cost), np.int64), np.empty(len(cost), np.int64)
    for i, (n, c) in enumerate(zip(n_tokens, cost)):
        j = int(np.where(room >= n, load, np.inf).argmin())
        if room[j] < n:
            j = len(room)
            room, load, used = np.append(room, capacity), np.append(load, 0.0), np.append(used, 0)
        seq[i], slot[i] = j, used[j]
        room[j] -= n
        load[j] += c
        used[j] += 1
    return seq, slot


def pack(docs: DataFrame, capacity: int = CAPACITY, quadratic: float = QUADRATIC, shard_sequences: int = SHARD_SEQUENCES, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None, crowded: int = CROWDED) -> DataFrame:
    """Assign every document to a sequence of at most ``capacity`` tokens.

    One row a piece: ``doc_id, piece, n_pieces, token_start, n_tokens, cost,
    shard, sequence, slot``.  A document longer than ``capacity`` is cut into
    pieces of that length and a rest, so no token is lost.  ``counts`` gives
    (doc_id, n_tokens) where another tokenizer counted them already.

    Null or empty texts have 0 tokens: one row with null sequence and slot.
    Null ids are packed like any other.  Repeated rows are packed once each.
    Ties are broken by id and piece.  A text of any length is counted whole.  An
    empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    tokens = frames.cut(counts if counts is not None else token_counts(docs, id_col, text_col))
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, math.ceil(total / (capacity * shard_sequences)))
    n, cap = F.col("n_tokens"), F.lit(capacity).cast("bigint")
    # very many rows of one id and size go round the shards; which of them is where makes no difference
    crowd = frames.cut(tokens.groupBy("doc_id", "n_tokens").count().filter(F.col("count") > crowded))
    salt = F.lit(0)
    if not crowd.isEmpty():
        crowd = crowd.select(F.col("doc_id").alias("id"), F.col("n_tokens").alias("size"), F.lit(1).alias("many"))
        tokens = tokens.withColumn("no", F.monotonically_increasing_id()).join(crowd, F.expr("doc_id <=> id and n_tokens = size"), "left")
        salt = F.when(F.col("many") == 1, F.col("no")).otherwise(0)
    pieces = (
        tokens.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(n / cap)).cast("int"))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", salt), F.lit(shards)).cast("int"))
        .select("doc_id", "n_tokens", "n_pieces", "shard")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("token_start", F.col("piece") * cap)
        .withColumn("n_tokens", F.least(cap, n - F.col("token_start")))
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["cost"] = pdf.n_tokens + pdf.n_tokens.astype(float) ** 2 / quadratic
        pdf = pdf.sort_values(["cost", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        full = int((pdf.n_tokens > 0).sum())
        seq, slot = fill(pdf.n_tokens.to_numpy()[:full], pdf.cost.to_numpy()[:full], capacity)
        rest = [None] * (len(pdf) - full)
        pdf["sequence"] = pd.array([*seq.tolist(), *rest], dtype="Int32")
        pdf["slot"] = pd.array([*slot.tolist(), *rest], dtype="Int32")
        pdf["doc_id"] = pdf.doc_id.astype("Int64")
        return pdf[["doc_id", "piece", "n_pieces", "token_start", "n_tokens", "cost", "shard", "sequence", "slot"]]

    return pieces.groupBy("shard").applyInPandas(one, SCHEMA)
