"""Benchmark decontamination by a broadcast set of test n-grams.

Words of both sides are folded to lower case and punctuation is dropped.  Each
test item gives its windows of ``n`` words; an item of fewer words is one window
of its own length.  One of fewer than ``min_words``, which any text may hold by
chance, is a hit only where it makes up a whole line.  Their 64-bit hashes are sent to
every executor; documents are scanned window by window with rolling sums; a
window whose hash is found is verified word by word against the item.  Verified
windows, joined over gaps of up to ``gap`` words, are the spans to remove; a
document of which ``drop_share`` of the words are in spans goes altogether.

The set is broadcast only while the benchmark has at most ``BROADCAST_BYTES`` of
text.  A larger one is cut into parts of that size, one at a time is on the
executors, and documents are scanned once a part; the spans that the parts find
are merged by document and joined to the texts before anything is removed.
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

N = 8
MIN_WORDS = 5
GAP = 4
DROP_SHARE = 0.5
BROADCAST_BYTES = 8 << 20
_FILTER_BITS = 22


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes, by position."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    p = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * tx.powers(len(h)), out=p[1:])
    i = np.arange(len(h) - n + 1)
    return tx.mix((p[i + n] - p[i]) * tx.powers(len(h) + 1, inverse=True)[i] + np.uint64(n))


@dataclass
class Grams:
    """Windows of a benchmark: for each length the sorted hashes, where each is
    found in ``words`` (hashes of the items' words, checked in verification by
    two independent hashes) and its item."""

    by_length: dict
    words: np.ndarray
    second: np.ndarray
    bloom: dict
    min_words: int


def _line_edges(w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """Which words are the first and which the last of their line."""
    breaks = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.data == 10, out=breaks[1:])
    first, last = np.ones(len(w.start), bool), np.ones(len(w.start), bool)
    first[1:] = breaks[w.start[1:]] > breaks[w.end[:-1]]
    heads = w.first[:-1][np.diff(w.first) > 0]
    first[heads] = True
    last[:-1] = first[1:]
    return first, last


def _second(w: tx.Words) -> np.ndarray:
    """Another hash of each word: verification compares both and the length."""
    q = tx.prefix_hash(w.data ^ np.uint8(0x5A))
    return tx.range_hash(q, w.start, w.end) ^ (w.end - w.start).astype(np.uint64)


def grams(items: pa.Array, texts: pa.Array, n: int = N, min_words: int = MIN_WORDS) -> Grams:
    w = tx.words(texts)
    h, second, owner = w.hashes(), _second(w), w.owner()
    ids = np.asarray(items)
    size = np.diff(w.first)
    by, bloom = {}, {}
    for length in sorted({min(n, int(s)) for s in size if s}):
        win = _windows(h, length)
        own = owner[: len(win)]
        ok = own == owner[length - 1 :]
        ok &= (size[own] >= n) if length == n else (size[own] == length)
        at = np.flatnonzero(ok)
        at = at[np.argsort(win[at], kind="stable")]
        by[length] = (win[at], at, ids[own[at]])
        mask = np.zeros(1 << _FILTER_BITS, dtype=bool)
        mask[win[at] >> np.uint64(64 - _FILTER_BITS)] = True
        bloom[length] = mask
    return Grams(by, h, second, bloom, min_words)


def hits(texts: pa.Array, g: Grams):
    """(words, document, first word, end word, item) of every verified window."""
    w = tx.words(texts)
    h = w.hashes()
    owner, second, edges, found = None, None, None, []
    for length, (keys, places, items) in g.by_length.items():
        win = _windows(h, length)
        at = np.flatnonzero(g.bloom[length][win >> np.uint64(64 - _FILTER_BITS)])
        lo, hi = np.searchsorted(keys, win[at], "left"), np.searchsorted(keys, win[at], "right")
        many = hi - lo
        at = np.repeat(at, many)
        if not len(at):
            continue
        key = np.repeat(lo, many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        if owner is None:
            owner, second = w.owner(), _second(w)
        ok = owner[at] == owner[at + length - 1]
        for k in range(length):
            ok &= (h[at + k] == g.words[places[key] + k]) & (second[at + k] == g.second[places[key] + k])
        if length < g.min_words:
            edges = edges or _line_edges(w)
            ok &= edges[0][at] & edges[1][at + length - 1]
        at, key = at[ok], key[ok]
        found.append((owner[at], at, at + length, items[key]))
    if not found:
        none = np.empty(0, np.int64)
        return w, none, none, none, none
    return (w, *(np.concatenate(x) for x in zip(*found)))


def spans(texts: pa.Array, g: Grams, gap: int = GAP) -> dict[int, tuple[list, int, int, list]]:
    """For each text with hits: spans (byte offsets), words in them, words, items."""
    w, doc, start, end, item = hits(texts, g)
    out = {}
    order = np.lexsort((start, doc))
    for d in np.unique(doc):
        mine = order[np.searchsorted(doc[order], d) : np.searchsorted(doc[order], d, "right")]
        merged: list[list[int]] = []
        for s, e in zip(start[mine].tolist(), end[mine].tolist()):
            if merged and s <= merged[-1][1] + gap:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        base = w.doc[d]
        out[int(d)] = (
            [(int(w.start[s] - base), int(w.end[e - 1] - base)) for s, e in merged],
            sum(e - s for s, e in merged),
            int(w.first[d + 1] - w.first[d]),
            sorted(set(item[mine].tolist())),
        )
    return out


def _items(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> list[DataFrame]:
    """(item, text) of the benchmark, in parts of at most about ``limit`` bytes."""
    item = F.coalesce(frames.col(benchmark, item_col).cast("bigint"), F.lit(-1).cast("bigint"))
    rows = benchmark.select(item.alias("item"), frames.col(benchmark, text_col).cast("string").alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    k = max(1, -(-total // limit))
    return [rows if k == 1 else rows.filter(F.pmod(F.xxhash64("text"), F.lit(k)) == i) for i in range(k)]


def _grams(part: DataFrame, n: int, min_words: int) -> Grams:
    t = part.toArrow()
    return grams(t["item"].to_numpy(), t["text"].combine_chunks(), n, min_words)


_SPANS = "doc_id bigint, th bigint, spans array<struct<s:bigint,e:bigint>>, items array<bigint>"


def _found(docs: DataFrame, benchmark: DataFrame, n: int, min_words: int, gap: int, limit: int, id_col: str, text_col: str, item_col: str, bench_text_col: str, change, schema) -> DataFrame:
    """``change(batch, texts, {row: spans})`` for pieces of ``docs``."""
    parts = _items(benchmark, item_col, bench_text_col, limit)
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index(text_col)
    if len(parts) == 1:
        shared = sc.broadcast(_grams(parts[0], n, min_words))

        def make(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = pc.cast(b.column(at), pa.string())
            return change(b, texts, spans(texts, shared.value, gap))

        return frames.with_text(docs, make, schema, text_col)

    text, own = frames.col(docs, text_col).cast("string"), frames.col(docs, id_col).cast("bigint")
    rows = docs.select(own.alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    every = None
    for part in parts:
        shared = sc.broadcast(_grams(part, n, min_words))

        def look(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            seen = spans(b.column(2), shared.value, gap)
            own = pa.array(list(seen), pa.int64())
            pair = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [b.column(0).take(own), b.column(1).take(own), pa.array([[{"s": s, "e": e} for s, e in x[0]] for x in seen.values()], pair), pa.array([x[3] for x in seen.values()], pa.list_(pa.int64()))],
                ["doc_id", "th", "spans", "items"],
            )

        hit = frames.cut(frames.with_text(rows, look, _SPANS))
        shared.unpersist()
        every = hit if every is None else every.unionAll(hit)
    id_name, th_name, span_name, item_name = frames.fresh_names(docs, "id", "th", "spans", "items")
    every = every.select("doc_id", "th", F.explode("spans").alias("span"), "items").distinct()  # rows may repeat
    merged = every.groupBy(F.col("doc_id").alias(id_name), F.col("th").alias(th_name)).agg(
        F.array_sort(F.collect_set("span")).alias(span_name), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias(item_name)
    )
    cond = F.xxhash64(text).eqNullSafe(merged[th_name]) & own.eqNullSafe(merged[id_name])
    joined = docs.join(merged, cond, "left").select(*map(frames.quoted, docs.columns), span_name, item_name)

    def put(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, k = pc.cast(b.column(at), pa.string()), b.num_columns - 2
        seen = {}
        for d in np.flatnonzero(pc.is_valid(b.column(k)).to_numpy(zero_copy_only=False)).tolist():
            w = tx.words(texts.slice(d, 1))
            cuts = _joined(w, [(x["s"], x["e"]) for x in b.column(k)[d].as_py()], gap)
            bad = sum(int(np.searchsorted(w.start, e) - np.searchsorted(w.start, s)) for s, e in cuts)
            seen[d] = (cuts, bad, len(w.start), b.column(k + 1)[d].as_py())
        plain = pa.RecordBatch.from_arrays(b.columns[:k], schema=pa.schema(list(b.schema)[:k]))
        return change(plain, texts, seen)

    return frames.with_text(joined, put, schema, text_col)


def _joined(w: tx.Words, cuts: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Sorted spans of one text merged over gaps of up to ``gap`` words."""
    out: list[list[int]] = []
    for s, e in sorted(cuts):
        if out and int(np.searchsorted(w.start, s) - np.searchsorted(w.start, out[-1][1])) <= gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _without(raw: bytes, cuts: list[tuple[int, int]]) -> str:
    out, last = [], 0
    for s, e in cuts:
        out.append(raw[last:s])
        last = e
    out.append(raw[last:])
    return b"".join(out).decode()


REPORT = "doc_id bigint, action string, items array<bigint>, n_words bigint, n_contaminated bigint, starts array<bigint>, ends array<bigint>, text string"


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, min_words: int = MIN_WORDS, gap: int = GAP, drop_share: float = DROP_SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each contaminated row of ``docs``: what is done to it.

    ``action`` is "remove document" (text null) or "remove spans" (text is what
    remains; a share of just ``drop_share`` removes); ``starts`` and ``ends`` are
    character offsets of the spans in the original text, ``items`` all items with a hit, also where several
    hold the same words.  Rows that aren't listed stay as they are.  Null and empty
    texts have no hits; a text of any length is scanned whole; a null id
    stays null; repeated rows are listed each; null items count as item -1, null
    item texts and items without words are ignored; with an empty benchmark or an
    empty table nothing is listed.  Other columns are ignored.
    """

    def change(b, texts, seen):
        rows = []
        for d, (cuts, bad, total, items) in sorted(seen.items()):
            raw = texts[d].as_buffer().to_pybytes()
            char = tx.chars(np.frombuffer(raw, np.uint8))
            whole = bad >= drop_share * total
            rows.append({
                "doc_id": b.column(0)[d].as_py(), "action": "remove document" if whole else "remove spans", "items": items, "n_words": total, "n_contaminated": bad,
                "starts": [int(char[s]) for s, _ in cuts], "ends": [int(char[e]) for _, e in cuts], "text": None if whole else _without(raw, cuts),
            })
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    rows = frames.inputs(docs, (id_col, "bigint"), (text_col, "string"))
    return _found(rows, benchmark, n, min_words, gap, limit, id_col, text_col, item_col, bench_text_col, change, REPORT)


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("action", pa.string()), ("items", pa.list_(pa.int64())), ("n_words", pa.int64()), ("n_contaminated", pa.int64()),
    ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("text", pa.string()),
])


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, min_words: int = MIN_WORDS, gap: int = GAP, drop_share: float = DROP_SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` (all its columns) after the actions that :func:`report` lists."""
    at = docs.columns.index(text_col)

    def change(b, texts, seen):
        if not seen:
            return b
        keep = np.ones(b.num_rows, dtype=bool)
        new = {}
        for d, (cuts, bad, total, _) in seen.items():
            if bad >= drop_share * total:
                keep[d] = False
            else:
                new[d] = _without(texts[d].as_buffer().to_pybytes(), cuts)
        if new:
            mask = np.zeros(b.num_rows, dtype=bool)
            mask[list(new)] = True
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([new[d] for d in sorted(new)], pa.string()))
        return b.set_column(at, b.schema.field(at), texts).filter(pa.array(keep))

    return _found(docs, benchmark, n, min_words, gap, limit, id_col, text_col, item_col, bench_text_col, change, docs.schema)


#: The same report in DuckDB (with arrays as text), by joining all windows of words to those of the items.
ORACLE = r"""
with texts as (
  select true as doc, doc_id as id, text from documents union all select false, coalesce(item_id, -1), text from benchmark where text is not null
), numbered as (select *, row_number() over () as row from texts
), lists as (select *, regexp_extract_all(text, '[A-Za-z0-9\x{80}-\x{10ffff}]+|[^A-Za-z0-9\x{80}-\x{10ffff}]+') as ps from numbered
), pieces as (select row, unnest(ps) as p, unnest(range(len(ps))) as i from lists
), placed as (
  select row, i, p, sum(length(p)) over before as e, sum(length(p) - length(replace(p, chr(10), ''))) over before as ln from pieces window before as (partition by row order by i)
), words as (
  select row, list(lower(p) order by i) as ws, list(ln order by i) as lns, list(e - length(p) order by i) as ss, list(e order by i) as es
  from placed where regexp_matches(p, '^[A-Za-z0-9\x{80}-\x{10ffff}]') group by row
), t as (select n.*, w.* exclude (row), len(ws) as n from words w join numbered n using (row)
), sizes as (select distinct least(n, 8) as l from t where not doc
), windows as (
  select row, doc, id, n, lns, l, unnest(range(n - l + 1)) as k, ws from t, sizes where n >= l and (doc or least(n, 8) = l)
), grams as (
  select row, doc, id, l, k, array_to_string(ws[k + 1 : k + l], ' ') as g, (k = 0 or lns[k] < lns[k + 1]) and (k + l = n or lns[k + l] < lns[k + l + 1]) as alone from windows
), hits as (
  select d.row, d.k as s, d.k + d.l as e, b.id as item from grams d join grams b on d.doc and not b.doc and d.l = b.l and d.g = b.g and (d.l >= 5 or d.alone)
), ends as (select row, s, e, max(e) over (partition by row order by s, e rows between unbounded preceding and 1 preceding) as before from hits
), runs as (select row, s, e, sum(case when before is null or s > before + 4 then 1 else 0 end) over (partition by row order by s, e) as run from ends
), spans as (select row, min(s) as s, max(e) as e from runs group by row, run
), cuts as (
  select row, text, id, n, e - s as bad, ss[s + 1] as a, es[e] as b, coalesce(lag(es[e]) over (partition by row order by s), 0) as last from spans join t using (row)
), found as (
  select row, id, n, sum(bad) as bad, list(cast(a as bigint) order by a) as starts, list(cast(b as bigint) order by a) as ends,
    string_agg(substr(text, cast(last + 1 as bigint), cast(a - last as bigint)), '' order by a) || substr(any_value(text), cast(max(b) + 1 as bigint)) as left_text from cuts group by row, id, n
), items as (select row, list_sort(list(distinct item)) as items from hits group by row)
select id as doc_id, case when 2 * bad >= n then 'remove document' else 'remove spans' end as action, array_to_string(items, ',') as items, cast(n as bigint) as n_words, cast(bad as bigint) as n_contaminated,
  array_to_string(starts, ',') as starts, array_to_string(ends, ',') as ends, case when 2 * bad >= n then null else left_text end as text from found join items using (row)
"""
