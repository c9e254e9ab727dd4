"""Connected components by alternating stars.

Edges are rewritten until every component is a star around its least node: the
large step links each node's greater neighbours to the least of its
neighbourhood, the small step links the lesser ones.  Rounds grow with the
logarithm of the diameter, each is two shuffles of the edges alone, and no node
ever gathers its neighbours in one row.  Before, each task makes stars of the edges it
reads, so that what is stored together takes one round to check.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dagbag.plans.lineage import cut, drop

#: Edges of which a task makes stars at once.
STARS = 500_000


# Least neighbours are aggregated before they are shuffled and then joined back, so
# that a node with very many neighbours, as every star has, is no task of its own.
def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    w = e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")
    pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return w.select(F.explode(pairs).alias("p")).select("p.u", "p.v").filter("u > v").distinct()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict = {}
    n = 0

    def find(x):
        while (y := up[x]) != x:
            up[x] = x = up[y]
        return x

    def made() -> pa.RecordBatch:
        pairs = [(x, y) for x in up if (y := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], t) for i, t in enumerate(types)], names=["u", "v"])

    types: list = []
    for batch in batches:
        types = [c.type for c in batch.columns]
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            u, v = find(u) if u in up else up.setdefault(u, u), find(v) if v in up else up.setdefault(v, v)
            if u < v:
                up[v] = u
            elif v < u:
                up[u] = v
        n += batch.num_rows
        if n >= STARS:
            yield made()
            up.clear()
            n = 0
    if up:
        yield made()


def star_forest(edges: DataFrame) -> DataFrame:
    """(u, v): v is the least node of u's component, for every u but v itself.

    ``edges`` has columns u and v of one orderable type; direction, repeats and
    loops don't matter.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    if isinstance(e.schema["u"].dataType, (T.IntegralType, T.StringType)):
        e = e.mapInArrow(_stars, e.schema)
    e = cut(e.distinct())
    signed = lambda: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    sign = signed()
    while True:
        new = cut(_small(_large(e)))
        drop(e)
        e = new
        now = signed()
        if now == sign:
            return e
        sign = now


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the least node that is connected to each node."""
    stars = star_forest(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")))
    joined = nodes.select(F.col(node)).join(stars.select(F.col("u").alias(node), "v"), node, "left")
    return joined.select(node, F.coalesce("v", node).alias("component"))
