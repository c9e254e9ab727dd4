"""Run-length encoding of histories whose values change slowly.

Nodes get positions in an order where neighbours are alike (one component after
the other, topologically); for every key only the positions where its weight
changes are kept, ``delta(keys..., pos, dv)``.  Worth it where the delta table
has fewer rows than the values, which :func:`ratio` measures; histories stay in
state form otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dagbag.operators.history import History


def encode(h: History, order: DataFrame) -> DataFrame:
    """(part, keys..., pos, dv) for ``order(node, part, pos)``; pos counts from 0
    without gaps in each part."""
    (val,) = h.g().columns
    rows = h.values().join(order, "node").select("part", *h.keys, "pos", val)
    w = Window.partitionBy("part", *h.keys).orderBy("pos")
    before = F.when(F.lag("pos").over(w) == F.col("pos") - 1, F.lag(val).over(w)).otherwise(F.lit(0))
    rows = rows.withColumn("__up", F.col(val) - before)
    rows = rows.withColumn("__ends", F.coalesce(F.lead("pos").over(w) != F.col("pos") + 1, F.lit(True)))
    changes = F.array(F.struct("pos", F.col("__up").alias("dv")), F.when(F.col("__ends"), F.struct((F.col("pos") + 1).alias("pos"), (-F.col(val)).alias("dv"))))
    out = rows.select("part", *h.keys, F.explode(F.array_compact(changes)).alias("__c")).select("part", *h.keys, "__c.*")
    return out.filter("dv <> 0")


def runs(delta: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """(part, keys..., from, to, val): the weight is val from ``from`` to before
    ``to`` (null: to the end)."""
    w = Window.partitionBy("part", *keys).orderBy("pos")
    total = F.sum("dv").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = delta.select("part", *keys, F.col("pos").alias("from"), F.lead("pos").over(w).alias("to"), total.alias("val"))
    return out.filter("val <> 0")


def decode(delta: DataFrame, order: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """(node, keys..., val): runs spread over their positions again.

    A run is as many rows as it stands for, so spreading and an equi-join do what
    a range join would.
    """
    last = order.groupBy("part").agg((F.max("pos") + 1).alias("__end"))
    spans = runs(delta, keys).join(last, "part").withColumn("pos", F.explode(F.sequence(F.col("from"), F.coalesce("to", "__end") - 1)))
    return spans.join(order, ["part", "pos"]).select("node", *keys, "val")


def ratio(h: History, order: DataFrame) -> float:
    """Rows of the encoding for each row of values; below 1 it pays."""
    rows = h.values().count()
    return encode(h, order).count() / rows if rows else 1.0
