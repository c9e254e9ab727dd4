"""Histories as changes along edges.

A history whose nodes are much like their parents has far fewer changes than
values.  Here it is kept as such: the values of nodes without parents
(``checkpoints``) and, for every edge and key, what the child's weight is more than
the parent's.  Operators work on changes: linear ones on each by itself; others look
up the weights of those keys only that change, :meth:`Changes.looked_up`.

Weights are looked up in a spanning tree.  In preorder the nodes below an edge are a
run of positions, so that a change counts from the child's position to the end of its
subtree; a weight is the sum of what has begun and not ended at a position.  Where a
change begins, the sum is the weight after it, so that a look-up sorts the changes
once and joins nothing.  Sums over large trees run in blocks of positions, so that a
key that changes everywhere isn't one task.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dagbag.functions.groups import Group
from dagbag.operators import topology
from dagbag.operators.history import COLLAPSE, LINEAR, History
from dagbag.plans.lineage import cut

#: Positions whose changes of a key are summed in one task.
BLOCK = 1 << 16


class Changes:
    """``at`` has the values of the checkpoints; ``by`` those of changes, its nodes
    are the edges as structs (src, dst)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, at: History, by: History, order: list[DataFrame] | None = None):
        self.nodes, self.edges, self.at, self.by = nodes, edges, at, by
        self._order = [] if order is None else order  # shared by all that have the same graph

    @classmethod
    def of(cls, h: History) -> Changes:
        """The changes of a history in state form."""
        h = h.collapse()
        h = h._with(cut(h._values), outer=h.outer, normal=True)  # read by both sides and the roots
        edge = F.struct("src", "dst").alias("node")
        edges = cut(h.edges().select("src", "dst").distinct())
        columns = [*h.keys, *h.g().columns]
        after = edges.join(h._values, edges["dst"] == h._values["node"]).select(edge, *columns)
        before = edges.join(h._values, edges["src"] == h._values["node"]).select(edge, *h.keys, *[(-F.col(c)).alias(c) for c in h.g().columns])
        return cls.from_frames(h.nodes(), edges, h._values, after.unionAll(before), h)

    @classmethod
    def from_frames(cls, nodes: DataFrame, edges: DataFrame, values: DataFrame, changes: DataFrame, like: History) -> Changes:
        """From values (of roots at least) and changes (node = struct of src and dst);
        keys and weights are those of ``like``."""
        none = edges.filter(F.lit(False)).select("src", "dst")
        roots = nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
        at = History.from_frames(roots, none, values.join(roots, "node", "left_semi"), like.keys, like.g(), like.outer)
        by = History.from_frames(edges.select(F.struct("src", "dst").alias("node")), none, changes, like.keys, like.g(), like.outer)
        return cls(nodes, edges, at.collapse(), by.collapse())

    def _new(self, at: History, by: History) -> Changes:
        return Changes(self.nodes, self.edges, at, by, self._order)

    def _kept(self, at: History, by: History) -> Changes:
        """The same, with the changes written: what looks up weights isn't done again
        by each look-up that follows."""
        by = by.collapse()
        return self._new(at, by._with(cut(by._values), outer=by.outer, normal=True))

    # -- what is linear in the weights works on each change -----------------

    def _linear(self, f: Callable[[History], History]) -> Changes:
        return self._new(f(self.at), f(self.by))

    def tmap_hom(self, h: Callable[..., Any], dynamics: str = COLLAPSE) -> Changes:
        return self._linear(lambda x: x.tmap_hom(h, dynamics))

    def tmap(self, f: Callable[..., Any], dynamics: str = COLLAPSE) -> Changes:
        return self._linear(lambda x: x.tmap(f, dynamics))

    def tfilter(self, f: Callable[..., Any]) -> Changes:
        return self._linear(lambda x: x.tfilter(f))

    def flat_map(self, f: Callable[..., Any], dynamics: str = COLLAPSE) -> Changes:
        return self._linear(lambda x: x.flat_map(f, dynamics))

    def map_values_hom(self, f: Callable[..., Any]) -> Changes:
        return self._linear(lambda x: x.map_values_hom(f))

    def inv(self) -> Changes:
        return self._linear(lambda x: x.inv())

    def tadd(self, other: Changes) -> Changes:
        """Pointwise sum over the same graph."""
        return self._new(self.at + other.at, self.by + other.by)

    __add__ = tadd

    def diff(self, merges: bool = True) -> History:
        """For every node the sum of the changes of its edges: no weight is looked up."""
        edges = self.edges
        if not merges:
            alone = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("dst")
            edges = edges.join(alone, "dst", "left_semi")
        g, rows = self.by.g(), self.by._values
        if not merges:
            rows = rows.join(alone.select(F.col("dst").alias("__dst")), F.col("node.dst") == F.col("__dst"), "left_semi")
        rows = rows.select(F.col("node.dst").alias("node"), *self.by.keys, *g.columns)
        return History.from_frames(self.nodes, self.edges, rows, self.by.keys, g, self.by.outer).collapse()

    # -- weights --------------------------------------------------------------

    def order(self) -> DataFrame:
        """(node, root, pos, end, size, parent), see :func:`topology.preorder`."""
        if not self._order:
            place = topology.preorder(self.nodes, self.edges)
            self._order.append(place if hasattr(place, "_dagbag_path") else cut(place))
        return self._order[0]

    def _largest(self) -> int:
        """Nodes of the largest tree."""
        place = self.order()
        if len(self._order) < 2:
            self._order.append(place.agg(F.max("size")).first()[0] or 0)
        return self._order[1]

    def _events(self, at: History, by: History, named: bool) -> DataFrame:
        """(root, keys..., at, weights...): what begins and ends in the trees.

        ``at`` orders them: four times the position, plus 0 for what ends there, 1 for
        what begins, 2 for changes of edges out of the tree, which don't count.  With
        ``named`` there are src and dst of the edges too, null for others; else the
        size of the tree.
        """
        place, keys, weights = self.order(), list(by.keys), list(by.g().columns)
        ends = ["src", "dst"] if named else []
        changed = by._values.select(F.col("node.src").alias("src"), F.col("node.dst").alias("dst"), *keys, *weights)
        placed = changed.join(place.select(F.col("node").alias("dst"), "root", "pos", "end", "size", "parent"), "dst")
        tree, lasts = F.col("parent").eqNullSafe(F.col("src")), F.col("end") < F.col("size")
        name = [F.col(c) for c in ends]
        starts = F.struct((F.col("pos") * 4 + F.when(tree, 1).otherwise(2)).alias("at"), *weights, *name)
        stops = F.struct((F.col("end") * 4).alias("at"), *[(-F.col(c)).cast(t).alias(c) for c, t in zip(weights, by.g().types)], *[F.lit(None).cast(place.schema["node"].dataType).alias(c) for c in ends])
        rest = [] if named else ["size"]
        moved = placed if named else placed.filter(tree)
        steps = moved.select("root", *rest, *keys, F.explode(F.when(tree & lasts, F.array(starts, stops)).otherwise(F.array(starts))).alias("__s")).select("root", *rest, *keys, "__s.*")
        tops = place.filter("node = root").select("node", "root", "size")
        top = at._values.join(tops, "node").select("root", *rest, *keys, F.lit(1).cast("bigint").alias("at"), *weights, *[F.lit(None).cast(place.schema["node"].dataType).alias(c) for c in ends])
        return steps.unionByName(top)

    def _running(self, rows: DataFrame, weights: list[str], kinds: list[str], block: int, **more: Column) -> DataFrame:
        """``rows`` (root, keys..., at, weights...) with running sums __0, __1... and columns
        over their order."""
        keys = ["root", *self.by.keys]
        counted = [F.when(F.col("at") % 4 == 2, 0).otherwise(F.col(c)) for c in weights]
        whole = Window.partitionBy(*keys).orderBy("at")
        # 2 and greater come after all that is at their position
        sums = lambda w: [F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in counted]
        more = {name: c.over(whole) for name, c in more.items()}
        if self._largest() <= block:
            return rows.withColumns({f"__{i}": c.cast(t) for i, (c, t) in enumerate(zip(sums(whole), kinds))} | more)
        rows = rows.withColumn("__b", F.floor(F.col("at") / (4 * block)))
        blocks = rows.groupBy(*keys, "__b").agg(*[F.sum(c).alias(f"__{i}") for i, c in enumerate(counted)])
        past = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carry = blocks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__c"), *[F.coalesce(F.sum(f"__{i}").over(past), F.lit(0)).alias(f"__c{i}") for i in range(len(weights))])
        cond = F.col("__b") == F.col("__c")
        for i, k in enumerate(keys):
            cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        here = Window.partitionBy(*keys, "__b").orderBy("at")
        joined = rows.join(carry, cond).withColumns({f"__{i}": (c + F.col(f"__c{i}")).cast(t) for i, (c, t) in enumerate(zip(sums(here), kinds))})
        return joined.drop("__b", "__c", *[f"__c{i}" for i in range(len(weights))], *[f"__k{i}" for i in range(len(keys))]).withColumns(more)

    def looked_up(self, at: History | None = None, by: History | None = None, block: int = BLOCK) -> DataFrame:
        """Changes (node, keys..., weights...) with the weights after them as __0, __1...

        ``at`` and ``by`` may be those of several histories side by side.
        """
        at, by = (at or self.at).collapse(), (by or self.by).collapse()
        weights = list(by.g().columns)
        sums = self._running(self._events(at, by, True), weights, list(by.g().types), block).filter("dst is not null")
        return sums.select(F.struct("src", "dst").alias("node"), *by.keys, *weights, *[f"__{i}" for i in range(len(weights))])

    def tmap_ix(self, f: Callable[..., Any]) -> Changes:
        """Any f: what it gives for the weight after less what it gives for the one before."""
        rows, by, g = self.looked_up(), self.by, self.by.g()
        after = F.struct(F.lit(1).alias("__sign"), *[F.col(f"__{i}").alias(c) for i, c in enumerate(g.columns)])
        before = F.struct(F.lit(-1).alias("__sign"), *[(F.col(f"__{i}") - F.col(c)).cast(t).alias(c) for i, (c, t) in enumerate(zip(g.columns, g.types))])
        # both in one pass, the sign with the edge
        both = rows.select("node", *by.keys, F.explode(F.array(after, before)).alias("__w")).select(F.struct("node", "__w.__sign").alias("node"), *by.keys, *[f"__w.{c}" for c in g.columns])
        made = by._with(both.filter(g.nonzero()), normal=True).tmap_ix(f, LINEAR)
        signed = [F.when(F.col("node.__sign") < 0, -F.col(c)).otherwise(F.col(c)).cast(t).alias(c) for c, t in zip(g.columns, g.types)]
        new = made._with(made._values.select(F.col("node.node").alias("node"), *made.keys, *signed), made.keys, outer=made.outer)
        return self._kept(self.at.tmap_ix(f), new)

    def tmap_ix2(self, f: Callable[..., Any]) -> Changes:
        """f of key, weight after the change and change gives the change of the result.

        At checkpoints the weight is the change.  The result is a history only if
        ``f(k, x, x - y) = f(k, x, x) - f(k, y, y)``.
        """
        rows, by = self.looked_up(), self.by
        n = len(by.g().columns)
        both = rows.select("node", *by.keys, *[F.col(f"__{i}").alias(f"__x{i}") for i in range(n)], *[F.col(c).alias(f"__d{i}") for i, c in enumerate(by.g().columns)])
        source = by._with(by._values, normal=True)
        source._values = both
        made = source._spread(f, [F.col(k) for k in by.keys] + [F.col(f"__{s}{i}") for s in "xd" for i in range(n)])
        return self._kept(self.at.tmap_ix2(f), by._out(made, COLLAPSE))

    def tjoin(self, other: Changes) -> Changes:
        """Keys of both, weights multiplied; only keys that one of them changes are looked up."""
        g, keys = self.by.g(), list(self.by.keys)
        other = other._new(other.at.rekey(keys), other.by.rekey(keys))
        n = len(g.columns)
        both = Group("both", tuple(f"__{s}{i}" for s in "xy" for i in range(n)), g.types + other.by.g().types)
        beside = lambda x, y: x._with(x._beside(y), keys, both, x.outer, True)
        written = lambda h: h._with(cut(h._values), outer=h.outer, normal=True)
        rows = self.looked_up(beside(self.at, other.at), written(beside(self.by, other.by)))
        new = [[F.col(f"__{s * n + i}") for i in range(n)] for s in range(2)]
        old = [[F.col(f"__{s * n + i}") - F.col(both.columns[s * n + i]) for i in range(n)] for s in range(2)]
        made = [(b - a).cast(t).alias(c) for a, b, t, c in zip(g.multiply(*old), g.multiply(*new), g.types, g.columns)]
        by = self.by._with(rows.select("node", *keys, *made).filter(g.nonzero()), normal=True)
        return self._kept(self.at.tjoin(other.at), by)

    def tcartesian(self, other: Changes) -> Changes:
        """All pairs of keys: the changes of one times the other's weights, and the other way."""
        mine, theirs, edges = self.states(), other.states(), self.edges.select(F.struct("src", "dst").alias("node"), "src", "dst")
        none = edges.filter(F.lit(False)).select("src", "dst")
        on = lambda h, end: History.from_frames(edges.select("node"), none, edges.join(h._values.withColumnRenamed("node", "__n"), F.col(end) == F.col("__n")).drop("__n", "src", "dst"), h.keys, h.g(), normal=True)
        changed = self.by.tcartesian(on(theirs, "dst"))
        return self._new(self.at.tcartesian(other.at), changed + on(mine, "src").tcartesian(other.by))

    def length(self) -> Changes:
        """Total weight as the single key."""
        return self.tmap_hom(lambda *a: [(F.lit(0), a[-1])]).tmap_ix(lambda k, v: [(v, F.lit(1))])

    def states(self, block: int = BLOCK) -> History:
        """The history in state form: runs of positions with the same weight, spread."""
        at, by = self.at.collapse(), self.by.collapse()
        keys, g = list(by.keys), by.g()
        sums = self._running(self._events(at, by, False), list(g.columns), list(g.types), block, __next=F.lead("at"))
        named = [F.col(f"__{i}").alias(c) for i, c in enumerate(g.columns)]
        pos, to = F.floor(F.col("at") / 4).alias("pos"), F.coalesce(F.floor(F.col("__next") / 4), F.col("size")).alias("__to")
        runs = sums.select("root", *keys, pos, to, *named).filter(g.nonzero() & (F.col("__to") > F.col("pos")))
        starts = runs.withColumn("__from", F.explode(F.sequence("pos", F.col("__to") - 1, F.lit(block))))
        places = F.sequence(F.col("__from"), F.least(F.col("__to"), F.col("__from") + block) - 1)
        spread = starts.select("root", *keys, *g.columns, F.explode(places).alias("pos"))
        values = spread.join(self.order().select("root", "pos", "node"), ["root", "pos"]).select("node", *keys, *g.columns)
        return History.from_frames(self.nodes, self.edges, values, keys, g, self.by.outer, normal=True)

    def values(self) -> DataFrame:
        return self.states().values()
