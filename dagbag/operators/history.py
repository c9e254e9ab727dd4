"""Histories: weighted multisets at the nodes of an acyclic graph.

A history is three lazy DataFrames: ``nodes(node)``, ``edges(src, dst)`` from
parent to child, and ``values(node, keys..., weights...)`` with a row for every
key that has a weight other than zero at a node.  Nested maps are stored flat,
their keys as leading key columns (``outer`` says how many), so that grouping and
ungrouping move no data.

Functions given to operators take key columns and give Column expressions, so
that Catalyst sees through them; a Python function is used by wrapping it as a
pandas UDF, with ``dynamics=MEMOIZATION`` to run it once for each distinct key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagbag.functions.groups import INTEGER, Group, pair
from dagbag.plans.memo import memo_apply

#: How an operator treats rows of the same key: sum after it (the default), leave
#: them until a later operator needs sums, or run its function once a key.
COLLAPSE, LINEAR, MEMOIZATION = "collapse", "linear", "memoization"

Keys = Column | dict[str, Column]


class History:
    def __init__(self, nodes: DataFrame, edges: DataFrame, values: DataFrame, keys: Sequence[str] = ("key",), group: Group = INTEGER, outer: int = 0, normal: bool = True):
        self._nodes, self._edges, self._values = nodes, edges, values
        self.keys, self._group, self.outer, self.normal = tuple(keys), group, outer, normal

    # -- construction ------------------------------------------------------

    @classmethod
    def from_frames(cls, nodes: DataFrame, edges: DataFrame, values: DataFrame, keys: Sequence[str] | None = None, group: Group = INTEGER, outer: int = 0, normal: bool = False) -> History:
        """From tables; keys are the columns of ``values`` besides node and weights.

        ``normal`` promises one row a key and no zeros; otherwise rows are summed
        before the first operator that needs sums.
        """
        if keys is None:
            keys = [c for c in values.columns if c != "node" and c not in group.columns]
        return cls(nodes.select("node"), edges.select("src", "dst"), values.select("node", *keys, *group.columns), keys, group, outer, normal)

    @classmethod
    def create(cls, spark: SparkSession, nodes: DataFrame | Callable[[], Iterable[Any]], parents: Callable[[Any], Iterable[Any]], values: Callable[[Any], dict[Any, Any]], node_type: str = "bigint", key_type: str = "string", group: Group = INTEGER) -> History:
        """From three functions; the last two run once a node, on the executors.

        Nodes may be a table (node) as well, which then stays where it is; those of a
        function go through the driver.
        """
        frame = nodes.select(F.col("node").cast(node_type)) if isinstance(nodes, DataFrame) else spark.createDataFrame([(n,) for n in nodes()], f"node {node_type}")

        def in_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(p, n) for n in b.node.tolist() for p in parents(n)]
                yield pd.DataFrame(rows, columns=["src", "dst"])

        def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(n, k, *(v if isinstance(v, tuple) else (v,))) for n in b.node.tolist() for k, v in values(n).items()]
                yield pd.DataFrame(rows, columns=["node", "key", *group.columns])

        edges = frame.mapInPandas(in_edges, f"src {node_type}, dst {node_type}")
        columns = ", ".join(f"{c} {t}" for c, t in zip(group.columns, group.types))
        return cls.from_frames(frame, edges, frame.mapInPandas(weights, f"node {node_type}, key {key_type}, {columns}"), ["key"], group)

    def _with(self, values: DataFrame, keys: Sequence[str] | None = None, group: Group | None = None, outer: int | None = None, normal: bool = False, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> History:
        keys = self.keys if keys is None else tuple(keys)
        group = group or self._group
        outer = (self.outer if len(keys) == len(self.keys) else 0) if outer is None else outer
        cls = type(self)
        out = cls.__new__(cls)
        out.__dict__.update(self.__dict__)
        History.__init__(out, self._nodes if nodes is None else nodes, self._edges if edges is None else edges, values.select("node", *keys, *group.columns), keys, group, outer, normal)
        return out

    def rekey(self, keys: Sequence[str], outer: int | None = None) -> History:
        """The same with other names for the key columns."""
        new = [F.col(a).alias(b) for a, b in zip(self.keys, keys)]
        return self._with(self._values.select("node", *new, *self._group.columns), keys, outer=self.outer if outer is None else outer, normal=self.normal)

    # -- access ------------------------------------------------------------

    def g(self) -> Group:
        return self._group

    def nodes(self) -> DataFrame:
        return self._nodes

    def edges(self) -> DataFrame:
        return self._edges

    def size(self) -> int:
        return self._nodes.count()

    def values(self) -> DataFrame:
        """(node, keys..., weights...): one row a key, no zeros."""
        return self.collapse()._values

    def collapse(self) -> History:
        """Sum the rows of equal keys and drop zeros; nothing if that is so already."""
        if self.normal:
            return self
        summed = self._values.groupBy("node", *self.keys).agg(*self._group.total())
        return self._with(summed.filter(self._group.nonzero()), outer=self.outer, normal=True)

    def topology(self) -> History:
        """Every node has itself, once."""
        values = self._nodes.select("node", F.col("node").alias("key"), F.lit(1).cast("bigint").alias("val"))
        return self._with(values, ["key"], INTEGER, 0, True)

    def index(self) -> DataFrame:
        """(node, entries): the canonical array of each node's keys and weights,
        empty where a node has none."""
        entry = F.struct(*self.keys, *self._group.columns)
        entries = self.values().groupBy("node").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        return self._nodes.join(entries, "node", "left").withColumn("entries", F.coalesce("entries", F.array().cast(entries.schema["entries"].dataType)))

    def __iter__(self) -> Iterator[tuple[Any, dict[Any, Any]]]:
        """(node, map) of every node, a partition at a time."""
        k, n = len(self.keys), len(self._group.columns)
        for row in self.index().toLocalIterator():
            found = {}
            for e in row.entries:
                key, val = tuple(e[:k]), tuple(e[k:])
                found[key[0] if k == 1 else key] = val[0] if n == 1 else val
            yield row.node, found

    def nested(self) -> DataFrame:
        """(node, outer keys..., map) with inner keys as a map column."""
        inner, heads = self.keys[self.outer :], self.keys[: self.outer]
        key = F.col(inner[0]) if len(inner) == 1 else F.struct(*inner)
        val = F.col(self._group.columns[0]) if len(self._group.columns) == 1 else F.struct(*self._group.columns)
        return self.values().groupBy("node", *heads).agg(F.map_from_entries(F.collect_list(F.struct(key.alias("key"), val.alias("val")))).alias("map"))

    # -- core algebra ------------------------------------------------------

    def diff(self, merges: bool = True) -> History:
        """For every edge the child's values less the parent's, summed by child.

        Roots are empty.  Without ``merges`` nodes of several parents are empty
        too.  The child's side is one row a node and key whatever the number of
        parents, the parents' one a row an edge and key.
        """
        indegree = self._edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("__in"))
        edges = self._edges
        if not merges:
            indegree = indegree.filter(F.col("__in") == 1)
            edges = edges.join(indegree.select(F.col("node").alias("dst")), "dst", "left_semi")
        cols = [F.col(c) for c in self._group.columns]
        weigh = lambda by: [(c * by).cast(t).alias(n) for c, t, n in zip(cols, self._group.types, self._group.columns)]
        plus = self._values.join(indegree, "node").select("node", *self.keys, *weigh(F.col("__in")))
        minus = edges.join(self._values, edges["src"] == self._values["node"]).select(edges["dst"].alias("node"), *self.keys, *weigh(F.lit(-1)))
        return self._with(plus.unionAll(minus), outer=self.outer).collapse()

    def _spread(self, h: Callable[..., Any], arguments: list[Column], memo: bool = False) -> DataFrame:
        """node and the (key, weight) entries that h gives for each row.

        h gives a list of (key, weight) pairs, or one Column that is an array of
        structs of key columns and weights.
        """
        made = h(*arguments)
        if isinstance(made, Column):
            rows = self._values.select("node", F.explode(made).alias("__e"))
        else:
            entries = [F.struct(*self._named(k), *self._weights(w)) for k, w in made]
            if not entries:
                raise ValueError("the function gives no entries")
            rows = self._values.select("node", F.explode(F.array(*entries)).alias("__e"))
        return rows.select("node", "__e.*")

    def _named(self, key: Keys) -> list[Column]:
        if isinstance(key, dict):
            return [c.alias(n) for n, c in key.items()]
        return [key.alias("key")]

    def _weights(self, w: Column | Sequence[Column]) -> list[Column]:
        w = [w] if isinstance(w, Column) else list(w)
        return [c.cast(t).alias(n) for c, t, n in zip(w, self._group.types, self._group.columns)]

    def _out(self, rows: DataFrame, dynamics: str, group: Group | None = None) -> History:
        group = group or self._group
        keys = [c for c in rows.columns if c != "node" and c not in group.columns]
        out = self._with(rows, keys, group, 0)
        return out if dynamics == LINEAR else out.collapse()

    def tmap_hom(self, h: Callable[..., Any], dynamics: str = COLLAPSE) -> History:
        """Sum of ``h(*keys, *weights)`` over a node's keys; h must be linear in the
        weight, so it may see partial sums."""
        return self._out(self._spread(h, [F.col(c) for c in (*self.keys, *self._group.columns)]), dynamics)

    def tmap_ix(self, f: Callable[..., Any], dynamics: str = COLLAPSE) -> History:
        """The same for any f: it sees the whole weight of a key, never zero."""
        x = self.collapse()
        return x._out(x._spread(f, [F.col(c) for c in (*x.keys, *x._group.columns)]), dynamics)

    def tmap_ix2(self, f: Callable[..., Any], dynamics: str = COLLAPSE) -> History:
        """The same for f of key, weight and change of the weight; states are
        computed from scratch here, so the change is the weight itself."""
        n = len(self._group.columns)
        return self.tmap_ix(lambda *a: f(*a, *a[-n:]), dynamics)

    def tadd(self, other: History) -> History:
        """Pointwise sum; the graphs are united."""
        if self._nodes is other._nodes and self._edges is other._edges:
            nodes, edges = self._nodes, self._edges
        else:
            nodes = self._nodes.unionByName(other._nodes).distinct()
            edges = self._edges.unionByName(other._edges).distinct()
        theirs = other.rekey(self.keys)._values
        return self._with(self._values.unionByName(theirs), outer=self.outer, nodes=nodes, edges=edges).collapse()

    __add__ = tadd

    def _meet(self, other: History) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges that both graphs have."""
        if self._nodes is other._nodes and self._edges is other._edges:
            return self._nodes, self._edges
        return self._nodes.join(other._nodes, "node", "left_semi"), self._edges.join(other._edges, ["src", "dst"], "left_semi")

    def _product(self, x: str, y: str) -> list[Column]:
        g = self._group
        return [p.cast(t).alias(c) for p, t, c in zip(g.multiply([F.col(f"{x}.{c}") for c in g.columns], [F.col(f"{y}.{c}") for c in g.columns]), g.types, g.columns)]

    def tcartesian(self, other: History) -> History:
        """All pairs of keys at a node, weights multiplied; the graphs' meet.

        Rows that aren't summed yet are fine: multiplication distributes.
        """
        nodes, edges = self._meet(other)
        mine = [f"{k}_1" if k in other.keys else k for k in self.keys]
        theirs = [f"{k}_2" if k in self.keys else k for k in other.keys]
        rows = self._values.alias("x").join(other._values.alias("y"), F.col("x.node") == F.col("y.node"))
        keys = [F.col(f"x.{k}").alias(n) for k, n in zip(self.keys, mine)] + [F.col(f"y.{k}").alias(n) for k, n in zip(other.keys, theirs)]
        out = self._with(rows.select(F.col("x.node").alias("node"), *keys, *self._product("x", "y")), [*mine, *theirs], outer=0, nodes=nodes, edges=edges)
        return out._settled(self.normal and other.normal)

    def _settled(self, unique: bool) -> History:
        """With zeros dropped; summed too unless keys are unique already."""
        if not unique:
            return self.collapse()
        return self._with(self._values.filter(self._group.nonzero()), outer=self.outer, normal=True)

    def _beside(self, other: History) -> DataFrame:
        """(node, keys..., x..., y...): total weights of both, 0 where one has none.

        One aggregation over the union: inputs that are partitioned by node and
        key already aren't shuffled again, rows that aren't summed yet needn't
        be, and null keys are keys like others.
        """
        sides = [("x", self), ("y", other.rekey(self.keys))]
        parts, totals = [], []
        for s, h in sides:
            parts.append(h._values.select("node", *self.keys, *[
                (F.col(c) if s == t else F.lit(0)).cast(k).alias(f"__{t}{i}") for t, g in sides for i, (c, k) in enumerate(zip(g._group.columns, g._group.types))
            ]))
            totals += [F.sum(f"__{s}{i}").cast(k).alias(f"__{s}{i}") for i, k in enumerate(h._group.types)]
        return parts[0].unionByName(parts[1]).groupBy("node", *self.keys).agg(*totals)

    def tjoin(self, other: History) -> History:
        """Keys that both have at a node, weights multiplied."""
        nodes, edges = self._meet(other)
        g = self._group
        x, y = ([F.col(f"__{s}{i}") for i in range(len(g.columns))] for s in "xy")
        made = [p.cast(t).alias(c) for p, t, c in zip(g.multiply(x, y), g.types, g.columns)]
        rows = self._beside(other).filter(g.nonzero(x) & g.nonzero(y)).select("node", *self.keys, *made)
        return self._with(rows.filter(g.nonzero()), outer=self.outer, normal=True, nodes=nodes, edges=edges)

    def tmap(self, f: Callable[..., Keys], dynamics: str = COLLAPSE) -> History:
        """Each key becomes f(key); weights of keys that meet are summed."""
        if dynamics == MEMOIZATION:
            as_struct = lambda *k: F.struct(*self._named(f(*k)))
            rows = memo_apply(self._values, self.keys, as_struct, "__k").select("node", "__k.*", *self._group.columns)
        else:
            rows = self._values.select("node", *self._named(f(*map(F.col, self.keys))), *self._group.columns)
        return self._out(rows, dynamics)

    def tfilter(self, f: Callable[..., Column]) -> History:
        """Keys for which f holds (null counts as no)."""
        return self._with(self._values.filter(f(*map(F.col, self.keys))), outer=self.outer, normal=self.normal)

    # -- derived operators -------------------------------------------------

    @staticmethod
    def single(key: Column) -> Column:
        """The bag of one key, as an array of entries for :meth:`flat_map`."""
        return F.array(F.struct(key.alias("key"), F.lit(1).cast("bigint").alias("val")))

    @staticmethod
    def bag(items: Column) -> Column:
        """The bag of an array's elements, as entries; repeats add up later."""
        return F.transform(items, lambda x: F.struct(x.alias("key"), F.lit(1).cast("bigint").alias("val")))

    def zero(self) -> History:
        """The same graph without any values."""
        return self._with(self._values.filter(F.lit(False)), outer=self.outer, normal=True)

    def map_values(self, f: Callable[..., Any]) -> History:
        """Each weight becomes f(weight); zeros go."""
        x = self.collapse()
        new = self._weights(f(*[F.col(c) for c in x._group.columns]))
        return x._with(x._values.select("node", *x.keys, *new).filter(x._group.nonzero()), outer=x.outer, normal=True)

    def map_values_hom(self, f: Callable[..., Any]) -> History:
        """The same for a linear f, which may see partial sums."""
        new = self._weights(f(*[F.col(c) for c in self._group.columns]))
        out = self._with(self._values.select("node", *self.keys, *new), outer=self.outer)
        return out._settled(self.normal)

    def parents(self) -> History:
        """Keys (parent, child) at every child; the weight is minus its in-degree."""
        indegree = self._edges.groupBy("dst").agg(F.count(F.lit(1)).alias("__in"))
        rows = self._edges.join(indegree, "dst").select(F.col("dst").alias("node"), F.col("src").alias("parent"), F.col("dst").alias("child"), (-F.col("__in")).alias("val"))
        return self._with(rows, ["parent", "child"], INTEGER, 0, True)

    def escape(self) -> History:
        """A node's whole map becomes its only key, as a canonical array."""
        entry = F.struct(*self.keys, *self._group.columns)
        rows = self.values().groupBy("node").agg(F.array_sort(F.collect_list(entry)).alias("key"))
        return self._with(rows.withColumn("val", F.lit(1).cast("bigint")), ["key"], INTEGER, 0, True)

    map = tmap

    def filter(self, f: Callable[..., Column], dynamics: str = LINEAR) -> History:
        """Keys for which f holds.  With MEMOIZATION f, then usually a Python
        function, runs once for each distinct key."""
        if dynamics != MEMOIZATION:
            return self.tfilter(f)
        kept = memo_apply(self._values, self.keys, f, "__keep").filter("__keep").drop("__keep")
        return self._with(kept, outer=self.outer, normal=self.normal)

    def inv(self) -> History:
        new = [(-F.col(c)).alias(c) for c in self._group.columns]
        return self._with(self._values.select("node", *self.keys, *new), outer=self.outer, normal=self.normal)

    def flat_map(self, f: Callable[..., Column], dynamics: str = COLLAPSE) -> History:
        """f gives an array of (key, val) entries; their weights are multiplied by
        the key's."""
        if dynamics == MEMOIZATION:
            rows = memo_apply(self._values, self.keys, f, "__a")
        else:
            rows = self._values.withColumn("__a", f(*map(F.col, self.keys)))
        rows = rows.select("node", *[F.col(c).alias(f"__{c}") for c in self._group.columns], F.explode("__a").alias("__e"))
        inner = rows.schema["__e"].dataType.names
        keys = [k for k in inner if k not in self._group.columns]
        made = self._group.multiply([F.col(f"__{c}") for c in self._group.columns], [F.col(f"__e.{c}") for c in self._group.columns])
        rows = rows.select("node", *[F.col(f"__e.{k}").alias(k) for k in keys], *self._weights(made))
        return self._out(rows, COLLAPSE if dynamics == MEMOIZATION else dynamics)

    def collect(self, defined: Callable[..., Column], f: Callable[..., Keys], dynamics: str = COLLAPSE) -> History:
        """tmap by a partial function: f where ``defined`` holds."""
        return self.tfilter(defined).tmap(f, dynamics)

    def filter_values(self, f: Callable[..., Column]) -> History:
        """Keys whose weight satisfies f."""
        x = self.collapse()
        return x._with(x._values.filter(f(*[F.col(c) for c in x._group.columns])), outer=x.outer, normal=True)

    def to_bag(self, name: str = "w") -> History:
        """The pair of key and weight becomes the key, with weight 1."""
        x = self.collapse()
        names = [name] if len(x._group.columns) == 1 else [f"{name}{i + 1}" for i in range(len(x._group.columns))]
        moved = [F.col(c).alias(n) for c, n in zip(x._group.columns, names)]
        return x._with(x._values.select("node", *x.keys, *moved).withColumn("val", F.lit(1).cast("bigint")), [*x.keys, *names], INTEGER, 0, True)

    join = tjoin

    def cogroup(self, other: History) -> History:
        """Pairs of weights of every key of either; a missing one is zero."""
        nodes, edges = self._meet(other)
        group = pair(self._group, other._group)
        rows = self._beside(other).select("node", *self.keys, F.col("__x0").alias("val1"), F.col("__y0").alias("val2"))
        return self._with(rows.filter(group.nonzero()), group=group, outer=self.outer, normal=True, nodes=nodes, edges=edges)

    def group_by(self, f: Callable[..., Column], name: str = "group") -> History:
        """Nest by f(key): a leading key column, no data moves."""
        rows = self._values.withColumn(name, f(*map(F.col, self.keys)))
        return self._with(rows, [name, *self.keys], outer=1, normal=self.normal)

    def group(self) -> History:
        """The first of several keys becomes the outer one."""
        if len(self.keys) < 2:
            raise ValueError("only a history of pairs can be grouped")
        return self._with(self._values, outer=1, normal=self.normal)

    def ungroup(self) -> History:
        return self._with(self._values, outer=0, normal=self.normal)

    def flatten(self) -> History:
        """Keys that are maps (arrays of entries or map columns) are spread, their
        weights multiplied by the key's."""
        (key,) = self.keys
        if self._values.schema[key].dataType.typeName() == "map":
            entries = lambda k: F.transform(F.map_entries(k), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("val")))
            return self.flat_map(entries)
        return self.flat_map(lambda k: k)

    def length(self) -> History:
        """Total weight: of a bag as its single key, of each group as its weight."""
        if self.outer:
            return self._with(self._values.select("node", *self.keys[: self.outer], *self._group.columns), self.keys[: self.outer], outer=0).collapse()
        return self._scalar(F.sum(self._group.columns[0]))

    def sum(self) -> History:
        """The same for the sum of elements times weights of numeric elements."""
        element = F.col(self.keys[-1]) * F.col(self._group.columns[0])
        if self.outer:
            rows = self._values.select("node", *self.keys[: self.outer], element.cast(self._group.types[0]).alias(self._group.columns[0]))
            return self._with(rows, self.keys[: self.outer], outer=0).collapse()
        return self._scalar(F.sum(element))

    def _scalar(self, total: Column) -> History:
        rows = self._values.groupBy("node").agg(total.cast(self._group.types[0]).alias("key")).filter("key <> 0")
        return self._with(rows.withColumn("val", F.lit(1).cast("bigint")), ["key"], INTEGER, 0, True)

    def avg(self) -> History:
        """Mean element of each group, a double; means that are 0 go."""
        from dagbag.functions.groups import DOUBLE

        v = F.col(self._group.columns[0])
        rows = self._values.groupBy("node", *self.keys[: self.outer]).agg(F.sum(F.col(self.keys[-1]) * v).cast("double").alias("__s"), F.sum(v).alias("__n"))
        rows = rows.filter("__n <> 0 and __s <> 0").select("node", *self.keys[: self.outer], (F.col("__s") / F.col("__n")).alias("val"))
        return self._with(rows, self.keys[: self.outer], DOUBLE, 0, True)

    def distinct(self) -> History:
        """Weights clamped to -1 and 1."""
        return self.map_values(lambda v: F.signum(v.cast("double")))

    def added(self) -> History:
        return self.filter_values(lambda v: v > 0)

    def removed(self) -> History:
        """Negative weights; they stay negative."""
        return self.filter_values(lambda v: v < 0)
