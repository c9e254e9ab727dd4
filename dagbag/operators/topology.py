"""Graph utilities over ``nodes(node)`` and ``edges(src, dst)`` tables.

Components of few nodes and edges are searched each in one task.  Searches in larger
ones go by frontiers: a round joins only what the last one found, and its
result is a written table, so plans stay short and a lost executor costs one
round.  Numbering of rows is by ranges; no window gathers a table in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dagbag.plans.components import components
from dagbag.plans.lineage import cut, drop

#: Edges up to which a graph is contracted in one process.
LOCAL_EDGES = 200_000
#: Nodes and edges up to which a component is searched in one task: where that takes time in
#: proportion, where branches are searched from each merge, and where all pairs are made.
TASK_ROWS, TASK_SEARCH, TASK_PAIRS = 50_000, 10_000, 1_000


def _tagged(nodes: DataFrame, edges: DataFrame, limit: int, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None] | None:
    """(component, kind, src, dst) of all nodes (kind 0, without dst), edges (1) and ``more``
    edges (2), and the components of more than ``limit`` rows, None if there are none.

    None where nodes aren't numbers or strings, or nothing fits the limit.
    """
    kind = nodes.schema["node"].dataType
    if limit <= 0 or not isinstance(kind, (T.IntegralType, T.StringType)):
        return None
    found = cut(components(nodes.select("node").distinct(), edges))
    row = lambda k, e: e.join(found.withColumnRenamed("node", "src"), "src").select("component", F.lit(k).alias("kind"), "src", "dst")
    rows = found.select("component", F.lit(0).alias("kind"), F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst")).unionAll(row(1, edges))
    rows = cut(rows if more is None else rows.unionAll(row(2, more)))
    drop(found)
    large = cut(rows.groupBy("component").count().filter(F.col("count") > limit).select("component"))
    return rows, None if large.isEmpty() else large


def _in_tasks(rows: DataFrame, f: Callable[..., Iterable[tuple] | None], schema: str | T.StructType) -> DataFrame:
    """What ``f(component, nodes, edges, more edges)`` gives for each component of tagged
    rows; it gives None for a cycle.  The first column of the result is never null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
        parts: tuple[set, ...] = (set(), set(), set())
        now = None
        for batch in batches:
            for component, kind, src, dst in zip(*(c.to_pylist() for c in batch.columns)):
                if component != now:
                    if parts[0]:
                        got = f(now, *parts)
                        out.extend([(None,) * len(arrow)] if got is None else got)
                    if len(out) > 50_000:
                        yield made()
                        out.clear()
                    now, parts = component, (set(), set(), set())
                parts[kind].add((src, dst) if kind else src)
        if parts[0]:
            got = f(now, *parts)
            out.extend([(None,) * len(arrow)] if got is None else got)
        if out:
            yield made()

    done = cut(rows.repartition("component").sortWithinPartitions("component").mapInArrow(run, schema))
    if not done.filter(F.col(schema.names[0]).isNull()).isEmpty():
        raise ValueError("the graph has a cycle")
    return done


def _apart(nodes: DataFrame, edges: DataFrame, limit: int, f: Callable[..., Iterable[tuple] | None], schema: T.StructType, far: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Small components in tasks by f, others by ``far`` of their nodes and edges."""
    tagged = _tagged(nodes, edges, limit)
    if tagged is None:
        return far(nodes, edges)
    rows, large = tagged
    if large is None:
        done = _in_tasks(rows, f, schema)
        drop(rows)
        return done
    small, rest = rows.join(large, "component", "left_anti"), cut(rows.join(large, "component", "left_semi"))
    found = far(rest.filter("kind = 0").select(F.col("src").alias("node")), rest.filter("kind = 1").select("src", "dst"))
    return _in_tasks(small.select(*rows.columns), f, schema).unionByName(found.select(*schema.names))


def _fields(kind: T.DataType, *named: tuple[str, T.DataType | None]) -> T.StructType:
    return T.StructType([T.StructField(name, t or kind) for name, t in named])


def _both_ways(nodes: Iterable, edges: Iterable[tuple]) -> tuple[dict, dict]:
    parents: dict = {n: [] for n in nodes}
    children: dict = {n: [] for n in nodes}
    for a, b in edges:
        parents[b].append(a)
        children[a].append(b)
    return parents, children


def _levels_local(parents: dict, children: dict) -> dict | None:
    """Longest paths that end at each node; None if there is a cycle."""
    level, left, todo = dict.fromkeys(parents, 0), {n: len(p) for n, p in parents.items()}, [n for n, p in parents.items() if not p]
    done = 0
    while todo:
        a = todo.pop()
        done += 1
        below = level[a] + 1
        for b in children[a]:
            if level[b] < below:
                level[b] = below
            left[b] -= 1
            if not left[b]:
                todo.append(b)
    return level if done == len(parents) else None


def _bypass_local(parents: dict, level: dict) -> set:
    redundant = set()
    for n, ps in parents.items():
        if len(ps) > 1:
            floor = min(level[p] for p in ps)
            seen, todo = set(), [a for p in ps for a in parents[p]]
            while todo:
                a = todo.pop()
                if a not in seen and level[a] >= floor:
                    seen.add(a)
                    todo += parents[a]
            redundant |= {(p, n) for p in ps if p in seen}
    return redundant


def _preorder_local(nodes: set, edges: set) -> list[tuple] | None:
    up: dict = {}
    for a, b in edges:
        if b not in up or a < up[b]:
            up[b] = a
    below: dict = {n: [] for n in nodes}
    for b in sorted(up, reverse=True):  # the stack gives the least first
        below[up[b]].append(b)
    out = []
    for root in nodes:
        if root in up:
            continue
        order, todo, size = [], [root], {}
        while todo:
            a = todo.pop()
            order.append(a)
            todo += below[a]
        for a in reversed(order):
            size[a] = 1 + sum([size[b] for b in below[a]])
        out += [(a, root, i, i + size[a], len(order), up.get(a)) for i, a in enumerate(order)]
    return out if len(out) == len(nodes) else None


def _closure_local(children: dict) -> Iterator[tuple]:
    for a in children:
        seen, todo = set(), list(children[a])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += children[b]
        for b in seen:
            yield a, b


def _doubled(links: DataFrame, n: int) -> DataFrame:
    """(node, head, dist) for ``links(node, next, w)``, each node having one next: the
    first node on the way that has none, and the sum of w up to it.

    Pointers double, so a chain of n takes log n rounds.
    """
    table = cut(links.select("node", "next", "w"))
    for _ in range(n.bit_length() + 1):
        now = table.select("node", "next", "w")
        ahead = now.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("w").alias("w2"))
        new = cut(now.join(ahead, "next", "left").select("node", F.coalesce("next2", "next").alias("next"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), "next2"))
        drop(table)
        table = new
        if table.filter("next2 is not null").isEmpty():
            return table.select("node", F.col("next").alias("head"), F.col("w").alias("dist"))
    raise ValueError("the graph has a cycle")


def levels(nodes: DataFrame, edges: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(node, level): the length of the longest path that ends at the node.

    Raises ValueError if the graph has a cycle.
    """
    schema = _fields(nodes.schema["node"].dataType, ("node", None), ("level", T.IntegerType()))
    return _apart(nodes, edges, task_rows, lambda _, ns, es, more: (found := _levels_local(*_both_ways(ns, es))) and found.items(), schema, _levels_far)


def _levels_far(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """:func:`levels` in large components.

    Nodes of one parent hang from the next node above that hasn't just one, at a
    known distance (found by doubling), and leave the graph; of the edges between
    the same two nodes that this makes the longest stays, so that branches that
    part and meet again become one edge.  Nodes whose parents all have levels get
    theirs.  Both are repeated until no edge is left: rounds grow with how deeply
    branches are nested and with the logarithm of their length, not with the depth.
    """
    nodes = cut(nodes.select("node").distinct())
    n = nodes.count()
    edges = cut(edges.select("src", "dst").distinct().withColumn("w", F.lit(1).cast("bigint")))
    # longest way to a node from those that have levels; for the others edges tell
    base = cut(nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(0).cast("bigint")))
    known, hanging = [], []
    while True:
        # what has no edge left has its level
        rest = edges.select(F.col("dst").alias("node")).distinct()
        have = cut(base.join(rest, "node", "left_anti"))
        known.append(have)
        if edges.isEmpty():
            break
        from_known = have.select(F.col("node").alias("src"), "level")
        told = edges.join(from_known, "src").select(F.col("dst").alias("node"), (F.col("level") + F.col("w")).alias("level"))
        new_base = cut(base.join(rest, "node", "left_semi").unionAll(told).groupBy("node").agg(F.max("level").alias("level")))
        new_edges = cut(edges.join(from_known, "src", "left_anti"))
        single = new_edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("next"), F.min("w").alias("w")).filter("n = 1").drop("n")
        single = cut(single.join(new_base, "node", "left_anti"))
        if single.isEmpty():
            if have.isEmpty():
                raise ValueError("the graph has a cycle")
            base, edges = new_base, new_edges
            continue
        found = _doubled(single, n)
        hanging.append(found)
        to = found.select(F.col("node").alias("src"), "head", "dist")
        moved = new_edges.join(found.select(F.col("node").alias("dst")), "dst", "left_anti").join(to, "src", "left")
        moved = moved.select(F.coalesce("head", "src").alias("src"), "dst", (F.col("w") + F.coalesce("dist", F.lit(0))).alias("w"))
        base, edges = new_base, cut(moved.groupBy("src", "dst").agg(F.max("w").alias("w")))
    out = cut(reduce(DataFrame.unionAll, known))
    for found in reversed(hanging):
        below = found.join(out.select(F.col("node").alias("head"), "level"), "head").select("node", (F.col("level") + F.col("dist")).alias("level"))
        out = cut(out.unionAll(below))
    if out.count() < n:
        raise ValueError("the graph has a cycle")
    return out.select("node", F.col("level").cast("int").alias("level"))


def numbered(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``df`` with the place (from 0) of each row in the given order.

    Rows are range-partitioned and numbered within partitions; only the sizes of
    partitions go through the driver.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    placed = cut(placed.withColumn(name, F.row_number().over(Window.partitionBy("__part").orderBy(*order)).cast("bigint") - 1))
    sizes = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())
    start, at = [], 0
    for part, size in sizes:
        start.append((part, at))
        at += size
    starts = df.sparkSession.createDataFrame(start, "__part int, __start bigint")
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col(name) + F.col("__start")).drop("__part", "__start")


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, position): parents come before children."""
    return numbered(levels(nodes, edges), "level", "node")


def preorder(nodes: DataFrame, edges: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(node, root, pos, end, size, parent): places in a preorder of a spanning forest.

    A node's tree parent is its least one.  Nodes below it have the positions from
    ``pos`` to before ``end`` of the tree of ``root``, which has ``size`` nodes.
    """
    long = T.LongType()
    schema = _fields(nodes.schema["node"].dataType, ("node", None), ("root", None), ("pos", long), ("end", long), ("size", long), ("parent", None))
    return _apart(nodes, edges, task_rows, lambda _, ns, es, more: _preorder_local(ns, es), schema, _preorder_far)


def _preorder_far(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """:func:`preorder` in large components.

    The way round a tree, in at each node and out again, is a list; places follow from
    distances to its end, which are found by doubling, so rounds grow with the logarithm
    of the size of a tree.
    """
    nodes = cut(nodes.select("node").distinct())
    tree = cut(edges.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent")))
    placed = cut(numbered(tree, "parent", "node", name="at"))
    after = placed.select((F.col("at") - 1).alias("at"), F.col("parent").alias("same"), F.col("node").alias("sibling"))
    siblings = placed.join(after, "at", "left").select("node", "parent", F.when(F.col("same") == F.col("parent"), F.col("sibling")).alias("sibling"))
    firsts = tree.groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("child"))
    step = lambda n, out: F.struct(n.alias("n"), F.lit(out).alias("out"))
    into = nodes.join(firsts, "node", "left").select(step(F.col("node"), False).alias("node"), F.when(F.col("child").isNotNull(), step(F.col("child"), False)).otherwise(step(F.col("node"), True)).alias("next"), F.lit(1).cast("bigint").alias("w"))
    back = siblings.select(step(F.col("node"), True).alias("node"), F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), False)).otherwise(step(F.col("parent"), True)).alias("next"), F.lit(0).cast("bigint").alias("w"))
    left = cut(_doubled(into.unionAll(back), 2 * nodes.count()))
    came = left.filter("not node.out").select(F.col("node.n").alias("node"), F.col("head.n").alias("root"), F.col("dist").alias("begin"))
    went = left.filter("node.out").select(F.col("node.n").alias("node"), F.col("dist").alias("rest"))
    total = came.filter("node = root").select("root", F.col("begin").alias("total"))
    out = came.join(total, "root").join(went, "node", "left").join(tree, "node", "left")
    return out.select("node", "root", (F.col("total") - F.col("begin")).alias("pos"), (F.col("total") - F.coalesce("rest", F.lit(0))).alias("end"), F.col("total").alias("size"), "parent")


def component_order(nodes: DataFrame, edges: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(node, component, level, position): topological order, one component after
    the other."""
    schema = _fields(nodes.schema["node"].dataType, ("node", None), ("component", None), ("level", T.IntegerType()))
    far = lambda ns, es: cut(_levels_far(ns, es).join(connected_components(ns, es), "node").select(*schema.names))

    def near(component, ns: set, es: set, more: set) -> Iterable[tuple] | None:
        found = _levels_local(*_both_ways(ns, es))
        return found and [(n, component, x) for n, x in found.items()]

    both = _apart(nodes, edges, task_rows, near, schema, far)
    return numbered(both, "component", "level", "node").select("node", "component", "level", "position")


def slices(df: DataFrame, n: int, position: str = "position", name: str = "slice") -> DataFrame:
    """Cut a numbered table into n runs of nearly equal length, the last ones one
    row longer.  With fewer rows than n the first runs are empty."""
    size = df.count()
    short, longer = divmod(size, n)
    plain = (n - longer) * short  # rows in the runs of the shorter length
    p = F.col(position)
    first = F.floor(p / max(short, 1)) if short else F.lit(0)
    return df.withColumn(name, F.when(p < plain, first).otherwise((n - longer) + F.floor((p - plain) / (short + 1))).cast("int"))


def incoming(edges: DataFrame) -> DataFrame:
    """(node, parents): sorted arrays, for nodes with a parent."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("parents"))


def outgoing(edges: DataFrame) -> DataFrame:
    """(node, children): sorted arrays, for nodes with a child."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("children"))


def indegree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("val"))


def outdegree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("val"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node of the component; lone nodes too."""
    return components(nodes, edges)


def merge_sets(members: DataFrame) -> DataFrame:
    """(element, component) of ``members(set, element)``: sets that share an
    element are united, the least element stands for the union."""
    head = members.groupBy("set").agg(F.min("element").alias("head"))
    edges = members.join(head, "set").select(F.col("element").alias("src"), F.col("head").alias("dst"))
    found = components(members.select(F.col("element").alias("node")).distinct(), edges)
    return found.select(F.col("node").alias("element"), "component")


def closure(edges: DataFrame, task_rows: int = TASK_PAIRS) -> DataFrame:
    """(src, dst): all pairs joined by a path of one edge or more."""
    edges = cut(edges.select("src", "dst"))
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst"))
    schema = _fields(edges.schema["src"].dataType, ("src", None), ("dst", None))
    return _apart(nodes, edges, task_rows, lambda _, ns, es, more: _closure_local(_both_ways(ns, es)[1]), schema, lambda ns, es: _closure_far(es))


def _closure_far(edges: DataFrame) -> DataFrame:
    """:func:`closure` in large components.

    A round joins the pairs of the last one with the edges; pairs are written once,
    by the round that finds them.
    """
    base = cut(edges.select("src", "dst").distinct())
    parts = [base]
    while True:
        step = parts[-1].select("src", F.col("dst").alias("mid")).join(base.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        new = cut(step.join(reduce(DataFrame.unionAll, parts), ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return reduce(DataFrame.unionAll, parts)
        parts.append(new)
        if len(parts) % 32 == 0:  # plans stay short
            parts[1:-1] = [cut(reduce(DataFrame.unionAll, parts[1:-1]))]


def bypass(nodes: DataFrame, edges: DataFrame, level: DataFrame | None = None, task_rows: int = TASK_SEARCH) -> DataFrame:
    """(src, dst): edges from a node that also is an ancestor of another parent."""

    def near(_, ns: set, es: set, more: set) -> Iterable[tuple] | None:
        parents, children = _both_ways(ns, es)
        found = _levels_local(parents, children)
        return found and _bypass_local(parents, found)

    schema = _fields(nodes.schema["node"].dataType, ("src", None), ("dst", None))
    return _apart(nodes, edges, task_rows, near, schema, lambda ns, es: _bypass_far(ns, es, level))


def _bypass_far(nodes: DataFrame, edges: DataFrame, level: DataFrame | None = None) -> DataFrame:
    """:func:`bypass` in large components.

    Only from children of several parents a search goes up, from each other
    parent, and no higher than the edge's source; the closure isn't built.
    """
    edges = cut(edges.select("src", "dst").distinct())
    level = cut(level if level is not None else _levels_far(nodes, edges))
    many = edges.groupBy("dst").count().filter("count > 1").select("dst")
    mine = edges.join(many, "dst", "left_semi")
    high = level.select(F.col("node").alias("src"), F.col("level").alias("floor"))
    todo = mine.join(high, "src").alias("a").join(mine.alias("b"), F.expr("a.dst = b.dst and a.src <> b.src"))
    # a pair is (source that may be found above, place of the search)
    start = cut(todo.select(F.col("a.src").alias("src"), F.col("a.dst").alias("dst"), "floor", F.col("b.src").alias("at")).distinct())
    up = edges.select(F.col("src").alias("next"), F.col("dst").alias("at")).join(level.select(F.col("node").alias("next"), F.col("level").alias("height")), "next")
    seen = cut(start.select("src", "floor", "at").distinct())
    frontier, links = seen, []
    while True:
        step = cut(frontier.join(up, "at").filter("height >= floor").select("src", "floor", F.col("at").alias("below"), F.col("next").alias("at")))
        if step.isEmpty():
            break
        links.append(step)
        new = cut(step.select("src", "floor", "at").distinct().join(seen, ["src", "at"], "left_anti").filter("src <> at"))
        if new.isEmpty():
            break
        seen = cut(seen.unionAll(new.select(*seen.columns)))
        frontier = new
    # who reaches the source, from it downwards along the searched steps
    if not links:
        return start.select("src", "dst").filter(F.lit(False))
    steps = links[0]
    for x in links[1:]:
        steps = steps.unionAll(x)
    steps = cut(steps.select("src", "below", "at").distinct())
    hit = cut(steps.filter("at = src").select("src", F.col("below").alias("at")).distinct())
    reach, frontier = hit, hit
    while True:
        down = frontier.join(steps, ["src", "at"]).select("src", F.col("below").alias("at")).distinct()
        new = cut(down.join(reach, ["src", "at"], "left_anti"))
        if new.isEmpty():
            break
        reach, frontier = cut(reach.unionAll(new)), new
    return start.join(reach, ["src", "at"]).select("src", "dst").distinct()


def contract(nodes: DataFrame, edges: DataFrame, contraction: DataFrame, remove_bypass: bool = True, local_edges: int = LOCAL_EDGES, task_rows: int = TASK_SEARCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contract the edges of ``contraction(src, dst)`` as far as the graph stays
    acyclic; gives nodes, edges and the mapping (node, to).

    Phases alternate between contractible edges into nodes with one parent and
    those out of nodes with one child, redundant edges being dropped before each;
    the topologically first node stands for a contracted set.  It ends with a
    phase of the second kind that finds nothing.

    The phases are many small steps.  A graph of at most ``local_edges`` edges,
    such as can be drawn, is contracted on the driver; of a larger one each component
    in a task, or, where one has more than ``task_rows`` nodes and edges, the whole step
    by step on the cluster, with the same result.
    """
    schema = nodes.select("node").schema["node"].dataType
    if edges.limit(local_edges + 1).count() <= local_edges and nodes.limit(local_edges + 2).count() <= local_edges + 1:
        rows = lambda df: {(r.src, r.dst) for r in df.select("src", "dst").collect()}
        ns, es, to = _contract_local({r.node for r in nodes.select("node").collect()}, rows(edges), rows(contraction), remove_bypass)
        frame = lambda data, *names: nodes.sparkSession.createDataFrame(data, T.StructType([T.StructField(c, schema) for c in names]))
        return frame([(n,) for n in ns], "node"), frame(list(es), "src", "dst"), frame(list(to.items()), "node", "to")
    contraction = contraction.select("src", "dst")
    tagged = _tagged(nodes, edges.select("src", "dst"), task_rows, contraction)
    if tagged is not None and tagged[1] is None:
        return _contract_in_tasks(tagged[0], schema, remove_bypass)
    nodes, edges, contraction = cut(nodes.select("node").distinct()), cut(edges.select("src", "dst").distinct()), cut(contraction.distinct())
    mapping = cut(nodes.select("node", F.col("node").alias("to")))
    into = True
    while True:
        level = cut(_levels_far(nodes, edges))
        redundant = None
        if remove_bypass:
            redundant = cut(_bypass_far(nodes, edges, level))
            # longest paths, and so levels, are the same without them
            edges = cut(edges.join(redundant, ["src", "dst"], "left_anti"))
        end = "dst" if into else "src"
        alone = edges.groupBy(end).count().filter("count = 1").select(end)
        chosen = cut(edges.join(contraction, ["src", "dst"], "left_semi").join(alone, end, "left_semi"))
        if chosen.isEmpty() and not into and (redundant is None or redundant.isEmpty()):
            return nodes, edges, mapping
        if not chosen.isEmpty():
            rank = lambda n: F.struct(F.col(f"{n}_level").alias("level"), F.col(n).alias("node"))
            levelled = chosen
            for n in ("src", "dst"):
                levelled = levelled.join(level.select(F.col("node").alias(n), F.col("level").alias(f"{n}_level")), n)
            ranked = level.select(F.struct("level", "node").alias("node"))
            found = components(ranked, levelled.select(rank("src").alias("src"), rank("dst").alias("dst")))
            to = cut(found.select(F.col("node.node").alias("node"), F.col("component.node").alias("to")))
            moved = lambda e: (
                e.join(to.select(F.col("node").alias("src"), F.col("to").alias("s")), "src")
                .join(to.select(F.col("node").alias("dst"), F.col("to").alias("d")), "dst")
                .filter("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
            )
            edges, contraction = cut(moved(edges)), cut(moved(contraction))
            nodes = cut(to.select(F.col("to").alias("node")).distinct())
            mapping = cut(mapping.select("node", F.col("to").alias("mid")).join(to.select(F.col("node").alias("mid"), "to"), "mid").select("node", "to"))
        into = not into


def _rank(node) -> tuple:
    """Orders nodes as the cluster does: nulls first, structs by their fields."""
    if node is None:
        return (0,)
    return (1, tuple(map(_rank, node))) if isinstance(node, tuple) else (1, node)


def _phases(nodes: set, edges: set, contraction: set, remove_bypass: bool) -> Iterator[tuple[bool, set, set, dict]]:
    """After each phase whether it found anything, the nodes and edges, and where nodes went."""
    to, into = {n: n for n in nodes}, True
    while True:
        parents, children = _both_ways(nodes, edges)
        level = _levels_local(parents, children)
        if level is None:
            raise ValueError("the graph has a cycle")
        redundant = _bypass_local(parents, level) if remove_bypass else set()
        edges = edges - redundant
        degree: dict = {}
        for e in edges:
            degree[e[into]] = degree.get(e[into], 0) + 1
        chosen = [e for e in edges if e in contraction and degree[e[into]] == 1]
        if chosen:
            root = {n: n for n in nodes}

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in chosen:
                x, y = sorted((find(a), find(b)), key=lambda n: (level[n], _rank(n)))
                root[y] = x
            at = {n: find(n) for n in nodes}
            moved = lambda es: {(at[a], at[b]) for a, b in es if at[a] != at[b]}
            edges, contraction = moved(edges), moved(contraction)
            nodes, to = set(at.values()), {n: at[m] for n, m in to.items()}
        yield bool(chosen or redundant), nodes, edges, to
        into = not into


def _contract_local(nodes: set, edges: set, contraction: set, remove_bypass: bool) -> tuple[set, set, dict]:
    for k, (found, *out) in enumerate(_phases(nodes, edges, {(a, b) for a, b in contraction if a in nodes and b in nodes}, remove_bypass)):
        if k % 2 and not found:
            return tuple(out)


def _contract_in_tasks(rows: DataFrame, kind: T.DataType, remove_bypass: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components by themselves, for as many phases as the whole graph takes: it ends with
    a phase of the second kind that finds nothing in any."""
    inner = lambda ns, more: {(a, b) for a, b in more if a in ns and b in ns}

    def busy(_, ns: set, es: set, more: set) -> list[tuple] | None:
        out, idle = [], 0
        try:
            for k, (found, *_) in enumerate(_phases(ns, es, inner(ns, more), remove_bypass)):
                idle = 0 if found else idle + 1
                if idle == 2:  # a phase of each kind: nothing will change
                    return out
                if k % 2 and found:
                    out.append((k,))
        except ValueError:
            return None

    used = {r.phase for r in _in_tasks(rows, busy, "phase int").distinct().collect()}
    last = next(k for k in range(1, 2 * len(used) + 2, 2) if k not in used)

    def run(_, ns: set, es: set, more: set) -> list[tuple]:
        idle = 0
        for k, (found, nodes, edges, to) in enumerate(_phases(ns, es, inner(ns, more), remove_bypass)):
            idle = 0 if found else idle + 1
            if k == last or idle == 2:
                return [(0, n, None) for n in nodes] + [(1, a, b) for a, b in edges] + [(2, n, m) for n, m in to.items()]

    done = _in_tasks(rows, run, _fields(kind, ("kind", T.IntegerType()), ("a", None), ("b", None)))
    of = lambda k, *names: done.filter(F.col("kind") == k).select(*[F.col(c).alias(n) for c, n in zip("ab", names)])
    return of(0, "node"), of(1, "src", "dst"), of(2, "node", "to")


def prefix_sum(changes: DataFrame, partition: str, position: str, value: str = "dv") -> DataFrame:
    """Running sums of changes along a linear order, per key."""
    w = Window.partitionBy(partition).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("val", F.sum(value).over(w))


def group_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): sorted arrays of the distinct values of each key."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def group_by_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """(value, keys): the same the other way round."""
    return df.groupBy(value).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def reduce_by_key(df: DataFrame, key: str, value: str, zero: Column, merge) -> DataFrame:
    """(key, value): each key's values folded by ``merge(a, b)`` in their order.

    For sums, minima and the like an aggregate function does it without arrays.
    """
    gathered = df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("__v"))
    return gathered.select(key, F.aggregate("__v", zero, merge).alias(value))
