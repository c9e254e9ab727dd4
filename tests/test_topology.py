import random

import pytest

from dagbag.operators import topology


def frames(spark, nodes, edges, kind="string"):
    return spark.createDataFrame([(n,) for n in nodes], f"node {kind}"), spark.createDataFrame(edges, f"src {kind}, dst {kind}")


def pairs(df):
    return {(r.src, r.dst) for r in df.collect()}


def above(edges, n, seen=None):
    seen = set() if seen is None else seen
    for p, c in edges:
        if c == n and p not in seen:
            seen.add(p)
            above(edges, p, seen)
    return seen


@pytest.mark.parametrize("local", [0, 100])
def test_contraction_of_the_worked_example(spark, local):
    n, e = frames(spark, "RABCD", [("R", "A"), ("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")])
    zero = spark.createDataFrame([("A", "B"), ("C", "D")], "src string, dst string")
    nodes, edges, mapping = topology.contract(n, e, zero, local_edges=local)
    assert {r.node for r in nodes.collect()} == {"R", "A", "C"} and pairs(edges) == {("R", "A"), ("A", "C")}
    assert {r.node: r.to for r in mapping.collect()} == {"R": "R", "A": "A", "B": "A", "C": "C", "D": "C"}


@pytest.mark.parametrize("seed", range(1))
def test_against_plain_searches(spark, seed):
    r = random.Random(seed)
    n = 12
    es = [(a, b) for b in range(n) for a in range(b) if r.random() < 0.25]
    nodes, edges = frames(spark, range(n), es, "bigint")
    up = {x: above(es, x) for x in range(n)}
    assert pairs(topology.closure(edges)) == {(a, x) for x in range(n) for a in up[x]}
    redundant = {(x, c) for x, c in es if any(x in up[p] for p, d in es if d == c and p != x)}
    assert pairs(topology.bypass(nodes, edges)) == redundant
    longest = {}
    for x in range(n):
        longest[x] = max([longest[p] + 1 for p, c in es if c == x], default=0)
    order = {r.node: (r.level, r.position) for r in topology.topological_order(nodes, edges).collect()}
    assert {x: lv for x, (lv, _) in order.items()} == longest
    assert sorted(p for _, p in order.values()) == list(range(n)) and all(order[a][1] < order[b][1] for a, b in es)
    root = {x: x for x in range(n)}
    for _ in range(n):
        for a, b in es:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.component for r in topology.connected_components(nodes, edges).collect()} == root
    still = [e for e in es if r.random() < 0.5]
    still = spark.createDataFrame(still, "src bigint, dst bigint")
    ns, left, mapping = topology.contract(nodes, edges, still, local_edges=0)
    alike = topology.contract(nodes, edges, still)
    assert [set(map(tuple, df.collect())) for df in alike] == [set(map(tuple, df.collect())) for df in (ns, left, mapping)]
    to = {r.node: r.to for r in mapping.collect()}
    assert set(to) == set(range(n)) and {r.node for r in ns.collect()} == set(to.values())
    topology.levels(ns, left)  # still acyclic
    assert pairs(left) <= {(to[a], to[b]) for a, b in es}


def test_cycles_are_refused(spark):
    with pytest.raises(ValueError):
        topology.levels(*frames(spark, "abc", [("a", "b"), ("b", "c"), ("c", "b")]))
    with pytest.raises(ValueError):
        topology.levels(*frames(spark, "ab", [("a", "b"), ("b", "a")]))


@pytest.mark.parametrize("size, n", [(10, 3), (9, 3), (2, 4), (0, 2), (5, 5)])
def test_slices(spark, size, n):
    got = [r.slice for r in topology.slices(topology.numbered(spark.range(size), "id"), n).orderBy("id").collect()]
    lengths = [got.count(i) for i in range(n)]
    assert got == sorted(got) and sum(lengths) == size
    assert lengths == sorted(lengths) and max(lengths) - min(lengths) <= 1


def test_numbering_and_adjacency(spark):
    rows = topology.numbered(spark.range(1000).selectExpr("(id * 7919) % 1000 as v"), "v").collect()
    assert all(r.v == r.position for r in rows)
    _, e = frames(spark, "abc", [("a", "c"), ("b", "c"), ("a", "b")])
    assert {r.node: r.parents for r in topology.incoming(e).collect()} == {"c": ["a", "b"], "b": ["a"]}
    assert {r.node: r.children for r in topology.outgoing(e).collect()} == {"a": ["b", "c"], "b": ["c"]}
    assert {r.node: r.val for r in topology.indegree(e).collect()} == {"c": 2, "b": 1}
    assert {r.node: r.val for r in topology.outdegree(e).collect()} == {"a": 2, "b": 1}


def test_merging_sets(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "x")], "set int, element string")
    assert {r.element: r.component for r in topology.merge_sets(members).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x"}


def test_levels_of_a_long_chain_take_few_rounds(spark):
    """50 000 commits in a row, with a bubble now and then and a bypassing edge."""
    n = 50_000
    rows = spark.range(n).selectExpr("id as node")
    chain = spark.range(1, n).selectExpr("id - 1 as src", "id as dst")
    skips = spark.range(10, n, 1000).selectExpr("id - 10 as src", "id as dst")
    got = topology.levels(rows, chain.unionAll(skips))
    assert got.filter("node <> level").count() == 0 and got.count() == n


def test_levels_of_a_dense_graph_and_cycles(spark):
    r = random.Random(7)
    n = 60
    es = {(a, b) for b in range(n) for a in range(max(0, b - 9), b) if r.random() < 0.3}
    longest = {}
    for x in range(n):
        longest[x] = max([longest[p] + 1 for p, c in es if c == x], default=0)
    assert {x.node: x.level for x in topology.levels(*frames(spark, range(n), sorted(es), "bigint")).collect()} == longest
    for bad in ([(0, 1), (1, 2), (2, 0)], [(0, 1), (1, 2), (2, 1), (0, 2)], [(5, 5)], [(0, 1), (2, 3), (3, 2)]):
        with pytest.raises(ValueError, match="cycle"):
            topology.levels(*frames(spark, range(6), bad, "bigint"))
