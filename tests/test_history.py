import random

import pytest
from pyspark.sql import functions as F

from dagbag.functions.groups import DOUBLE, INTEGER, pair, triple
from dagbag.operators import COLLAPSE, LINEAR, MEMOIZATION, History

EDGES = [("R", "A"), ("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")]
X = {"R": {}, "A": {"x": 1}, "B": {"x": 1, "y": 2}, "C": {"x": 3}, "D": {"x": 3, "y": 2}}
Y = {"A": {"x": 2}, "B": {"y": 1}, "D": {"x": -1, "z": 4}}


def history(spark, values, edges=EDGES, nodes=None, node="string", key="string", normal=False):
    nodes = sorted({n for e in edges for n in e} | set(values)) if nodes is None else nodes
    rows = [(n, k, v) for n, m in values.items() for k, v in m.items()]
    return History.from_frames(
        spark.createDataFrame([(n,) for n in nodes], f"node {node}"),
        spark.createDataFrame(edges, f"src {node}, dst {node}"),
        spark.createDataFrame(rows, f"node {node}, key {key}, val bigint"),
        ["key"], normal=normal,
    )


def maps(h):
    return {n: m for n, m in h if m}


@pytest.fixture(scope="module")
def xy(spark):
    x = history(spark, X)
    rows = [(n, k, v) for n, m in Y.items() for k, v in m.items()]
    return x, x._with(spark.createDataFrame(rows, "node string, key string, val bigint"))


def test_worked_example(xy):
    x, y = xy
    assert dict(iter(x)) == X
    assert maps(x.diff()) == {"A": {"x": 1}, "B": {"y": 2}, "C": {"x": 2}, "D": {"x": 2, "y": 2}}
    assert maps(x.diff(False)) == {"A": {"x": 1}, "B": {"y": 2}, "C": {"x": 2}}
    assert maps(x.topology().diff()) == {"A": {"A": 1, "R": -1}, "B": {"B": 1, "A": -1}, "C": {"C": 1, "A": -1}, "D": {"D": 2, "B": -1, "C": -1}}
    assert maps(x.parents()) == {"A": {("R", "A"): -1}, "B": {("A", "B"): -1}, "C": {("A", "C"): -1}, "D": {("B", "D"): -2, ("C", "D"): -2}}
    assert maps(x.length()) == {"A": {1: 1}, "B": {3: 1}, "C": {3: 1}, "D": {5: 1}}
    assert maps(x.diff(False).added().length()) == {"A": {1: 1}, "B": {2: 1}, "C": {2: 1}}
    assert maps(x.join(y)) == {"A": {"x": 2}, "B": {"y": 2}, "D": {"x": -3}}
    assert maps(x.tcartesian(y))["D"] == {("x", "x"): -3, ("x", "z"): 12, ("y", "x"): -2, ("y", "z"): 8}
    assert maps(x.cogroup(y))["D"] == {"x": (3, -1), "y": (2, 0), "z": (0, 4)}
    assert maps(x + x.inv()) == {}
    assert maps(x.map(lambda k: F.lit("k"))) == {"A": {"k": 1}, "B": {"k": 3}, "C": {"k": 3}, "D": {"k": 5}}
    assert maps(x.distinct()) == {"A": {"x": 1}, "B": {"x": 1, "y": 1}, "C": {"x": 1}, "D": {"x": 1, "y": 1}}
    assert maps(x.to_bag())["B"] == {("x", 1): 1, ("y", 2): 1}
    assert maps(x.filter_values(lambda v: v > 2)) == {"C": {"x": 3}, "D": {"x": 3}}
    assert [r.entries for r in x.escape().index().filter("node = 'B'").collect()][0][0].key == [("x", 1), ("y", 2)]
    assert maps(x.escape().flatten()) == maps(x)
    assert maps(x.diff().removed()) == {} and maps(y.removed()) == {"D": {"x": -1}}
    assert x.size() == 5 and x.g() is INTEGER and maps(x.zero()) == {}


def test_groups_of_numbers(spark):
    nodes, none = spark.createDataFrame([("n",)], "node string"), spark.createDataFrame([], "src string, dst string")
    rows = spark.createDataFrame([("n", "g", 2, 1), ("n", "g", 5, 3), ("n", "h", 4, 1), ("n", "h", 4, -1), ("n", "i", 1, 1), ("n", "i", -1, 1)], "node string, g string, e int, val bigint")
    b = History.from_frames(nodes, none, rows, ["g", "e"], outer=1)
    assert maps(b.length()) == {"n": {"g": 4, "i": 2}}
    assert maps(b.sum()) == {"n": {"g": 17}}
    assert maps(b.avg()) == {"n": {"g": 4.25}}
    plain = b.tfilter(lambda g, e: g == "g").tmap(lambda g, e: e)
    assert maps(plain.sum()) == {"n": {17: 1}} and maps(plain.length()) == {"n": {4: 1}}
    assert maps(b.ungroup().length()) == {"n": {6: 1}}
    assert b.ungroup().group().outer == 1 and [r["map"] for r in b.nested().filter("g = 'g'").collect()] == [{2: 1, 5: 3}]
    with pytest.raises(ValueError):
        plain.group()
    assert maps(plain.group_by(lambda e: e % 2).length()) == {"n": {0: 1, 1: 3}}


def test_flatten_multiplies(spark):
    nodes, none = spark.createDataFrame([("n",)], "node string"), spark.createDataFrame([], "src string, dst string")
    m = spark.sql("select 'n' as node, map('a', 1L, 'b', 2L) as key, 3L as val")
    assert maps(History.from_frames(nodes, none, m, ["key"], normal=True).flatten()) == {"n": {"a": 3, "b": 6}}


@pytest.mark.parametrize("group, a, b, total, product", [(DOUBLE, (0.5,), (0.25,), 0.75, 0.125), (pair(), (1, 2), (3, -2), (4, 0), (3, -4)), (triple(INTEGER, DOUBLE, INTEGER), (1, 0.5, 2), (1, 0.5, 3), (2, 1.0, 5), (1, 0.25, 6))])
def test_other_groups(spark, group, a, b, total, product):
    nodes, none = spark.createDataFrame([(1,)], "node int"), spark.createDataFrame([], "src int, dst int")
    schema = "node int, key string, " + ", ".join(f"{c} {t}" for c, t in zip(group.columns, group.types))
    x, y = (History.from_frames(nodes, none, spark.createDataFrame([(1, "k", *v)], schema), ["key"], group) for v in (a, b))
    assert maps(x + y) == {1: {"k": total}}
    assert maps(x.tjoin(y)) == {1: {"k": product}}
    assert maps(x + x.inv()) == {}


# -- a plain model -------------------------------------------------------------


def norm(m):
    out = {}
    for n, x in m.items():
        x = {k: v for k, v in x.items() if v}
        if x:
            out[n] = x
    return out


def add(*ms):
    out = {}
    for m in ms:
        for n, x in m.items():
            for k, v in x.items():
                out.setdefault(n, {})[k] = out.get(n, {}).get(k, 0) + v
    return norm(out)


def model_diff(x, edges, merges=True):
    parents = {}
    for p, c in edges:
        parents.setdefault(c, []).append(p)
    out = {}
    for c, ps in parents.items():
        if merges or len(ps) == 1:
            for p in ps:
                out = add(out, {c: x.get(c, {})}, {c: {k: -v for k, v in x.get(p, {}).items()}})
    return out


def random_case(seed):
    r = random.Random(seed)
    n = r.randrange(2, 9)
    edges = [(a, b) for b in range(n) for a in range(b) if r.random() < 0.4]
    value = lambda: {i: {k: r.choice([-2, -1, 1, 2, 3]) for k in "abcd" if r.random() < 0.5} for i in range(n)}
    return n, edges, value(), value()


@pytest.mark.parametrize("seed", range(3))
def test_laws_on_random_graphs(spark, seed):
    n, edges, xm, ym = random_case(seed)
    x = history(spark, xm, edges, range(n), "bigint")
    y = x._with(history(spark, ym, edges, range(n), "bigint")._values)
    xm, ym = norm(xm), norm(ym)
    assert maps(x.diff()) == model_diff(xm, edges)
    assert maps(x.diff(False)) == model_diff(xm, edges, False)
    assert maps(x + y) == add(xm, ym)
    assert maps((x + y).diff()) == maps(x.diff() + y.diff())
    join = norm({i: {k: v * ym.get(i, {}).get(k, 0) for k, v in m.items()} for i, m in xm.items()})
    assert maps(x.tjoin(y)) == join
    assert maps(x.tcartesian(y)) == norm({i: {(k, q): v * w for k, v in m.items() for q, w in ym.get(i, {}).items()} for i, m in xm.items()})
    to = lambda k: F.when(k < "c", F.lit("low")).otherwise(k)
    want = add(*[{i: {("low" if k < "c" else k): v}} for i, m in xm.items() for k, v in m.items()])
    assert all(maps(x.tmap(to, d)) == want for d in (COLLAPSE, LINEAR, MEMOIZATION))
    square = norm({i: {k: v * v for k, v in m.items()} for i, m in xm.items()})
    assert maps(x.tmap_ix2(lambda k, v, d: [(k, 2 * v * d - d * d)])) == square
    # not summed before a function that isn't linear, the result would differ
    halves = x.tmap(to, LINEAR)
    assert maps(halves.tmap_ix(lambda k, v: [(k, v * v)])) == norm({i: {k: v * v for k, v in m.items()} for i, m in want.items()})
    assert maps(x.filter(lambda k: k > "b")) == maps(x.filter(lambda k: k > "b", MEMOIZATION))
    assert maps(x.collect(lambda k: k > "b", lambda k: F.concat(k, k))) == norm({i: {k + k: v for k, v in m.items() if k > "b"} for i, m in xm.items()})


def test_create_runs_functions_on_executors(spark):
    h = History.create(spark, lambda: range(4), lambda n: [n - 1] if n else [], lambda n: {"k": n, "z": 0}, "bigint")
    assert maps(h.diff()) == {1: {"k": 1}, 2: {"k": 1}, 3: {"k": 1}} and dict(iter(h))[0] == {}


def test_histories_of_several_graphs(spark):
    a, b = history(spark, {"A": {"x": 1}}, [("A", "B")]), history(spark, {"B": {"x": 2}, "C": {"y": 1}}, [("B", "C")])
    both = a + b
    assert both.size() == 3 and both.edges().count() == 2 and maps(both) == {"A": {"x": 1}, "B": {"x": 2}, "C": {"y": 1}}
    assert a.tcartesian(b).size() == 1 and a.tcartesian(b).edges().count() == 0


def test_plans_push_filters_and_prune_columns(spark, tmp_path):
    spark.range(100).selectExpr("id as node", "cast(id % 7 as string) as key", "1L as val", "uuid() as unused").write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    none = spark.createDataFrame([], "src bigint, dst bigint")
    plan = History.from_frames(v.select("node"), none, v, ["key"]).tfilter(lambda k: k == "3").values()._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,3)" in plan and "unused" not in plan
