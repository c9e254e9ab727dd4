"""Change form against state form, operator by operator."""

import random

import pytest
from pyspark.sql import functions as F

from dagbag.operators import topology
from dagbag.operators.changes import Changes
from dagbag.operators.history import History


def make(spark, seed, n=24, keys="abcd"):
    r = random.Random(seed)
    edges = sorted({(a, b) for b in range(n) for a in r.sample(range(b), min(b, r.choice([0, 1, 1, 2])))})
    state, rows = {}, []
    for x in range(n):
        above = [p for p, c in edges if c == x]
        mine = dict(state[above[0]]) if above else {}
        for _ in range(r.randrange(3)):
            mine[r.choice(keys)] = r.randrange(-2, 4)
        state[x] = {k: v for k, v in mine.items() if v}
        rows += [(x, k, v) for k, v in state[x].items()]
    frame = lambda data, schema: spark.createDataFrame(data, schema).coalesce(2)
    return frame([(x,) for x in range(n)], "node bigint"), frame(edges, "src bigint, dst bigint"), frame(rows, "node bigint, key string, val bigint")


@pytest.fixture(scope="module")
def pair(spark):
    nodes, edges, one = make(spark, 1)
    two = make(spark, 2)[2]
    return [History.from_frames(nodes, edges, v, normal=True) for v in (one, two)]


@pytest.fixture(scope="module")
def changes(pair):
    x, y = (Changes.of(h) for h in pair)
    y._order = x._order
    return x, y


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_preorder(spark):
    nodes, edges, _ = make(spark, 5, 40)
    got = {r.node: r for r in topology.preorder(nodes, edges).collect()}
    assert len(got) == 40
    up = {}
    for r in edges.collect():
        up[r.dst] = min(up.get(r.dst, r.src), r.src)
    for x, r in got.items():
        below = {y for y in got if any(x == z for z in chain(up, y))}
        assert r.parent == up.get(x) and r.root == list(chain(up, x))[-1]
        assert {y for y, q in got.items() if q.root == r.root and r.pos <= q.pos < r.end} == below


def chain(up, x):
    yield x
    while x in up:
        x = up[x]
        yield x


def test_states_come_back(pair, changes):
    assert rows(changes[0].values()) == rows(pair[0].values())
    assert rows(changes[0].states(3).values()) == rows(pair[0].values())


OPERATORS = {
    "tmap_hom": lambda x, y: x.tmap_hom(lambda k, v: [(F.concat(k, F.lit("1")), v * 2), (F.lit("z"), -v)]),
    "tmap": lambda x, y: x.tmap(lambda k: F.when(k == "a", "b").otherwise(k)),
    "tfilter": lambda x, y: x.tfilter(lambda k: k != "b"),
    "tmap_ix": lambda x, y: x.tmap_ix(lambda k, v: [(F.concat(k, v.cast("string")), v * v), (F.lit("n"), F.lit(1))]),
    "tadd": lambda x, y: x + y,
    "tjoin": lambda x, y: x.tjoin(y),
    "tcartesian": lambda x, y: x.tcartesian(y),
    "length": lambda x, y: x.length(),
    "inv_after_ix": lambda x, y: x.tmap_ix(lambda k, v: [(k, v * v)]).tfilter(lambda k: k < "d").inv().length(),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_gives_what_it_gives_on_states(pair, changes, name):
    f = OPERATORS[name]
    assert rows(f(*changes).values()) == rows(f(*pair).values())


@pytest.mark.parametrize("merges", [True, False])
def test_diff(pair, changes, merges):
    assert rows(changes[0].diff(merges).values()) == rows(pair[0].diff(merges).values())


def test_function_of_weight_and_change(pair, changes):
    """Squares by their changes: f(k, x, x - y) = f(k, x, x) - f(k, y, y)."""
    square = lambda k, x, d: [(k, 2 * x * d - d * d)]
    want = rows(pair[0].tmap_ix(lambda k, v: [(k, v * v)]).values())
    assert rows(changes[0].tmap_ix2(square).values()) == want == rows(pair[0].tmap_ix2(square).values())
    seen = rows(changes[0].tmap_ix2(lambda k, x, d: [(F.concat_ws(" ", k, x.cast("string"), d.cast("string")), F.lit(1))]).by._values)
    assert any(k.split()[1] != k.split()[2] for _, k, _ in seen)


def test_only_what_changes_is_kept(spark):
    """A thousand keys that stay, one that changes."""
    nodes = spark.range(50).selectExpr("id as node")
    edges = spark.range(1, 50).selectExpr("id - 1 as src", "id as dst")
    values = nodes.crossJoin(spark.range(100).selectExpr("cast(id as string) as key")).selectExpr("node", "key", "if(key = '7', node + 1, 1) as val")
    c = Changes.of(History.from_frames(nodes, edges, values, normal=True))
    assert c.by._values.count() == 49 and c.at._values.count() == 100
    assert c.length().by._values.count() == 98
    assert rows(c.length().values()) == [(i, 100 + i, 1) for i in range(50)]
