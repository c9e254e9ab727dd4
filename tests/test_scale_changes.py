"""Look-ups of the change form sort the changes once."""

from pyspark.sql import functions as F

from dagbag.operators import changes
from dagbag.operators.changes import Changes
from dagbag.operators.history import History
from dagbag.plans import lineage


def history(spark):
    """Two chains of 20 with branches and edges that go round; key a changes everywhere."""
    nodes = spark.range(40).selectExpr("id as node")
    edges = spark.range(40).filter("id % 20 > 0").selectExpr("id - 1 as src", "id as dst")
    edges = edges.unionAll(spark.range(40).filter("id % 20 > 4 and id % 5 = 0").selectExpr("id - 3 as src", "id as dst"))
    values = nodes.selectExpr("node", "'a' as key", "node + 1 as val").unionAll(nodes.filter("node % 3 > 0").selectExpr("node", "'b' as key", "node % 3 as val"))
    return History.from_frames(nodes, edges, values, normal=True)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_weights_after_changes_in_blocks(spark):
    h = history(spark)
    c = Changes.of(h)
    weight = {(r.node, r.key): r.val for r in h.values().collect()}
    got = rows(c.looked_up().select("node.src", "node.dst", "key", "val", "__0"))
    assert got == rows(c.looked_up(block=3).select("node.src", "node.dst", "key", "val", "__0"))
    assert len(got) == c.by.values().count()
    for src, dst, key, change, after in got:
        assert after == weight.get((dst, key), 0) and after - change == weight.get((src, key), 0)


def test_no_joins_of_what_was_looked_up(spark, monkeypatch):
    """Joined are the places of edges and of roots, and for the changes themselves states."""
    plans = []
    x, y = Changes.of(history(spark)), Changes.of(history(spark).map_values(lambda v: v * 2))
    y._order = x._order
    x.order()
    monkeypatch.setattr(changes, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or lineage.cut(df))
    double = x.tmap_ix(lambda k, v: [(F.concat(k, k), v * v)])
    assert max(plans) <= 7
    joined = x.tjoin(y)
    assert max(plans) <= 14
    assert rows(double.values()) == rows(history(spark).tmap_ix(lambda k, v: [(F.concat(k, k), v * v)]).values())
    assert rows(joined.values()) == rows(history(spark).map_values(lambda v: 2 * v * v).values())
