"""What must not grow with the input: rounds, joins, rows of a task."""

import random

import pytest
from pyspark.sql import functions as F

from dagbag.operators import topology


def graph(spark, seed, n=40):
    """A few components, chains, merges and lone nodes; some edges to contract."""
    r = random.Random(seed)
    edges = sorted({(a, b) for b in range(n) if b % 8 for a in r.sample(range(b - b % 8, b), min(b % 8, r.choice([0, 1, 1, 2, 3])))})
    frame = lambda data, schema: spark.createDataFrame(data, schema).coalesce(2)
    some = [e for e in edges if r.random() < 0.6] + [(0, 7), (3, 20)]
    return frame([(x,) for x in range(n)], "node bigint"), frame(edges, "src bigint, dst bigint"), frame(some, "src bigint, dst bigint")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


SEARCHES = {
    "levels": lambda n, e, k: topology.levels(n, e, task_rows=k),
    "preorder": lambda n, e, k: topology.preorder(n, e, task_rows=k).select("node", "root", "pos", "end", "size", "parent"),
    "component_order": lambda n, e, k: topology.component_order(n, e, task_rows=k),
    "closure": lambda n, e, k: topology.closure(e, task_rows=k),
    "bypass": lambda n, e, k: topology.bypass(n, e, task_rows=k),
}


@pytest.mark.parametrize("name", SEARCHES)
def test_components_in_tasks_give_what_rounds_give(spark, name):
    """All in tasks, some, none."""
    nodes, edges, _ = graph(spark, 3)
    want = rows(SEARCHES[name](nodes, edges, 0))
    assert want and rows(SEARCHES[name](nodes, edges, 1000)) == want == rows(SEARCHES[name](nodes, edges, 14))


@pytest.mark.parametrize("seed", [4, 5])
def test_contraction_in_tasks_takes_as_many_phases_as_the_whole(spark, seed):
    """All components at once in one process, each in a task."""
    nodes, edges, some = graph(spark, seed)
    want = [rows(x) for x in topology.contract(nodes, edges, some)]
    assert [rows(x) for x in topology.contract(nodes, edges, some, local_edges=0)] == want


def test_contraction_by_steps(spark):
    nodes, edges, some = graph(spark, 4, 8)
    want = [rows(x) for x in topology.contract(nodes, edges, some)]
    assert [rows(x) for x in topology.contract(nodes, edges, some, local_edges=0, task_rows=0)] == want


@pytest.mark.parametrize("search", [
    lambda n, e: topology.levels(n, e), lambda n, e: topology.preorder(n, e), lambda n, e: topology.closure(e),
    lambda n, e: topology.contract(n, e, e.filter("src % 3 = 0"), local_edges=0)[2],
])
def test_small_components_take_as_many_tables_whatever_their_depth(spark, monkeypatch, search):
    """A chain of 60 in a task: rounds wrote a table for each, or for each power of two."""
    made = []
    for module in ("dagbag.operators.topology", "dagbag.plans.components"):
        from dagbag.plans import lineage

        monkeypatch.setattr(f"{module}.cut", lambda df: made.append(1) or lineage.cut(df))
    e = spark.range(60).filter("id % 30 > 0").select((F.col("id") - 1).alias("src"), F.col("id").alias("dst")).coalesce(1)
    assert search(spark.range(60).select(F.col("id").alias("node")), e).count()
    assert len(made) <= 8
