import logging

import pytest
from pyspark.sql import functions as F

from dagbag.config import setting
from dagbag.functions import text
from dagbag.functions.isolated import Isolated, Pool
from dagbag.functions.groups import map_add, map_invert, map_multiply
from dagbag.operators import History
from dagbag.plans import delta, guard
from dagbag.plans.lineage import cut, drop, shared_dir
from dagbag.plans.memo import memo_apply


@pytest.fixture(scope="module")
def chain(spark):
    nodes = spark.range(30).toDF("node")
    edges = spark.range(29).selectExpr("id as src", "id + 1 as dst")
    values = spark.range(30).selectExpr("id as node", "explode(array('a', if(id < 20, 'b', 'c'), if(id % 10 = 5, 'd', 'a'))) as key", "1L as val")
    return History.from_frames(nodes, edges, values)


def test_memo_runs_once_an_argument(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, v int")
    out = memo_apply(df, ["k"], lambda k: F.coalesce(F.upper(k), F.lit("none")), "r")
    assert {(r.v, r.r) for r in out.collect()} == {(1, "A"), (2, "A"), (3, "none"), (4, "B")}


def test_delta_pays_for_slow_changes(spark, chain):
    order = chain.nodes().selectExpr("node", "0 as part", "node as pos")
    d = delta.encode(chain, order)
    back = delta.decode(d, order, chain.keys)
    assert back.exceptAll(chain.values()).count() == chain.values().exceptAll(back).count() == 0
    assert delta.ratio(chain, order) < 0.5
    assert delta.runs(d, chain.keys).filter("key = 'b'").collect()[0].asDict() == {"part": 0, "key": "b", "from": 0, "to": 20, "val": 1}


def test_watched_histories(chain, caplog):
    logged = guard.Logged()
    with caplog.at_level(logging.INFO, "dagbag"):
        out = guard.Watched.of(chain, logged).tmap(lambda k: F.upper(k)).diff()
    assert logged.count == 2 and "1 tmap" in caplog.text and isinstance(out, guard.Watched)
    guard.same_values(out, chain.tmap(lambda k: F.upper(k)).diff())
    assert guard.Watched.of(chain, guard.Cut(1)).inv().inv().values().count() == 0
    seen = []
    guard.Watched.of(chain, guard.Checked(lambda h: seen.append(1) or h)).diff().index()
    assert seen == [1]
    with pytest.raises(AssertionError):
        guard.Watched.of(chain, guard.Checked(lambda h: h.inv(), always=True)).diff()


def test_aliases_round_trip(spark, chain):
    named = History.from_frames(chain.nodes().selectExpr("concat('n', node) as node"), chain.edges().selectExpr("concat('n', src) as src", "concat('n', dst) as dst"), chain.values().selectExpr("concat('n', node) as node", "key", "val"))
    short, ids = guard.aliased(named)
    assert sorted(r.node for r in short.nodes().collect()) == list(range(30))
    guard.same_values(guard.unaliased(short.diff(), ids), named.diff())


def test_profile():
    mean, spread = guard.profile(lambda: sum(range(1000)), 3)
    assert mean > 0 and spread >= 0


def test_cut_tables(spark):
    df = cut(spark.range(5))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    drop(df)
    drop(df)  # a second time does nothing
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == (named.rstrip("/") if named else shared_dir(spark))


def test_text_functions(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert row(text.split_camel_case(F.lit("parseHTTPRequest now"))) == "parse HTTP Request now"
    assert row(text.keep_letters(F.lit("a1-b"))) == "a  b"
    assert row(text.tokenize(F.lit(" a  b\tc "))) == ["a", "b\tc"]
    assert row(text.replace(F.lit("abc"), {"b": "x", "a": "b"})) == "xxc"
    assert row(text.insert(F.lit("foo(a) bar(b)"), r"\w\(", " ", 1)) == "foo (a) bar (b)"
    assert row(text.is_fix(F.lit("Fixes the parser"))) and not row(text.is_fix(F.lit("add prefix and postfix")))
    assert row(text.mentions_issue(F.lit("see Issue #3"))) and not row(text.mentions_issue(F.lit("reissued")))
    assert row(text.iso_instant(F.lit(86400))) == "1970-01-02T00:00:00Z"
    assert row(text.lines(F.lit("a\r\nb\n"))) == ["a", "b"]
    java = 'class A<T extends B> { /* if */ void f() { // while\n if (x) for (;;) do { y = a ? b : c; } while (z); String s = "if (q)"; try { } catch (E e) { } switch (v) { case 1: case 2: } } }'
    assert row(text.java_complexity(F.lit(java))) == 8


def test_map_columns(spark):
    df = spark.sql("select map('a', 1, 'b', 2) as x, map('b', -2, 'c', 3) as y")
    assert df.select(map_add(F.col("x"), F.col("y")).alias("m")).first().m == {"a": 1, "c": 3}
    assert df.select(map_multiply(F.col("x"), F.col("y")).alias("m")).first().m == {"b": -4}
    assert df.select(map_invert(F.col("x")).alias("m")).first().m == {"a": -1, "b": -2}


def test_settings(tmp_path, monkeypatch):
    path = tmp_path / "c.properties"
    path.write_text("# note\ncache = /x\n")
    monkeypatch.setenv("OTHER", "y")
    assert [setting(n, str(path)) for n in ("cache", "OTHER", "third")] == ["/x", "y", "third"]


def test_isolated_calls():
    import os
    import time

    def f(x):
        if x == 1:
            time.sleep(30)
        if x == 2:
            os._exit(3)
        return 10 // (x - 3)

    with Isolated(f, 0.5, -1) as g:
        assert [g(x) for x in (4, 1, 5, 2, 3, 8)] == [10, -1, 5, -1, -1, 2]
        assert g.peak_mb > 1
    with Pool(f, 0.5, -1, 3) as g:
        assert g.map([4, 1, 5, 2, 3, 8] * 2) == [10, -1, 5, -1, -1, 2] * 2
