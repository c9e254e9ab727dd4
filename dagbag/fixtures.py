"""Histories over the order tables, for queries that SQL can check.

Orders of a customer form one component: a chain with branches, merges and
redundant edges.  See ``ORACLE`` for the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagbag.operators.history import History
from dagbag.plans.sizes import reads
from dagbag.sources.git import Repositories

#: The tables in SQL, to put in front of an oracle.
ORACLE = """
seq as (select o_orderkey as node, o_custkey as comp, row_number() over (partition by o_custkey order by o_orderkey) as i from orders),
n as (select o_orderkey as node from orders),
e as (select p.node as src, s.node as dst from seq s join seq p on p.comp = s.comp and (
  ((s.i - 1) % 4 in (0, 1, 3) and p.i = s.i - 1) or ((s.i - 1) % 4 in (2, 3) and p.i = s.i - 2) or (s.i % 8 = 1 and p.i = s.i - 4))),
l as (select l_orderkey as node, p_brand as key, count(*) as val from lineitem join part on l_partkey = p_partkey group by 1, 2),
r as (select l_orderkey as node, p_brand as key, cast(sum(l_linenumber) as bigint) as val from lineitem join part on l_partkey = p_partkey where l_quantity > 25 group by 1, 2),
q as (select l_orderkey as node, cast(l_quantity as int) as key, count(*) as val from lineitem group by 1, 2),
b as (select l_orderkey as node, p_brand as key1, cast(l_quantity as int) as key2, count(*) as val from lineitem join part on l_partkey = p_partkey group by 1, 2, 3)
""".strip()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    reads(spark, path)
    return spark.read.parquet(path)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents are 1, 2 or 4 orders back: lags of one window, no join."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    i = F.row_number().over(w)
    step = (i - 1) % 4
    back = lambda k, cond: F.when(cond, F.lag("o_orderkey", k).over(w))
    parents = F.array(back(1, step.isin(0, 1, 3)), back(2, step.isin(2, 3)), back(4, i % 8 == 1))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dst"), parents.alias("p"))
    return rows.select(F.explode(F.array_compact("p")).alias("src"), "dst")


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "node")
    return items.join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))


def _history(spark: SparkSession, sf_dir: str, values: DataFrame, keys: list[str], outer: int = 0) -> History:
    return History.from_frames(nodes(spark, sf_dir), edges(spark, sf_dir), values, keys, outer=outer, normal=True)


def brands(spark: SparkSession, sf_dir: str) -> History:
    """l: bag of brands of each order."""
    rows = _brands(spark, sf_dir).groupBy("node", F.col("p_brand").alias("key")).agg(F.count(F.lit(1)).alias("val"))
    return _history(spark, sf_dir, rows, ["key"])


def heavy_brands(spark: SparkSession, sf_dir: str) -> History:
    """r: brands of large items, weighted by line number."""
    rows = _brands(spark, sf_dir).filter("l_quantity > 25").groupBy("node", F.col("p_brand").alias("key")).agg(F.sum("l_linenumber").alias("val"))
    return _history(spark, sf_dir, rows, ["key"])


def quantities(spark: SparkSession, sf_dir: str) -> History:
    """q: bag of the quantities of each order."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("node"), F.col("l_quantity").cast("int").alias("key")).agg(F.count(F.lit(1)).alias("val"))
    return _history(spark, sf_dir, rows, ["key"])


def brand_quantities(spark: SparkSession, sf_dir: str) -> History:
    """b: bag of quantities of each brand of each order."""
    rows = _brands(spark, sf_dir).groupBy("node", F.col("p_brand").alias("key1"), F.col("l_quantity").cast("int").alias("key2")).agg(F.count(F.lit(1)).alias("val"))
    return _history(spark, sf_dir, rows, ["key1", "key2"], outer=1)


def events(spark: SparkSession, sf_dir: str) -> History:
    """The events of a user as a chain; every event has its type."""
    rows = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    chain = rows.select(F.lag("event_id").over(w).alias("src"), F.col("event_id").alias("dst")).filter("src is not null")
    values = rows.select(F.col("event_id").alias("node"), F.col("event_type").alias("key"), F.lit(1).cast("bigint").alias("val"))
    return History.from_frames(rows.select(F.col("event_id").alias("node")), chain, values, ["key"], normal=True)


def documents(spark: SparkSession, sf_dir: str) -> History:
    """Every document has its text."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), F.col("text").alias("key"), F.lit(1).cast("bigint").alias("val"))
    none = rows.select(F.col("node").alias("src"), F.col("node").alias("dst")).filter(F.lit(False))
    return History.from_frames(rows.select("node"), none, rows, ["key"], normal=True)


#: The repository below in SQL, after ``ORACLE``.
REPOSITORY_ORACLE = """
c as (select cast(o_orderkey as varchar) as sha, o_orderkey as node, cast(epoch(o_orderdate) as bigint) as time, o_orderstatus as author_name, concat(o_custkey, '@shop') as author_mail,
  concat(o_orderpriority, case when o_orderstatus = 'F' then ' fixes an Issue' else ' adds a prefix' end) as message from orders),
t as (select cast(l_orderkey as varchar) as sha, concat('src/', l_linenumber, case when l_suppkey % 2 = 0 then '.java' else '.txt' end) as path, cast(l_partkey as varchar) as object_id from lineitem),
f as (select cast(p_partkey as varchar) as object_id, p_size % 5 as loops, concat('if ', p_name, chr(10), '// while ', p_type, repeat(concat(chr(10), 'for ', p_brand, ' "do"'), p_size % 5), case when p_size % 2 = 0 then chr(10) else '' end) as content from part),
ce as (select cast(src as varchar) as src, cast(dst as varchar) as dst from e union all select null, cast(node as varchar) from n where node not in (select dst from e))
""".strip()


def repository(spark: SparkSession, sf_dir: str) -> Repositories:
    """Orders as commits of one repository, their items as files, parts as contents."""
    orders = read(spark, sf_dir, "orders")
    above = edges(spark, sf_dir).groupBy(F.col("dst").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.col("src").cast("string"))).alias("parents"))
    note = F.when(F.col("o_orderstatus") == "F", " fixes an Issue").otherwise(" adds a prefix")
    commits = orders.join(above, "o_orderkey", "left").select(
        F.lit("shop").alias("address"), F.col("o_orderkey").cast("string").alias("sha"), F.unix_seconds(F.from_utc_timestamp(F.col("o_orderdate").cast("timestamp"), F.current_timezone())).alias("time"),
        F.concat("o_orderpriority", note).alias("message"), F.col("o_orderstatus").alias("author_name"), F.concat(F.col("o_custkey").cast("string"), F.lit("@shop")).alias("author_mail"),
        F.coalesce("parents", F.array().cast("array<string>")).alias("parents"),
    )
    kind = F.when(F.col("l_suppkey") % 2 == 0, ".java").otherwise(".txt")
    trees = read(spark, sf_dir, "lineitem").select(
        F.lit("shop").alias("address"), F.col("l_orderkey").cast("string").alias("sha"), F.concat(F.lit("src/"), F.col("l_linenumber").cast("string"), kind).alias("path"), F.col("l_partkey").cast("string").alias("object_id")
    )
    # a decision, a comment, 0 to 4 more decisions, and for some a line feed at the end
    loops = F.repeat(F.concat(F.lit("\nfor "), "p_brand", F.lit(' "do"')), F.col("p_size").cast("int") % 5)
    content = F.concat(F.lit("if "), "p_name", F.lit("\n// while "), "p_type", loops, F.when(F.col("p_size") % 2 == 0, "\n").otherwise(""))
    blobs = read(spark, sf_dir, "part").select(F.lit("shop").alias("address"), F.col("p_partkey").cast("string").alias("object_id"), F.encode(content, "UTF-8").alias("content"))
    pairs = commits.select("address", "sha", F.explode(F.when(F.size("parents") > 0, F.col("parents")).otherwise(F.array(F.lit(None).cast("string")))).alias("parent"))
    files = lambda c: pairs.join(trees.select(F.col("sha").alias("__sha"), "path", "object_id"), F.col(c) == F.col("__sha")).drop("__sha")
    side = lambda c, name: files(c).groupBy("sha", "parent", "path").agg(F.collect_list("object_id").alias(name))
    old, new = side("parent", "old").alias("o"), side("sha", "new").alias("n")
    both = old.join(new, F.expr("o.sha = n.sha and o.parent <=> n.parent and o.path = n.path"), "full_outer")
    ids = F.arrays_zip(F.coalesce("old", F.array().cast("array<string>")).alias("a"), F.coalesce("new", F.array().cast("array<string>")).alias("b"))
    first = lambda c: F.coalesce(f"o.{c}", f"n.{c}").alias(c)
    diffs = both.select(F.lit("shop").alias("address"), first("sha"), first("parent"), first("path"), F.explode(ids).alias("x"))
    diffs = diffs.select("address", "sha", "parent", "path", F.col("x.a").alias("old_object_id"), F.col("x.b").alias("object_id")).filter("not (old_object_id <=> object_id)")
    return Repositories(commits, trees, blobs, diffs=diffs)
