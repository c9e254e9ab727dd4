"""Queries over the fixtures, one for each operator, and their oracles in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from inspect import signature

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dagbag import apps
from dagbag import fixtures as fx
from dagbag.functions import text
from dagbag.functions.groups import DOUBLE, map_add, map_invert, map_multiply
from dagbag.operators import topology
from dagbag.operators.changes import Changes
from dagbag.operators.history import LINEAR, MEMOIZATION, History
from dagbag.plans import delta, guard, sizes
from dagbag.plans.lineage import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_DIFF = """u as (select d.dst as node, l.key as key, l.val as val from d join l on l.node = d.dst union all select d.dst, l.key, -l.val from d join l on l.node = d.src),
x as (select node, key, cast(sum(val) as bigint) as val from u group by 1, 2 having sum(val) <> 0)"""
DIFF = f"d as (select src, dst from e),\n{_DIFF}"
DIFF1 = f"d as (select e.src, e.dst from e join (select dst as only from e group by dst having count(*) = 1) s on s.only = e.dst),\n{_DIFF}"
LEVELS = """recursive_levels(node, level) as (
  select node, 0 from n where node not in (select dst from e)
  union select e.dst, t.level + 1 from recursive_levels t join e on e.src = t.node),
lv as (select node, max(level) as level from recursive_levels group by 1)"""
CLOSURE = """tc(src, dst) as (select src, dst from e union select tc.src, e.dst from tc join e on e.src = tc.dst)"""


def query(sql: str | None = None, using: str = "", recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``sql`` follows the fixtures and ``using`` as CTEs."""

    def add(q: Query) -> Query:
        QUERIES[q.__name__] = q
        if sql is not None:
            ORACLE_SQL[q.__name__] = f"with {'recursive ' if recursive else ''}{fx.ORACLE}{',' if using else ''}\n{using}\n{sql}"
        return q

    return add


def last(key: Column) -> Column:
    return F.right(key, F.lit(1))


# -- core algebra ------------------------------------------------------------


@query("select node, key, val from l where node % 2 = 0 union all select node, 'odd', 1 from n where node % 2 = 1")
def create(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = fx.brands(spark, sf_dir)
    odd = l.nodes().filter("node % 2 = 1").select("node", F.lit("odd").alias("key"), F.lit(1).cast("bigint").alias("val"))
    return History.from_frames(l.nodes(), l.edges(), l.values().filter("node % 2 = 0").unionByName(odd)).values()


def _from_functions(spark: SparkSession, sf_dir: str) -> History:
    """Every fifth node has the one before it and itself halved as parents."""
    return History.create(spark, fx.nodes(spark, sf_dir), lambda n: [n - 1, n // 2] if n % 5 == 0 else [], lambda n: {n * 2: n % 3}, "bigint", "bigint")


@query("select node, node * 2 as key, cast(node % 3 as bigint) as val from n where node % 3 <> 0")
def create_from_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_functions(spark, sf_dir).values()


@query("select node - 1 as src, node as dst from n where node % 5 = 0 union all select node // 2, node from n where node % 5 = 0")
def create_edges_from_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_functions(spark, sf_dir).edges()


@query("select count(*) as size from n")
def size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).nodes().agg(F.count(F.lit(1)).alias("size"))


@query("select node from n")
def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).nodes()


@query("select src, dst from e")
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).edges()


@query("select node, node as key, cast(1 as bigint) as val from n")
def topology_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).topology().values()


@query("select n.node, cast(case when l.key is null then -1 else row_number() over (partition by n.node order by l.key) - 1 end as int) as place, coalesce(l.key, '') as key, coalesce(l.val, 0) as val from n left join l on l.node = n.node")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical array of every node, entry by entry; nodes without have one empty row."""
    entries = fx.brands(spark, sf_dir).index().select("node", F.posexplode_outer("entries").alias("place", "e"))
    return entries.select("node", F.coalesce("place", F.lit(-1)).alias("place"), F.coalesce("e.key", F.lit("")).alias("key"), F.coalesce("e.val", F.lit(0)).alias("val"))


@query("select node, key, val from x", DIFF)
def diff_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).diff().values()


@query("select node, key, val from x", DIFF1)
def diff_nomerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).diff(False).values()


@query("""select node, key, cast(sum(val) as bigint) as val from (
  select event_id as node, event_type as key, 1 as val from events where event_id in (select dst from c) union all
  select c.dst, event_type, -1 from events join c on c.src = event_id) t group by 1, 2 having sum(val) <> 0""",
       "c as (select src, dst from (select lag(event_id) over (partition by user_id order by ts, event_id) as src, event_id as dst from events) where src is not null)")
def diff_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.events(spark, sf_dir).diff().values()


@query("select node, key, cast(sum(val) as bigint) as val from (select node, right(key, 1) as key, 2 * val as val from l union all select node, 'all', val from l) t group by 1, 2 having sum(val) <> 0")
def tmap_hom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).tmap_hom(lambda k, v: [(last(k), 2 * v), (F.lit("all"), v)]).values()


@query("select node, val as key, count(*) as val from l group by 1, 2")
def tmap_ix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).tmap_ix(lambda k, v: [(v, F.lit(1))]).values()


@query("select node, key, val * val as val from l")
def tmap_ix2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).tmap_ix2(lambda k, x, dx: [(k, 2 * x * dx - dx * dx)]).values()


_ADD = "select node, key, cast(sum(val) as bigint) as val from (select node, key, val from l union all select node, key, {}val from r) t group by 1, 2 having sum(val) <> 0"


@query(_ADD.format(""))
def tadd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (fx.brands(spark, sf_dir) + fx.heavy_brands(spark, sf_dir)).values()


@query("select node, key, val from (" + _ADD.format("-") + ") t where val > 0")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (fx.brands(spark, sf_dir) + fx.heavy_brands(spark, sf_dir).inv()).added().values()


@query("select l.node, l.key as key_1, r.key as key_2, l.val * r.val as val from l join r on l.node = r.node")
def tcartesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).tcartesian(fx.heavy_brands(spark, sf_dir)).values()


@query("select l.node, l.key, l.val * r.val as val from l join r on l.node = r.node and l.key = r.key")
def tjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).tjoin(fx.heavy_brands(spark, sf_dir)).values()


@query("select l.node, l.key, cast(1 as bigint) as val from l join r on l.node = r.node and l.key = r.key")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).distinct().tjoin(fx.heavy_brands(spark, sf_dir).distinct()).values()


_TMAP = "select node, right(key, 1) as key, cast(sum(val) as bigint) as val from l {}group by 1, 2 having sum(val) <> 0"


@query(_TMAP.format(""))
def tmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).tmap(last).values()


@query(_TMAP.format(""))
def tmap_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums are put off until the values are read."""
    return fx.brands(spark, sf_dir).tmap(last, LINEAR).values()


@F.pandas_udf(T.StringType())
def _last_letter(keys: pd.Series) -> pd.Series:
    return keys.str[-1]


@query(_TMAP.format(""))
def tmap_memoized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function, run once for each distinct key."""
    return fx.brands(spark, sf_dir).tmap(_last_letter, MEMOIZATION).values()


@query("select node, key, val from l where key like '%1'")
def tfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).tfilter(lambda k: k.endswith("1")).values()


# -- derived operators ---------------------------------------------------------


@query("select node, 'one' as key, cast(sum(val) as bigint) as val from l group by 1")
def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).flat_map(lambda k: History.single(F.lit("one"))).values()


@query("select node, key, cast(sum(val) as bigint) as val from (select node, right(key, 1) as key, val from l union all select node, right(key, 2), val from l) t group by 1, 2")
def bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).flat_map(lambda k: History.bag(F.array(last(k), F.right(k, F.lit(2))))).values()


@query("select node, key, val from l where false")
def zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).zero().values()


@query("select node, key, val - 1 as val from l where val - 1 <> 0")
def map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).map_values(lambda v: v - 1).values()


@query("select node, key, 3 * val as val from l")
def map_values_hom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).map_values_hom(lambda v: 3 * v).values()


@query("select e.dst as node, e.src as parent, e.dst as child, -d.c as val from e join (select dst, count(*) as c from e group by 1) d on d.dst = e.dst")
def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).parents().values()


@query("select node, string_agg(concat(key, '=', val), ',' order by key) as key, cast(1 as bigint) as val from l group by 1")
def escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).escape().tmap(lambda m: F.array_join(F.transform(m, lambda e: F.concat(e["key"], F.lit("="), e["val"])), ",")).values()


@query("select node, key, val from l where key like '%1'")
def filter_memoized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).filter(lambda k: _last_letter(k) == "1", MEMOIZATION).values()


@query("select node, key, -val as val from l")
def inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).inv().values()


_TOKENS = "select doc_id as node, t as key, count(*) as val from (select doc_id, unnest(string_split(text, ' ')) as t from documents) where t <> '' group by 1, 2"


@query(_TOKENS)
def flat_map_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.documents(spark, sf_dir).flat_map(lambda t: History.bag(text.tokenize(t))).values()


@query(_TOKENS)
def flat_map_memoized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.documents(spark, sf_dir).flat_map(lambda t: History.bag(text.tokenize(t)), MEMOIZATION).values()


@query("select node, right(key, 1) as key, cast(sum(val) as bigint) as val from l where key like '%1' group by 1, 2 having sum(val) <> 0")
def collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).collect(lambda k: k.endswith("1"), last).values()


@query("select node, key, val from l where val > 1")
def filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).filter_values(lambda v: v > 1).values()


@query("select node, key, val as w, cast(1 as bigint) as val from l")
def to_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).to_bag().values()


@query("select node, cast(key as bigint) as key, cast(sum(val) as bigint) as val from (select node, key, val from q union all select node, node as key, 1 from n) t group by 1, 2 having sum(val) <> 0")
def add_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two types meet in the wider one."""
    q = fx.quantities(spark, sf_dir)
    return (q + q.topology()).values()


@query("select coalesce(l.node, r.node) as node, coalesce(l.key, r.key) as key, coalesce(l.val, 0) as val1, coalesce(r.val, 0) as val2 from l full outer join r on l.node = r.node and l.key = r.key")
def cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).cogroup(fx.heavy_brands(spark, sf_dir)).values()


@query("select node, right(key, 1) as \"group\", key, val from l")
def group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).group_by(last).values()


@query("select node, right(key, 1) as \"group\", cast(sum(val) as bigint) as val from l group by 1, 2")
def group_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).group_by(last).length().values()


@query("select node, cast(sum(val) as bigint) as key, cast(1 as bigint) as val from l group by 1 having sum(val) <> 0")
def length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).length().values()


@query("select node, key, cast(sign(val) as bigint) as val from x", DIFF)
def distinct_of_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).diff().distinct().values()


@query("select node, key, val from x where val > 0", DIFF)
def added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).diff().added().values()


@query("select node, key, val from x where val < 0", DIFF)
def removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brands(spark, sf_dir).diff().removed().values()


@query("select node, cast(sum(key * val) as bigint) as key, cast(1 as bigint) as val from q group by 1 having sum(key * val) <> 0")
def sum_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.quantities(spark, sf_dir).sum().values()


@query("select node, key1, cast(sum(val) as bigint) as val from b group by 1, 2 having sum(val) <> 0")
def grouped_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brand_quantities(spark, sf_dir).length().values()


@query("select node, key1, cast(sum(key2 * val) as bigint) as val from b group by 1, 2 having sum(key2 * val) <> 0")
def grouped_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brand_quantities(spark, sf_dir).sum().values()


@query("select node, key1, cast(sum(key2 * val) as double) / sum(val) as val from b group by 1, 2 having sum(val) <> 0 and sum(key2 * val) <> 0")
def grouped_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brand_quantities(spark, sf_dir).avg().values()


@query("select node, key1, key2, val from b")
def group_ungroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.brand_quantities(spark, sf_dir).ungroup().group().ungroup().values()


@query("select node, key1, key2, val from b")
def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps inside, entry by entry."""
    return fx.brand_quantities(spark, sf_dir).nested().select("node", "key1", F.explode("map").alias("key2", "val"))


@query("select node, key, val from l")
def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaping and flattening again."""
    return fx.brands(spark, sf_dir).escape().flatten().values()


@query("select node, key, cast(val as double) / 4 as val from l")
def double_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = fx.brands(spark, sf_dir)
    h = History.from_frames(l.nodes(), l.edges(), l.values().withColumn("val", F.col("val").cast("double")), ["key"], DOUBLE)
    return h.map_values_hom(lambda v: v / 4).values()


@query("select node, key, val from x", DIFF1.replace("x as (", "y as (") + ", x as (select node, cast(sum(val) as bigint) as key, cast(1 as bigint) as val from y where val > 0 group by 1)")
def terms_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much every node adds to its only parent: the shape of an analysis."""
    return fx.brands(spark, sf_dir).diff(False).added().length().values()


# -- graph utilities -----------------------------------------------------------


def _ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return cut(fx.nodes(spark, sf_dir)), cut(fx.edges(spark, sf_dir))


@query("select dst as node, count(*) as val from e group by 1")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.indegree(fx.edges(spark, sf_dir))


@query("select src as node, count(*) as val from e group by 1")
def outdegrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.outdegree(fx.edges(spark, sf_dir))


@query("select dst as node, string_agg(src, ',' order by src) as parents from e group by 1")
def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.incoming(fx.edges(spark, sf_dir)).withColumn("parents", F.array_join(F.transform("parents", lambda p: p.cast("string")), ","))


@query("select src as node, string_agg(dst, ',' order by dst) as children from e group by 1")
def outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.outgoing(fx.edges(spark, sf_dir)).withColumn("children", F.array_join(F.transform("children", lambda p: p.cast("string")), ","))


@query("select src, string_agg(dst, ',' order by dst) as values from e group by 1")
def group_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topology.group_by_key(fx.edges(spark, sf_dir), "src", "dst")
    return out.withColumn("values", F.array_join(F.transform("values", lambda p: p.cast("string")), ","))


@query("select dst, string_agg(src, ',' order by src) as keys from e group by 1")
def group_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topology.group_by_value(fx.edges(spark, sf_dir), "src", "dst")
    return out.withColumn("keys", F.array_join(F.transform("keys", lambda p: p.cast("string")), ","))


@query("select src, max(dst) as dst from e group by 1")
def reduce_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.reduce_by_key(fx.edges(spark, sf_dir), "src", "dst", F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b))


@query("select node, cast(level as int) as level from lv", LEVELS, True)
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.levels(*_ends(spark, sf_dir))


@query("select node, cast(level as int) as level, cast(row_number() over (order by level, node) - 1 as bigint) as position from lv", LEVELS, True)
def topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.topological_order(*_ends(spark, sf_dir))


_COMPONENTS = "cc as (select node, min(node) over (partition by comp) as component from seq)"


@query("select node, component from cc", _COMPONENTS)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.connected_components(*_ends(spark, sf_dir))


@query("select node, component, cast(level as int) as level, cast(row_number() over (order by component, level, node) - 1 as bigint) as position from lv join cc using (node)", LEVELS + ",\n" + _COMPONENTS, True)
def component_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.component_order(*_ends(spark, sf_dir))


@query("select element, min(element) over (partition by u) as component from (select distinct c_custkey as element, c_custkey % 50 as u from customer) t")
def merge_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of customers by remainders of 100 and of 50 overlap to those of 50."""
    c = fx.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("element"))
    sets = c.select((F.col("element") % 100).alias("set"), "element").unionByName(c.select((F.col("element") % 50 + 1000).alias("set"), "element"))
    return topology.merge_sets(sets)


@query("select node, cast(case when p < 7 * s - m * s then p / s else 7 - m + (p - (7 - m) * s) / (s + 1) end as int) as slice from (select node, p, s, m from (select node, row_number() over (order by node) - 1 as p from n), (select count(*) // 7 as s, count(*) % 7 as m from n)) t".replace("p / s", "p // s").replace("* s) / (s + 1)", "* s) // (s + 1)"))
def cut_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = topology.numbered(fx.nodes(spark, sf_dir), "node")
    return topology.slices(placed, 7).select("node", "slice")


@query("select src, dst from tc", CLOSURE, True)
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.closure(fx.edges(spark, sf_dir))


@query("select distinct e.src, e.dst from e join e p on p.dst = e.dst and p.src <> e.src join tc on tc.src = e.src and tc.dst = p.src", CLOSURE, True)
def bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.bypass(*_ends(spark, sf_dir))


@query()
def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between orders of one priority are contracted; gives the mapping."""
    n, e = _ends(spark, sf_dir)
    kind = fx.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    end = lambda c: kind.select(F.col("o_orderkey").alias(c), F.col("o_orderpriority").alias(f"{c}_kind"))
    still = e.join(end("src"), "src").join(end("dst"), "dst").filter("src_kind = dst_kind").select("src", "dst")
    return topology.contract(n, e, still)[2]


@query("select user_id, event_id, cast(sum(1) over (partition by user_id order by ts, event_id) as bigint) as val from events")
def prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.read(spark, sf_dir, "events").withColumn("dv", F.lit(1)).withColumn("at", F.struct("ts", "event_id"))
    return topology.prefix_sum(rows, "user_id", "at").select("user_id", "event_id", "val")


# -- functions -------------------------------------------------------------------


def _of_documents(name: str, f: Callable[[Column], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fx.read(spark, sf_dir, "documents").select("doc_id", f(F.col("text")).alias("out"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"select doc_id, {sql} as out from documents"


_of_documents("fn_replace", lambda t: text.replace(t, {"the": "a", "of": "the"}), "regexp_replace(regexp_replace(text, 'of', 'the', 'g'), 'the', 'a', 'g')")
_of_documents("fn_keep_letters", text.keep_letters, "regexp_replace(text, '[^A-Za-z]', ' ', 'g')")
_of_documents("fn_split_camel_case", text.split_camel_case, r"regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')")
_of_documents("fn_to_lower", text.to_lower, "lower(text)")
_of_documents("fn_tokenize", lambda t: F.array_join(text.tokenize(t), "|"), "array_to_string(list_filter(string_split(text, ' '), lambda t: t <> ''), '|')")
_of_documents("fn_insert", lambda t: text.insert(t, "the", "-", 1), "regexp_replace(text, 'the', 't-he', 'g')")
_of_documents("fn_mentions_issue", text.mentions_issue, "len(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z]', ' ', 'g')), ' '), lambda t: t in ('issue', 'issues'))) > 0")
_of_documents("fn_lines", lambda t: F.array_join(text.lines(t), "|"), r"array_to_string(string_split(regexp_replace(text, '\n$', ''), chr(10)), '|')")


@query("select o_orderkey, o_orderstatus <> 'O' as fix from orders")
def fn_is_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    message = F.when(status == "F", "Fixes it").when(status == "P", "a prefix, andBugfix").otherwise("prefix and postfix")
    return fx.read(spark, sf_dir, "orders").select("o_orderkey", text.is_fix(message).alias("fix"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as instant from events")
def fn_iso_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.read(spark, sf_dir, "events").select("event_id", text.iso_instant(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("instant"))


@query("select user_id, event_type as key, 3 * count(*) as added, count(*) * 2 * count(*) as multiplied, -count(*) as inverted from events group by 1, 2")
def fn_map_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointwise sum, product and inverse of map columns."""
    counts = fx.read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    m = m.withColumn("two", F.transform_values("m", lambda _, v: v * 2))
    m = m.select("user_id", map_add(F.col("m"), F.col("two")).alias("a"), map_multiply(F.col("m"), F.col("two")).alias("p"), map_invert(F.col("m")).alias("i"))
    return m.select("user_id", F.explode("a").alias("key", "added"), "p", "i").select("user_id", "key", "added", F.col("p")[F.col("key")].alias("multiplied"), F.col("i")[F.col("key")].alias("inverted"))


# -- repositories and analyses -------------------------------------------------------


def repository(sql: str, using: str = "") -> Callable[[Query], Query]:
    return query(sql, fx.REPOSITORY_ORACLE + ("," + using if using else ""))


def _flat(h: History) -> DataFrame:
    """Commits as text columns; the virtual root has a null one."""
    return h.values().withColumn("sha", F.col("node.sha")).drop("node")


@repository("select sha, sha as key, cast(1 as bigint) as val from c union all select null, null, 1")
def repo_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(fx.repository(spark, sf_dir).history()).withColumn("key", F.col("key.sha"))


@repository("select src, dst from ce")
def repo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.repository(spark, sf_dir).history().edges().select(F.col("src.sha").alias("src"), F.col("dst.sha").alias("dst"))


@repository("select sha, message as key, cast(1 as bigint) as val from c")
def repo_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.repository(spark, sf_dir)
    return _flat(r.message(r.history()))


@repository("select sha, author_name, author_mail, cast(1 as bigint) as val from c")
def repo_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.repository(spark, sf_dir)
    return _flat(r.author(r.history()))


@repository("select sha, time as key, cast(1 as bigint) as val from c")
def repo_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.repository(spark, sf_dir)
    return _flat(r.time(r.history()))


@repository("select sha, time as key, cast(1 as bigint) as val from c")
def repo_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.repository(spark, sf_dir)
    return _flat(r.date(r.history())).withColumn("key", F.unix_seconds("key"))


@repository("select sha, path, object_id, count(*) as val from t where path like '%.java' group by 1, 2, 3")
def repo_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.repository(spark, sf_dir)
    return _flat(r.resources(r.history(), ".java")).withColumn("object_id", F.col("resource.object_id")).drop("resource")


@repository("""select sha, path, object_id, cast(sum(val) as bigint) as val from (
  select ce.dst as sha, t.path, t.object_id, 1 as val from ce join t on t.sha = ce.dst union all
  select ce.dst, t.path, t.object_id, -1 from ce join t on t.sha = ce.src) x group by 1, 2, 3 having sum(val) <> 0""")
def repo_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that every commit adds and removes against its parents."""
    r = fx.repository(spark, sf_dir)
    return _flat(r.resources(r.history()).diff()).withColumn("object_id", F.col("resource.object_id")).drop("resource")


@repository("select coalesce(a.path, b.path) as path, a.object_id as old_object_id, b.object_id as new_object_id from (select * from t where sha = '1') a full join (select * from t where sha = '2') b on a.path = b.path where a.object_id is distinct from b.object_id")
def repo_tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.repository(spark, sf_dir).tree_diff("shop", "1", "2")


@repository("select object_id, cast(2 + loops as bigint) as n_lines from f")
def repo_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.repository(spark, sf_dir).line_counts().select("resource.object_id", "n_lines")


@repository("""select sha, strftime(to_timestamp(time), '%Y-%m-%dT%H:%M:%SZ') as date, cast(author_name = 'F' as varchar) as fix, cast(author_name = 'F' as varchar) as issue, 'shop' as address,
  cast((select count(*) from e where e.dst = c.node) as varchar) as parents, author_name as name, author_mail as mail from c""")
def repo_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.repository(spark, sf_dir).attributes()
    return a.select("node.sha", *[F.col("attributes")[k].alias(k) for k in ("date", "fix", "issue", "address", "parents", "name", "mail")])


@repository("select sha, cast(sum(1 + loops) as bigint) as key, cast(1 as bigint) as val from t join f using (object_id) where path like '%.java' group by 1")
def app_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(apps.complexity(fx.repository(spark, sf_dir)))


@repository("select sha, cast(sum(len(list_filter(string_split(rtrim(content, chr(10)), chr(10)), lambda x: not starts_with(ltrim(x), '//')))) as bigint) as key, cast(1 as bigint) as val from t join f using (object_id) where path like '%.java' group by 1")
def app_lines_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(apps.lines_of_code(fx.repository(spark, sf_dir)))


@repository("select sha, cast(sum(val) as bigint) as key, cast(1 as bigint) as val from g where val > 0 group by 1",
            """w as (select t.sha, word, count(*) as val from t join (select object_id, unnest(list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(content, '[^A-Za-z]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), ' '), lambda x: x <> '')) as word from f) f using (object_id) where path like '%.java' group by 1, 2),
  o as (select src, dst from ce where dst in (select dst from ce group by 1 having count(*) = 1)),
  g as (select sha, word, sum(val) as val from (select o.dst as sha, word, val from o join w on w.sha = o.dst union all select o.dst, word, -val from o join w on w.sha = o.src) x group by 1, 2)""")  # fmt: skip
def app_terms_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(apps.terms_added(fx.repository(spark, sf_dir)))


# -- plans -----------------------------------------------------------------------


def _order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("part"), (F.row_number().over(w) - 1).alias("pos"))


@query("select node, key, val from l")
def delta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, order = fx.brands(spark, sf_dir), _order(spark, sf_dir)
    return delta.decode(delta.encode(l, order), order, l.keys)


@query("select node, key, val from l")
def alias_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, ids = guard.aliased(fx.brands(spark, sf_dir))
    return guard.unaliased(h, ids).values()


@query("select 1 as step, node, key, -val as val from l union all select 3, node, key, 1 from l where false union all select 0, node, key, val from l")
def cut_after_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first operation is done as ever, from the second on nothing is left to do."""
    l = fx.brands(spark, sf_dir)
    first = guard.Watched.of(l, guard.Cut(1)).inv()
    parts = [(0, l), (1, first), (3, first.inv().map_values(lambda v: v * 7))]
    out = [h.values().select(F.lit(k).alias("step"), "node", "key", "val") for k, h in parts]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("select node, key, val from x", DIFF)
def watched_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.Watched.of(fx.brands(spark, sf_dir), guard.Logged()).diff().values()


# -- change form -----------------------------------------------------------------


def _changes(name: str, f: Callable[..., Changes | History], like: str) -> None:
    """A query over the changes along edges, with the oracle of the one over states; f
    gets a second history where it takes one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = [Changes.of(h(spark, sf_dir)) for h, _ in zip((fx.brands, fx.heavy_brands), signature(f).parameters)]
        for y in made[1:]:
            y._order = made[0]._order  # one graph
        return f(*made).values()

    QUERIES[name] = run
    ORACLE_SQL[name] = ORACLE_SQL[like]


_changes("changes_states", lambda x: x, "flatten")
_changes("changes_tmap_hom", lambda x: x.tmap_hom(lambda k, v: [(last(k), 2 * v), (F.lit("all"), v)]), "tmap_hom")
_changes("changes_tmap_ix", lambda x: x.tmap_ix(lambda k, v: [(v, F.lit(1))]), "tmap_ix")
_changes("changes_tmap_ix2", lambda x: x.tmap_ix2(lambda k, v, d: [(k, 2 * v * d - d * d)]), "tmap_ix2")
_changes("changes_tadd", lambda x, y: x + y, "tadd")
_changes("changes_tjoin", lambda x, y: x.tjoin(y), "tjoin")
_changes("changes_length", lambda x: x.length(), "length")
_changes("changes_diff", lambda x: x.diff(), "diff_all")


@query("select node, count(*) over (partition by root) as size from (select node, comp as root from seq)")
def preorder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are one tree; its root spans it and positions are unique."""
    got = topology.preorder(*_ends(spark, sf_dir))
    roots = got.filter("parent is null").select("root", (F.col("end") - F.col("pos")).alias("size"))
    return got.groupBy("root", "pos").agg(F.min("node").alias("node")).join(roots, "root").select("node", "size")


@repository("""select sha, path, object_id, cast(sum(val) as bigint) as val from (
  select ce.dst as sha, t.path, t.object_id, 1 as val from ce join t on t.sha = ce.dst union all
  select ce.dst, t.path, t.object_id, -1 from ce join t on t.sha = ce.src) x group by 1, 2, 3 having sum(val) <> 0""")
def repo_changes_from_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(fx.repository(spark, sf_dir).resource_changes().diff()).withColumn("object_id", F.col("resource.object_id")).drop("resource")


for _name in ("topology_", "sum_"):
    QUERIES[_name.rstrip("_")] = QUERIES.pop(_name)
    ORACLE_SQL[_name.rstrip("_")] = ORACLE_SQL.pop(_name)


def _sized(q: Query) -> Query:
    """The query in a session with as many partitions as its tables need."""

    @wraps(q)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q(sizes.own(spark), sf_dir)

    return run


QUERIES.update({name: _sized(q) for name, q in QUERIES.items()})
