"""Plumbing shared by the operators: cut lineage, pass rows through Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from dagbag.llm import text as tx
from dagbag.plans.lineage import cut, drop, shared_dir  # noqa: F401


def quoted(name: str) -> str:
    """The name as it stands in expressions, whatever dots or ticks it has."""
    return "`" + name.replace("`", "``") + "`"


def col(df: DataFrame, name: str) -> Column:
    return df[quoted(name)]


def inputs(df: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """Just the named columns, cast; columns of other names can't clash then."""
    return df.select(*[col(df, c).cast(t).alias(c) for c, t in columns])


def with_text(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema, column: str = "text", limit: int = tx.CHUNK_BYTES) -> DataFrame:
    """mapInArrow over pieces of about ``limit`` bytes of text each.

    ``make`` sees columns by place; names with dots or ticks are kept from Spark's
    Python plans, which can't take them.
    """
    at, named = df.columns.index(column), None
    if any("." in c or "`" in c for c in df.columns):
        df, column = df.toDF(*[f"c{i}" for i in range(len(df.columns))]), f"c{at}"
        if not isinstance(schema, str):
            named, schema = schema.names, StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches, column, limit):
            out = make(piece)
            if out.num_rows:
                yield out

    out = df.mapInArrow(run, schema)
    return out.toDF(*named) if named else out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The same for several, which differ among themselves."""
    return [fresh(df, n) for n in names]


def first_labels(labels: DataFrame, label: str, per_class: int | tuple[int, ...], id_col: str = "doc_id", classes=(0, 1)) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, in order of a hash.

    A null id or label is left out; an id with several labels has the lowest.
    """
    one = (
        labels.select(col(labels, id_col).cast("bigint").alias("id"), col(labels, label).cast("int").alias("y"))
        .dropna()
        .groupBy("id")
        .agg(F.min("y").alias("y"))
    )
    bounds = per_class if isinstance(per_class, tuple) else (per_class,) * len(classes)
    parts = [one.filter(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(n) for c, n in zip(classes, bounds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int | tuple[int, ...], sample_bytes: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> pa.Table:
    """(id, text, y) of labelled documents, on the driver: at most ``per_class`` ids
    of each class, and of those no more once ``sample_bytes`` of text are taken.

    Of an id that several rows have the least text is used.  Only sizes, one row a
    chosen id, are looked at before the texts.
    """
    chosen = first_labels(labels, label, per_class, id_col)
    text = col(docs, text_col).cast("string")
    rows = docs.select(col(docs, id_col).cast("bigint").alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")
    sizes = rows.groupBy("id", "y").agg(F.max(F.octet_length("text")).alias("size")).withColumn("at", F.xxhash64("id")).collect()
    left, use = list(sample_bytes), []
    for r in sorted(sizes, key=lambda r: (r.at, r.id)):
        if left[r.y] > 0:
            use.append((r.id,))
            left[r.y] -= r.size or 0
    if len(use) < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(use, "id bigint")), "id")
    return rows.groupBy("id", "y").agg(F.min("text").alias("text")).toArrow().sort_by([("id", "ascending")])
