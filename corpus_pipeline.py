"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes it as Parquet to the folder that all executors share and reads it again
as the next stage's documents, and removes the tables that a stage made on its way.

In all stages a null id is an id like others and other columns, whatever their
names, are kept; null, empty and repeated rows, ties and very long texts are treated
as each stage says; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagbag.llm import decontaminate, frames, linededup, packing, quality, simhash
from dagbag.plans.lineage import scope


def _recounted(docs: DataFrame) -> DataFrame:
    """With n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is trained on labelled ones.

    Null and empty texts go.  Repeated rows stay or go together, a probability of just
    the threshold stays, a long text is scored whole.  Without labels of both classes
    every row stays.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has, nearly or exactly.

    A document whose lines all go goes; null texts and texts without lines stay.
    Repeated rows are one document; of equal lines the one of the least id, then text
    hash, then line number stays.
    """
    return _recounted(linededup.clean(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id.

    Of rows that repeat id and text one stays; texts without words all stay; a group
    may be linked through documents between.
    """
    return simhash.dedup(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    A document of which half the words are in passages goes; null and empty texts
    stay; repeated rows are changed alike; without a benchmark nothing changes.
    """
    return _recounted(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences that the documents are packed into.

    Every row is packed, also repeated ones; null and empty texts have no sequence; a
    text longer than a sequence is cut into pieces; equal costs go by id and piece.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("packing", packing_stage),
]

#: A trained classifier can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scope(spark) as keep:
            last, docs = docs, frames.cut(stage(spark, docs, sf_dir))
            keep.append(docs)
        frames.drop(last)
    return docs
