"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagbag.llm import chroma, decontaminate, linededup, lm, packing, quality, simhash, sstable, toxicity, warc


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(read(spark, sf_dir, "documents"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lm.score(read(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read(spark, sf_dir, "documents"))


def op6_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.links(read(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return r.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("items", "starts", "ends")})  # as SQL engines print alike


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.bundles(read(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.shards(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_linededup": op3_linededup,
    "op4_lm": op4_lm,
    "op5_simhash": op5_simhash,
    "op6_chroma": op6_chroma,
    "op7_decontaminate": op7_decontaminate,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_sstable": op10_sstable,
}

#: DuckDB SQL of those that SQL can express; the others have brute-force tests.
ORACLE_SQL: dict[str, str] = {
    "op3_linededup": linededup.ORACLE,
    "op4_lm": lm.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
}
