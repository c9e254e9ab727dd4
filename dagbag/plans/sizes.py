"""As many shuffle partitions as the tables read need.

A fixed number of partitions makes tasks grow with the input.  A query runs in a
session of its own, with the settings of the given one, in which every table that is
read raises the number; adaptive execution merges what turns out small.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of Parquet that a partition is planned for, and bytes of shuffled rows up to which partitions are merged.
TABLE_BYTES, MERGED_BYTES = 4 << 20, 8 << 20


def own(spark: SparkSession) -> SparkSession:
    """A session with the settings, views and functions of ``spark`` now, whose
    partitions :func:`reads` may change."""
    out = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    out._dagbag_bytes = {}
    SparkSession(spark.sparkContext, spark._jsparkSession)  # stays the active one
    return out


def reads(spark: SparkSession, path: str) -> None:
    """Raise the partitions of an own session for one more table; others are left alone."""
    tables = getattr(spark, "_dagbag_bytes", None)
    if tables is None or path in tables:
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    tables[path] = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    need = -(-sum(tables.values()) // TABLE_BYTES)
    if need > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", need)
        merged = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
        if spark._jsparkSession.sessionState().conf().getConf(spark._jvm.org.apache.spark.sql.internal.SQLConf.ADVISORY_PARTITION_SIZE_IN_BYTES()) > MERGED_BYTES:
            spark.conf.set(merged, f"{MERGED_BYTES}b")
