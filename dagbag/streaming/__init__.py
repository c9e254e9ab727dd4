"""Keeping tables of commits up to date from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_new(stream: DataFrame, table: str, keys: tuple[str, ...], checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, once: bool = False) -> StreamingQuery:
    """Append the rows of a stream whose keys the Parquet table doesn't have yet.

    A batch that is run again after a failure finds its rows there and adds
    none.  ``then`` gets the new rows of every batch.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(keys))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(table), list(keys), "left_anti")
        fresh = fresh.select(*batch.columns).persist()
        try:
            if then is not None:
                then(fresh, number)
            fresh.write.mode("append").parquet(table)
        finally:
            fresh.unpersist()

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
