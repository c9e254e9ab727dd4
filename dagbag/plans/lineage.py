"""Cutting lineage with tables in a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master may lack the setting; it then gets a temporary folder
    that goes when the process ends.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="dagbag-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return "file://" + _local["dir"]


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: no lineage is left."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dagbag-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._dagbag_path = path
    _made.append(path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Remove the tables that :func:`cut` makes meanwhile, but those in the list given.

    For work whose result is written before the end, so that nothing reads them later.
    """
    before, keep = len(_made), []
    try:
        yield keep
    finally:
        kept = {getattr(df, "_dagbag_path", None) for df in keep}
        for path in _made[before:]:
            if path not in kept:
                _made.remove(path)
                _remove(spark, path)


def sweep(spark: SparkSession) -> None:
    """Remove all tables that :func:`cut` has made in this process; to be called
    when no DataFrame that reads them is needed any more."""
    while _made:
        _remove(spark, _made.pop())


def drop(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`cut` that nothing reads any more."""
    path = getattr(df, "_dagbag_path", None)
    if path in _made:
        _made.remove(path)
        _remove(df.sparkSession, path)
