"""Memoisation: an expensive function runs once for each distinct argument."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def memo_apply(df: DataFrame, arguments: Sequence[str], f: Callable[..., Column], name: str) -> DataFrame:
    """``df`` with a column ``name`` that holds f of the argument columns.

    f is applied to the distinct arguments and joined back; null arguments
    count as equal.  Worth it where f is a Python function or parses content,
    not for built-in expressions, which cost less than the join.
    """
    # renamed, so that the join isn't one of a column with itself
    theirs = [f"__memo_{i}" for i in range(len(arguments))]
    once = df.select(*[F.col(a).alias(t) for a, t in zip(arguments, theirs)]).distinct()
    done = once.withColumn(name, f(*[F.col(t) for t in theirs]))
    cond = [F.col(a).eqNullSafe(F.col(t)) for a, t in zip(arguments, theirs)]
    return df.join(done, cond, "left").drop(*theirs)
