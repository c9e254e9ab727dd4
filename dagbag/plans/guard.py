"""Histories that are watched: logging, step limits, differential checks, timing."""

from __future__ import annotations

import logging
import statistics
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagbag.operators.history import History

UNARY = ("topology", "diff", "tmap_hom", "tmap_ix", "tmap_ix2", "tmap", "tfilter", "map_values", "parents", "escape", "inv", "flat_map", "filter_values", "to_bag", "length", "sum", "avg", "group_by")
BINARY = ("tadd", "tcartesian", "tjoin", "cogroup")

log = logging.getLogger("dagbag")


class Hooks:
    """What a watched history calls; override what is of interest.

    ``before`` may change the history that an operator gets, ``after`` its
    result, ``at_index`` sees what is materialised; ``dynamics`` may override
    the execution hint.
    """

    def before(self, operation: str, h: History) -> History:
        return h

    def after(self, operation: str, h: History) -> History:
        return h

    def at_index(self, h: History, index: DataFrame) -> DataFrame:
        return index

    def dynamics(self, operation: str, wanted: str | None) -> str | None:
        return wanted


class Watched(History):
    """A history whose operators run between hooks."""

    hooks: Hooks
    inside: bool = False

    @classmethod
    def of(cls, h: History, hooks: Hooks) -> Watched:
        out = cls.__new__(cls)
        out.__dict__.update(h.__dict__)
        out.hooks = hooks
        return out

    def index(self) -> DataFrame:
        plain = Watched.of(self, self.hooks)
        plain.inside = True
        return self.hooks.at_index(plain, History.index(self))


def _watch(name: str, binary: bool) -> Callable:
    plain = getattr(History, name)

    @wraps(plain)
    def run(self: Watched, *args, **kwargs):
        if self.inside:
            return plain(self, *args, **kwargs)
        hooks = self.hooks
        mine = hooks.before(name, self)
        if binary:
            args = (hooks.before(name, args[0]), *args[1:])
        if "dynamics" in kwargs:
            kwargs["dynamics"] = hooks.dynamics(name, kwargs["dynamics"])
        mine = Watched.of(mine, hooks)
        mine.inside = True
        out = Watched.of(plain(mine, *args, **kwargs), hooks)
        out.inside = True  # what the hook does isn't watched
        out = Watched.of(hooks.after(name, out), hooks)
        out.inside = False
        return out

    return run


for _name in (*UNARY, *BINARY):
    setattr(Watched, _name, _watch(_name, _name in BINARY))
Watched.__add__ = Watched.tadd
Watched.map = Watched.tmap
Watched.join = Watched.tjoin


class Logged(Hooks):
    """Number, name and time of every operation; jobs get its name."""

    def __init__(self) -> None:
        self.count = 0

    def before(self, operation: str, h: History) -> History:
        self.count += 1
        log.info("%d %s at %s", self.count, operation, time.strftime("%Y-%m-%dT%H:%M:%S"), stack_info=log.isEnabledFor(logging.DEBUG))
        h.nodes().sparkSession.sparkContext.setJobDescription(f"{self.count} {operation}")
        return h


class Cut(Hooks):
    """From operation ``step`` on all inputs are empty: profiles a prefix."""

    def __init__(self, step: int) -> None:
        self.step, self.count = step, 0

    def before(self, operation: str, h: History) -> History:
        self.count += 1
        return h.zero() if self.count > self.step else h


class Checked(Hooks):
    """Compares what is materialised, or (``always``) each result, with another
    way of computing it."""

    def __init__(self, other: Callable[[History], History], always: bool = False) -> None:
        self.other, self.always = other, always

    def after(self, operation: str, h: History) -> History:
        if self.always:
            same_values(h, self.other(h))
        return h

    def at_index(self, h: History, index: DataFrame) -> DataFrame:
        same_values(h, self.other(h))
        return index


def same_values(a: History, b: History) -> None:
    """Raise AssertionError, with some rows, unless the values are equal."""
    x, y = History.values(a), History.values(b.rekey(a.keys))
    wrong = x.exceptAll(y).withColumn("side", F.lit("left")).unionAll(y.exceptAll(x).withColumn("side", F.lit("right"))).take(5)
    if wrong:
        raise AssertionError(f"histories differ: {wrong}")


@contextmanager
def timed(name: str, times: dict[str, list[float]]) -> Iterator[None]:
    """Add the seconds that a block takes to ``times[name]``."""
    began = time.perf_counter()
    try:
        yield
    finally:
        times.setdefault(name, []).append(time.perf_counter() - began)


def profile(run: Callable[[], object], repeats: int = 5, warm_up: int = 1) -> tuple[float, float]:
    """(mean, deviation) of the seconds of a run, warm-ups left out."""
    times: dict[str, list[float]] = {}
    for i in range(warm_up + repeats):
        with timed("warm-up" if i < warm_up else "run", times):
            run()
    return statistics.mean(times["run"]), statistics.pstdev(times["run"])


def aliased(h: History) -> tuple[History, DataFrame]:
    """The history over dense numbers instead of nodes, and (node, node_id).

    Pays where node identifiers are long, like hashes of commits.
    """
    from dagbag.operators.topology import numbered

    ids = numbered(h.nodes(), "node", name="node_id")
    swap = lambda df, c: df.join(ids.select(F.col("node").alias(c), "node_id"), c).drop(c).withColumnRenamed("node_id", c)
    values = swap(h._values, "node")
    return History.from_frames(swap(h.nodes(), "node"), swap(swap(h.edges(), "src"), "dst"), values, h.keys, h.g(), h.outer, h.normal), ids


def unaliased(h: History, ids: DataFrame) -> History:
    back = lambda df, c: df.join(ids.select(F.col("node_id").alias(c), F.col("node").alias("__n")), c).drop(c).withColumnRenamed("__n", c)
    return History.from_frames(back(h.nodes(), "node"), back(back(h.edges(), "src"), "dst"), back(h._values, "node"), h.keys, h.g(), h.outer, h.normal)
