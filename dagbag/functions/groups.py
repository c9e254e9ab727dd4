"""Groups that the values of a history can be drawn from.

A group says which columns hold a value and how values are added, negated,
multiplied and compared with zero, all as Column expressions.  Map-valued
weights need no group of their own: a map is stored flat, its keys as further
key columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Group:
    """``columns`` hold a value; ``types`` are their SQL types."""

    name: str
    columns: tuple[str, ...]
    types: tuple[str, ...]

    def zero(self) -> list[Column]:
        return [F.lit(0).cast(t) for t in self.types]

    def one(self) -> list[Column]:
        return [F.lit(1).cast(t) for t in self.types]

    def add(self, a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
        return [x + y for x, y in zip(a, b)]

    def invert(self, a: Sequence[Column]) -> list[Column]:
        return [-x for x in a]

    def multiply(self, a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
        return [x * y for x, y in zip(a, b)]

    def difference(self, a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
        """What must be added to a to get b."""
        return self.add(self.invert(a), b)

    def total(self) -> list[Column]:
        """Aggregates that add up a group of rows."""
        return [F.sum(c).cast(t).alias(c) for c, t in zip(self.columns, self.types)]

    def fold(self) -> list[Column]:
        """The same by :meth:`add` alone, for a group whose sum isn't that of its columns;
        a subclass returns this from :meth:`total`.

        The rows of one key are gathered in an array of that key, so they must be few;
        their order is fixed.
        """
        rows = F.array_sort(F.collect_list(F.struct(*self.columns)))
        zero = F.struct(*[z.alias(c) for z, c in zip(self.zero(), self.columns)])
        of = lambda s: [s[c] for c in self.columns]
        merge = lambda a, b: F.struct(*[x.cast(t).alias(c) for x, t, c in zip(self.add(of(a), of(b)), self.types, self.columns)])
        return [F.aggregate(rows, zero, merge)[c].alias(c) for c in self.columns]

    def nonzero(self, a: Sequence[Column] | None = None) -> Column:
        a = [F.col(c) for c in self.columns] if a is None else a
        return reduce(or_, [x != 0 for x in a])


INTEGER = Group("integer", ("val",), ("bigint",))
DOUBLE = Group("double", ("val",), ("double",))


def pair(first: Group = INTEGER, second: Group = INTEGER) -> Group:
    """Component-wise group of two values."""
    return Group("pair", ("val1", "val2"), first.types + second.types)


def triple(first: Group = INTEGER, second: Group = INTEGER, third: Group = INTEGER) -> Group:
    """Component-wise group of three values."""
    return Group("triple", ("val1", "val2", "val3"), first.types + second.types + third.types)


def map_add(a: Column, b: Column) -> Column:
    """Pointwise sum of two map columns; keys that sum to zero go."""
    total = F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return F.map_filter(total, lambda _, v: v != 0)


def map_multiply(a: Column, b: Column) -> Column:
    """Pointwise product on the keys that both map columns have."""
    product = F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0)))
    return F.map_filter(product, lambda _, v: v != 0)


def map_invert(a: Column) -> Column:
    return F.transform_values(a, lambda _, v: -v)
