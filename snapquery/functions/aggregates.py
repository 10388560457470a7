"""Aggregates, with their meaning over nothing: a sum is zero, a count is zero, the rest has no value.

In a group, the average of nulls alone is 0.0 and the least and greatest are null.  Integer sums are
64-bit, decimal ones exact, and an average is a double.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapquery.errors import ColumnNotFound
from snapquery.functions.predicates import Field, Predicate, Types

NEEDS_ELEMENTS = ("average", "min", "max")


@dataclass(frozen=True)
class Aggregate:
    op: str  # count, long_count, sum, average, min, max
    name: str | None = None
    where: Predicate | None = None

    def column(self, known: Types, grouped: bool = False) -> Column:
        if self.op in ("count", "long_count"):
            return F.count_if(self.where.column(known)) if self.where is not None else F.count(F.lit(1))
        if self.name not in known:
            raise ColumnNotFound(f"no column {self.name!r}; there are {', '.join(known)}")
        c, kind = F.col(f"`{self.name}`"), known[self.name]
        if self.op == "sum":
            total = F.sum(c)
            zero = F.lit(0.0) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(0)
            return F.coalesce(total, zero)
        if self.op == "average":
            mean = F.avg(c.cast("double") if isinstance(kind, T.DecimalType) else c)
            return F.coalesce(mean, F.lit(0.0)) if grouped else mean
        return F.min(c) if self.op == "min" else F.max(c)

    def text(self) -> str:
        return f"{self.op.replace('_', ' ').title().replace(' ', '')}({self.name or ''})"


def _name(column: str | Field) -> str:
    return column.name if isinstance(column, Field) else column


def count(where: Predicate | None = None) -> Aggregate:
    return Aggregate("count", None, where)


def long_count() -> Aggregate:
    return Aggregate("long_count")


def sum_(column: str | Field) -> Aggregate:
    return Aggregate("sum", _name(column))


def average(column: str | Field) -> Aggregate:
    return Aggregate("average", _name(column))


def min_(column: str | Field) -> Aggregate:
    return Aggregate("min", _name(column))


def max_(column: str | Field) -> Aggregate:
    return Aggregate("max", _name(column))
