"""Predicates on columns, with two-valued logic where a value is null.

``c.age > 30``, ``c.name.contains("a")``, ``p & q``, ``p | q``, ``~p``.  A comparison with a null value is
false, so its negation is true; a string that is null differs from every string; a NaN is neither equal
to, less nor greater than anything.  A predicate becomes a Catalyst column when a query binds it, so
filters reach the scan like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapquery.errors import ColumnNotFound, UnsupportedOperation

Types = Mapping[str, T.DataType]
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
#: Guesses where no statistics are at hand: shares of rows that are null, that equal one value, that hold a piece of text.
NULLS, EQUAL, TEXT = 1 / 16, 1 / 8, 1 / 4
FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _bound(name: str, known: Types) -> Column:
    if name not in known:
        raise ColumnNotFound(f"no column {name!r}; there are {', '.join(known)}")
    return F.col(f"`{name}`")


class Predicate:
    """Something that holds or doesn't for a row."""

    #: Share of rows expected to pass, for ``explain`` and the order of conjunctions.
    selectivity = 0.5

    def column(self, known: Types) -> Column:
        raise NotImplementedError

    def columns(self) -> list[str]:
        return []

    def conjuncts(self) -> list[Predicate]:
        return [self]

    def warnings(self) -> list[str]:
        return []

    def __and__(self, other: Predicate) -> Predicate:
        return And((*self.conjuncts(), *predicate(other).conjuncts()))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((*(self.parts if isinstance(self, Or) else (self,)), predicate(other)))

    def __invert__(self) -> Predicate:
        return Not(self)

    def __bool__(self) -> bool:
        raise TypeError("use & | ~ on predicates")


@dataclass(frozen=True)
class Compare(Predicate):
    name: str
    op: str
    value: Any

    def column(self, known: Types) -> Column:
        c, kind = _bound(self.name, known), known[self.name]
        if self.value is None:
            if self.op not in ("=", "!="):
                return F.lit(False)
            return c.isNull() if self.op == "=" else c.isNotNull()
        if isinstance(self.value, (Column, Field)):
            other = _bound(self.value.name, known) if isinstance(self.value, Field) else self.value
            return _compared(c, kind, self.op, other)
        if isinstance(kind, T.StringType) and self.op == "!=":
            return ~c.eqNullSafe(F.lit(self.value))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            if isinstance(self.value, float) and math.isnan(self.value):
                return c.isNotNull() if self.op == "!=" else F.lit(False)
            holds = COMPARE[self.op](c, F.lit(self.value))
            return holds if self.op == "!=" else holds & ~F.isnan(c)
        return COMPARE[self.op](c, F.lit(self.value))

    def columns(self) -> list[str]:
        return [self.name, self.value.name] if isinstance(self.value, Field) else [self.name]

    @property
    def selectivity(self) -> float:  # type: ignore[override]
        if self.value is None:
            return NULLS if self.op == "=" else 1 - NULLS
        return {"=": EQUAL, "!=": 1 - EQUAL}.get(self.op, 0.5)


def _compared(c: Column, kind: T.DataType, op: str, other: Column) -> Column:
    """Two columns of a row: a null on either side fails (strings: differs from any string), a NaN is unequal to all and in no order."""
    if isinstance(kind, T.StringType) and op == "!=":
        return ~c.eqNullSafe(other)
    if not isinstance(kind, T.NumericType):
        return COMPARE[op](c, other)
    nan = F.isnan(other.cast("double"))
    nan = nan | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else nan
    if op == "!=":
        return c.isNotNull() & other.isNotNull() & (nan | COMPARE[op](c, other))
    return COMPARE[op](c, other) & ~nan


@dataclass(frozen=True)
class StringOp(Predicate):
    name: str
    op: str  # contains, startswith, endswith, equals
    value: str
    ignore_case: bool = False
    selectivity = TEXT

    def column(self, known: Types) -> Column:
        c, v = _bound(self.name, known), F.lit(self.value)
        if self.ignore_case:
            c, v = F.upper(c), F.upper(v)
        return c == v if self.op == "equals" else getattr(c, self.op)(v)

    def columns(self) -> list[str]:
        return [self.name]


@dataclass(frozen=True)
class Like(Predicate):
    """``%`` at the ends only becomes a plain string test; anything else is SQL's LIKE."""

    name: str
    pattern: str
    selectivity = TEXT

    def column(self, known: Types) -> Column:
        inner = self.pattern.strip("%")
        if "%" in inner or "_" in inner or "\\" in inner:
            return _bound(self.name, known).like(self.pattern)
        left, right = self.pattern.startswith("%"), self.pattern.endswith("%")
        if not inner and (left or right):
            return _bound(self.name, known).isNotNull()
        op = {(True, True): "contains", (True, False): "endswith", (False, True): "startswith", (False, False): "equals"}[left, right]
        return StringOp(self.name, op, inner).column(known)

    def columns(self) -> list[str]:
        return [self.name]


@dataclass(frozen=True)
class NullOr(Predicate):
    """Null, or empty (after trimming, if ``blank``)."""

    name: str
    blank: bool = False
    selectivity = NULLS

    def column(self, known: Types) -> Column:
        c = _bound(self.name, known)
        return c.isNull() | ((F.trim(c) if self.blank else c) == "")

    def columns(self) -> list[str]:
        return [self.name]


@dataclass(frozen=True)
class Among(Predicate):
    name: str
    values: tuple[Any, ...]
    selectivity = EQUAL

    def column(self, known: Types) -> Column:
        values = [v for v in self.values if not (isinstance(v, float) and math.isnan(v))]  # a NaN equals nothing
        return _bound(self.name, known).isin(*values) if values else F.lit(False)

    def columns(self) -> list[str]:
        return [self.name]


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]

    def column(self, known: Types) -> Column:
        """Conjuncts in the order of their expected selectivity, as generated code stops at the first that fails."""
        return reduce(lambda a, b: a & b, (p.column(known) for p in sorted(self.parts, key=lambda p: p.selectivity)))

    def columns(self) -> list[str]:
        return [c for p in self.parts for c in p.columns()]

    def conjuncts(self) -> list[Predicate]:
        return list(self.parts)

    def warnings(self) -> list[str]:
        return [w for p in self.parts for w in p.warnings()]

    @property
    def selectivity(self) -> float:  # type: ignore[override]
        return math.prod(p.selectivity for p in self.parts)


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]

    def column(self, known: Types) -> Column:
        return reduce(lambda a, b: a | b, (p.column(known) for p in self.parts))

    def columns(self) -> list[str]:
        return [c for p in self.parts for c in p.columns()]

    def warnings(self) -> list[str]:
        return ["a disjunction is pushed to the scan only if every part can be", *(w for p in self.parts for w in p.warnings())]

    @property
    def selectivity(self) -> float:  # type: ignore[override]
        return 1 - math.prod(1 - p.selectivity for p in self.parts)


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def column(self, known: Types) -> Column:
        return ~F.coalesce(self.part.column(known), F.lit(False))

    def columns(self) -> list[str]:
        return self.part.columns()

    @property
    def selectivity(self) -> float:  # type: ignore[override]
        return 1 - self.part.selectivity


@dataclass(frozen=True)
class Raw(Predicate):
    """Any boolean Catalyst column, with the meaning that Spark gives it."""

    expression: Column = field(hash=False)

    def column(self, known: Types) -> Column:
        return self.expression

    def __repr__(self) -> str:
        return f"Raw({self.expression})"


@dataclass(frozen=True)
class Fallback(Predicate):
    """A Python function of a row, run row by row outside the columns."""

    function: Callable[[Any], bool]

    def column(self, known: Types) -> Column:
        return F.udf(self.function, "boolean")(F.struct(*[F.col(f"`{c}`") for c in known]))

    def warnings(self) -> list[str]:
        return ["a Python function can't be pushed to columns: every row is sent to Python"]


def predicate(p: Any) -> Predicate:
    """A predicate of a predicate, a boolean field, a column or a function."""
    if isinstance(p, Predicate):
        return p
    if isinstance(p, Field):
        return p == True  # noqa: E712
    if isinstance(p, Column):
        return Raw(p)
    if callable(p):
        return Fallback(p)
    raise UnsupportedOperation(f"{p!r} is no predicate")


@dataclass(frozen=True, eq=False)
class Field:
    """A column by name, from which comparisons are made."""

    name: str

    def __eq__(self, value: Any) -> Predicate:  # type: ignore[override]
        return Compare(self.name, "=", value)

    def __ne__(self, value: Any) -> Predicate:  # type: ignore[override]
        return Compare(self.name, "!=", value)

    def __lt__(self, value: Any) -> Predicate:
        return Compare(self.name, "<", value)

    def __le__(self, value: Any) -> Predicate:
        return Compare(self.name, "<=", value)

    def __gt__(self, value: Any) -> Predicate:
        return Compare(self.name, ">", value)

    def __ge__(self, value: Any) -> Predicate:
        return Compare(self.name, ">=", value)

    __hash__ = None  # type: ignore[assignment]

    def __invert__(self) -> Predicate:
        """Of a flag: that it is false; a null flag is neither true nor false."""
        return self == False  # noqa: E712

    def __and__(self, other: Any) -> Predicate:
        return predicate(self) & predicate(other)

    def __or__(self, other: Any) -> Predicate:
        return predicate(self) | predicate(other)

    def __bool__(self) -> bool:
        raise TypeError("use & | ~ on columns")

    def contains(self, value: str, ignore_case: bool = False) -> Predicate:
        return StringOp(self.name, "contains", value, ignore_case)

    def startswith(self, value: str, ignore_case: bool = False) -> Predicate:
        return StringOp(self.name, "startswith", value, ignore_case)

    def endswith(self, value: str, ignore_case: bool = False) -> Predicate:
        return StringOp(self.name, "endswith", value, ignore_case)

    def equals(self, value: str | None, ignore_case: bool = False) -> Predicate:
        return StringOp(self.name, "equals", value, True) if ignore_case and value is not None else self == value

    def like(self, pattern: str) -> Predicate:
        return Like(self.name, pattern)

    def is_null(self) -> Predicate:
        return Compare(self.name, "=", None)

    def has_value(self) -> Predicate:
        return Compare(self.name, "!=", None)

    is_not_null = has_value

    def is_null_or_empty(self) -> Predicate:
        return NullOr(self.name)

    def is_null_or_blank(self) -> Predicate:
        return NullOr(self.name, True)

    def isin(self, *values: Any) -> Predicate:
        return Among(self.name, values)

    def between(self, low: Any, high: Any) -> Predicate:
        return (self >= low) & (self <= high)


class _Fields:
    """``c.age`` or ``c["age"]``."""

    def __getattr__(self, name: str) -> Field:
        if name.startswith("__"):
            raise AttributeError(name)
        return Field(name)

    def __getitem__(self, name: str) -> Field:
        return Field(name)


c = _Fields()
all_of = lambda *p: reduce(lambda a, b: a & b, map(predicate, p))
any_of = lambda *p: reduce(lambda a, b: a | b, map(predicate, p))
not_ = lambda p: ~predicate(p)
