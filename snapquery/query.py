"""The fluent query: a lazy chain of steps over a snapshot."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import replace as replaced
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from snapquery.errors import ColumnNotFound, EmptySequenceError, MultipleElementsError, UnsupportedOperation
from snapquery.functions import aggregates as agg
from snapquery.functions.aggregates import Aggregate
from snapquery.functions.predicates import Fallback, Field, Raw, predicate
from snapquery.operators import grouping, joins, rows
from snapquery.operators.rows import HIDDEN, RID
from snapquery.plans.steps import Steps

if TYPE_CHECKING:
    from snapquery.snapshot import Snapshot


@dataclass(frozen=True)
class Query:
    """Each method returns a new query; nothing runs before a terminal or an action on ``to_df()``."""

    snapshot: Snapshot
    make: Callable[[], DataFrame]
    steps: Steps = field(default_factory=Steps)
    order: tuple[tuple[str, bool], ...] = ()
    strict: bool = True
    partitions: int | None = None
    skipped: tuple[Query, int] | None = None  # of a query that ends in ``skip``: what stands before it, and how many rows

    # plan

    def _frame(self) -> DataFrame:
        """With the ordinal, unordered."""
        self.snapshot.check_open()
        return self.snapshot.plans.get(self.steps.key(), self.make, self.steps)

    def _next(self, kind: str, details: Any, make: Callable[[], DataFrame], order: tuple[tuple[str, bool], ...] | None = None) -> Query:
        return replaced(self, make=make, steps=self.steps.then(kind, details), order=self.order if order is None else order, skipped=None)

    def to_df(self, ordered: bool = True) -> DataFrame:
        """The result as a frame, in the query's order unless that doesn't matter."""
        df = self._frame()
        df = rows.ordered(df, list(self.order)) if ordered and not self._in_order() else df
        df = rows.shown(df)
        return df if self.partitions is None else df.coalesce(self.partitions)

    def _in_order(self) -> bool:
        """Whether the plan gives rows in their order without a sort: that of the scan, which filters and projections keep."""
        return self.snapshot.in_place and not self.order and all(s.kind in ("where", "select") for s in self.steps.items)

    def with_parallel(self, partitions: int | None = None) -> Query:
        return replaced(self, partitions=partitions)

    def as_sequential(self) -> Query:
        return self.with_parallel(1)

    def allow_fallback(self) -> Query:
        """Let Python functions be predicates, at the price of sending rows to Python."""
        return replaced(self, strict=False)

    def strict_mode(self) -> Query:
        return replaced(self, strict=True)

    def explain_text(self) -> str:
        return self.steps.explain()

    def explain_plan(self, mode: str = "formatted") -> str:
        """Spark's own explanation."""
        return self.to_df(ordered=bool(self.order))._jdf.queryExecution().explainString(
            self.snapshot.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
        )

    # operators

    def where(self, *conditions: Any, **equal: Any) -> Query:
        parts = [predicate(p) for p in conditions] + [Field(k) == v for k, v in equal.items()]
        if self.strict and any(isinstance(q, Fallback) for p in parts for q in p.conjuncts()):
            raise UnsupportedOperation("a Python function can't be pushed to columns; allow_fallback() runs it row by row")
        both = parts[0]
        for p in parts[1:]:
            both = both & p
        both.column(rows.known(self._frame()))  # names are checked at once
        self._check_strict(lambda: rows.filtered(self._frame(), both), any(_holds_column(q) for q in both.conjuncts()))
        return self._next("where", both, lambda: rows.filtered(self._frame(), both))

    def _check_strict(self, make: Callable[[], DataFrame], columns: bool) -> None:
        """Columns of Spark may hold Python functions, which only the plan tells."""
        if self.strict and columns and rows.python_calls(make()) > rows.python_calls(self._frame()):
            raise UnsupportedOperation("a Python function in a column can't be pushed to columns; allow_fallback() runs it row by row")

    having = where

    def select(self, *columns: str | Field, **renamed: str | Field | Column) -> Query:
        chosen: dict[str, str | Column] = {_name(c): _name(c) for c in columns}
        chosen |= {k: v if isinstance(v, Column) else _name(v) for k, v in renamed.items()}
        self._check_strict(lambda: rows.projected(self._frame(), chosen), any(isinstance(v, Column) for v in chosen.values()))
        rows.projected(self._frame(), chosen)  # names are checked at once
        df, order, hidden = self._frame(), [], {}
        for k, falling in self.order:
            shown = [n for n, c in chosen.items() if c == k] if not k.startswith(HIDDEN) else []
            if not shown and not k.startswith(HIDDEN):
                shown = [f"{HIDDEN}key_{len(self.steps.items)}_{len(hidden)}"]
                hidden[shown[0]] = k
            order.append((shown[0] if shown else k, falling))
        keys = {n: rows.quoted(k) for n, k in hidden.items()}
        return self._next("select", chosen, lambda: rows.projected(df.withColumns(keys) if keys else df, chosen), tuple(order))

    def _shown_order(self) -> tuple[tuple[str, bool], ...]:
        """Of the order, what does not stand on hidden columns."""
        return tuple(o for o in self.order if not o[0].startswith(HIDDEN))

    def order_by(self, column: str | Field) -> Query:
        return self._order(column, False, ())

    def order_by_desc(self, column: str | Field) -> Query:
        return self._order(column, True, ())

    def then_by(self, column: str | Field) -> Query:
        return self._order(column, False, self.order)

    def then_by_desc(self, column: str | Field) -> Query:
        return self._order(column, True, self.order)

    def _order(self, column: str | Field, falling: bool, before: tuple[tuple[str, bool], ...]) -> Query:
        name = _name(column)
        if name not in rows.known(self._frame()):
            raise ColumnNotFound(f"no column {name!r}")
        order = (*before, (name, falling))
        return self._next("order", order, self._frame, order)

    def skip(self, n: int) -> Query:
        make = lambda: rows.page(self._frame(), list(self.order), skip=n)
        make()
        return replaced(self._next("skip", n, make), skipped=(self, n))

    def take(self, n: int) -> Query:
        """The first n; after ``skip`` both become one page."""
        q, skip = self.skipped or (self, 0)
        make = lambda: rows.page(q._frame(), list(self.order), skip, n)
        make()
        return self._next("take", n, make)

    def page(self, skip: int, take: int) -> Query:
        return self._next("take", (skip, take), lambda: rows.page(self._frame(), list(self.order), skip, take))

    def distinct(self) -> Query:
        return self._next("distinct", None, lambda: rows.distinct(self._frame()), self._shown_order())

    def group_by(self, *keys: str | Field, **renamed: str | Field) -> Grouping:
        return Grouping(self, {_name(k): _name(k) for k in keys} | {n: _name(k) for n, k in renamed.items()})

    def join(self, other: Query | Snapshot, on: str | dict[str, str], how: str = "inner", suffix: str = "_right") -> Query:
        right, keys = _query(other), on if isinstance(on, dict) else {on: on}
        joins.check(how)
        details = (how, keys, right.snapshot.serial, right.steps.key())
        return self._next("join", details, lambda: joins.joined(self._frame(), right._frame(), keys, how, suffix), self._shown_order())

    def group_join(self, other: Query | Snapshot, on: str | dict[str, str], **aggregates: Aggregate) -> Query:
        right, keys = _query(other), on if isinstance(on, dict) else {on: on}
        details = ("group", keys, right.snapshot.serial, right.steps.key(), aggregates)
        return self._next("join", details, lambda: joins.group_joined(self._frame(), right._frame(), keys, aggregates), self._shown_order())

    # terminals

    def _timed(self, run: Callable[[], Any]) -> Any:
        began = time.perf_counter()
        out = run()
        self.snapshot.tracker.record(self.steps.key(), (time.perf_counter() - began) * 1000)
        return out

    def count(self, *conditions: Any) -> int:
        q = self.where(*conditions) if conditions else self
        return q._timed(lambda: q._frame().count())

    long_count = count

    def aggregate_df(self, **aggregates: Aggregate) -> DataFrame:
        """All aggregates in one pass, as a frame of one row; what has no value is null."""
        return grouping.totals(self._frame(), aggregates)

    def aggregate(self, **aggregates: Aggregate) -> Row:
        """All aggregates in one pass; averages, least and greatest of nothing raise."""
        checks = {f"_n_{k}": F.count(rows.quoted(a.name)) for k, a in aggregates.items() if a.op in agg.NEEDS_ELEMENTS}
        have = rows.known(self._frame())
        cells = [a.column(have).alias(k) for k, a in aggregates.items()] + [c.alias(k) for k, c in checks.items()]
        row = self._timed(lambda: self._frame().agg(*cells).first())
        for k in checks:
            if not row[k]:
                raise EmptySequenceError(f"{aggregates[k[3:]].text()} of no elements")
        return Row(**{k: row[k] for k in aggregates})

    def sum(self, column: str | Field) -> Any:
        return self.aggregate(v=agg.sum_(column)).v

    def average(self, column: str | Field) -> float:
        return self.aggregate(v=agg.average(column)).v

    def min(self, column: str | Field) -> Any:
        return self.aggregate(v=agg.min_(column)).v

    def max(self, column: str | Field) -> Any:
        return self.aggregate(v=agg.max_(column)).v

    def _some(self, n: int, skip: int = 0) -> list[Row]:
        return self._timed(lambda: rows.shown(rows.page(self._frame(), list(self.order), skip, n)).collect())

    def first(self, *conditions: Any) -> Row:
        found = (self.where(*conditions) if conditions else self)._some(1)
        if not found:
            raise EmptySequenceError("first of no elements")
        return found[0]

    def first_or_default(self, *conditions: Any) -> Row | None:
        found = (self.where(*conditions) if conditions else self)._some(1)
        return found[0] if found else None

    def first_n(self, n: int) -> list[Row]:
        return self._some(n)

    def single(self, *conditions: Any) -> Row:
        found = self.single_or_default(*conditions)
        if found is None:
            raise EmptySequenceError("single of no elements")
        return found

    def single_or_default(self, *conditions: Any) -> Row | None:
        found = (self.where(*conditions) if conditions else self)._some(2)
        if len(found) > 1:
            raise MultipleElementsError("single of several elements")
        return found[0] if found else None

    def any(self, *conditions: Any) -> bool:
        q = self.where(*conditions) if conditions else self
        return not q._timed(lambda: q._frame().isEmpty())

    def all(self, *conditions: Any) -> bool:
        """True of nothing; a row for which the condition is null fails it."""
        both = self.where(*conditions).steps.of("where")[-1]
        return not self.where(~both).any()

    def element_at(self, i: int) -> Row:
        found = self._some(1, i)
        if not found:
            raise EmptySequenceError(f"no element {i}")
        return found[0]

    def last(self) -> Row:
        df = self._frame()
        back = [rows.quoted(k).asc_nulls_first() if falling else rows.quoted(k).desc_nulls_last() for k, falling in self.order]
        found = rows.shown(df.orderBy(*back, F.col(RID).desc()).limit(1)).collect()
        if not found:
            raise EmptySequenceError("last of no elements")
        return found[0]

    def to_list(self) -> list[Row]:
        return self._timed(lambda: self.to_df().collect())

    def reverse(self) -> list[Row]:
        return self.to_list()[::-1]

    def to_arrow(self) -> pa.Table:
        return self.to_df().toArrow()

    def indices(self) -> list[int]:
        """Ordinals of the rows, in their order."""
        return [r[0] for r in rows.ordered(self._frame(), list(self.order)).select(RID).collect()]

    def to_dict(self, key: str, value: str) -> dict[Any, Any]:
        """Of a grouped result: key to aggregate."""
        return {r[0]: r[1] for r in self._frame().select(rows.quoted(key), rows.quoted(value)).collect()}

    def __iter__(self) -> Iterator[Row]:
        """Rows one after another, a partition at a time."""
        yield from self.to_df().toLocalIterator()


@dataclass(frozen=True)
class Grouping:
    """What ``group_by`` returns: waits for its aggregates."""

    query: Query
    keys: dict[str, str]

    def agg(self, **aggregates: Aggregate) -> Query:
        for name, a in aggregates.items():
            if not isinstance(a, Aggregate):
                raise UnsupportedOperation(f"{name}: a group has count, sum, average, min and max")
        q = self.query
        make = lambda: grouping.grouped(q._frame(), self.keys, aggregates)
        make()
        return q._next("group", (self.keys, aggregates), make, ())

    def count(self) -> Query:
        return self.agg(Count=agg.count())

    def to_dict(self, aggregate: Aggregate) -> dict[Any, Any]:
        if len(self.keys) != 1:
            raise UnsupportedOperation("a dictionary has one key")
        return self.agg(_v=aggregate).to_dict(next(iter(self.keys)), "_v")


def _holds_column(p: Any) -> bool:
    parts = getattr(p, "parts", None) or ([p.part] if hasattr(p, "part") else [])
    return isinstance(p, Raw) or isinstance(getattr(p, "value", None), Column) or any(map(_holds_column, parts))


def _name(column: str | Field) -> str:
    return column.name if isinstance(column, Field) else column


def _query(source: Query | Snapshot) -> Query:
    return source if isinstance(source, Query) else source.query()
