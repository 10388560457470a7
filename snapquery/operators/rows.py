"""Row operators on frames that carry a hidden ordinal: filters, projections, order, pages, distinct rows."""

from __future__ import annotations

import re
from collections.abc import Mapping

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapquery.errors import ColumnNotFound
from snapquery.functions.predicates import Predicate

#: Reserved for hidden columns; an input whose column names begin with it is refused.
HIDDEN = "__snapquery_"
RID = HIDDEN + "ordinal"
#: Of a page that ends by this row, each task holds the first rows and sends them to one task.
GATHERED = 10_000
#: Ranges of the order in which the rows of a late page are counted.
RANGES = 64
#: Groups over which rows are dealt that need no number; small ones are sorted by their number alone.
GROUPS = 2**20
PLACE, GROUP, NUMBER, WHOLE = HIDDEN + "place", HIDDEN + "group", HIDDEN + "number", HIDDEN + "whole"
#: Steps of a plan that give the same rows each time, if their expressions and inputs do.
REPEATABLE = {"Aggregate", "Filter", "InMemoryRelation", "Join", "LocalRelation", "LogicalRelation", "Project", "SubqueryAlias"}


def known(df: DataFrame) -> dict[str, T.DataType]:
    """Visible columns and their types."""
    return {f.name: f.dataType for f in df.schema.fields if not f.name.startswith(HIDDEN)}


def shown(df: DataFrame) -> DataFrame:
    """Without the ordinal and the hidden keys of the order."""
    return df.drop(*[c for c in df.columns if c.startswith(HIDDEN)])


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def filtered(df: DataFrame, predicate: Predicate) -> DataFrame:
    return df.where(predicate.column(known(df)))


def projected(df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    """Output name to column name or expression; the ordinal stays."""
    have, out = known(df), []
    for name, source in columns.items():
        if isinstance(source, str):
            if source not in have:
                raise ColumnNotFound(f"no column {source!r}; there are {', '.join(have)}")
            source = quoted(source)
        out.append(source.alias(name))
    return df.select(*out, *[c for c in df.columns if c.startswith(HIDDEN)])


def order_columns(keys: list[tuple[str, bool]]) -> list[Column]:
    """Nulls come first rising and last falling; the ordinal settles ties, so the order is stable."""
    out = [quoted(k).desc_nulls_last() if falling else quoted(k).asc_nulls_first() for k, falling in keys]
    return [*out, F.col(RID).asc()]


def ordered(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    return df.orderBy(*order_columns(keys))


def page(df: DataFrame, keys: list[tuple[str, bool]], skip: int = 0, take: int | None = None) -> DataFrame:
    """Rows ``skip`` to ``skip + take`` of the order, in order.

    A page that ends early is a top-k plan.  No other sends all rows through one task: what few rows can
    be before its edges is told apart from the rest first, and only those are numbered together.
    """
    if skip < 0 or (take is not None and take < 0):
        raise ValueError("counts of rows must not be negative")
    end = None if take is None else skip + take
    if end is not None and end <= GATHERED:
        out = ordered(df, keys).limit(end)
        return out.offset(skip) if skip else out
    if skip or end is not None:
        far = max(skip, end or 0) > GATHERED
        df = (_by_ranges if far and repeatable(df) else _by_places)(df, keys, skip, end)
    return ordered(df, keys)


def _within(place: Column, skip: int, end: int | None) -> Column:
    """Whether a row is in the page; places are from 1."""
    return (place > skip) if end is None else (place > skip) & (place <= end)


def _by_places(df: DataFrame, keys: list[tuple[str, bool]], skip: int, end: int | None) -> DataFrame:
    """The rows are read once: those that stand late in the order of their own partition stand late among all, the others are numbered."""
    order = order_columns(keys)
    local = F.col(PLACE).bitwiseAND(F.lit(2**33 - 1))  # in its partition, from 0
    out = df.sortWithinPartitions(*order).withColumn(PLACE, F.monotonically_increasing_id())
    out = out.withColumn(GROUP, F.when(local < (skip if end is None else end), 0).otherwise(1 + local % GROUPS))
    out = out if end is None else out.where(F.col(GROUP) == 0)
    out = out.withColumn(NUMBER, F.row_number().over(Window.partitionBy(GROUP).orderBy(*order)))
    return out.where((F.col(GROUP) > 0) | _within(F.col(NUMBER), skip, end)).drop(PLACE, GROUP, NUMBER)


def _by_ranges(df: DataFrame, keys: list[tuple[str, bool]], skip: int, end: int | None) -> DataFrame:
    """Counted in ranges of the order; only rows of a range in which the page begins or ends are numbered.

    The rows are read more than once and must be the same each time.  What the ranges' bounds are, rows
    of the least hashes, decides how even they are, not which rows the page has.
    """
    order, by = order_columns(keys), [*keys, (RID, False)]
    names = [f"k{i}" for i in range(len(by))]
    least = df.select(*[quoted(k).alias(n) for n, (k, _) in zip(names, by, strict=True)])
    least = least.orderBy(F.xxhash64(*names), *names).limit(16 * RANGES)
    row = [F.col(n).desc_nulls_last() if falling else F.col(n).asc_nulls_first() for n, (_, falling) in zip(names, by, strict=True)]
    every = Window.partitionBy(F.lit(0))
    least = least.select(F.struct(*names).alias("key"), F.row_number().over(every.orderBy(*row)).alias("n"), F.count(F.lit(1)).over(every).alias("of"))
    bounds = least.agg(*[F.max(F.when(F.col("n") == F.ceil(F.col("of") * i / RANGES), F.col("key"))).alias(f"{HIDDEN}bound_{i}") for i in range(1, RANGES)])

    def reached(i: int) -> Column:
        """Whether a row is not before a bound."""
        bound, out = F.col(f"{HIDDEN}bound_{i}"), F.lit(True)
        for n, (k, falling) in reversed(list(zip(names, by, strict=True))):
            a, b = quoted(k), bound[n]
            after = (b.isNotNull() & (a.isNull() | (a < b))) if falling else (a.isNotNull() & (b.isNull() | (a > b)))
            out = after | (a.eqNullSafe(b) & out)
        return bound.isNotNull() & out

    def bounds_reached(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        i = (low + high + 1) // 2
        return F.when(reached(i), bounds_reached(i, high)).otherwise(bounds_reached(low, i - 1))

    ranged = df.crossJoin(F.broadcast(bounds)).select(*df.columns, bounds_reached(0, RANGES - 1).alias(GROUP))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = ranged.groupBy(F.col(GROUP).alias("of")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n")
    first, last = F.col("start") + 1, F.col("start") + F.col("n")
    parts = counts.select(F.col("of").alias(NUMBER), F.col("start").alias(PLACE), (_within(first, skip, end) & _within(last, skip, end)).alias(WHOLE), first.alias("first"), last.alias("last"))
    parts = parts.where((F.col("last") > skip) if end is None else (F.col("last") > skip) & (F.col("first") <= end)).drop("first", "last")
    found = ranged.join(F.broadcast(parts), F.col(GROUP) == F.col(NUMBER)).drop(NUMBER)
    number = F.row_number().over(Window.partitionBy(GROUP).orderBy(*order))
    cut = found.where(~F.col(WHOLE)).withColumn(NUMBER, F.col(PLACE) + number).where(_within(F.col(NUMBER), skip, end))
    return found.where(WHOLE).select(*df.columns).union(cut.select(*df.columns))


def repeatable(df: DataFrame) -> bool:
    """Whether each reading of a frame gives the same rows: not with places in a scan, or sums of floating numbers."""
    plan = df._jdf.queryExecution().withCachedData()
    return plan.deterministic() and _repeatable(plan)


def _repeatable(plan: JavaObject) -> bool:
    kind = plan.getClass().getSimpleName()
    if kind == "Aggregate" and re.search("float|double", plan.schema().simpleString()) or kind not in REPEATABLE:
        return False
    children = plan.children()
    return all(_repeatable(children.apply(i)) for i in range(children.size()))


def distinct(df: DataFrame) -> DataFrame:
    """Each row once, at the place of its first occurrence; nulls are equal."""
    columns = list(known(df))
    return df.groupBy(*map(quoted, columns)).agg(F.min(RID).alias(RID)).select(*map(quoted, columns), RID)


def python_calls(df: DataFrame) -> int:
    """Steps of the plan that send rows to Python functions."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("EvalPython")
