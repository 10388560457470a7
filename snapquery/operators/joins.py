"""Equi-joins; null keys never match.  Catalyst and adaptive execution choose the strategy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapquery.functions.aggregates import Aggregate
from snapquery.operators.rows import HIDDEN, RID, known, quoted

HOW = ("inner", "left", "right", "full", "left_semi", "left_anti")


def check(how: str) -> None:
    if how not in HOW:
        raise ValueError(f"how: one of {', '.join(HOW)}")


def joined(left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Pairs with equal keys (left name to right name), in the order of the left rows and then the right.

    Columns of the right side whose names are taken get ``suffix``.
    """
    check(how)
    taken = set(known(left))
    names = {c: c + suffix if c in taken else c for c in known(right)}
    other = right.select(*[quoted(c).alias(f"{HIDDEN}right_{c}") for c in names], F.col(RID).alias(f"{HIDDEN}right"))
    condition = [quoted(a) == quoted(f"{HIDDEN}right_{b}") for a, b in on.items()]
    out = left.join(other, condition, how)
    if how in ("left_semi", "left_anti"):
        return out.select(*map(quoted, known(left)), RID)
    rid = F.struct(F.col(RID).alias("a"), F.col(f"{HIDDEN}right").alias("b")).alias(RID)
    return out.select(*map(quoted, known(left)), *[quoted(f"{HIDDEN}right_{c}").alias(n) for c, n in names.items()], rid)


def group_joined(left: DataFrame, right: DataFrame, on: Mapping[str, str], aggregates: Mapping[str, Aggregate]) -> DataFrame:
    """Every left row with aggregates of its right rows; counts and sums of none are zero.

    The right side is aggregated before the join, so that no pair is made.
    """
    have = known(right)
    inner = right.groupBy(*[quoted(b).alias(f"{HIDDEN}key_{a}") for a, b in on.items()]).agg(
        *[a.column(have, grouped=True).alias(n) for n, a in aggregates.items()]
    )
    out = left.join(inner, [quoted(a) == quoted(f"{HIDDEN}key_{a}") for a in on], "left")
    kinds = {f.name: f.dataType for f in inner.schema.fields}
    filled = [
        F.coalesce(quoted(n), F.lit(0).cast(kinds[n])).alias(n) if a.op in ("count", "long_count", "sum") and isinstance(kinds[n], T.NumericType) else quoted(n)
        for n, a in aggregates.items()
    ]
    return out.select(*map(quoted, known(left)), *filled, RID)
