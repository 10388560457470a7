"""Grouped and global aggregation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapquery.errors import ColumnNotFound
from snapquery.functions.aggregates import Aggregate
from snapquery.operators.rows import RID, known, quoted


def grouped(df: DataFrame, keys: Mapping[str, str], aggregates: Mapping[str, Aggregate], keep_null_keys: bool = False) -> DataFrame:
    """One row for each value of the keys (output name to column name), in the order of first occurrence.

    Rows with a null key are no group, unless asked for.  One partial and one final aggregation; the
    ordinal's minimum is only computed if the order is used.
    """
    have = known(df)
    for k in keys.values():
        if k not in have:
            raise ColumnNotFound(f"no column {k!r}; there are {', '.join(have)}")
    rows = df if keep_null_keys else df.dropna(subset=[f"`{k}`" for k in keys.values()])
    out = rows.groupBy(*[quoted(k).alias(name) for name, k in keys.items()])
    return out.agg(*[a.column(have, grouped=True).alias(n) for n, a in aggregates.items()], F.min(RID).alias(RID))


def totals(df: DataFrame, aggregates: Mapping[str, Aggregate]) -> DataFrame:
    """All aggregates over all rows, in one pass."""
    have = known(df)
    return df.agg(*[a.column(have).alias(n) for n, a in aggregates.items()])
