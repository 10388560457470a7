"""The steps of a query on an unbounded frame.

A snapshot is frozen, but its filters, projections and groupings mean the same on rows that keep
arriving; order, pages and joins to other snapshots don't carry over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapquery.errors import UnsupportedOperation
from snapquery.operators.rows import known, quoted
from snapquery.query import Query


def replay(query: Query, stream: DataFrame, event_time: str | None = None, lateness: str = "10 minutes", window: str | None = None) -> DataFrame:
    """``query``'s steps on ``stream``; groups may be cut into windows of ``event_time``, which late rows miss after ``lateness``."""
    df = stream.withWatermark(event_time, lateness) if event_time else stream
    for step in query.steps.items:
        if step.kind == "where":
            df = df.where(step.details.column(known(df)))
        elif step.kind == "select":
            df = df.select(*[(quoted(c) if isinstance(c, str) else c).alias(n) for n, c in step.details.items()])
        elif step.kind == "group":
            keys, aggregates = step.details
            have = known(df)
            by = [quoted(k).alias(n) for n, k in keys.items()] + ([F.window(event_time, window)] if window and event_time else [])
            df = df.dropna(subset=list(keys.values())).groupBy(*by).agg(*[a.column(have, grouped=True).alias(n) for n, a in aggregates.items()])
        else:
            raise UnsupportedOperation(f"{step.kind} has no meaning on a stream")
    return df
