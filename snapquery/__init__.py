"""Immutable, typed, single-table snapshots on Spark, with fluent and SQL queries."""

from snapquery.functions.aggregates import Aggregate, average, count, long_count, max_, min_, sum_
from snapquery.functions.predicates import all_of, any_of, c, not_
from snapquery.query import Query
from snapquery.schema import ReadOptions, RecordSchema, field
from snapquery.snapshot import Snapshot

__all__ = ["Aggregate", "Query", "ReadOptions", "RecordSchema", "Snapshot", "all_of", "any_of", "average", "c", "count", "field", "long_count", "max_", "min_", "not_", "sum_"]
