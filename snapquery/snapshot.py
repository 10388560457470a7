"""The snapshot: an immutable table with declared columns and an order of its rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from snapquery.errors import ClosedSnapshotError
from snapquery.operators import rows, statistics
from snapquery.operators.rows import known, quoted
from snapquery.plans.cache import CacheStatistics, PlanCache, Tracker
from snapquery.query import Query
from snapquery.schema import ReadOptions, RecordSchema
from snapquery.sources import ipc
from snapquery.sources import rows as sources

_SERIAL = count()


class Snapshot:
    """Made once, never changed; queries on it are lazy.  ``persist`` keeps its columns in memory, spilling to disk."""

    def __init__(self, df: DataFrame, schema: RecordSchema | None = None, persist: bool = False, in_place: bool = False) -> None:
        self.serial = next(_SERIAL)
        self.spark = df.sparkSession
        self._df = df.persist() if persist else df
        self.schema = schema or RecordSchema.of_frame(rows.shown(df))
        self.plans, self.tracker = PlanCache(), Tracker()
        self.in_place = in_place  # the scan gives rows in their order
        self._persisted, self._closed = persist, False
        self._statistics: statistics.BuildStatistics | None = None

    # sources

    @staticmethod
    def from_rows(spark: SparkSession, items: Iterable[Any], record: Any, persist: bool = False) -> Snapshot:
        return Snapshot(sources.from_rows(spark, items, record), RecordSchema.of(record), persist, True)

    @staticmethod
    def from_df(df: DataFrame, order_by: list[str] | None = None, persist: bool = False, copy_to: str | None = None) -> Snapshot:
        """``copy_to``: a folder for a copy of the rows, which a later change of their source leaves alone."""
        df = df if copy_to is None else sources.copied(df, copy_to)
        return Snapshot(sources.with_ordinal(df, order_by), persist=persist, in_place=not order_by)

    @staticmethod
    def from_parquet(spark: SparkSession, path: str, order_by: list[str] | None = None, record: Any = None, options: ReadOptions = ReadOptions(), persist: bool = False, copy_to: str | None = None) -> Snapshot:
        return Snapshot.from_df(sources.from_parquet(spark, path, record, options), order_by, persist, copy_to)

    @staticmethod
    def from_ipc(spark: SparkSession, source: Any, record: Any = None, options: ReadOptions = ReadOptions(), order_by: list[str] | None = None, persist: bool = False, copy_to: str | None = None) -> Snapshot:
        """From a path (a file or a folder of streams), bytes, buffers or an open stream; the codec is told by the data."""
        df = ipc.read(spark, source, record, options) if isinstance(source, str) else ipc.from_bytes(spark, source, record, options)
        return Snapshot.from_df(df, order_by, persist, copy_to)

    # sinks

    def to_ipc_bytes(self, codec: str | None = None) -> bytes:
        return ipc.to_bytes(self.df(), codec)

    def write_ipc(self, path: str, codec: str | None = None, mode: str = "error") -> None:
        """A folder of streams, written by as many tasks as the snapshot has partitions; streams that are there: error, overwrite or append."""
        self.check_open()
        ipc.write(rows.shown(self._df), path, codec, mode)

    def write_parquet(self, path: str, sort_by: list[str] | None = None) -> None:
        """Sorted within ranges, row groups have narrow bounds, by which scans skip them."""
        df = self.df(ordered=False)
        keys = [quoted(k) for k in sort_by or []]
        (df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df).write.parquet(path)

    # use

    def check_open(self) -> None:
        if self._closed:
            raise ClosedSnapshotError("the snapshot is closed")

    def query(self) -> Query:
        self.check_open()
        return Query(self, lambda: self._df)

    def df(self, ordered: bool = True) -> DataFrame:
        return self.query().to_df(ordered)

    def sql(self, text: str, parity: bool = False) -> DataFrame:
        from snapquery import sql

        self.check_open()
        return sql.run(self, text, parity)

    def sql_rows(self, text: str, as_: type | None = None) -> list[Any]:
        found = self.sql(text).collect()
        return found if as_ is None else [as_(**r.asDict()) for r in found]

    def sql_scalar(self, text: str) -> Any:
        row = self.sql(text).first()
        return None if row is None else row[0]

    def __len__(self) -> int:
        return self.query().count()

    def __iter__(self) -> Iterator[Row]:
        self.check_open()
        return iter(self.query())

    def statistics(self, approximate: bool = False) -> statistics.BuildStatistics:
        """Of every column; computed once."""
        self.check_open()
        if self._statistics is None:
            sizes = {c.name: c.type.size for c in self.schema.columns}
            runs = {r["column"]: r.runs for r in statistics.runs(self._df).collect()}
            found = [statistics.ColumnStatistics(r["column"], sizes[r["column"]], r.total, r.nulls, r.distinct, runs[r["column"]]) for r in statistics.profile(self._df, approximate).collect()]
            self._statistics = statistics.BuildStatistics(tuple(found))
        return self._statistics

    def profile_df(self, approximate: bool = False) -> DataFrame:
        return statistics.profile(self._df, approximate)

    def runs_df(self) -> DataFrame:
        return statistics.runs(self._df)

    @property
    def columns(self) -> list[str]:
        return list(known(self._df))

    @property
    def cached_plans(self) -> int:
        return self.plans.statistics().entries

    def plan_cache_statistics(self) -> CacheStatistics:
        return self.plans.statistics()

    def clear_plan_cache(self) -> None:
        self.plans.clear()

    def close(self) -> None:
        """Free what is persisted; closing twice does nothing."""
        if not self._closed and self._persisted:
            self._df.unpersist()
        self._closed = True
        self.plans.clear()

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()


