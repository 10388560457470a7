"""Helpers shared by the operators: durable intermediate tables, distributed ranks, components, Arrow glue."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

T_ = TypeVar("T_")

#: What the running worker process keeps from task to task: of one operator at a time, as workers serve all in turn.
_KEPT: dict[object, object] = {}
#: Open scopes, each with the folders that were stored in it.
_SCOPES: list[list[str]] = []
#: Folder used where the session names none, which only a single-machine session may do.
_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a temporary folder; a cluster is refused, since its
    executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="snapquery-")
    return _OWN[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most the tasks that it ran, never the table.
    It also makes every later read see the same rows in the same files.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/snapquery/{name}-{uuid.uuid4().hex}"
    for of_scope in _SCOPES:
        of_scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables stored inside the block are removed at its end; write results elsewhere before.

    The list has the tables' folders in order; what is taken out of it stays.
    """
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES[:] = [s for s in _SCOPES if s is not paths]
        remove(spark, paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders, wherever Spark finds them."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``max_bytes`` at most (one row at least)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and held + n > max_bytes:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null gives none."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def numbered(df: DataFrame, group: str) -> DataFrame:
    """Add ``rank``: a gapless number from 0 within each value of the integer column ``group``.

    No group is gathered anywhere.  Each task counts its own rows of a group; the counts of the
    tasks (one row for each task and group) give the offsets at which the tasks' own numbers start.
    The numbered rows are stored once in between, so that both reads see the same tasks.
    """
    columns = df.columns
    schema = T.StructType(list(df.schema.fields)).add("_task", T.IntegerType()).add("_nth", T.LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget_kept()
        task, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            g = np.asarray(b.column(group))
            order = np.argsort(g, kind="stable")
            values, first, counts = np.unique(g[order], return_index=True, return_counts=True)
            nth = np.empty(len(g), np.int64)
            for v, at, n in zip(values.tolist(), first.tolist(), counts.tolist(), strict=True):
                before = seen.get(v, 0)
                nth[order[at : at + n]] = np.arange(before, before + n)
                seen[v] = before + n
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(g), task, np.int32)), pa.array(nth)], names=[*columns, "_task", "_nth"]
            )

    rows = stored(df.mapInArrow(tidied(count), schema), "numbered")
    counts = rows.groupBy(group, "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(offsets, [group, "_task"]).select(*columns, (F.col("_offset") + F.col("_nth")).alias("rank"))


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of each node of the undirected ``edges`` (a, b), as (node, label).

    Labels fall to the smallest label among the neighbours, then each label is replaced by its own
    label (pointer jumping), until a round changes none.  Every round's labels are stored.
    """
    with scratch(edges.sparkSession) as folders:
        both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
        labels = stored(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels"
        )
        while True:
            best = (
                both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near"))
            )
            moved = labels.join(best, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
            roots = labels.select(F.col("node").alias("to"), F.col("label").alias("jump"))
            following = stored(
                moved.join(roots, "to", "left").select("node", "old", F.least("to", "jump").alias("label")), "labels"
            )
            labels = following.select("node", "label")
            if following.where("label < old").isEmpty():
                folders.pop()  # the result
                return labels


def whole_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """Each row as one struct ``row`` beside the given columns, so that no name of the input is in the way; ``row.*`` brings it back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def kept_by_worker(key: object, make: Callable[[], T_]) -> T_:
    """The worker's state under ``key``, made at need; what another operator has kept there is dropped."""
    if key not in _KEPT:
        forget_kept()
        _KEPT[key] = make()
    return _KEPT[key]


def forget_kept() -> None:
    """At the start of a task of an operator that keeps nothing: give back what others have kept in the worker."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    _give_back()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which idles or serves another operator next, gives back the memory that it has freed."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return tidy


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # of glibc
        trim(0)
