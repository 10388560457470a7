"""Arrow IPC streams: as bytes, as one file, and as a folder written and read by many tasks.

Each task of a distributed write makes one stream; a distributed read has one task for each file and
one batch at a time in memory.  Unsigned and half columns are written in the types they were declared
with and widened when read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from snapquery import types
from snapquery.schema import META, ReadOptions, RecordSchema, fit

FORMAT = "snapquery_ipc"
CODECS = (None, "lz4", "zstd")


def _options(codec: str | None) -> pa.ipc.IpcWriteOptions:
    if codec not in CODECS:
        raise ValueError("codec: None, lz4 or zstd")
    return pa.ipc.IpcWriteOptions(compression=codec)


def declared(schema: T.StructType) -> pa.Schema:
    """Arrow fields as declared; what wasn't declared as Spark has it."""
    plain = to_arrow_schema(schema)
    fields = []
    for f, p in zip(schema.fields, plain, strict=True):
        meta = f.metadata.get(META) or {}
        fields.append(pa.field(f.name, types.ALL[meta["type"]].arrow if meta.get("type") in types.ALL else p.type, nullable=meta.get("nullable", f.nullable) or True))
    return pa.schema(fields)


def narrowed(batch: Any, schema: pa.Schema) -> Any:
    """A table or batch in the declared types."""
    columns = []
    for c, f in zip(batch.columns, schema, strict=True):
        if pa.types.is_timestamp(f.type) and pa.types.is_timestamp(c.type):
            c = c.cast(pa.timestamp("us")).cast(pa.timestamp("us", tz=f.type.tz)) if c.type.tz is None and f.type.tz else c
            c = c.cast(f.type, safe=False)
        elif pa.types.is_float16(f.type):
            c = c.cast(pa.float32()).cast(pa.float16())
        columns.append(c if c.type == f.type else c.cast(f.type))
    return type(batch).from_arrays(columns, schema=schema)


def widened(table: Any) -> Any:
    """A table or batch in types that Spark takes."""
    columns = []
    for c in table.columns:
        t = c.type
        if pa.types.is_dictionary(t):
            c = c.dictionary_decode() if isinstance(c, pa.Array) else c.cast(t.value_type)
            t = c.type
        to = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32(), pa.large_string(): pa.string()}.get(t)
        if pa.types.is_timestamp(t):
            c = pc.local_timestamp(c) if t.tz else c
            to = pa.timestamp("us")
        columns.append(c.cast(to) if to is not None else c)
    return type(table).from_arrays(columns, names=table.schema.names)


def to_bytes(df: DataFrame, codec: str | None = None) -> bytes:
    """One stream, gathered on the driver."""
    sink = pa.BufferOutputStream()
    schema = declared(df.schema)
    with pa.ipc.new_stream(sink, schema, options=_options(codec)) as writer:
        writer.write_table(narrowed(df.toArrow(), schema))
    return sink.getvalue().to_pybytes()


def from_bytes(spark: SparkSession, data: Any, record: Any = None, options: ReadOptions = ReadOptions()) -> DataFrame:
    """All batches of a stream of bytes, of a sequence of buffers, or of an open file."""
    if isinstance(data, (list, tuple)):
        data = b"".join(bytes(d) for d in data)
    with pa.ipc.open_stream(data) as reader:
        table = widened(reader.read_all())
    return _framed(spark, table, record, options)


def _framed(spark: SparkSession, table: pa.Table, record: Any, options: ReadOptions) -> DataFrame:
    from pyspark.sql.pandas.types import from_arrow_schema

    df = spark.createDataFrame(table, schema=from_arrow_schema(table.schema, prefer_timestamp_ntz=True))
    return df if record is None else fit(df, RecordSchema.of(record), options)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _files(path: str) -> tuple[fs.FileSystem, list[str]]:
    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return system, [root]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return system, sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def _present(path: str) -> list[str]:
    """Streams at a path that may not exist."""
    try:
        return _files(path)[1]
    except FileNotFoundError:
        return []


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.path)[1]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = _files(self.path)
        want = to_arrow_schema(self.schema)
        with system.open_input_stream(partition.path) as f, pa.ipc.open_stream(f) as reader:
            for batch in reader:
                wide = widened(batch)
                yield pa.RecordBatch.from_arrays([wide.column(n).cast(t) for n, t in zip(want.names, want.types, strict=True)], schema=want)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, codec: str | None, overwrite: bool = False) -> None:
        self.path, self.schema, self.codec, self.run = path, schema, codec, uuid.uuid4().hex
        self.replaced = _present(path) if overwrite else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """A stream under a hidden name, which commit gives its own: a task that runs twice leaves one file."""
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f".part-{context.partitionId():05d}-{self.run}-{context.attemptNumber()}.arrows"
        schema = declared(self.schema)
        with system.open_output_stream(f"{root}/{name}") as sink, pa.ipc.new_stream(sink, schema, options=_options(self.codec)) as writer:
            for batch in iterator:
                writer.write_batch(narrowed(batch, schema))
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        for m in messages:
            if m is not None:
                system.move(f"{root}/{m.name}", f"{root}/{m.name[1:]}")
        for old in self.replaced:  # once what is new stands
            system.delete_file(old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{root}/{m.name}")


class _Written(WriterCommitMessage):
    def __init__(self, name: str) -> None:
        self.name = name


class IpcSource(DataSource):
    """Spark data source of folders of Arrow IPC streams: ``spark.read.format("snapquery_ipc").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        system, files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no stream in {self.options['path']}")
        with system.open_input_stream(files[0]) as f, pa.ipc.open_stream(f) as reader:
            return from_arrow_schema(widened(reader.schema.empty_table()).schema, prefer_timestamp_ntz=True)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, self.options.get("codec") or None, overwrite)


def write(df: DataFrame, path: str, codec: str | None = None, mode: str = "error") -> None:
    """A folder of streams, one for each partition; ``mode``: what to do with streams that are there already."""
    _options(codec)
    if mode not in ("error", "overwrite", "append"):
        raise ValueError("mode: error, overwrite or append")
    if mode == "error" and _present(path):
        raise FileExistsError(f"{path} holds streams; overwrite or append them by name")
    df.sparkSession.dataSource.register(IpcSource)
    df.write.format(FORMAT).option("codec", codec or "").mode("overwrite" if mode == "overwrite" else "append").save(path)


def read(spark: SparkSession, path: str, record: Any = None, options: ReadOptions = ReadOptions()) -> DataFrame:
    """All streams of a folder, or one file."""
    spark.dataSource.register(IpcSource)
    df = spark.read.format(FORMAT).load(path)
    return df if record is None else fit(df, RecordSchema.of(record), options)
