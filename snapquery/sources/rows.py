"""Frames from rows in memory and from Parquet."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Iterable, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapquery import types
from snapquery.errors import SchemaError
from snapquery.operators.rows import HIDDEN, RID
from snapquery.schema import ReadOptions, RecordSchema, fit


def _value(value: Any, kind: types.LogicalType) -> Any:
    if value is not None and kind is types.Timestamp:
        return value.replace(tzinfo=None, microsecond=value.microsecond // 1000 * 1000)
    return value


def from_rows(spark: SparkSession, rows: Iterable[Any], record: Any) -> DataFrame:
    """Rows (objects, mappings or tuples) copied to a frame whose ordinal is their place; times are cut to milliseconds."""
    schema = RecordSchema.of(record)
    if taken := [n for n in schema.names if n.startswith(HIDDEN)]:
        raise SchemaError(f"names that begin with {HIDDEN} are reserved: {', '.join(taken)}")
    columns: list[list[Any]] = [[] for _ in schema.columns]
    for row in rows:
        for i, c in enumerate(schema.columns):
            if isinstance(row, Mapping):
                value = row.get(c.member, row.get(c.name))
            elif dataclasses.is_dataclass(row):
                value = getattr(row, c.member)
            else:
                value = row[i]
            columns[i].append(_value(value, c.type))
    plain = {types.Timestamp: pa.timestamp("us"), types.UInt8: pa.int16(), types.UInt16: pa.int32(), types.UInt32: pa.int64(), types.UInt64: pa.decimal128(20, 0), types.Half: pa.float32()}
    arrays = [pa.array(v, plain.get(c.type, c.type.arrow)) for c, v in zip(schema.columns, columns, strict=True)]
    table = pa.Table.from_arrays([*arrays, pa.array(range(len(columns[0])), pa.int64())], names=[*schema.names, RID])
    struct = schema.struct().add(RID, "long")
    df = spark.createDataFrame(table, schema=struct)
    return fit(df, schema, keep=(RID,))


def from_parquet(spark: SparkSession, path: str, record: Any = None, options: ReadOptions = ReadOptions()) -> DataFrame:
    """Columns and filters are pushed to the scan by whatever is done with the frame."""
    df = spark.read.parquet(path)
    return df if record is None else fit(df, RecordSchema.of(record), options)


def copied(df: DataFrame, folder: str) -> DataFrame:
    """A copy in a folder of its own below ``folder``, read back."""
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_ordinal(df: DataFrame, order_by: list[str] | None) -> DataFrame:
    """Add the ordinal: the key columns, if the rows have a declared order, else their place in the scan.

    A place in the scan rises with files and rows; it holds as long as the files are split alike, so
    that a snapshot that is paged without a key should be persisted.
    """
    if taken := [c for c in df.columns if c.startswith(HIDDEN)]:
        raise SchemaError(f"names that begin with {HIDDEN} are reserved: {', '.join(taken)}")
    if not order_by:
        return df.withColumn(RID, F.monotonically_increasing_id())
    keys = [F.col(f"`{k}`") for k in order_by]
    return df.withColumn(RID, keys[0] if len(keys) == 1 else F.struct(*keys))
