"""Column types: logical names, their Spark and Arrow forms, defaults and sizes."""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T

from snapquery.errors import SchemaError


@dataclass(frozen=True)
class LogicalType:
    """A column type; Spark lacks unsigned and half types, which are widened and remembered by name."""

    name: str
    spark: T.DataType
    arrow: pa.DataType | None  # None: as Spark has it
    default: Any
    size: int

    def __or__(self, other: None) -> NullableType:
        return NullableType(self)


@dataclass(frozen=True)
class NullableType:
    """``Int32 | None``."""

    of: LogicalType


_EPOCH = dt.datetime(1, 1, 1)
Int8 = LogicalType("int8", T.ByteType(), pa.int8(), 0, 1)
Int16 = LogicalType("int16", T.ShortType(), pa.int16(), 0, 2)
Int32 = LogicalType("int32", T.IntegerType(), pa.int32(), 0, 4)
Int64 = LogicalType("int64", T.LongType(), pa.int64(), 0, 8)
UInt8 = LogicalType("uint8", T.ShortType(), pa.uint8(), 0, 1)
UInt16 = LogicalType("uint16", T.IntegerType(), pa.uint16(), 0, 2)
UInt32 = LogicalType("uint32", T.LongType(), pa.uint32(), 0, 4)
UInt64 = LogicalType("uint64", T.DecimalType(20, 0), pa.uint64(), decimal.Decimal(0), 8)
Half = LogicalType("half", T.FloatType(), pa.float16(), 0.0, 2)
Float = LogicalType("float", T.FloatType(), pa.float32(), 0.0, 4)
Double = LogicalType("double", T.DoubleType(), pa.float64(), 0.0, 8)
Bool = LogicalType("bool", T.BooleanType(), pa.bool_(), False, 1)
Decimal = LogicalType("decimal", T.DecimalType(29, 6), pa.decimal128(29, 6), decimal.Decimal(0), 16)
String = LogicalType("string", T.StringType(), pa.string(), None, 8)
Binary = LogicalType("binary", T.BinaryType(), pa.binary(), None, 8)
Date = LogicalType("date", T.DateType(), pa.date32(), dt.date(1, 1, 1), 4)
Timestamp = LogicalType("timestamp", T.TimestampNTZType(), pa.timestamp("ms", tz="UTC"), _EPOCH, 8)

ALL = {t.name: t for t in (Int8, Int16, Int32, Int64, UInt8, UInt16, UInt32, UInt64, Half, Float, Double, Bool, Decimal, String, Binary, Date, Timestamp)}
PYTHON = {bool: Bool, int: Int64, float: Double, str: String, bytes: Binary, dt.datetime: Timestamp, dt.date: Date, decimal.Decimal: Decimal}


def logical(kind: Any) -> LogicalType:
    """The logical type of an annotation: one of the names above, its text, or a plain Python type."""
    if isinstance(kind, LogicalType):
        return kind
    if isinstance(kind, str) and kind in ALL:
        return ALL[kind]
    if isinstance(kind, type) and kind in PYTHON:
        return PYTHON[kind]
    raise SchemaError(f"{kind!r} is no column type; there are {', '.join(ALL)}")


def of_spark(kind: T.DataType) -> LogicalType:
    """The logical type that a Spark column has, where it wasn't declared; types without one here are carried as they are."""
    if isinstance(kind, T.DecimalType):
        return Decimal
    if isinstance(kind, T.TimestampType):
        return Timestamp
    for t in (Int8, Int16, Int32, Int64, Float, Double, Bool, String, Binary, Date, Timestamp):
        if type(t.spark) is type(kind):
            return t
    return LogicalType(kind.simpleString(), kind, None, None, 8)
