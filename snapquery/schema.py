"""Record declarations, and how incoming columns are fitted to them."""

from __future__ import annotations

import dataclasses
import types as pytypes
import typing
import warnings
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapquery import types
from snapquery.errors import SchemaError

META = "snapquery"


def field(name: str | None = None, **options: Any) -> Any:
    """A member whose column has a name of its own."""
    return dataclasses.field(metadata={META: name}, **options)


@dataclass(frozen=True)
class ColumnSpec:
    member: str
    name: str
    type: types.LogicalType
    nullable: bool

    def struct_field(self) -> T.StructField:
        return T.StructField(self.name, self.type.spark, True, {META: {"member": self.member, "type": self.type.name, "nullable": self.nullable}})

    def default(self) -> Column:
        value = None if self.nullable else self.type.default
        if self.type is types.Timestamp and value is not None:
            return F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
        if self.type is types.Date and value is not None:
            return F.lit("0001-01-01").cast("date")
        return F.lit(value).cast(self.type.spark)


@dataclass(frozen=True)
class RecordSchema:
    columns: tuple[ColumnSpec, ...]

    @staticmethod
    def of(record: Any) -> RecordSchema:
        """From a dataclass, or from (name, type) pairs; ``T | None`` makes a column nullable."""
        if isinstance(record, RecordSchema):
            return record
        if dataclasses.is_dataclass(record):
            hints = typing.get_type_hints(record, vars(types) | {"LogicalType": types.LogicalType})
            specs = []
            for f in dataclasses.fields(record):
                kind, nullable = _optional(hints[f.name])
                if META in f.metadata and f.metadata[META] is None:
                    warnings.warn(f"{f.name} has no column name of its own; the member's is used", stacklevel=3)
                specs.append(ColumnSpec(f.name, f.metadata.get(META) or f.name, types.logical(kind), nullable))
        else:
            specs = [ColumnSpec(n, n, types.logical(_optional(k)[0]), _optional(k)[1]) for n, k in record]
        if not specs:
            raise SchemaError("a record needs one column at least")
        names = [c.name for c in specs]
        if twice := {n for n in names if names.count(n) > 1}:
            raise SchemaError(f"columns declared twice: {', '.join(sorted(twice))}")
        return RecordSchema(tuple(specs))

    @staticmethod
    def of_frame(df: DataFrame) -> RecordSchema:
        specs = []
        for f in df.schema.fields:
            meta = f.metadata.get(META) or {}
            kind = types.ALL[meta["type"]] if "type" in meta else types.of_spark(f.dataType)
            specs.append(ColumnSpec(meta.get("member", f.name), f.name, kind, meta.get("nullable", f.nullable)))
        return RecordSchema(tuple(specs))

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def struct(self) -> T.StructType:
        return T.StructType([c.struct_field() for c in self.columns])


def _optional(kind: Any) -> tuple[Any, bool]:
    if isinstance(kind, types.NullableType):
        return kind.of, True
    if isinstance(kind, (pytypes.UnionType, typing._UnionGenericAlias)):
        inner = [a for a in typing.get_args(kind) if a is not type(None)]
        if len(inner) != 1:
            raise SchemaError(f"{kind!r} is no column type")
        return inner[0], True
    return kind, isinstance(kind, types.LogicalType) and kind in (types.String, types.Binary)


@dataclass(frozen=True)
class ReadOptions:
    """What to do with columns that only one side has: ``unknown`` is ignore or throw, ``missing`` is default or throw."""

    unknown: str = "ignore"
    missing: str = "default"

    def __post_init__(self) -> None:
        if self.unknown not in ("ignore", "throw") or self.missing not in ("default", "throw"):
            raise ValueError("unknown: ignore or throw; missing: default or throw")


def check_columns(have: Iterable[str], schema: RecordSchema, options: ReadOptions) -> None:
    have = list(have)
    unknown = [c for c in have if c not in schema.names]
    missing = [c for c in schema.names if c not in have]
    if unknown and options.unknown == "throw":
        raise SchemaError(f"unknown columns: {', '.join(unknown)}")
    if missing and options.missing == "throw":
        raise SchemaError(f"missing columns: {', '.join(missing)}")


def fit(df: DataFrame, schema: RecordSchema, options: ReadOptions = ReadOptions(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns by name, in declared order and type; missing ones get the type's default."""
    check_columns([c for c in df.columns if c not in keep], schema, options)
    columns = []
    for c in schema.columns:
        value = F.col(f"`{c.name}`").cast(c.type.spark) if c.name in df.columns else c.default()
        columns.append(value.alias(c.name, metadata=c.struct_field().metadata))
    return df.select(*columns, *keep)
