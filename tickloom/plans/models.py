"""Schemas from Python classes, descriptions of bitemporal tables, and frames that carry metadata."""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import enum
import json
import types
import typing
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PLAIN = {
    bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), dt.datetime: T.TimestampType(),
    dt.date: T.DateType(), dt.timedelta: T.DayTimeIntervalType(), decimal.Decimal: T.DecimalType(38, 18),
}


def type_of(hint) -> tuple[T.DataType, bool]:
    """A Spark type for a Python annotation, and whether it may be null."""
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        some = [a for a in args if a is not type(None)]
        if len(some) != 1:
            raise TypeError(f"{hint} is more than one type")
        return type_of(some[0])[0], len(some) < len(args)
    if origin in (list, set, frozenset, Sequence, tuple):
        if origin is tuple and (len(args) != 2 or args[1] is not Ellipsis):
            return T.StructType([T.StructField(f"_{i + 1}", *type_of(a)) for i, a in enumerate(args)]), False
        kind, null = type_of(args[0])
        return T.ArrayType(kind, null), False
    if origin in (dict, Mapping):
        kind, null = type_of(args[1])
        return T.MapType(type_of(args[0])[0], kind, null), False
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        return T.StringType(), False
    if dataclasses.is_dataclass(hint) or hasattr(hint, "model_fields"):
        return schema_of(hint), False
    if hint in PLAIN:
        return PLAIN[hint], False
    raise TypeError(f"no column type for {hint}")


def schema_of(model: type) -> T.StructType:
    """The schema of a dataclass, or of a model that lists `model_fields`, with nested ones as structs."""
    hints = typing.get_type_hints(model)
    names = [f.name for f in dataclasses.fields(model)] if dataclasses.is_dataclass(model) else list(model.model_fields)
    return T.StructType([T.StructField(n, *type_of(hints[n])) for n in names])


@dataclasses.dataclass(frozen=True)
class TableSchema:
    """The columns of a bitemporal table: event time, time of knowledge, then the keys' columns and the values'."""

    date: str
    as_of: str
    partition_keys: tuple[str, ...]
    removed_keys: tuple[str, ...]
    values: T.StructType

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.date, self.as_of, *self.values.names)

    @property
    def is_multi_row(self) -> bool:
        """Do several rows share an event time?"""
        return bool(self.partition_keys)

    def shape(self) -> T.StructType:
        times = [T.StructField(n, T.TimestampType(), False) for n in (self.date, self.as_of)]
        return T.StructType(times + list(self.values.fields))


def make_table_schema(values: T.StructType, partition_keys: Sequence[str] = (), removed_keys: Sequence[str] = (), date: str = "date", as_of: str = "as_of") -> TableSchema:
    unknown = {*partition_keys, *removed_keys} - set(values.names)
    if unknown or {date, as_of} & set(values.names):
        raise ValueError(f"unknown or repeated columns: {sorted(unknown or {date, as_of} & set(values.names))}")
    return TableSchema(date, as_of, tuple(partition_keys), tuple(removed_keys), values)


def table_schema(table: DataFrame, partition_keys: Sequence[str] = (), removed_keys: Sequence[str] = (), date: str = "date", as_of: str = "as_of") -> TableSchema:
    """The description of a table that `recording.to_table` wrote."""
    rest = T.StructType([f for f in table.schema.fields if f.name not in (date, as_of)])
    return make_table_schema(rest, partition_keys, removed_keys, date, as_of)


# Metadata of a frame: in the metadata of its first column, under one name, so that it is written with Parquet.

NAME = "tickloom.frame"


def with_frame_metadata(df: DataFrame, metadata) -> DataFrame:
    """The frame with a JSON value, or a dataclass's fields, in its schema."""
    value = dataclasses.asdict(metadata) if dataclasses.is_dataclass(metadata) else metadata
    first = df.schema.fields[0]
    return df.withMetadata(first.name, (first.metadata or {}) | {NAME: json.dumps(value)})


def frame_metadata(df: DataFrame, kind: type | None = None):
    """The frame's value, as a dataclass if one is given; None without one."""
    raw = (df.schema.fields[0].metadata or {}).get(NAME) if df.schema.fields else None
    value = None if raw is None else json.loads(raw)
    return kind(**value) if kind and value is not None else value


def has_frame_metadata(df: DataFrame) -> bool:
    return bool(df.schema.fields) and NAME in (df.schema.fields[0].metadata or {})


def without_frame_metadata(df: DataFrame) -> DataFrame:
    """The frame without this value; other metadata of the column stay."""
    if not has_frame_metadata(df):
        return df
    first = df.schema.fields[0]
    return df.withMetadata(first.name, {k: v for k, v in first.metadata.items() if k != NAME})
