"""Conversions between shapes, JSON text, and constructors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import str_

TAG = "_type"


def cast_(c: Column, to: str) -> Column:
    return c.cast(to)


def convert(c: Column, source: str, to: str) -> Column:
    """From one kind to another.  Kinds: list, set (a list without repeats), map,
    entries (a list of key and value), struct, str, or a Spark type's name."""
    if to == "str":
        return str_(c, source)
    if (source, to) in (("list", "set"), ("set", "set")):
        return F.array_distinct(c)
    if (source, to) in (("set", "list"), ("list", "list")):
        return c
    if to == "map":
        return {"entries": F.map_from_entries, "list": lambda x: F.map_from_arrays(F.sequence(F.lit(0), F.size(x) - 1), x)}[source](c)
    if source == "map":
        return {"entries": F.map_entries, "list": F.map_values, "set": F.map_keys}[to](c)
    if to in ("list", "set"):
        return F.array(c)
    if to == "boolean" and source in ("str", "string"):
        return F.octet_length(c) > 0
    return c.cast(to)


def combine(strict: bool = True, **fields: Column) -> Column:
    """One struct; null if a field is, unless not `strict`."""
    whole = F.struct(*[c.alias(n) for n, c in fields.items()])
    if not strict:
        return whole
    ready = F.lit(True)
    for c in fields.values():
        ready = ready & c.isNotNull()
    return F.when(ready, whole)


combine_cs = combine


def combine_list(*items: Column) -> Column:
    return F.array(*items)


def combine_tss_from_tsl(*items: Column) -> Column:
    """The set of the items that are not null."""
    return F.array_distinct(F.array_compact(F.array(*items)))


def combine_map(keys: Column, values: Column) -> Column:
    """A repeated key takes its last value.  Sorted by key, not compared pair by pair."""
    entries = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x, i: F.struct(x["k"].alias("key"), i.alias("place"), x["v"].alias("value")))
    found = F.array_sort(entries, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(x["place"] - y["place"]))
    last = F.filter(found, lambda x, i: F.coalesce(F.get(found, i + 1)["key"] != x["key"], F.lit(True)))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))


def combine_date(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(year, month, day)


def combine_datetime(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return F.make_timestamp(year, month, day, hour, minute, second)


def downcast_(c: Column, tags: list[str], payload: str = "value") -> Column:
    """The payload of a tagged struct; another tag is an error."""
    return F.when(c[TAG].isin(*tags), c[payload]).otherwise(F.raise_error(F.concat(F.lit("not a "), F.lit(" or ".join(tags)), F.lit(": "), c[TAG])))


def downcast_ref(c: Column, payload: str = "value") -> Column:
    return c[payload]


def type_(df: DataFrame, column: str) -> str:
    """The name of a column's type, which is the same in every row."""
    return df.schema[column].dataType.simpleString()


# Containers.


def getitem_(c: Column, key, kind: str = "list") -> Column:
    """A list's item (from the end if negative), a map's value or a struct's field; null where there is none."""
    if kind == "map":
        return F.try_element_at(c, key if isinstance(key, Column) else F.lit(key))
    if kind == "struct":
        return c[key]
    i = key if isinstance(key, Column) else F.lit(key)
    return F.get(c, F.when(i >= 0, i).otherwise(F.size(c) + i))


def getattr_(c: Column, name: str, otherwise: Column | None = None) -> Column:
    return c[name] if otherwise is None else F.coalesce(c[name], otherwise)


# JSON.


def to_json(c: Column) -> Column:
    """Null fields stay."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def from_json(text: Column, schema: str | T.DataType) -> Column:
    return F.from_json(text, schema)


def json_encode(tree: Column) -> Column:
    return F.to_json(tree)


def json_as_int(tree: Column) -> Column:
    return F.try_variant_get(tree, "$", "bigint")


def json_as_float(tree: Column) -> Column:
    return F.try_variant_get(tree, "$", "double")


def json_as_str(tree: Column) -> Column:
    return F.try_variant_get(tree, "$", "string")


def json_as_bool(tree: Column) -> Column:
    return F.try_variant_get(tree, "$", "boolean")


# Sources of one value and of none.


def const(spark: SparkSession, value, kind: str, start: int, delay: int = 0) -> DataFrame:
    """One tick, `delay` microseconds after the start."""
    return spark.range(1).select(F.lit(start + delay).cast("long").alias("us"), F.lit(value).cast(kind).alias("value"))


def nothing(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
