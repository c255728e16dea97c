"""Routing, selection and higher-order operators.

A routed stream stays one DataFrame with a column that names the output, so
that a source is scanned once however many outputs are read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import free
from .streams import Order


def if_(s: DataFrame, condition: Column, name: str = "route") -> DataFrame:
    """Each tick to `true` or `false`; ticks without a condition go nowhere."""
    return s.withColumn(name, F.when(condition, "true").when(~condition, "false")).where(F.col(name).isNotNull())


def route_by_index(s: DataFrame, index: Column, outputs: int, name: str = "route") -> DataFrame:
    """Each tick to one of `outputs`; an index out of range goes nowhere."""
    return s.withColumn(name, index).where((F.col(name) >= 0) & (F.col(name) < outputs))


def if_true(s: DataFrame, condition: Column) -> DataFrame:
    return s.where(condition)


def if_cmp(cmp: Column, lt: Column, eq: Column, gt: Column) -> Column:
    return F.when(cmp == "LT", lt).when(cmp == "EQ", eq).when(cmp == "GT", gt)


def all_(*flags: Column) -> Column:
    out = F.lit(True)
    for f in flags:
        out = out & f
    return out


def any_(*flags: Column) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def switch_(s: DataFrame, key: str, branches: Mapping[object, Callable[[DataFrame], DataFrame]], default: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of each key through its branch.  The branches must give the same columns.
    Each one filters the same scan; the filter reaches the source."""
    parts = [f(s.where(F.col(key) == F.lit(k))) for k, f in branches.items()]
    if default:
        parts.append(default(s.where(~F.col(key).isin(*branches) | F.col(key).isNull())))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def map_(d: DataFrame, order: Order, child: Callable[..., DataFrame], keys: Sequence[str], *inputs: Callable[[], DataFrame]) -> DataFrame:
    """`child` for each live key: its windows run within the keys as well.  The
    inputs (see `pass_through`) do not take part in the keys: each key gets them whole."""
    return child(d, Order(keys=(*keys, *order.keys), by=order.by), *[i() for i in inputs])


def emit(s: DataFrame, values: str, name: str = "value", position: str = "position") -> DataFrame:
    """One tick for each element of an array, in its order."""
    return s.select("*", F.posexplode(values).alias(position, name)).drop(values)


def collect(s: DataFrame, order: Order, value: str, n: int, name: str = "values") -> DataFrame:
    """The last `n` values as an array, oldest first; the first n - 1 ticks give shorter ones."""
    if n < 1:
        raise ValueError("a window has at least one tick")
    w = Window.partitionBy(*order.keys).orderBy(*order.by).rowsBetween(1 - n, 0)
    return s.withColumn(name, F.collect_list(value).over(w))


def valid(s: DataFrame, order: Order, value: str, name: str = "valid") -> DataFrame:
    """The ticks at which a value becomes usable (not null) or stops to be."""
    w = Window.partitionBy(*order.keys).orderBy(*order.by)
    now = F.col(value).isNotNull()
    (was,) = free(s, other=[name])
    return s.withColumn(name, now).withColumn(was, F.coalesce(F.lag(now).over(w), F.lit(False))).where(F.col(name) != F.col(was)).drop(was)


def compare(a: DataFrame, b: DataFrame, on: Sequence[str], value: str, name: str = "equal") -> DataFrame:
    """Per tick, whether both streams have the same value; a tick of one alone is unequal."""
    x, y = free(a, b, count=2)
    left = a.select(*on, F.struct(F.col(value)).alias(x))
    right = b.select(*on, F.struct(F.col(value)).alias(y))
    return left.join(right, list(on), "full").select(*on, F.col(x).eqNullSafe(F.col(y)).alias(name))


def pass_through(frame: DataFrame) -> Callable[[], DataFrame]:
    """An input of `map_` that every key gets whole."""
    return lambda: frame


no_key = pass_through
