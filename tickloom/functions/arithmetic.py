"""Arithmetic, comparison and logic of two or more values.

`kind` is the operands' type where it decides the meaning: a Column does not
know its own type before analysis.  Kinds: int, float, str, bool, list, set,
map, time (bigint microseconds).
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalar import EPSILON


def add_(a: Column, b: Column, kind: str = "int") -> Column:
    return {"str": F.concat, "list": F.concat, "set": F.array_union, "map": lambda x, y: bit_or(x, y, "map")}.get(kind, lambda x, y: x + y)(a, b)


def sub_(a: Column, b: Column, kind: str = "int") -> Column:
    if kind == "map":
        return F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.array_except(a, b) if kind == "set" else F.filter(a, lambda x: ~F.array_contains(b, x)) if kind == "list" else a - b


def mul_(a: Column, b: Column, kind: str = "int") -> Column:
    """A text or list repeats; a count below 1 gives an empty one."""
    if kind == "str":
        return F.repeat(a, b.cast("int"))
    return F.flatten(F.array_repeat(a, F.greatest(b.cast("int"), F.lit(0)))) if kind == "list" else a * b


def pow_(a: Column, b: Column, kind: str = "int") -> Column:
    """Whole numbers stay exact; an overflow or a negative exponent is an error."""
    if kind != "int":
        return F.pow(a, b)
    factors = F.array_repeat(a.cast("long"), F.greatest(b, F.lit(0)).cast("int"))
    return F.when(b < 0, F.raise_error(F.lit("negative exponent")).cast("long")).otherwise(F.aggregate(factors, F.lit(1).cast("long"), lambda acc, x: acc * x))


def neg_(a: Column) -> Column:
    return -a


def pos_(a: Column) -> Column:
    return a


def abs_(a: Column) -> Column:
    return F.abs(a)


def sign(a: Column, kind: str = "int") -> Column:
    return F.signum(a).cast("long" if kind == "int" else "double")


def ln(a: Column) -> Column:
    """Minus infinity at 0, NaN below."""
    x = a.cast("double")
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


@F.pandas_udf(T.DoubleType())
def _rounded(x: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(d) else v if v is None or v != v or v in (float("inf"), float("-inf")) else float(f"{v:.{min(max(int(d), 0), 40)}f}") for v, d in zip(x, n, strict=True)], dtype="float64")


def round_(a: Column, digits: Column | int = 0) -> Column:
    """Half to even on the exact binary value, which Spark's own rounding is not.  Digits from 0 to 40."""
    return _rounded(a.cast("double"), digits if isinstance(digits, Column) else F.lit(digits))


# Of several values, or of the members of one array.


def sum_(*a: Column) -> Column:
    return reduce(lambda x, y: x + y, a)


def mean(*a: Column) -> Column:
    return sum_(*[c.cast("double") for c in a]) / len(a)


def _extreme(f, a: tuple[Column, ...], default: Column | None) -> Column:
    """Null where an operand is null, as no tick comes before all have one; NaN is the largest."""
    ready = reduce(lambda x, y: x & y, [c.isNotNull() for c in a])
    c = F.when(ready, f(*a)) if len(a) > 1 else a[0]
    return c if default is None else F.coalesce(c, default)


def min_(*a: Column, default: Column | None = None) -> Column:
    return _extreme(F.least, a, default)


def max_(*a: Column, default: Column | None = None) -> Column:
    return _extreme(F.greatest, a, default)


def var(*a: Column) -> Column:
    """The sample's variance; 0 for fewer than two values."""
    if len(a) < 2:
        return a[0].cast("double") * 0
    m = mean(*a)
    return sum_(*[(c - m) * (c - m) for c in a]) / (len(a) - 1)


def std(*a: Column) -> Column:
    return F.sqrt(var(*a))


def array_min(a: Column) -> Column:
    return F.array_min(a)


def array_max(a: Column) -> Column:
    return F.array_max(a)


def members_mean(a: Column) -> Column:
    """NaN without members."""
    n = F.cardinality(a)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n)


def members_var(a: Column) -> Column:
    """The sample's variance of an array's members; 0 for fewer than two."""
    n, m = F.cardinality(a), members_mean(a)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (n - 1))


def members_std(a: Column) -> Column:
    return F.sqrt(members_var(a))


# Comparison.  Equality of floats has a tolerance, inequality has none.


def eq_(a: Column, b: Column, kind: str = "int") -> Column:
    if kind == "map":
        return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))
    if kind == "set":
        return F.array_sort(a) == F.array_sort(b)
    return F.abs(a - b) <= EPSILON if kind == "float" else a == b


def ne_(a: Column, b: Column, kind: str = "int") -> Column:
    return a != b if kind == "float" else ~eq_(a, b, kind)


def lt_(a: Column, b: Column) -> Column:
    return a < b


def le_(a: Column, b: Column) -> Column:
    return a <= b


def gt_(a: Column, b: Column) -> Column:
    return a > b


def ge_(a: Column, b: Column) -> Column:
    return a >= b


# Logic on truth values, bits and collections.


def _true(c: Column, kind: str) -> Column:
    if kind == "bool":
        return c
    return F.octet_length(c) > 0 if kind == "str" else F.cardinality(c) > 0 if kind in ("list", "set", "map") else c != 0


def and_(a: Column, b: Column, kind: str = "bool") -> Column:
    return _true(a, kind) & _true(b, kind)


def or_(a: Column, b: Column, kind: str = "bool") -> Column:
    return _true(a, kind) | _true(b, kind)


def not_(a: Column, kind: str = "bool") -> Column:
    return ~_true(a, kind)


def invert_(a: Column) -> Column:
    return F.bitwise_not(a)


def bit_and(a: Column, b: Column, kind: str = "int") -> Column:
    if kind == "map":
        return F.map_filter(a, lambda k, _: F.map_contains_key(b, k))
    return F.array_intersect(a, b) if kind == "set" else a & b if kind == "bool" else a.bitwiseAND(b)


def bit_or(a: Column, b: Column, kind: str = "int") -> Column:
    """Of two maps with the same key, the second one's value."""
    if kind == "map":
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    return F.array_union(a, b) if kind == "set" else a | b if kind == "bool" else a.bitwiseOR(b)


def bit_xor(a: Column, b: Column, kind: str = "int") -> Column:
    if kind == "map":
        return F.map_concat(sub_(a, b, "map"), sub_(b, a, "map"))
    if kind == "set":
        return F.array_union(F.array_except(a, b), F.array_except(b, a))
    return a != b if kind == "bool" else a.bitwiseXOR(b)


def zero(operator: str, kind: str):
    """The identity of an operator: adding it, or multiplying by it, changes nothing."""
    empty = {"int": 0, "float": 0.0, "str": "", "list": [], "set": [], "bool": False}
    one = {"int": 1, "float": 1.0, "bool": True}
    found = (one if operator in ("mul_", "and_") else empty).get(kind)
    if found is None or (operator in ("min_", "max_")):
        raise ValueError(f"{operator} has no identity for {kind}")
    return found
