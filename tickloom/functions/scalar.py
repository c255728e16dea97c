"""Scalar functions as column expressions: arithmetic, comparison, logic, strings,
containers, JSON, time and interval ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10


def mod_(a: Column, b: Column) -> Column:
    """The remainder with the sign of the divisor."""
    return ((a % b) + b) % b


def floordiv(a: Column, b: Column) -> Column:
    return F.floor((a - mod_(a, b)) / b)


def divmod_(a: Column, b: Column) -> Column:
    return F.struct(floordiv(a, b).alias("quotient"), mod_(a, b).alias("remainder"))


def div(a: Column, b: Column, on_zero: str = "null") -> Column:
    q = F.try_divide(a.cast("double"), b.cast("double"))
    other = {"null": F.lit(None), "nan": F.lit(float("nan")), "inf": F.when(a == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")) * F.signum(a.cast("double"))), "zero": F.lit(0.0), "one": F.lit(1.0)}
    if on_zero == "error":
        return a.cast("double") / b.cast("double")
    return F.when(b == 0, other[on_zero].cast("double")).otherwise(q)


def eq(a: Column, b: Column, floating: bool = False) -> Column:
    return F.abs(a - b) <= EPSILON if floating else a == b


def cmp(a: Column, b: Column) -> Column:
    return F.when(a < b, "LT").when(a == b, "EQ").otherwise("GT")


def truthy(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return c
    return F.length(c) > 0 if kind == "string" else F.size(c) > 0 if kind in ("array", "map") else c != 0


def lshift(c: Column, n: int) -> Column:
    if not 0 <= n < 63:
        raise ValueError("shift out of range")
    return F.shiftleft(c, n)


def rshift(c: Column, n: int) -> Column:
    if not 0 <= n < 63:
        raise ValueError("shift out of range")
    return F.shiftright(c, n)


def substr(s: Column, start: int, stop: int | None = None) -> Column:
    """A slice by Python's rules."""
    n = F.length(s)
    lo = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    hi = n if stop is None else F.lit(stop) if stop >= 0 else F.greatest(n + stop, F.lit(0))
    return F.substring(s, lo + 1, F.greatest(hi - lo, F.lit(0)))


def split(s: Column, separator: str) -> Column:
    import re

    return F.split(s, re.escape(separator))


def match(s: Column, pattern: str, group: int = 0) -> Column:
    return F.struct(s.rlike(pattern).alias("is_match"), F.regexp_extract(s, pattern, group).alias("found"))


def get(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i) if i >= 0 else F.size(a) + i)


def index_of(a: Column, x) -> Column:
    return F.coalesce(F.array_position(a, x), F.lit(0)) - 1


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def day_part(us: Column) -> Column:
    return F.floor(us / 86_400_000_000)


def second_part(us: Column) -> Column:
    return F.floor(mod_(us, F.lit(86_400_000_000)) / 1_000_000)


def temporal_floor(us: Column, quantum: int, origin: int = 0) -> Column:
    return us - mod_(us - origin, F.lit(quantum))


def temporal_ceil(us: Column, quantum: int, origin: int = 0) -> Column:
    low = temporal_floor(us, quantum, origin)
    return F.when(low == us, us).otherwise(low + quantum)


def temporal_round(us: Column, quantum: int, origin: int = 0) -> Column:
    """The nearest multiple; of two, the even one."""
    low = temporal_floor(us, quantum, origin)
    rest, index = us - low, F.floor((low - origin) / quantum)
    up = (2 * rest > quantum) | ((2 * rest == quantum) & (mod_(index, F.lit(2)) == 1))
    return F.when(up, low + quantum).otherwise(low)


# Interval ranges: lo, hi and whether each end is part of it; both ends finite.


def range_empty(lo: Column, hi: Column, lo_in: Column, hi_in: Column) -> Column:
    return (lo > hi) | ((lo == hi) & ~(lo_in & hi_in))


def range_contains(x: Column, lo: Column, hi: Column, lo_in: Column, hi_in: Column) -> Column:
    return ((x > lo) | ((x == lo) & lo_in)) & ((x < hi) | ((x == hi) & hi_in))


def range_intersection(a: tuple, b: tuple) -> tuple:
    lo, hi = F.greatest(a[0], b[0]), F.least(a[1], b[1])
    lo_in = F.when(a[0] > b[0], a[2]).when(a[0] < b[0], b[2]).otherwise(a[2] & b[2])
    hi_in = F.when(a[1] < b[1], a[3]).when(a[1] > b[1], b[3]).otherwise(a[3] & b[3])
    return lo, hi, lo_in, hi_in


def range_overlaps(a: tuple, b: tuple) -> Column:
    return ~range_empty(*range_intersection(a, b))


def range_touches(a: tuple, b: tuple) -> Column:
    return (a[1] == b[0]) | (b[1] == a[0])


def range_adjacent(a: tuple, b: tuple) -> Column:
    """They touch, and exactly one of them has the shared end."""
    return ((a[1] == b[0]) & (a[3] != b[2])) | ((b[1] == a[0]) & (b[3] != a[2]))


def range_mergeable(a: tuple, b: tuple) -> Column:
    return range_overlaps(a, b) | range_adjacent(a, b)


def range_hull(a: tuple, b: tuple) -> tuple:
    return F.least(a[0], b[0]), F.greatest(a[1], b[1])
