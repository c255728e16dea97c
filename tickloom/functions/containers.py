"""Arrays, structs, JSON and shaped-array statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(a: Column, x) -> Column:
    return F.array_contains(a, x)


def len_(a: Column) -> Column:
    return F.cardinality(a)


def is_empty(a: Column) -> Column:
    return F.cardinality(a) == 0


def setattr_(s: Column, name: str, value: Column) -> Column:
    return s.withField(name, value)


def json_decode(text: Column) -> Column:
    """A JSON tree; null where the text is not JSON."""
    return F.try_parse_json(text)


def json_as(tree: Column, path: str, kind: str) -> Column:
    """A scalar leaf as bigint, double, string or boolean; null where there is none."""
    return F.try_variant_get(tree, path, kind)


def combine_json(**fields: Column) -> Column:
    """JSON text of an object; null fields are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def default(c: Column, otherwise) -> Column:
    return F.coalesce(c, F.lit(otherwise))


# Statistics of one array of numbers; of an empty array null, where nothing else is said.


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, array_sum(a) / F.size(a))


def array_std(a: Column, sample: bool = False) -> Column:
    """The population's deviation, or the sample's; NaN for too few values."""
    n = F.size(a) - (1 if sample else 0)
    mean = array_mean(a)
    deviation = F.sqrt(array_sum(F.transform(a, lambda x: (x - mean) * (x - mean))) / n)
    return F.when(a.isNotNull(), F.when(n > 0, deviation).otherwise(F.lit(float("nan"))))


def quantile(a: Column, q: float, method: str = "linear") -> Column:
    """Between the two nearest ranks: linear, lower, higher, midpoint or nearest (of two, the even rank)."""
    if not 0 <= q <= 1:
        raise ValueError("quantile out of range")
    s = F.sort_array(a)
    at = (F.size(a) - 1) * F.lit(float(q))
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    x, y = F.get(s, low).cast("double"), F.get(s, high).cast("double")
    found = {"linear": x + (y - x) * (at - low), "lower": x, "higher": y, "midpoint": (x + y) / 2, "nearest": F.get(s, F.rint(at).cast("int")).cast("double")}
    return F.when(F.size(a) > 0, found[method])


def cumulative_sum(a: Column) -> Column:
    """Each member's sum with all before it, in one pass."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("sum"))
    add = lambda acc, x: F.struct(F.array_append(acc["out"], acc["sum"] + x).alias("out"), (acc["sum"] + x).alias("sum"))
    return F.aggregate(a, start, add)["out"]


def array_var(a: Column, ddof: int = 0) -> Column:
    """The variance with n - ddof; NaN for too few values.  For a list, a window's buffer, or the values of a map."""
    n, mean = F.size(a) - ddof, array_mean(a)
    squares = array_sum(F.transform(a, lambda x: (x - mean) * (x - mean)))
    return F.when(a.isNotNull(), F.when(n > 0, squares / n).otherwise(F.lit(float("nan"))))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's coefficient of two arrays of one length; NaN without variance."""
    da = F.transform(a, lambda x: x - array_mean(a))
    db = F.transform(b, lambda x: x - array_mean(b))
    dot = lambda x, y: array_sum(F.zip_with(x, y, lambda p, q: p * q))
    found = F.try_divide(dot(da, db), F.sqrt(dot(da, da) * dot(db, db)))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(found, F.lit(float("nan"))))


def keys_where_true(m: Column) -> Column:
    """The keys of a map whose value is true."""
    return F.map_keys(F.map_filter(m, lambda _, v: v))


def where_true(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v)


def tsl_to_tsd(a: Column, keys: list[str]) -> Column:
    """A list's items under names; null items are left out."""
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), a), lambda _, v: v.isNotNull())


def flatten_values(m: Column) -> Column:
    """All values of a map of lists."""
    return F.flatten(F.map_values(m))


def array_get_item(a: Column, *at: int) -> Column:
    """An item of nested arrays; an index below 0 counts from the end."""
    for i in at:
        a = F.get(a, F.lit(i) if i >= 0 else F.size(a) + i)
    return a
