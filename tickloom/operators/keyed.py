"""Keyed dictionaries of streams, as rows (order, key columns, value), and sets.

A dictionary's state is its latest row for each key; nested dictionaries have
several key columns.  Removal is a row whose `op` is 'remove'."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import free


def snapshot(d: DataFrame, keys: Sequence[str], by: Sequence[str], op: str | None = None) -> DataFrame:
    """The live entries: the latest row of each key, by aggregation (map-side
    combined), not by a window."""
    rest = [c for c in d.columns if c not in keys]
    out = d.groupBy(*keys).agg(*_opened(d, rest, lambda r: F.max_by(r, F.struct(*by))))
    out = _unpacked(out, d, keys, rest)
    return out.where(F.col(op) != "remove") if op else out


def _opened(d: DataFrame, rest: Sequence[str], pick) -> list[Column]:
    """The picked row of a group in one column."""
    return [pick(F.struct(*rest)).alias(free(d)[0])]


def _unpacked(out: DataFrame, d: DataFrame, keys: Sequence[str], rest: Sequence[str]) -> DataFrame:
    r = F.col(free(d)[0])
    return out.select(*keys, *[r[c].alias(c) for c in rest])


def keys_(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    return d.select(*keys).distinct()


def values_(d: DataFrame, value: str) -> DataFrame:
    return d.select(value).distinct()


def rekey(d: DataFrame, mapping: DataFrame, key: str, new_key: str) -> DataFrame:
    """Entries under their new keys; those without one go."""
    return d.join(mapping.select(key, new_key).where(F.col(new_key).isNotNull()), key).drop(key).withColumnRenamed(new_key, key)


def flip(d: DataFrame, key: str, value: str, unique: bool = True) -> DataFrame:
    if unique:
        return d.select(F.col(value).alias(key), F.col(key).alias(value))
    return d.groupBy(F.col(value).alias(key)).agg(F.sort_array(F.collect_set(key)).alias("keys"))


def partition(d: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    return d.join(groups.select(key, group), key).select(group, *d.columns)


def unpartition(d: DataFrame, group: str, key: str) -> DataFrame:
    """Without the outer key; the smallest outer key wins where inner keys meet."""
    rest = [c for c in d.columns if c not in (group, key)]
    return _unpacked(d.groupBy(key).agg(*_opened(d, rest, lambda r: F.min_by(r, group))), d, [key], rest)


def flip_keys(d: DataFrame, outer: str, inner: str) -> DataFrame:
    return d.select(F.col(inner).alias(outer), F.col(outer).alias(inner), *[c for c in d.columns if c not in (outer, inner)])


def collapse_keys(d: DataFrame, outer: str, inner: str, name: str = "key") -> DataFrame:
    return d.select(F.struct(outer, inner).alias(name), *[c for c in d.columns if c not in (outer, inner)])


def uncollapse_keys(d: DataFrame, name: str = "key") -> DataFrame:
    return d.select(f"{name}.*", *[c for c in d.columns if c != name])


def filter_by_matches(d: DataFrame, matches: DataFrame, key: str, match: str) -> DataFrame:
    return d.join(matches.where(F.col(match)).select(key), key, "left_semi")


def merge_disjoint(ds: Sequence[DataFrame], key: str) -> DataFrame:
    """For each key the entry of the leftmost dictionary that has it."""
    (i,) = free(*ds)
    out = None
    for n, d in enumerate(ds):
        d = d.withColumn(i, F.lit(n))
        out = d if out is None else out.unionByName(d)
    rest = [c for c in out.columns if c not in (key, i)]
    return _unpacked(out.groupBy(key).agg(*_opened(out, rest, lambda r: F.min_by(r, i))), out, [key], rest)


def reduce_(d: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    return d.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])


def top_by_key(d: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    (r,) = free(d)
    return d.withColumn(r, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(r) <= n).drop(r)


def union(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def intersection(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.intersect(s)
    return out


def difference(first: DataFrame, *others: DataFrame) -> DataFrame:
    out = first
    for s in others:
        out = out.subtract(s)
    return out.distinct()


def symmetric_difference(*sets: DataFrame) -> DataFrame:
    """Members of an odd number of sets, in one aggregation."""
    out = None
    for s in sets:
        s = s.distinct()
        out = s if out is None else out.union(s)
    (n,) = free(out)
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) % 2 == 1).drop(n)


def make_tsd(pairs: DataFrame, key: str, value: str, removed: str | None = None, op: str = "op") -> DataFrame:
    """Upserts of a dictionary from a stream of keys and values (see
    `streams.combine_latest`).  A new key does not remove the one before; a true
    `removed` removes the key."""
    gone = F.lit(False) if removed is None else F.coalesce(F.col(removed), F.lit(False))
    out = pairs.where(F.col(key).isNotNull()).withColumn(op, F.when(gone, "remove").otherwise("set"))
    return out.withColumn(value, F.when(F.col(op) == "set", F.col(value)))


def combine_tsd(s: DataFrame, keys: str, values: str, key: str = "key", value: str = "value") -> DataFrame:
    """A dictionary's rows from one array of keys and one of values."""
    rest = [c for c in s.columns if c not in (keys, values)]
    pairs = F.arrays_zip(F.col(keys).alias("k"), F.col(values).alias("v"))
    return s.select(*rest, F.explode(pairs).alias("__p")).select(*rest, F.col("__p.k").alias(key), F.col("__p.v").alias(value))


def flatten_map(s: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """The rows of a column of maps."""
    return s.select(*[c for c in s.columns if c != column], F.explode(column).alias(key, value))


def make_map(d: DataFrame, by: Sequence[str], key: str, value: str, name: str = "map") -> DataFrame:
    """One map for each of `by`: a snapshot as a value.  A map holds its keys in
    one row, so this is for dictionaries that fit in one."""
    return d.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))))).alias(name))


def race_by_key(d: DataFrame, by: Sequence[str], key: str, fields: Sequence[str]) -> DataFrame:
    """For each of `by` and each field the value of the first key, in the keys'
    order, that has one.  One field is a race of values, several one of bundles."""
    return d.groupBy(*by).agg(*[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(key))).alias(f) for f in fields])
