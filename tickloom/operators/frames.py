"""Frames: relational operators and bitemporal replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import free

HOWS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def from_frame(df: DataFrame, dt: str, value: str, key: str | None = None, offset_micros: int = 0) -> DataFrame:
    """A frame's rows as ticks at their time; a null value is no tick."""
    t = F.timestamp_micros(F.unix_micros(F.col(dt).cast("timestamp")) + offset_micros)
    return df.where(F.col(value).isNotNull()).select(t.alias("ts"), *([F.col(key).alias("key")] if key else []), F.col(value).alias("value"))


def from_frame_batches(batches: Sequence[DataFrame], dt: str, value: str, key: str | None = None, offset_micros: int = 0) -> DataFrame:
    """The ticks of frames that came one after the other.  A frame whose first
    retained row is before the last one of an earlier frame came too late: an
    error, raised when rows are read.  One row a frame says where it begins and ends."""
    out, spans = None, None
    for i, b in enumerate(batches):
        t = from_frame(b, dt, value, key, offset_micros).withColumn("batch", F.lit(i))
        span = t.groupBy("batch").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        out, spans = (t, span) if out is None else (out.unionByName(t), spans.unionByName(span))
    late = spans.withColumn("before", F.max("last").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)))
    late = late.agg(F.coalesce(F.bool_or(F.col("first") < F.col("before")), F.lit(False)).alias("late"))
    ok = F.when(~F.col("late"), F.lit(True)).otherwise(F.raise_error(F.lit("a batch came after its first row's time")).cast("boolean"))
    return out.join(F.broadcast(late), ok).drop("late", "batch")


def to_frame(s: DataFrame, **names: str) -> DataFrame:
    return s.select(*[F.col(c).alias(n) for n, c in names.items()])


def replay(df: DataFrame, date: str, as_of: str, keys: Sequence[str], until: Column, removed: str | None = None) -> DataFrame:
    """Of each date and key the latest revision known at `until`; revisions
    that remove the row leave none.  One map-side combined aggregation."""
    rest = [c for c in df.columns if c not in (date, *keys)]
    (r,) = free(df)
    out = df.where(F.col(as_of) <= until).groupBy(date, *keys).agg(F.max_by(F.struct(*rest), as_of).alias(r)).select(date, *keys, *[F.col(r)[c].alias(c) for c in rest])
    return out.where(~F.col(removed)) if removed else out


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Equality join; columns of the right side that clash get the suffix.  The
    keys are the left side's, so rows of the right side alone have null keys."""
    named = {c: c if c in on or c not in left.columns else c + suffix for c in right.columns}
    if how not in ("right", "full"):
        return left.join(right.select(*[F.col(c).alias(n) for c, n in named.items()]), list(on), HOWS[how])
    right = right.select(*[F.col(c).alias(f"__on{on.index(c)}" if c in on else n) for c, n in named.items()])
    condition = F.lit(True)
    for i, c in enumerate(on):
        condition = condition & (left[c] == right[f"__on{i}"])
    return left.join(right, condition, HOWS[how]).drop(*[f"__on{i}" for i in range(len(on))])


def matching(df: DataFrame, **fields) -> DataFrame:
    """Rows equal to all given fields; a None is a wildcard."""
    for name, value in fields.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def sorted_(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last())


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    if a.dtypes != b.dtypes:
        raise ValueError("the frames have different schemas")
    return a.unionByName(b)


def with_columns(df: DataFrame, schema: Sequence[str], **columns: Column) -> DataFrame:
    return df.withColumns(columns).select(*schema)


def group_by(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """A keyed dictionary of frames stays flat: its keys are columns."""
    return df.repartition(*by)


def ungroup(df: DataFrame, keys: Sequence[str], keep_keys: bool = True) -> DataFrame:
    return df if keep_keys else df.drop(*keys)
