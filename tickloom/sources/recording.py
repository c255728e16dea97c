"""Record and replay, bitemporal tables, and frame sources.

A recording is a Parquet table partitioned by its key, so replaying one key
reads only that key's files, and a time range reaches the scan as a filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "__recording"


def record(s: DataFrame, path: str, key: str, mode: str = "append") -> None:
    s.withColumn(KEY, F.lit(key)).write.partitionBy(KEY).mode(mode).parquet(path)


def replay(spark: SparkSession, path: str, key: str, ts: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The ticks of one recording from `start` to `end`, both included."""
    s = spark.read.parquet(path).where(F.col(KEY) == key).drop(KEY)
    if start is not None:
        s = s.where(F.col(ts) >= start)
    return s if end is None else s.where(F.col(ts) <= end)


def replay_const(spark: SparkSession, path: str, key: str, ts: str, at: Column, keys: Sequence[str] = ()) -> DataFrame:
    """The latest tick at or before `at`, one for each of `keys`.  Of equal times, any one."""
    s = replay(spark, path, key, ts, end=at)
    rest = [c for c in s.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.col(ts)).alias("__r")
    grouped = s.groupBy(*keys).agg(latest)
    return grouped.where(F.col("__r").isNotNull()).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def to_table(s: DataFrame, ts: str, as_of: Column, date: str = "date", as_of_name: str = "as_of") -> DataFrame:
    """Rows of a bitemporal table: event time, time of knowledge, then the value's columns."""
    return s.select(F.col(ts).alias(date), as_of.alias(as_of_name), *[c for c in s.columns if c != ts])


def from_table(t: DataFrame, keys: Sequence[str], until: Column, date: str = "date", as_of: str = "as_of") -> DataFrame:
    """Of each key and event time, the revision known at `until`."""
    w = Window.partitionBy(*keys, date).orderBy(F.col(as_of).desc())
    return t.where(F.col(as_of) <= until).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", as_of)


def from_sql(spark: SparkSession, url: str, query: str, split_by: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A query's rows over JDBC; with `split_by` and `bounds` in `parts` parallel reads."""
    r = spark.read.format("jdbc").option("url", url).options(**options)
    if split_by is None or bounds is None:
        return r.option("query", query).load()
    ranges = {"partitionColumn": split_by, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return r.option("dbtable", f"({query}) q").options(**ranges).load()
