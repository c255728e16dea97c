"""Streams from frames, files, tables and generators, and sinks.

A source is a lazy read: column pruning and time ranges reach the scan."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

OPERATORS = {
    "=": lambda a, b: a == b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a.isin(*b), "not in": lambda a, b: ~a.isin(*b),
}


def between(df: DataFrame, dt: str, start=None, end=None) -> DataFrame:
    """Rows from `start` to `end`, both included; a missing bound is open."""
    if start is not None:
        df = df.where(F.col(dt) >= F.lit(start))
    return df if end is None else df.where(F.col(dt) <= F.lit(end))


def checked(df: DataFrame, dt: str) -> DataFrame:
    """A row without a time is an error, as is a column that holds no times."""
    if not isinstance(df.schema[dt].dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
        raise TypeError(f"{dt} holds no dates or timestamps")
    kind = df.schema[dt].dataType.simpleString()
    return df.withColumn(dt, F.when(F.col(dt).isNotNull(), F.col(dt)).otherwise(F.raise_error(F.lit("a row has no time")).cast(kind)))


def out_of_order(df: DataFrame, dt: str, keys: Sequence[str], position: str) -> DataFrame:
    """Rows whose time is before that of the row before, by position."""
    w = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn("__b", F.lag(dt).over(w)).where(F.col("__b") > F.col(dt)).drop("__b")


def ts_from_data_source(df: DataFrame, dt: str, value: str) -> DataFrame:
    return checked(df, dt).select(F.col(dt).alias("ts"), F.col(value).alias("value")).where("value IS NOT NULL")


def tsb_from_data_source(df: DataFrame, dt: str) -> DataFrame:
    """One row a tick; a null field does not tick."""
    return checked(df, dt).select(F.col(dt).alias("ts"), *[c for c in df.columns if c != dt])


def tsd_k_v_from_data_source(df: DataFrame, dt: str, key: str, value: str) -> DataFrame:
    return checked(df, dt).select(F.col(dt).alias("ts"), F.col(key).alias("key"), F.col(value).alias("value")).where("key IS NOT NULL")


def tsd_k_b_from_data_source(df: DataFrame, dt: str, key: str) -> DataFrame:
    return checked(df, dt).select(F.col(dt).alias("ts"), F.col(key).alias("key"), *[c for c in df.columns if c not in (dt, key)]).where("key IS NOT NULL")


def tsd_k_tsd_from_data_source(df: DataFrame, dt: str, outer: str, inner: str, value: str) -> DataFrame:
    return checked(df, dt).select(F.col(dt).alias("ts"), F.col(outer).alias("outer"), F.col(inner).alias("inner"), F.col(value).alias("value")).where("outer IS NOT NULL AND inner IS NOT NULL")


def ts_of_array_from_data_source(df: DataFrame, dt: str, columns: Sequence[str]) -> DataFrame:
    """The columns of a row as one array, in the order given."""
    return checked(df, dt).select(F.col(dt).alias("ts"), F.array(*columns).alias("value"))


tsl_from_data_source = ts_of_array_from_data_source


def tsd_k_a_from_data_source(df: DataFrame, dt: str, key: str, columns: Sequence[str]) -> DataFrame:
    return checked(df, dt).select(F.col(dt).alias("ts"), F.col(key).alias("key"), F.array(*columns).alias("value"))


def ts_of_matrix_from_data_source(df: DataFrame, dt: str, row: str, columns: Sequence[str]) -> DataFrame:
    """The rows that share a time as one matrix, ordered by `row`."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.array(*columns).alias("a"))))
    return checked(df, dt).groupBy(F.col(dt).alias("ts")).agg(F.transform(rows, lambda x: x["a"]).alias("value"))


def filter_exp(df: DataFrame, *conditions: Column) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def read_table(df: DataFrame, columns: Sequence[str] | None = None, filters: Sequence[tuple] = (), sort: Sequence[str] = ()) -> DataFrame:
    """Rows that meet every (column, operator, value), with the columns named."""
    for column, operator, value in filters:
        df = df.where(OPERATORS[operator](F.col(column), value if isinstance(value, list | tuple) else F.lit(value)))
    df = df.select(*columns) if columns else df
    return df.orderBy(*sort) if sort else df


def query_tables(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """SQL over tables under the names given; nothing stays registered."""
    return spark.sql(sql, **tables)


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = True) -> DataFrame:
    r = spark.read.option("multiLine", not lines)
    return (r.schema(schema) if schema else r).json(path)


def keyed_overwrite(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows of keys that the new rows do not have, and the new rows.  A
    key's missing columns are null.  To be written to another place than the old."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def split_back(requests: DataFrame, shared: DataFrame, on: Sequence[str]) -> DataFrame:
    """One query for all requesters: its rows go back to whoever asked for them."""
    return requests.join(shared, list(on))


# Versioned tables: a folder of revisions; Spark's _SUCCESS marks a whole one.


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def revisions(spark: SparkSession, root: str, data_id: str) -> list[int]:
    """The whole revisions of a data id: metadata, one number each."""
    fs, p = _files(spark, f"{root}/{data_id}")
    if not fs.exists(p):
        return []
    marks = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p, "revision=*/_SUCCESS"))
    return sorted(int(m.getPath().getParent().getName().split("=")[1]) for m in marks)


def publish_data(df: DataFrame, root: str, data_id: str, revision: int) -> bool:
    """Write a whole frame under a revision (say, microseconds).  The same
    revision again is left alone, so a job that is run twice publishes once."""
    if revision in revisions(df.sparkSession, root, data_id):
        return False
    df.write.mode("overwrite").parquet(f"{root}/{data_id}/revision={revision}")
    return True


def subscribe_data(spark: SparkSession, root: str, data_id: str, as_of: int | None = None) -> DataFrame:
    """The latest revision, or the latest at or before `as_of`."""
    found = [r for r in revisions(spark, root, data_id) if as_of is None or r <= as_of]
    if not found:
        raise LookupError(f"{data_id} has no such revision")
    return spark.read.parquet(f"{root}/{data_id}/revision={found[-1]}")


# Generators and sinks.


def generator(function: Callable[..., Iterable[tuple]], schema: str, name: str, parts: int = 1) -> type[DataSource]:
    """A data source from a generator of rows; its first column is a time that
    never goes back within a part.  `spark.dataSource.register` it, then read its
    name.  `function(part)` runs on an executor."""

    class Part(InputPartition):
        def __init__(self, value):
            self.value = value

    class Reader(DataSourceReader):
        def partitions(self):
            return [Part(i) for i in range(parts)]

        def read(self, partition):
            last = None
            for row in function(partition.value):
                if last is not None and row[0] < last:
                    raise ValueError("a generator's time goes back")
                last = row[0]
                yield row

    class Generator(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Generator


def null_sink(s: DataFrame) -> None:
    s.write.format("noop").mode("overwrite").save()


def debug_print(s: DataFrame, label: str, rows: int = 20) -> None:
    print(label)
    s.show(rows, truncate=False)


def log_(s: DataFrame, message: Column, order: Column, level: int = logging.INFO, sample: int = 1, most: int = 1000) -> None:
    """Every `sample`-th of the first `most` messages, in order, to the logger.  A report: it has a limit."""
    rows = s.select(message.alias("m"), order.alias("o")).orderBy("o").limit(most).collect()
    for r in rows[::sample]:
        logging.getLogger("tickloom").log(level, r.m)


def assert_(s: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows; reading one whose condition is false fails with the message."""
    return s.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def stop_at(s: DataFrame, trigger: DataFrame, ts: str) -> DataFrame:
    """Ticks up to the first tick of the trigger, which is one row."""
    first = trigger.agg(F.min(ts).alias("__stop"))
    return s.join(F.broadcast(first), F.col("__stop").isNull() | (F.col(ts) <= F.col("__stop"))).drop("__stop")


def kafka_options(servers: str, topic: str, start="latest", offsets: dict[int, int] | None = None, timestamp: int | None = None, most: int | None = None) -> dict[str, str]:
    """Options of Spark's Kafka reader: start at earliest, latest, a time (milliseconds) or offsets by partition."""
    import json

    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start}
    if offsets is not None:
        out["startingOffsets"] = json.dumps({topic: {str(p): o for p, o in sorted(offsets.items())}})
    if timestamp is not None:
        out.pop("startingOffsets")
        out["startingTimestamp"] = str(timestamp)
    return out if most is None else out | {"maxOffsetsPerTrigger": str(most)}


def kafka_records(spark: SparkSession, options: dict[str, str], live: bool = True) -> DataFrame:
    """Key, value, topic, partition, offset and time of each record.  Needs Spark's Kafka package."""
    reader = (spark.readStream if live else spark.read).format("kafka").options(**options)
    return reader.load().select("key", "value", "topic", "partition", "offset", F.col("timestamp").alias("ts"))
