"""What a query does with each micro-batch, and running state by key.

The batch functions are for `writeStream.foreachBatch`.  A micro-batch that is
run again has the same number, so each of them writes it once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conflate(batch: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The latest tick of each key in a micro-batch."""
    rest = [c for c in batch.columns if c not in keys]
    latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("__r"))
    return latest.where(F.col("__r").isNotNull()).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def burst(batch: DataFrame, keys: Sequence[str], by: Sequence[str], value: str, name: str = "values") -> DataFrame:
    """The values of each key in a micro-batch as one list, in order; a trigger's limits bound it."""
    ordered = F.array_sort(F.collect_list(F.struct(*by, F.struct(F.col(value)).alias("__v"))))
    return batch.groupBy(*keys).agg(F.transform(ordered, lambda x: x["__v"][value]).alias(name))


def to_table(path: str, keys: Sequence[str] = (), by: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch (with keys: its latest ticks) as `batch=<number>` of a
    table.  The folder is replaced if the batch is run again."""

    def publish(batch: DataFrame, number: int) -> None:
        rows = conflate(batch, keys, by) if keys else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return publish


def current(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The dictionary that the batches of `to_table` amount to: of each key the latest batch's row."""
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    latest = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r"))
    return latest.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def compact(table: DataFrame, keys: Sequence[str], path: str) -> None:
    """Write the current rows to another folder, in as many files as they need."""
    current(table, keys).write.mode("overwrite").parquet(path)


def logged(label: str, message: Column, every: int = 1) -> Callable[[DataFrame, int], None]:
    """Log the number of ticks of every n-th micro-batch, and the smallest and largest message."""
    import logging

    def run(batch: DataFrame, number: int) -> None:
        if number % every == 0:
            n, low, high = batch.agg(F.count(F.lit(1)), F.min(message), F.max(message)).first()
            logging.getLogger("tickloom").info("%s %d: %d ticks, %s to %s", label, number, n, low, high)

    return run


def running(s: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """After each micro-batch the running count and sum (bigint) of each key that
    ticked.  The state is two numbers a key; a batch's frames are added one by one."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema.fields if f.name in keys)

    def step(key, frames, state):
        import pandas as pd

        n, total = state.get if state.exists else (0, 0)
        for f in frames:
            v = f[value].dropna()
            n, total = n + len(v), total + int(v.sum())
        state.update((n, total))
        yield pd.DataFrame([(*key, n, total)], columns=[*keys, "n", "total"])

    picked = s.select(*keys, F.col(value).cast("long").alias(value))
    return picked.groupBy(*keys).applyInPandasWithState(step, f"{fields}, n long, total long", "n long, total long", "update", "NoTimeout")


def call(s: DataFrame, function: Callable, *args: Column) -> None:
    """The function for each row, on the executors, for what it does; its values are dropped."""
    names = [f"a{i}" for i in range(len(args))]

    def run(rows):
        for r in rows:
            function(*r)

    s.select(*[a.alias(n) for a, n in zip(args, names, strict=True)]).foreachPartition(run)
