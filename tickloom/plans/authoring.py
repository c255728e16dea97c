"""Writing plans: components that are recorded and compared, and functions over bitemporal frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames


def lower(function: Callable[..., DataFrame], date: str, as_of: str, keys: Sequence[str] = (), removed: str | None = None) -> Callable[..., DataFrame]:
    """The function over frames: each is first reduced to its rows as known at `until`."""

    def lowered(*inputs: DataFrame, until: Column) -> DataFrame:
        return function(*[frames.replay(f, date, as_of, keys, until, removed) for f in inputs])

    return lowered


@dataclass
class Component:
    """A named part of a plan whose inputs and output can be recorded under `root`.

    record: write both, and give the output.  replay: the output of the recorded
    inputs.  recover: the recorded output itself.  compare: the rows in which the
    output of the recorded inputs and the recorded output differ, with `side`
    (`new` or `recorded`) and how many times more they occur there.
    """

    name: str
    function: Callable[..., DataFrame]
    root: str

    def _at(self, part: str) -> str:
        return f"{self.root}/{self.name}/{part}"

    def record(self, **inputs: DataFrame) -> DataFrame:
        spark = next(iter(inputs.values())).sparkSession
        for n, df in inputs.items():
            df.write.mode("overwrite").parquet(self._at(f"in/{n}"))
        self.replay(spark, *inputs).write.mode("overwrite").parquet(self._at("out"))
        return self.recover(spark)

    def replay(self, spark: SparkSession, *names: str) -> DataFrame:
        return self.function(**{n: spark.read.parquet(self._at(f"in/{n}")) for n in names})

    def recover(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self._at("out"))

    def compare(self, spark: SparkSession, *names: str) -> DataFrame:
        new, old = self.replay(spark, *names), self.recover(spark)
        both = new.withColumn("__d", F.lit(1)).unionByName(old.withColumn("__d", F.lit(-1)))
        left = both.groupBy(*new.columns).agg(F.sum("__d").alias("__d")).where("__d != 0")
        return left.select(*new.columns, F.when(F.col("__d") > 0, "new").otherwise("recorded").alias("side"), F.abs("__d").alias("times"))


def identity(df: DataFrame) -> DataFrame:
    return df


def then(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The steps one after the other, as one function."""

    def run(df: DataFrame) -> DataFrame:
        for f in steps:
            df = df.transform(f)
        return df

    return run


def center_of_mass_to_alpha(mass: float) -> float:
    if mass < 0:
        raise ValueError("a centre of mass is not negative")
    return 1 / (1 + mass)


def span_to_alpha(span: float) -> float:
    if span < 1:
        raise ValueError("a span is at least 1")
    return 2 / (span + 1)


# Names that are bound later, values in a scope, pairs of source and sink, and plans side by side.


class DelayedBinding:
    """A frame that is used before it is made.  It is a name, not a circle: reading it unbound, or binding it twice, is an error."""

    def __init__(self, name: str = "binding"):
        self.name, self._made = name, None

    def bind(self, df: DataFrame) -> None:
        if self._made is not None:
            raise ValueError(f"{self.name} is bound already")
        self._made = df

    def __call__(self) -> DataFrame:
        if self._made is None:
            raise LookupError(f"{self.name} is not bound")
        return self._made


_scopes: ContextVar[tuple[tuple[str, object], ...]] = ContextVar("scopes", default=())


@contextmanager
def context(name: str, value) -> Iterator[None]:
    """Within the block, `in_context(name)` is the value; inner blocks come first."""
    token = _scopes.set((*_scopes.get(), (name, value)))
    try:
        yield
    finally:
        _scopes.reset(token)


def in_context(name: str):
    for known, value in reversed(_scopes.get()):
        if known == name:
            return value
    raise LookupError(f"no {name} in this context")


class Services:
    """Implementations by path: register one, then ask for it by its path."""

    def __init__(self):
        self._made: dict[str, Callable] = {}

    def register(self, path: str, implementation: Callable) -> None:
        if path in self._made:
            raise ValueError(f"{path} is registered already")
        self._made[path] = implementation

    def __call__(self, path: str, *args, **named):
        if path not in self._made:
            raise LookupError(f"nothing is registered at {path}")
        return self._made[path](*args, **named)


@dataclass(frozen=True)
class Adaptor:
    """A boundary to the outside: rows go out through `write`, and come in through `read`."""

    read: Callable[[SparkSession], DataFrame]
    write: Callable[[DataFrame], None]

    def exchange(self, requests: DataFrame) -> DataFrame:
        """Send the requests out, then read what has come in."""
        self.write(requests)
        return self.read(requests.sparkSession)


def side_by_side(plans: Sequence[Callable[[], object]], most: int = 8) -> list:
    """The results of several plans whose jobs run at the same time, in the plans' order.
    A plan's error is raised when all have ended."""
    with ThreadPoolExecutor(max_workers=most) as pool:
        running = [pool.submit(copy_context().run, p) for p in plans]
    return [r.result() for r in running]
