"""Dispatch on types, errors as data, keys that read each other, and services."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import checkpointed
from .names import free


def nearest_case(kind: str, parents: Mapping[str, str | None], cases: Mapping[str, object]) -> str | None:
    """The type itself or its nearest ancestor that has a case."""
    seen = set()
    while kind is not None and kind not in cases:
        if kind in seen:
            raise ValueError(f"{kind} is its own ancestor")
        seen.add(kind)
        kind = parents.get(kind)
    return kind


def dispatch_(s: DataFrame, tag: str, parents: Mapping[str, str | None], cases: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each row through the case of its type, or of its nearest ancestor that
    has one; rows without a case are an error.  `parents` names every type."""
    kinds = set(parents) | set(cases)
    groups: dict[str, list[str]] = {}
    for k in sorted(kinds):
        found = nearest_case(k, parents, cases)
        if found is not None:
            groups.setdefault(found, []).append(k)
    known = [k for ks in groups.values() for k in ks]
    checked = s.withColumn(tag, F.when(F.col(tag).isin(*known), F.col(tag)).otherwise(F.raise_error(F.concat(F.lit("no case for "), F.coalesce(F.col(tag), F.lit("null"))))))
    out = None
    for name, ks in groups.items():
        # one branch sees all rows, so that a row without a case is found
        source = checked if out is None else s
        part = cases[name](source.where(F.col(tag).isin(*ks)))
        out = part if out is None else out.unionByName(part)
    return out


def try_except(function: Callable, returns: str | T.DataType, *args: Column, name: str = "result") -> Column:
    """struct<out, exception>: the function's value for each row or the text of what it
    raised.  Spark's own errors are caught by the `try_*` functions instead."""
    kind = T._parse_datatype_string(returns) if isinstance(returns, str) else returns
    schema = T.StructType([T.StructField("out", kind), T.StructField("exception", T.StringType())])

    @F.pandas_udf(schema)
    def run(x: pd.DataFrame) -> pd.DataFrame:
        values, errors = [], []
        for r in zip(*[x[c].astype(object).where(x[c].notna(), None) for c in x.columns], strict=True):
            try:
                values.append(function(*r))
                errors.append(None)
            except Exception as e:
                values.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return pd.DataFrame({"out": pd.Series(values, dtype=object), "exception": pd.Series(errors, dtype=object)})

    return run(F.struct(*[a.alias(f"a{i}") for i, a in enumerate(args)])).alias(name)


def mesh_(d: DataFrame, reads: DataFrame, key: str, other: str, value: str, aggregate: Callable[[Column], Column], combine: Callable[[Column, Column], Column], ranks: int = 1000) -> DataFrame:
    """Outputs of keys that read each other's outputs, in order of their ranks.

    `d` has each key's own value; `reads` has rows (key, other): key reads other's
    output.  A key's output is combine(own, aggregate(outputs that it reads)), and
    its own value if it reads none.  A round takes all keys whose others are known,
    so there are as many rounds as ranks.  Keys read each other in a circle, or read
    a key that `d` lacks: an error.  Keys are unique and not null."""
    reads = reads.select(F.col(key), F.col(other).alias("__o")).distinct()
    left = d.select(key, F.col(value).alias("__own"))
    done = checkpointed(left.join(reads.select(key).distinct(), key, "left_anti").select(key, F.col("__own").alias(value)))
    left = left.join(reads.select(key).distinct(), key, "left_semi")
    for _ in range(ranks):
        left = checkpointed(left)
        if left.isEmpty():
            return done
        seen = done.select(F.col(key).alias("__o"), F.col(value).alias("__x"), F.lit(True).alias("__known"))
        found = reads.join(left.select(key), key, "left_semi").join(seen, "__o", "left").groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.count("__known").alias("__k"), aggregate(F.col("__x")).alias("__agg"))
        ready = checkpointed(left.join(found.where("__n = __k"), key).select(key, combine(F.col("__own"), F.col("__agg")).alias(value)))
        if ready.isEmpty():
            raise ValueError("keys read each other in a circle, or a key is missing")
        done = done.unionByName(ready)  # each rank is written once
        left = left.join(ready.select(key), key, "left_anti")
    raise ValueError(f"more than {ranks} ranks")


# Services: shared sub-plans.


def subscription_service(requests: DataFrame, key: str, implementation: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each requester's rows of the key that it asks for; the implementation sees each key once."""
    return requests.join(implementation(requests.select(key).distinct()), key)


def request_reply_service(requests: DataFrame, identifier: str, implementation: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every request with its reply, or nulls; the implementation keeps the
    identifier.  Two replies to one identifier are an error."""
    replies = implementation(requests)
    more = [c for c in replies.columns if c not in requests.columns]
    n, r = free(requests, replies, count=2)
    one = replies.groupBy(identifier).agg(F.count(F.lit(1)).alias(n), F.first(F.struct(*more)).alias(r))
    checked = F.when(F.col(n) == 1, F.col(r)).otherwise(F.raise_error(F.lit("a request has several replies")))
    return requests.join(one.select(identifier, checked.alias(r)), identifier, "left").select(*requests.columns, *[F.col(r)[c].alias(c) for c in more])


def reference_service(implementation: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """One output for all clients: the implementation is asked once, and every client gets the same plan."""
    made: list[DataFrame] = []

    def client() -> DataFrame:
        if not made:
            made.append(implementation())
        return made[0]

    return client


# Statuses of several streams: the worst one, and each message once.

STATUSES = ("OK", "STALE", "WAITING", "ERROR", "FATAL")


def combine_statuses(*statuses: Column, order: Sequence[str] = STATUSES) -> Column:
    ranks = F.array(*[F.lit(x) for x in order])
    worst = F.greatest(*[F.array_position(ranks, s) for s in statuses]) if len(statuses) > 1 else F.array_position(ranks, statuses[0])
    return F.try_element_at(ranks, worst.cast("int"))


def combine_status_messages(*messages: Column, separator: str = "; ") -> Column:
    return F.array_join(F.array_distinct(F.filter(F.array(*messages), lambda m: m.isNotNull() & (m != ""))), separator)


# Overloads by the kinds of their arguments.


class Overloads:
    """A function with several forms; the form that names the most kinds wins, a tie is an error.
    A kind of None stands for any."""

    def __init__(self, name: str):
        self.name, self.forms = name, []

    def add(self, *kinds: str | None):
        def register(f):
            self.forms.append((kinds, f))
            return f

        return register

    def __call__(self, kinds: Sequence[str], *args, **named):
        fits = [(sum(k is not None for k in form), f) for form, f in self.forms if len(form) == len(kinds) and all(k in (None, x) for k, x in zip(form, kinds, strict=True))]
        if not fits:
            raise TypeError(f"{self.name} has no form for {', '.join(kinds)}")
        best = max(rank for rank, _ in fits)
        winners = [f for rank, f in fits if rank == best]
        if len(winners) > 1:
            raise TypeError(f"{self.name} is ambiguous for {', '.join(kinds)}")
        return winners[0](*args, **named)


def lift(function: Callable, returns: str) -> Callable[..., Column]:
    """A scalar Python function as a column function, run in Arrow batches.  Nulls reach it as None."""

    def lifted(*args: Column) -> Column:
        return apply_(function, returns, *args)

    return lifted


def apply_(function: Callable, returns: str, *args: Column) -> Column:
    """The function's value for each row; what it raises ends the query."""

    @F.pandas_udf(returns)
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series([function(*r) for r in zip(*[x[c].astype(object).where(x[c].notna(), None) for c in x.columns], strict=True)], dtype=object)

    return run(F.struct(*[a.alias(f"a{i}") for i, a in enumerate(args)]))
