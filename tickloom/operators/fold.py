"""Ordered state machines, for semantics that windows cannot express.

A key's rows are sorted by Spark within their partition (spilling to disk where
they must) and pass by once, so the state is all that is held in memory, however
many ticks a key has.  A lost executor's partitions are computed again from the
shuffle.  One key is one task: time, not memory, grows with a hot key.  Sums of
hot keys are better taken with `running_in_blocks`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .names import free
from .streams import Order

ROWS = 4096


def fold(
    s: DataFrame, order: Order, start: Callable[[], dict], step: Callable[[dict, object, list[dict]], Iterable[dict]], fields: list[T.StructField],
    finish: Callable[[dict], Iterable[dict]] | None = None,
) -> DataFrame:
    """`step(state, time, rows)` sees all rows of a key that share a time, in
    order, changes the state and returns rows of `fields`; `finish(state)` may
    return more after a key's last time.  The result has the keys and `fields`."""
    keys, time = list(order.keys), order.by[0]
    schema = T.StructType([s.schema[k] for k in keys] + fields)
    arrow = to_arrow_schema(schema)
    dealt = s.repartition(*keys) if keys else s.repartition(1)

    def run(batches):
        import pyarrow as pa

        rows = (r for b in batches for r in b.to_pylist())
        out = []
        for key, mine in groupby(rows, lambda r: tuple(r[k] for k in keys)):
            named, state = dict(zip(keys, key, strict=True)), start()
            for t, cycle in groupby(mine, itemgetter(time)):
                out.extend({**r, **named} for r in step(state, t, list(cycle)))
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            if finish:
                out.extend({**r, **named} for r in finish(state))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt.sortWithinPartitions(*keys, *order.by).mapInArrow(run, schema)


def _rest(s: DataFrame, order: Order) -> list[T.StructField]:
    return [f for f in s.schema.fields if f.name not in order.keys]


def ewma(s: DataFrame, order: Order, value: str, alpha: float, name: str = "ewma") -> DataFrame:
    """Exponentially weighted moving average; the first tick starts it.  Ticks without a value go."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha out of range")

    def step(state, _, rows):
        for r in rows:
            x, e = float(r[value]), state.get("e")
            state["e"] = x if e is None else alpha * x + (1 - alpha) * e
            yield r | {name: state["e"]}

    return fold(s.where(F.col(value).isNotNull()), order, dict, step, _rest(s, order) + [T.StructField(name, T.DoubleType())])


def throttle(s: DataFrame, order: Order, micros: int) -> DataFrame:
    """At most one tick a period: a tick opens a period, the last of the ticks
    up to its end (included) comes out at its end and opens the next one.  A
    period without ticks opens none."""
    import datetime

    time, span = order.by[0], datetime.timedelta(microseconds=micros)

    def step(state, t, rows):
        held, due = state.get("held"), state.get("due")
        if held is not None and t > due:
            yield held | {time: due}
            held, due = None, due + span
        if due is None or t >= due:
            yield rows[-1]
            state.update(held=None, due=t + span)
        else:
            state.update(held=rows[-1], due=due)

    def finish(state):
        if state.get("held") is not None:
            yield state["held"] | {time: state["due"]}

    return fold(s, order, dict, step, _rest(s, order), finish)


def batch(condition: DataFrame, s: DataFrame, order: Order, flag: str, value: str, delay: int, most: int | None = None, name: str = "values") -> DataFrame:
    """Lists of the values that queued up: each tick of a true condition sends
    them, and while it stays true a timer does, `delay` microseconds after the
    first tick that finds no timer running.  More than `most` waiting values are an error."""
    import datetime

    time, span = order.by[0], datetime.timedelta(microseconds=delay)
    kinds = dict(s.dtypes)[value], dict(condition.dtypes)[flag]
    c = condition.select(*order.keys, *order.by, F.col(flag).alias("__c"), F.lit(None).cast(kinds[0]).alias("__v"), F.lit(0).alias("__i"))
    v = s.select(*order.keys, *order.by, F.lit(None).cast(kinds[1]).alias("__c"), F.col(value).alias("__v"), F.lit(1).alias("__i"))

    def sent(state, t):
        values, state["queue"] = state["queue"], []
        if values:
            yield {time: t, name: values}

    def step(state, t, rows):
        due = state["due"]
        if due is not None and due < t:
            state["due"] = None
            if state["open"]:
                yield from sent(state, due)
        ticked = False
        for r in rows:
            if r["__i"] == 0:
                ticked, state["open"] = True, bool(r["__c"])
            else:
                if most is not None and len(state["queue"]) >= most:
                    raise OverflowError("too many values wait in a batch")
                state["queue"].append(r["__v"])
        now = state["due"] == t
        if now:
            state["due"] = None
        if state["open"]:
            if not now and not ticked and state["due"] is None:
                state["due"] = t + span
            if now or ticked:
                yield from sent(state, t)

    def finish(state):
        if state["due"] is not None and state["open"]:
            yield from sent(state, state["due"])

    fields = [s.schema[time], T.StructField(name, T.ArrayType(s.schema[value].dataType))]
    return fold(c.unionByName(v), order, lambda: {"open": False, "queue": [], "due": None}, step, fields, finish)


def running_in_blocks(s: DataFrame, order: Order, micros: int, **sums: str) -> DataFrame:
    """Running sums for keys too hot for one task: sums of blocks of `micros`
    (partial aggregation), a window over the blocks, and one within each block.
    No task sees more than one block's ticks, or a key's block totals."""
    time = order.by[0]
    us = F.col(time) if dict(s.dtypes)[time] == "bigint" else F.unix_micros(F.col(time).cast("timestamp"))
    s = s.withColumn("__b", F.floor(us / micros).cast("long"))
    at = [*order.keys, "__b"]
    totals = s.groupBy(*at).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*order.keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(at)], *[F.sum(f"__{n}").over(earlier).alias(f"__{n}") for n in sums])
    inside = order.so_far("__b")
    parts = s.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    same = F.lit(True)
    for i, k in enumerate(at):
        same = same & parts[k].eqNullSafe(base[f"__k{i}"])
    joined = parts.join(base, same, "left")
    whole = lambda n: F.when(F.col(n).isNull(), F.col(f"__{n}")).otherwise(F.col(n) + F.coalesce(F.col(f"__{n}"), F.lit(0)))
    return joined.select(*[c for c in s.columns if c != "__b"], *[whole(n).alias(n) for n in sums])


def lag_in_blocks(s: DataFrame, order: Order, micros: int, value: str, name: str = "before") -> DataFrame:
    """Each tick with the value of the tick before (null at a key's first), for
    keys too hot for one task: a window within each block of `micros`, and the
    last value of each block, by partial aggregation, carried to the next one."""
    time = order.by[0]
    us = F.col(time) if dict(s.dtypes)[time] == "bigint" else F.unix_micros(F.col(time).cast("timestamp"))
    block, first, carried, *names = free(s, count=4 + len(order.keys), other=[name])
    s = s.withColumn(block, F.floor(us / micros).cast("long"))
    at = [*order.keys, block]
    last = s.groupBy(*at).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order.by)).alias(carried))
    last = last.withColumn(carried, F.lag(carried).over(Window.partitionBy(*order.keys).orderBy(block)))
    last = last.select(*[F.col(k).alias(n) for k, n in zip(at, names, strict=True)], carried)
    same = F.lit(True)
    for k, n in zip(at, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    inside = order.window(block)
    out = s.withColumns({name: F.lag(value).over(inside), first: F.row_number().over(inside) == 1}).join(last, same, "left")
    return out.withColumn(name, F.when(F.col(first), F.col(carried)["v"]).otherwise(F.col(name))).drop(block, first, carried, *names)


def dedup_in_blocks(s: DataFrame, order: Order, micros: int, value: str) -> DataFrame:
    """`streams.dedup` for keys too hot for one task; null is not a value here, so ticks without one go."""
    (before,) = free(s)
    out = lag_in_blocks(s.where(F.col(value).isNotNull()), order, micros, value, before)
    return out.where(F.col(before).isNull() | (F.col(before) != F.col(value))).drop(before)


def feedback(s: DataFrame, order: Order, value: str, function: Callable, initial, field: T.StructField) -> DataFrame:
    """Each tick with function(value, the output of the tick before), from `initial` on."""

    def step(state, _, rows):
        for r in rows:
            state["x"] = function(r[value], state["x"])
            yield r | {field.name: state["x"]}

    return fold(s, order, lambda: {"x": initial}, step, _rest(s, order) + [field])


def compute_node(s: DataFrame, order: Order, function: Callable[[dict, dict], object], field: T.StructField, start: Callable[[], dict] = dict) -> DataFrame:
    """A node with state: `function(state, row)` for each tick of a key, in order,
    gives the output, or None for no tick.  Without state, `graph.lift` is faster."""

    def step(state, _, rows):
        for r in rows:
            x = function(state, r)
            if x is not None:
                yield r | {field.name: x}

    return fold(s, order, start, step, _rest(s, order) + [field])


def dedup_close(s: DataFrame, order: Order, value: str, tolerance: float = 1e-15) -> DataFrame:
    """Floats that differ from the last one that came out by more than the tolerance.
    A NaN after a NaN, and a null after a null, are repeats."""

    def step(state, _, rows):
        for r in rows:
            x, last = r[value], state.get("x", state)
            if last is state:
                new = True
            elif x is None or last is None:
                new = x is not last
            elif x != x or last != last:
                new = (x == x) or (last == last)
            else:
                new = x != last and not abs(x - last) <= tolerance
            if new:
                state["x"] = x
                yield r

    return fold(s, order, dict, step, _rest(s, order))
