"""Stream operators.

A stream is a DataFrame with one row for each tick.  `Order` names its key
columns and its order (time, then a sequence number).  All operators add the
keys to the window's partitioning, so keyed streams run in parallel, and a
stream without keys is one window: give it keys where it is large, or take its
sums with `operators.fold.running_in_blocks`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .names import free


#: Slots of a gap that one row holds.
GAP = 4096


@dataclass(frozen=True)
class Order:
    """The key and order columns of a stream."""

    keys: Sequence[str] = ()
    by: Sequence[str] = field(default=("ts", "seq"))

    def window(self, *extra: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *extra).orderBy(*self.by)

    def so_far(self, *extra: str) -> WindowSpec:
        return self.window(*extra).rowsBetween(Window.unboundedPreceding, 0)

    def last_rows(self, n: int, *extra: str) -> WindowSpec:
        return self.window(*extra).rowsBetween(1 - n, 0)

    def last_time(self, micros: int, *extra: str) -> WindowSpec:
        time = F.unix_micros(F.col(self.by[0]).cast("timestamp"))
        return Window.partitionBy(*self.keys, *extra).orderBy(time).rangeBetween(-micros, 0)


def position(order: Order) -> Column:
    """The number of the tick, from 0."""
    return F.row_number().over(order.window()) - 1


def lag(s: DataFrame, order: Order, value: str, n: int, name: str = "lagged") -> DataFrame:
    """Each tick with the value n ticks before; the first n ticks go."""
    (p,) = free(s, other=[name])
    before, at = F.lag(value, n).over(order.window()), position(order)
    return s.withColumns({p: at, name: before}).where(F.col(p) >= n).drop(p)


def lag_time(s: DataFrame, order: Order, micros: int) -> DataFrame:
    """Every tick again, so much later."""
    t = order.by[0]
    return s.withColumn(t, F.timestamp_micros(F.unix_micros(F.col(t).cast("timestamp")) + micros))


def dedup(s: DataFrame, order: Order, value: str) -> DataFrame:
    """Ticks whose value differs from the one before."""
    (p,) = free(s)
    last = F.lag(F.struct(F.col(value).alias("v"))).over(order.window())
    return s.withColumn(p, last).where(F.col(p).isNull() | ~F.equal_null(F.col(p)["v"], F.col(value))).drop(p)


def _at(s: DataFrame, order: Order, keep) -> DataFrame:
    """The ticks whose position passes."""
    (p,) = free(s)
    return s.withColumn(p, position(order)).where(keep(F.col(p))).drop(p)


def take(s: DataFrame, order: Order, n: int, reset: str | None = None) -> DataFrame:
    """The first n ticks, anew after each reset."""
    if not reset:
        return _at(s, order, lambda p: p < n)
    segment, p = free(s, count=2)
    return segments(s, order, reset, segment).withColumn(p, F.row_number().over(order.window(segment))).where(F.col(p) <= n).drop(p, segment)


def drop(s: DataFrame, order: Order, n: int) -> DataFrame:
    return _at(s, order, lambda p: p >= n)


def drop_time(s: DataFrame, order: Order, micros: int) -> DataFrame:
    """Ticks more than so long after the first."""
    (p,) = free(s)
    t = F.unix_micros(F.col(order.by[0]).cast("timestamp"))
    first = F.min(t).over(Window.partitionBy(*order.keys))
    return s.withColumn(p, t - first).where(F.col(p) > micros).drop(p)


def step(s: DataFrame, order: Order, n: int) -> DataFrame:
    return _at(s, order, lambda p: p % n == 0)


def slice_(s: DataFrame, order: Order, start: int, stop: int | None, stride: int = 1) -> DataFrame:
    return _at(s, order, lambda p: (p >= start) & ((p - start) % stride == 0) & (F.lit(True) if stop is None else p < stop))


def segments(s: DataFrame, order: Order, reset: str, name: str = "segment") -> DataFrame:
    """Number the stretches that start at each tick where `reset` is true."""
    return s.withColumn(name, F.sum(F.coalesce(F.col(reset), F.lit(False)).cast("int")).over(order.so_far()))


def running(s: DataFrame, order: Order, reset: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates over all ticks so far, anew after each reset."""
    (segment,) = free(s, other=aggregates)
    if reset:
        s = segments(s, order, reset, segment)
    w = order.so_far(*[segment] if reset else [])
    return s.withColumns({name: c.over(w) for name, c in aggregates.items()}).drop(segment)


def count(s: DataFrame, order: Order, reset: str | None = None, name: str = "count") -> DataFrame:
    """How many ticks so far, anew after each reset."""
    return running(s, order, reset, **{name: F.count(F.lit(1))})


def accumulate(s: DataFrame, order: Order, value: str, reset: str | None = None, name: str = "accumulated") -> DataFrame:
    """The sum of the values so far."""
    return running(s, order, reset, **{name: F.sum(value)})


def average(s: DataFrame, order: Order, value: str, reset: str | None = None, name: str = "average") -> DataFrame:
    """The mean of the values so far."""
    return running(s, order, reset, **{name: F.avg(value)})


def improving(s: DataFrame, order: Order, value: str, largest: bool, name: str = "extreme") -> DataFrame:
    """Running minimum or maximum; a tick for each new one."""
    (p,) = free(s)
    before = (F.max if largest else F.min)(value).over(order.window().rowsBetween(Window.unboundedPreceding, -1))
    better = F.col(value) > F.col(p) if largest else F.col(value) < F.col(p)
    return s.withColumn(p, before).where(F.col(p).isNull() | better).drop(p).withColumn(name, F.col(value))


def rolling(s: DataFrame, order: Order, n: int, least: int | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates of the last n ticks, from the least-th tick on (default n)."""
    (p,) = free(s, other=aggregates)
    w = order.last_rows(n)
    out = s.withColumns({p: position(order)} | {name: c.over(w) for name, c in aggregates.items()})
    return out.where(F.col(p) >= (least or n) - 1).drop(p)


def rolling_mean(s: DataFrame, order: Order, value: str, n: int, least: int | None = None, name: str = "mean") -> DataFrame:
    return rolling(s, order, n, least, **{name: F.avg(value)})


def rolling_var(s: DataFrame, order: Order, value: str, n: int, least: int | None = None, ddof: int = 0, name: str = "var") -> DataFrame:
    """The variance of the last n ticks."""
    (p,) = free(s)
    return rolling(s, order, n, least, **{p: (F.var_pop if ddof == 0 else F.var_samp)(value)}).withColumn(name, F.coalesce(p, F.lit(float("nan")))).drop(p)


def rolling_std(s: DataFrame, order: Order, value: str, n: int, least: int | None = None, ddof: int = 0, name: str = "std") -> DataFrame:
    """The deviation of the last n ticks."""
    return rolling_var(s, order, value, n, least, ddof, name).withColumn(name, F.sqrt(name))


def rolling_time(s: DataFrame, order: Order, micros: int, least_micros: int = 0, **aggregates: Column) -> DataFrame:
    """Aggregates of the ticks of the last so many microseconds, both ends
    included, once a window's first and last tick are `least_micros` apart."""
    w = order.last_time(micros)
    out = s.withColumns({name: c.over(w) for name, c in aggregates.items()})
    if least_micros <= 0:
        return out
    t = F.unix_micros(F.col(order.by[0]).cast("timestamp"))
    (p,) = free(out)
    return out.withColumn(p, t - F.min(t).over(w)).where(F.col(p) >= least_micros).drop(p)


def diff(s: DataFrame, order: Order, value: str, name: str = "diff") -> DataFrame:
    (p,) = free(s)
    return lag(s, order, value, 1, p).withColumn(name, F.col(value) - F.col(p)).drop(p)


def pct_change(s: DataFrame, order: Order, value: str, n: int = 1, name: str = "pct_change") -> DataFrame:
    (p,) = free(s)
    return lag(s, order, value, n, p).withColumn(name, F.try_divide(F.col(value) - F.col(p), F.col(p))).drop(p)


def clip(value: Column, low, high) -> Column:
    """Null stays null and NaN stays NaN."""
    if low > high:
        raise ValueError("the lower bound is above the upper")
    return F.when(value < low, F.lit(low)).when((value > high) & ~F.isnan(value), F.lit(high)).otherwise(value)


def until_true(s: DataFrame, order: Order, predicate: str) -> DataFrame:
    """All ticks up to the first where the predicate holds."""
    before = F.sum(F.coalesce(F.col(predicate), F.lit(False)).cast("int")).over(order.window().rowsBetween(Window.unboundedPreceding, -1))
    (p,) = free(s)
    return s.withColumn(p, F.coalesce(before, F.lit(0))).where(F.col(p) == 0).drop(p)


def freeze(s: DataFrame, order: Order, predicate: str) -> DataFrame:
    """Ticks from the first with a predicate to the first where it is true, which is the last."""
    before = order.window().rowsBetween(Window.unboundedPreceding, -1)
    known = F.count(predicate).over(order.so_far()) > 0
    ended = F.coalesce(F.max(predicate).over(before), F.lit(False))
    (p,) = free(s)
    return s.withColumn(p, known & ~ended).where(F.col(p)).drop(p)


def window(s: DataFrame, order: Order, value: str, n: int, least: int | None = None) -> DataFrame:
    """The last n values (`buffer`) and their times (`index`), once there are `least` (n) of them."""
    if n < 1:
        raise ValueError("a window has at least one tick")
    ticks = F.collect_list(F.struct(F.col(order.by[0]).alias("t"), F.col(value).alias("v"))).over(order.last_rows(n))
    (p,) = free(s)
    out = s.withColumn(p, ticks).where(F.size(p) >= (n if least is None else least))
    return out.withColumn("buffer", F.col(p)["v"]).withColumn("index", F.col(p)["t"]).drop(p)


def combine_latest(a: DataFrame, b: DataFrame, order: Order, a_value: str, b_value: str, all_valid: bool = True, passive: str | None = None) -> DataFrame:
    """One tick whenever either input ticks, with the latest value of both; a
    tick of `passive` (the value's name) alone gives none.  The inputs share the
    names of their keys and order columns.  As a union and one sort: no join,
    and one shuffle on the keys."""
    side, after, active = free(a, b, count=3)
    both = a.select(*order.keys, *order.by, F.col(a_value), F.lit(None).cast(dict(b.dtypes)[b_value]).alias(b_value), F.lit(0).alias(side)).unionByName(
        b.select(*order.keys, *order.by, F.lit(None).cast(dict(a.dtypes)[a_value]).alias(a_value), F.col(b_value), F.lit(1).alias(side)))
    line = Window.partitionBy(*order.keys).orderBy(*order.by, side)
    w = line.rowsBetween(Window.unboundedPreceding, 0)
    last = {a_value: F.last(a_value, ignorenulls=True).over(w), b_value: F.last(b_value, ignorenulls=True).over(w), after: F.lead(F.struct(*order.by)).over(line)}
    if passive:
        # a cycle's rows are side by side: the last one knows whether the other input ticked in it
        mine = F.col(side) == (1 if passive == a_value else 0)
        last[active] = mine | F.coalesce(F.lag(F.struct(*order.by, mine.alias("m"))).over(line) == F.struct(*order.by, F.lit(True).alias("m")), F.lit(False))
    out = both.withColumns(last).where(F.col(after).isNull() | (F.col(after) != F.struct(*order.by)))
    out = (out.where(F.col(active)) if passive else out).select(*order.keys, *order.by, a_value, b_value)
    return out.where(F.col(a_value).isNotNull() & F.col(b_value).isNotNull()) if all_valid else out


def sample(signal: DataFrame, s: DataFrame, order: Order, value: str) -> DataFrame:
    """At each tick of the signal the latest value of s (none before its first)."""
    (p,) = free(signal, s)
    both = signal.select(*order.keys, *order.by, F.lit(None).cast(dict(s.dtypes)[value]).alias(value), F.lit(True).alias(p)).unionByName(s.select(*order.keys, *order.by, value, F.lit(False).alias(p)))
    w = Window.partitionBy(*order.keys).orderBy(*order.by, p).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where(F.col(p) & F.col(value).isNotNull()).drop(p)


def filter_by(condition: DataFrame, s: DataFrame, order: Order, flag: str, value: str) -> DataFrame:
    """Ticks of s while the latest condition holds, and the latest value of s
    when the condition turns true after s has ticked under a false one."""
    i, c, v, o, new, was, shown = free(condition, s, count=7)
    both = condition.select(*order.keys, *order.by, F.col(flag), F.lit(None).cast(dict(s.dtypes)[value]).alias(value), F.lit(0).alias(i)).unionByName(s.select(*order.keys, *order.by, F.lit(None).cast("boolean").alias(flag), value, F.lit(1).alias(i)))
    line = Window.partitionBy(*order.keys).orderBy(*order.by, i)
    w = line.rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({c: F.last(flag, ignorenulls=True).over(w), v: F.last(value, ignorenulls=True).over(w)})
    out = out.withColumn(o, F.coalesce(F.col(c), F.lit(False)))
    out = out.withColumn(new, F.sum(F.when((F.col(i) == 1) & ~F.col(o), 1).otherwise(0)).over(w))
    out = out.withColumn(was, F.coalesce(F.lag(o).over(line), F.lit(False)))
    seen = F.coalesce(F.max(F.when(F.col(o) & F.col(v).isNotNull(), F.col(new))).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn(shown, seen)
    opens = (F.col(i) == 0) & F.col(o) & ~F.col(was) & (F.col(new) > F.col(shown)) & F.col(v).isNotNull()
    return out.where((F.col(o) & (F.col(i) == 1)) | opens).select(*order.keys, *order.by, F.col(v).alias(value))


def _numbered(streams: Sequence[DataFrame], name: str) -> DataFrame:
    """All ticks, with the number of their input."""
    out = None
    for i, s in enumerate(streams):
        s = s.withColumn(name, F.lit(i))
        out = s if out is None else out.unionByName(s)
    return out


def merge(streams: Sequence[DataFrame], order: Order) -> DataFrame:
    """All ticks; where several inputs tick at once, the first input's."""
    i, r = free(*streams, count=2)
    w = Window.partitionBy(*order.keys, *order.by).orderBy(i)
    return _numbered(streams, i).withColumn(r, F.row_number().over(w)).where(F.col(r) == 1).drop(r, i)


def race(streams: Sequence[DataFrame], order: Order) -> DataFrame:
    """Per key the ticks of the input that ticked first (the earlier one of equals)."""
    i, r = free(*streams, count=2)
    winner = F.min(F.struct(*order.by, F.col(i).alias("input"))).over(Window.partitionBy(*order.keys))
    return _numbered(streams, i).withColumn(r, winner).where(F.col(r)["input"] == F.col(i)).drop(r, i)


def if_then_else(condition: str, then: Column, otherwise: Column) -> Column:
    return F.when(F.col(condition), then).otherwise(otherwise)


def resample(s: DataFrame, order: Order, value: str, micros: int) -> DataFrame:
    """The latest value at each multiple of the period from the first one at
    or after a key's first tick up to its last tick.  The latest value of each
    period is found by aggregation, so the window runs over periods, not ticks."""
    t = F.unix_micros(F.col(order.by[0]).cast("timestamp"))
    slot = F.ceil(t / micros).cast("long")
    last = s.groupBy(*order.keys, slot.alias("slot")).agg(F.max_by(value, F.struct(*order.by)).alias(value))
    following = F.lead("slot").over(Window.partitionBy(*order.keys).orderBy("slot"))
    # a long gap is filled in two steps, so that no row holds more than GAP slots
    stop = F.coalesce(following, F.col("slot") + 1) - 1
    out = last.withColumn("__stop", stop).withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("__stop"), F.lit(GAP))))
    out = out.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.least(F.col("slot") + GAP - 1, F.col("__stop")))))
    return out.select(*order.keys, F.timestamp_micros(F.col("slot") * micros).alias(order.by[0]), value)


def gate(condition: DataFrame, s: DataFrame, order: Order, flag: str, value: str) -> DataFrame:
    """Ticks of s; those under a false condition wait until it turns true and
    then follow one microsecond apart, in order."""
    i, o, opened, nth, left = free(condition, s, count=5)
    both = condition.select(*order.keys, *order.by, F.col(flag), F.lit(None).cast(dict(s.dtypes)[value]).alias(value), F.lit(0).alias(i)).unionByName(s.select(*order.keys, *order.by, F.lit(None).cast("boolean").alias(flag), value, F.lit(1).alias(i)))
    line = Window.partitionBy(*order.keys).orderBy(*order.by, i)
    t = F.unix_micros(F.col(order.by[0]).cast("timestamp"))
    out = both.withColumn(o, F.coalesce(F.last(flag, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    opens = F.first(F.when((F.col(i) == 0) & F.col(o), t), ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn(opened, F.when(F.col(o), t).otherwise(opens)).where((F.col(i) == 1) & F.col(opened).isNotNull())
    # the k-th waiting tick leaves k microseconds after the opening, never before its predecessor
    k = F.row_number().over(Window.partitionBy(*order.keys).orderBy(*order.by)) - 1
    out = out.withColumn(nth, k)
    leave = F.max(F.col(opened) - F.col(nth)).over(Window.partitionBy(*order.keys).orderBy(*order.by).rowsBetween(Window.unboundedPreceding, 0)) + F.col(nth)
    return out.withColumn(left, leave).select(*order.keys, F.timestamp_micros(left).alias(order.by[0]), *order.by[1:], value)


def schedule(spark, start: str, count: int, micros: int) -> DataFrame:
    """A true signal at each period."""
    return spark.range(count).select(F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.col("id") * micros).alias("ts"), F.col("id").alias("seq"), F.lit(True).alias("signal"))


def window_values(s: DataFrame, order: Order, value: str, n: int, least: int | None = None, pad=0) -> DataFrame:
    """`buffer` always has n values: the missing ones of the first windows are `pad`, at the end."""
    out = window(s, order, value, n, least).drop("index")
    kind = dict(s.dtypes)[value]
    return out.withColumn("buffer", F.concat("buffer", F.array_repeat(F.lit(pad).cast(kind), F.lit(n) - F.size("buffer"))))


def modified(s: DataFrame, order: Order, name: str = "modified") -> DataFrame:
    """True at each time with a tick, and false a microsecond later unless there is a tick then.
    The start's own false is left out, as a batch has no start."""
    t = order.by[0]
    us = F.col(t) if dict(s.dtypes)[t] == "bigint" else F.unix_micros(F.col(t).cast("timestamp"))
    times = s.select(*order.keys, us.alias("__u")).distinct()
    times = times.withColumn("__n", F.lead("__u").over(Window.partitionBy(*order.keys).orderBy("__u")))
    pulse = F.struct(F.col("__u").alias("u"), F.lit(True).alias("m"))
    end = F.struct((F.col("__u") + 1).alias("u"), F.lit(False).alias("m"))
    both = F.when(F.col("__n") == F.col("__u") + 1, F.array(pulse)).otherwise(F.array(pulse, end))
    out = times.select(*order.keys, F.explode(both).alias("__x"))
    back = F.col("__x.u") if dict(s.dtypes)[t] == "bigint" else F.timestamp_micros("__x.u")
    return out.select(*order.keys, back.alias(t), F.col("__x.m").alias(name))


def time_in_range(s: DataFrame, order: Order, start: str, end: str, name: str = "in_range") -> DataFrame:
    """LT, EQ or GT for a time before, in or after [start, end]: at each tick of
    the bounds, and when time itself reaches the start or passes the end before
    the key's next tick.  The order's first column and the bounds are microseconds (bigint).
    A start after its end is an error."""
    t = F.col(order.by[0])
    s = s.withColumn("__n", F.lead(order.by[0]).over(order.window()))
    ahead = lambda x: (x > t) & (F.col("__n").isNull() | (x < F.col("__n")))
    times = F.array(t, F.when(ahead(F.col(start)), F.col(start)), F.when(ahead(F.col(end) + 1), F.col(end) + 1))
    s = s.withColumn("__t", F.explode(F.array_distinct(F.array_compact(times))))
    at = F.col("__t")
    result = F.when(F.col(start) > F.col(end), F.raise_error(F.lit("a range starts after its end")).cast("string")).when(at < F.col(start), "LT").when(at <= F.col(end), "EQ").otherwise("GT")
    return s.withColumn(name, result).withColumn(order.by[0], at).drop("__t", "__n")


def freeze_by(predicate: DataFrame, s: DataFrame, order: Order, flag: str, value: str) -> DataFrame:
    """Ticks of s from the first predicate on until a true one.  At a true
    predicate the latest value of s comes out, as the last tick, if it has one.
    Keys and order name a tick; of several with the same, a true predicate and
    the largest value count."""
    both = predicate.select(*order.keys, *order.by, F.col(flag), F.lit(None).cast(dict(s.dtypes)[value]).alias(value)).unionByName(s.select(*order.keys, *order.by, F.lit(None).cast("boolean").alias(flag), value))
    cycles = both.groupBy(*order.keys, *order.by).agg(F.max(flag).alias(flag), F.max(value).alias(value))
    known, ended, v = free(cycles, count=3)
    so_far, before = order.so_far(), order.window().rowsBetween(Window.unboundedPreceding, -1)
    out = cycles.withColumns({known: F.count(flag).over(so_far) > 0, ended: F.coalesce(F.max(flag).over(before), F.lit(False)), v: F.last(value, ignorenulls=True).over(so_far)})
    shown = F.col(value).isNotNull() | F.coalesce(F.col(flag), F.lit(False))
    return out.where(F.col(known) & ~F.col(ended) & shown & F.col(v).isNotNull()).select(*order.keys, *order.by, F.col(v).alias(value))


def request_id(s: DataFrame, by: Sequence[str], name: str = "request_id") -> DataFrame:
    """A whole number for each distinct `by`, different from all others of the
    frame and the same whenever the frame is read again: partitions count apart."""
    from ..sources.shared import checkpointed

    ids = checkpointed(s.select(*by).distinct().withColumn(name, F.monotonically_increasing_id()))
    (k,) = free(s, other=[name])
    same = F.lit(True)
    right = ids.select(F.struct(*by).alias(k), name)
    for c in by:
        same = same & s[c].eqNullSafe(right[k][c])
    return s.join(right, same).drop(k)
