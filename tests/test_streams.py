"""Stream operators that SQL can't express, and their edges, on small streams."""

import datetime as dt

from pyspark.sql import functions as F
from tickloom.functions import scalar as S
from tickloom.operators import fold, streams
from tickloom.operators.streams import Order

O = Order(keys=("k",), by=("ts", "seq"))
T0 = dt.datetime(2024, 1, 1)


def at(us):
    return T0 + dt.timedelta(microseconds=us)


def stream(spark, values, name="v", kind="long"):
    return spark.createDataFrame([("a", at(t), i, v) for i, (t, v) in enumerate(values)], f"k string, ts timestamp, seq long, {name} {kind}")


def ticks(df, name="v"):
    return sorted(((r.ts - T0).microseconds, r[name]) for r in df.collect())


def test_dedup(spark):
    s = stream(spark, enumerate([7, 7, None, None, 5, 7, 5, 5]))
    assert ticks(streams.dedup(s, O, "v")) == [(0, 7), (2, None), (4, 5), (5, 7), (6, 5)]


def test_throttle(spark):
    s = stream(spark, [(0, 1), (1, 2), (2, 3), (9, 4)])
    assert ticks(fold.throttle(s, O, 4)) == [(0, 1), (4, 3), (9, 4)]


def test_gate(spark):
    c = stream(spark, [(0, False), (2, True)], "c", "boolean")
    s = stream(spark, [(0, 1), (1, 2), (4, 3), (5, 4)])
    assert ticks(streams.gate(c, s, O, "c", "v")) == [(2, 1), (3, 2), (4, 3), (5, 4)]


def test_filter_by_reopens_with_latest(spark):
    c = stream(spark, [(0, True), (1, False), (3, True), (4, True)], "c", "boolean")
    s = stream(spark, [(0, 1), (1, 2), (2, 3), (5, 4)])
    assert ticks(streams.filter_by(c, s, O, "c", "v")) == [(0, 1), (3, 3), (5, 4)]


def test_freeze(spark):
    s = stream(spark, enumerate([None, False, False, True, False, True]), "p", "boolean")
    assert ticks(streams.freeze(s, O, "p"), "p") == [(1, False), (2, False), (3, True)]


def test_window(spark):
    s = stream(spark, enumerate([1, 2, None, 4]))
    got = streams.window(s, O, "v", 3, 2).orderBy("seq").collect()
    assert [(r.buffer, [(t - T0).microseconds for t in r["index"]]) for r in got] == [([1, 2], [0, 1]), ([1, 2, None], [0, 1, 2]), ([2, None, 4], [1, 2, 3])]


def test_ewma(spark):
    s = stream(spark, enumerate([10, 20]))
    assert [round(v, 6) for _, v in ticks(fold.ewma(s, O, "v", 0.5, "e"), "e")] == [10, 15]


def test_rounding(spark):
    r = spark.range(1).select(*[S.temporal_round(F.lit(x), 10).alias(f"c{i}") for i, x in enumerate((4, 5, 15, 16, -5))]).first()
    assert list(r) == [0, 0, 20, 20, 0]


def test_empty(spark):
    s = stream(spark, [(0, 1)]).where("false")
    for df in (streams.dedup(s, O, "v"), streams.take(s, O, 2), fold.throttle(s, O, 4), streams.merge([s, s], O), streams.race([s, s], O), fold.ewma(s, O, "v", 0.5)):
        assert df.count() == 0
