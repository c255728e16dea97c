"""The names of the engine's operators, and operators that were given more of their meaning."""

from pyspark.sql import functions as F
from tickloom import api
from tickloom.functions import containers as C
from tickloom.operators import streams

from .test_streams import O, stream, ticks


def test_names():
    found = api.operators()
    assert len(found) > 200 and all(callable(f) for f in found.values())
    assert found["throttle"] is api.fold.throttle
    for name in api.ALIASES:
        assert name in found


def test_freeze_by_another_stream(spark):
    s = stream(spark, [(0, 1), (2, 2), (4, 3), (6, 4)])
    flag = lambda *x: stream(spark, x, "p", "boolean").withColumn("seq", F.lit(0).cast("long"))
    s = s.withColumn("seq", F.lit(0).cast("long"))
    assert ticks(streams.freeze_by(flag((1, False), (5, True)), s, O, "p", "v")) == [(2, 2), (4, 3), (5, 3)]
    assert ticks(streams.freeze_by(flag((2, False), (4, True)), s, O, "p", "v")) == [(2, 2), (4, 3)]
    assert ticks(streams.freeze_by(flag((2, True)), s, O, "p", "v")) == [(2, 2)]
    assert ticks(streams.freeze_by(flag(), s, O, "p", "v")) == []


def test_rolling_time_waits_for_its_least_span(spark):
    s = stream(spark, [(0, 1), (2, 2), (4, 3), (10, 4)])
    assert ticks(streams.rolling_time(s, O, 5, 4, t=F.sum("v")), "t") == [(4, 6)]


def test_nested_items(spark):
    a = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))
    assert spark.range(1).select(C.array_get_item(a, -1, 0), C.array_get_item(a, 0, 5)).first()[:] == (3, None)
