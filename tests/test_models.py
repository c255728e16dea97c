"""Schemas, metadata, single-value time arithmetic, and the ways to write a plan."""

import dataclasses
import datetime as dt
import enum

import pytest
from pyspark.sql import functions as F
from tickloom import api
from tickloom.functions import dates as D
from tickloom.functions import eager as E
from tickloom.operators import frames, graph, keyed, streams
from tickloom.operators.streams import Order
from tickloom.plans import authoring, models
from tickloom.streaming import sinks

T0 = dt.datetime(2024, 3, 10)
MICRO = dt.timedelta(microseconds=1)


class Side(enum.Enum):
    BUY = 1


@dataclasses.dataclass
class Leg:
    qty: int
    price: float | None


@dataclasses.dataclass
class Order_:
    id: int
    side: Side
    legs: list[Leg]
    tags: dict[str, str]
    at: dt.datetime | None = None


def test_schema_of_a_class(spark):
    s = models.schema_of(Order_)
    assert s.simpleString() == "struct<id:bigint,side:string,legs:array<struct<qty:bigint,price:double>>,tags:map<string,string>,at:timestamp>"
    assert [f.nullable for f in s.fields] == [False, False, False, False, True] and s["legs"].dataType.elementType["price"].nullable
    row = (1, "BUY", [(2, None)], {"a": "b"}, T0)
    assert spark.createDataFrame([row], s).first().legs[0].qty == 2
    with pytest.raises(TypeError):
        models.type_of(int | str)


def test_table_schema(spark):
    t = spark.createDataFrame([(T0, T0, "a", False, 1)], "date timestamp, as_of timestamp, k string, gone boolean, v long")
    s = models.table_schema(t, ["k"], ["gone"])
    assert s.keys == ("date", "as_of", "k", "gone", "v") and s.is_multi_row and s.shape().names == list(s.keys)
    with pytest.raises(ValueError):
        models.table_schema(t, ["other"])


def test_frame_metadata(spark, tmp_path):
    d = models.with_frame_metadata(spark.createDataFrame([(1, 2)], "a long, b long").withMetadata("a", {"own": 1}), Leg(3, 0.5))
    d.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert models.has_frame_metadata(back) and models.frame_metadata(back, Leg) == Leg(3, 0.5)
    bare = models.without_frame_metadata(back)
    assert not models.has_frame_metadata(bare) and models.frame_metadata(bare) is None and bare.schema["a"].metadata == {"own": 1}


def test_eager_times():
    at = dt.datetime(2024, 1, 31, 12, 7, 30)
    minute = dt.timedelta(minutes=15)
    assert (E.floor(at, minute), E.ceil(at, minute), E.round_(at, minute)) == (at.replace(minute=0, second=0), at.replace(minute=15, second=0), at.replace(minute=0, second=0))
    assert E.round_(at + minute, minute) == at.replace(minute=30, second=0)
    assert E.apply_period(at, months=1) == at.replace(month=2, day=29) and E.apply_period(at, years=1, months=1, days=1) == dt.datetime(2025, 3, 1, 12, 7, 30)
    assert E.checked_divide(-MICRO, 2) == -MICRO and E.checked_multiply(MICRO, 3) == 3 * MICRO and E.checked_negate(MICRO) == -MICRO
    for bad in (lambda: E.checked_add(dt.datetime.max, MICRO), lambda: E.checked_divide(MICRO, 0), lambda: E.floor(at, dt.timedelta(0))):
        with pytest.raises((OverflowError, ZeroDivisionError, ValueError)):
            bad()


def test_eager_zones_are_those_of_columns(spark):
    hours = [T0 + dt.timedelta(minutes=30 * i) for i in range(48)] + [dt.datetime(2024, 11, 3) + dt.timedelta(minutes=30 * i) for i in range(48)]
    us = lambda t: (t - E.EPOCH) // MICRO
    d = spark.createDataFrame([(us(t),) for t in hours], "us long")
    for overlap, gap in (("earlier", "forward"), ("later", "backward"), ("earlier", "null")):
        got = [tuple(r) for r in d.select("us", D.resolve_civil(F.col("us"), "America/New_York", overlap, gap), D.to_civil(F.col("us"), "America/New_York")).collect()]
        want = []
        for t in hours:
            x = E.resolve_civil(t, "America/New_York", overlap, gap)
            want.append((us(t), None if x is None else us(x), us(E.to_civil(t, "America/New_York"))))
        assert got == want


def test_eager_ranges():
    """Against the points that they hold, at half steps."""
    points = [T0 + i * MICRO * 5 for i in range(12)]
    some = [E.Range(T0 + a * 10 * MICRO, T0 + b * 10 * MICRO, i, j) for a in range(4) for b in range(4) for i in (True, False) for j in (True, False)]
    held = lambda *rs: {p for p in points if any(p in r for r in rs)}
    for a in some:
        for b in some:
            assert held(a.intersection(b)) == held(a) & held(b)
            assert held(*a.union(b)) == held(a) | held(b) and held(*a.difference(b)) == held(a) - held(b)
            assert a.overlaps(b) == bool(held(a) & held(b))
    assert E.bucket(T0 + MICRO, 10 * MICRO) == E.Range(T0, T0 + 10 * MICRO) and E.Range(T0, T0 + MICRO).shift(MICRO).extent() == MICRO


def test_binding_context_services_and_threads(spark):
    later = authoring.DelayedBinding("later")
    with pytest.raises(LookupError):
        later()
    later.bind(spark.range(3))
    assert later().count() == 3
    with pytest.raises(ValueError):
        later.bind(spark.range(1))
    with authoring.context("rate", 1), authoring.context("rate", 2):
        assert authoring.in_context("rate") == 2
    with pytest.raises(LookupError):
        authoring.in_context("rate")
    services = authoring.Services()
    services.register("sum", lambda a, b: a + b)
    assert services("sum", 1, 2) == 3
    with pytest.raises(ValueError):
        services.register("sum", max)
    assert authoring.side_by_side([lambda n=n: spark.range(n).count() for n in range(5)], 2) == [0, 1, 2, 3, 4]
    sent = []
    echo = authoring.Adaptor(lambda s: s.range(len(sent)), lambda d: sent.extend(d.collect()))
    assert echo.exchange(spark.range(4)).count() == 4


def test_services_answer_once(spark):
    calls = []
    client = graph.reference_service(lambda: calls.append(1) or spark.range(2))
    assert client() is client() and calls == [1]
    requests = spark.createDataFrame([(1, "a"), (2, "b")], "id long, q string")
    twice = lambda d: d.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("x"))
    with pytest.raises(Exception, match="several replies"):
        graph.request_reply_service(requests, "id", twice).collect()


def test_columns_of_any_name_stay(spark):
    o = Order(("k",), ("t",))
    names = ["_p", "_l", "_b", "_v", "_i", "_w", "_r", "_k", "_s", "_n", "__0", "__1", "segment"]
    d = spark.createDataFrame([("a", i, i % 3, i == 2) for i in range(6)], "k string, t long, v long, r boolean").withColumns({n: F.lit(n) for n in names})
    kept = (
        streams.lag(d, o, "v", 1), streams.dedup(d, o, "v"), streams.take(d, o, 2), streams.take(d, o, 2, "r"), streams.drop(d, o, 1), streams.step(d, o, 2), streams.slice_(d, o, 1, 4), streams.improving(d, o, "v", True), streams.diff(d, o, "v"),
        streams.pct_change(d, o, "v"), streams.until_true(d, o, "r"), streams.freeze(d, o, "r"), streams.window(d, o, "v", 2), streams.merge([d, d], o), streams.race([d, d], o), streams.running(d, o, "r", total=F.sum("v")), streams.rolling(d, o, 2, total=F.sum("v")),
        streams.rolling_std(d, o, "v", 2), keyed.snapshot(d, ["k"], ["t"]), keyed.merge_disjoint([d, d], "k"), keyed.top_by_key(d, ["k"], [F.col("t")], 1), streams.request_id(d, ["k"]),
    )
    for out in kept:
        r = out.first()
        assert set(d.columns) <= set(out.columns) and all(r[n] == n for n in names)
    assert [c for c in kept[0].columns if c not in d.columns] == ["lagged"]


def test_clip_min_max_of_nothing(spark):
    d = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (9.0, 1.0), (-9.0, 1.0), (2.0, 3.0)], "x double, y double")
    got = d.select(streams.clip(F.col("x"), 0.0, 5.0), api.arithmetic.min_(F.col("x"), F.col("y")), api.arithmetic.max_(F.col("x"), F.col("y")), api.arithmetic.min_(F.col("x"), F.col("y"), default=F.lit(7.0))).collect()
    assert got[0][:] == (None, None, None, 7.0) and got[1][0] != got[1][0] and [r[0] for r in got[2:]] == [5.0, 0.0, 2.0] and got[4][1:3] == (2.0, 3.0)


def test_late_batches_are_errors(spark):
    at = lambda i: T0 + i * MICRO
    frame = lambda *ts: spark.createDataFrame([(at(t), t) for t in ts], "t timestamp, v long")
    assert sorted(r.value for r in frames.from_frame_batches([frame(1, 2), frame(2, 5), frame(6)], "t", "v").collect()) == [1, 2, 2, 5, 6]
    with pytest.raises(Exception, match="after its first row"):
        frames.from_frame_batches([frame(1, 4), frame(3)], "t", "v").collect()


def test_call_reaches_every_row(spark, tmp_path):
    path = str(tmp_path)

    def touch(i):
        open(f"{path}/{i}", "w").close()

    sinks.call(spark.range(5), touch, F.col("id"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0", "1", "2", "3", "4"]


def test_long_gaps_and_maps(spark):
    s = spark.createDataFrame([("a", T0, 1, 1), ("a", T0 + dt.timedelta(seconds=20_000), 2, 2)], "k string, ts timestamp, seq long, v long")
    r = streams.resample(s, Order(("k",), ("ts", "seq")), "v", 1_000_000)
    assert r.count() == r.select("ts").distinct().count() == 20_001 and r.agg(F.sum("v")).first()[0] == 20_002
    m = spark.range(1).select(api.convert.combine_map(F.array(*map(F.lit, [3, 1, 3, 2])), F.array(*map(F.lit, "abcd"))).alias("m"), api.containers.cumulative_sum(F.array(F.lit(1.0), F.lit(2.0))).alias("c")).first()
    assert m.m == {1: "b", 3: "c", 2: "d"} and m.c == [1.0, 3.0]
