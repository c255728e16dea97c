"""Zones, ranges, array statistics, recordings and live streams against plain Python."""

import datetime as dt
import statistics
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F
from tickloom.functions import containers as C
from tickloom.functions import dates as D
from tickloom.operators import control
from tickloom.operators.streams import Order
from tickloom.sources import recording
from tickloom.streaming import live

UTC, ZONE = dt.timezone.utc, "America/New_York"
EPOCH = dt.datetime(1970, 1, 1)


def us(t):
    return (t.replace(tzinfo=None) - EPOCH) // dt.timedelta(microseconds=1)


def test_civil_times_around_both_clock_changes(spark):
    hours = [dt.datetime(2024, m, d, h, 30) for m, d in ((3, 10), (11, 3), (7, 1)) for h in range(5)]
    rows = spark.createDataFrame([(us(t),) for t in hours], "c long")
    for overlap, fold in (("earlier", 0), ("later", 1)):
        got = {r.c: r.i for r in rows.select("c", D.resolve_civil(F.col("c"), ZONE, overlap, "null").alias("i")).collect()}
        for t in hours:
            instant = t.replace(tzinfo=ZoneInfo(ZONE), fold=fold).astimezone(UTC)
            shown = instant.astimezone(ZoneInfo(ZONE)).replace(tzinfo=None) == t
            assert got[us(t)] == (us(instant) if shown else None)
    gap = us(dt.datetime(2024, 3, 10, 2, 30))
    forward, backward = spark.range(1).select(*[D.to_civil(D.resolve_civil(F.lit(gap), ZONE, gap=g), ZONE) for g in ("forward", "backward")]).first()
    assert (forward - gap, backward - gap) == (3_600_000_000, -3_600_000_000)
    with pytest.raises(ValueError):
        D.resolve_civil(F.lit(0), ZONE, gap="unknown")


def test_iso_and_parts_before_the_epoch(spark):
    times = [dt.datetime(1969, 12, 31, 23, 59, 59, 7), dt.datetime(2024, 2, 29), dt.datetime(1900, 1, 1, 1)]
    for t in times:
        c = F.lit(us(t))
        assert spark.range(1).select(D.isoformat(c)).first()[0] == t.isoformat()
        assert list(spark.range(1).select(D.weekday(c), D.isoweekday(c), D.hour(c), D.microsecond(c)).first()) == [t.weekday(), t.isoweekday(), t.hour, t.microsecond]


def test_ranges_hold_the_right_points(spark):
    flags = [(x, y) for x in (True, False) for y in (True, False)]
    bounds = [(lo, hi, *f) for lo, hi in ((0, 4), (2, 6), (4, 8), (2, 2)) for f in flags]
    pairs = spark.createDataFrame([(a, b) for a in bounds for b in bounds], "a struct<lo:long,hi:long,li:boolean,ri:boolean>, b struct<lo:long,hi:long,li:boolean,ri:boolean>")
    parts = lambda n: tuple(F.col(f"{n}.{f}") for f in ("lo", "hi", "li", "ri"))
    a, b = parts("a"), parts("b")
    holds = lambda r, x: (r[0] < x < r[1]) or (x == r[0] and x == r[1] and r[2] and r[3]) or (r[0] < r[1] and ((x == r[0] and r[2]) or (x == r[1] and r[3])))
    for row in pairs.select("a", "b", D.range_union(a, b).alias("u"), D.range_difference(a, b).alias("d")).collect():
        for x in [i / 2 for i in range(-2, 20)]:
            in_a, in_b = holds(row.a, x), holds(row.b, x)
            assert any(holds(r, x) for r in row.u) == (in_a or in_b), row
            assert any(holds(r, x) for r in row.d) == (in_a and not in_b), row


def test_array_statistics(spark):
    x, y = [3.0, 1.0, 4.0, 1.0, 5.0], [2.0, 7.0, 1.0, 8.0, 2.0]
    s = spark.createDataFrame([(x, y)], "x array<double>, y array<double>")
    a, b = F.col("x"), F.col("y")
    got = s.select(C.array_std(a), C.array_std(a, True), C.correlation(a, b), C.quantile(a, 0.3), C.cumulative_sum(a)).first()
    assert got[0] == pytest.approx(statistics.pstdev(x)) and got[1] == pytest.approx(statistics.stdev(x))
    assert got[2] == pytest.approx(statistics.correlation(x, y)) and got[3] == pytest.approx(1.4)
    assert got[4] == [3.0, 4.0, 8.0, 9.0, 14.0]
    empty = F.array().cast("array<double>")
    few = s.select(C.array_std(empty), C.array_std(F.array(F.lit(1.0)), True), C.correlation(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))), C.quantile(empty, 0.5)).first()
    assert all(x != x for x in few[:3]) and few[3] is None


def test_valid_gives_transitions(spark):
    s = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 1, 2, None, None, 3])], "k string, t int, v int")
    got = control.valid(s, Order(("k",), ("t",)), "v").orderBy("t").collect()
    assert [(r.t, r.valid) for r in got] == [(1, True), (3, False), (5, True)]


def test_record_and_replay(spark, tmp_path):
    path = str(tmp_path / "r")
    a = spark.createDataFrame([("x", 1, 10), ("x", 3, 30), ("y", 2, 20)], "k string, t int, v int")
    recording.record(a, path, "one")
    recording.record(a.selectExpr("k", "t", "v + 1 AS v"), path, "two")
    rows = lambda d: sorted(tuple(r) for r in d.select("k", "t", "v").collect())
    assert rows(recording.replay(spark, path, "one", "t")) == [("x", 1, 10), ("x", 3, 30), ("y", 2, 20)]
    assert rows(recording.replay(spark, path, "two", "t", F.lit(2), F.lit(3))) == [("x", 3, 31), ("y", 2, 21)]
    assert rows(recording.replay_const(spark, path, "one", "t", F.lit(2), ["k"])) == [("x", 1, 10), ("y", 2, 20)]
    assert rows(recording.replay_const(spark, path, "one", "t", F.lit(0))) == []
    t = recording.to_table(a, "t", F.lit(1)).unionByName(recording.to_table(a.selectExpr("k", "t", "-v AS v"), "t", F.lit(2)))
    known = lambda at: sorted(r.v for r in recording.from_table(t, ["k"], F.lit(at)).collect())
    assert (known(0), known(1), known(2)) == ([], [10, 20, 30], [-30, -20, -10])


def test_live_streams(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", at(1), 1), ("a", at(2), 1), ("a", at(11), 2), ("b", at(3), None), ("b", at(4), 5)]
    path, schema = str(tmp_path / "in"), "k string, ts timestamp, v long"
    spark.createDataFrame(rows, schema).write.parquet(path)
    s = spark.readStream.schema(schema).parquet(path)

    def run(name, df, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name)

    sums = run("live_windows", live.windowed(s, "ts", "10 seconds", "1 minute", ["k"], total=F.sum("v")), "complete")
    assert sorted((r.k, r.start.second, r.total) for r in sums.collect()) == [("a", 0, 2), ("a", 10, 2), ("b", 0, 5)]
    changed = run("live_changes", live.changes(s, "k", ["ts"], "v"), "append")
    assert sorted((r.k, r.ts.second, r.v) for r in changed.collect()) == [("a", 1, 1), ("a", 11, 2), ("b", 3, None), ("b", 4, 5)]
    first = run("live_distinct", live.distinct_within(s, "ts", ["k"], "1 minute"), "append")
    assert sorted(r.k for r in first.collect()) == ["a", "b"]
