"""Folds, dispatch, meshes, conversions, sources and services on small inputs, against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from tickloom.functions import arithmetic as A
from tickloom.functions import containers as C
from tickloom.functions import convert as V
from tickloom.functions import dates as D
from tickloom.functions import text as X
from tickloom.operators import fold, frames, graph, keyed, streams
from tickloom.operators.streams import Order
from tickloom.sources import frames as sources

from .test_streams import T0, O, at, stream, ticks

MICRO = dt.timedelta(microseconds=1)


def lists(df):
    return sorted(((r.ts - T0) // MICRO, list(r["values"])) for r in df.collect())


def test_throttle_merges_a_tick_at_the_end_of_a_period(spark):
    s = stream(spark, enumerate(["1", "1", "2", "3", "", "2", "1"]), kind="string")
    assert ticks(fold.throttle(s, O, 2)) == [(0, "1"), (2, "2"), (4, ""), (6, "1")]


@pytest.mark.parametrize(("delay", "values", "want"), [(1, [1, 2, 3, 4], [(1, [1, 2]), (3, [3, 4])]), (2, [1, 2, 3, 4, 5], [(1, [1, 2]), (4, [3, 4, 5])])])
def test_batch(spark, delay, values, want):
    condition = stream(spark, enumerate([False, True]), "c", "boolean")
    s = stream(spark, enumerate(values))
    assert lists(fold.batch(condition, s, O, "c", "v", delay)) == want


def test_batch_overflow_and_leftover(spark):
    condition = stream(spark, [(0, False)], "c", "boolean")
    s = stream(spark, enumerate([1, 2]))
    assert lists(fold.batch(condition, s, O, "c", "v", 1)) == []
    with pytest.raises(Exception, match="too many values"):
        fold.batch(condition, s, O, "c", "v", 1, 1).collect()
    condition = stream(spark, [(0, True)], "c", "boolean")
    assert lists(fold.batch(condition, stream(spark, [(3, 7), (9, None)]), O, "c", "v", 4)) == [(7, [7]), (13, [None])]


def test_folds_keep_keys_apart(spark):
    rows = [(k, at(i), i, random.Random(k).random() + i) for k in ("a", "b", None) for i in range(3000)]
    s = spark.createDataFrame(rows, "k string, ts timestamp, seq long, v double")
    got = {(r.k, r.seq): r.ewma for r in fold.ewma(s, O, "v", 0.3).collect()}
    assert len(got) == 9000
    for k in ("a", "b", None):
        e = None
        for _, _, i, v in [r for r in rows if r[0] == k]:
            e = v if e is None else 0.3 * v + 0.7 * e
            assert got[k, i] == pytest.approx(e)


def test_running_in_blocks_is_the_running_sum(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "b", None]), at(r.randrange(500)), i, r.choice([None, r.randrange(-50, 50)])) for i in range(400)]
    s = spark.createDataFrame(rows, "k string, ts timestamp, seq long, v long")
    want = {x.seq: x.t for x in streams.running(s, O, t=F.sum("v")).collect()}
    for width in (1, 37, 10_000):
        assert {x.seq: x.t for x in fold.running_in_blocks(s, O, width, t="v").collect()} == want


def test_folds_of_empty_streams(spark):
    s, c = stream(spark, []), stream(spark, [], "c", "boolean")
    for df in (fold.ewma(s, O, "v", 0.5), fold.throttle(s, O, 3), fold.batch(c, s, O, "c", "v", 1), fold.running_in_blocks(s, O, 5, t="v"), streams.modified(s, O), streams.window_values(s, O, "v", 3)):
        assert df.collect() == []


def test_modified_pulse(spark):
    assert ticks(streams.modified(stream(spark, [(0, 1), (1, 1), (5, 1)]), O), "modified") == [(0, True), (1, True), (2, False), (5, True), (6, False)]


def test_time_in_range_rejects_a_reversed_range(spark):
    s = spark.createDataFrame([("a", 5, 0, 9, 3)], "k string, us long, seq long, lo long, hi long")
    with pytest.raises(Exception, match="starts after its end"):
        streams.time_in_range(s, Order(("k",), ("us", "seq")), "lo", "hi").collect()


def test_arithmetic_edges(spark):
    one = spark.range(1)
    values = [(2.675, 2), (0.125, 2), (2.5, 0), (-1.5, 0), (1e300, 5), (0.1, 90)]
    got = spark.createDataFrame(values, "x double, n int").select("x", "n", A.round_(F.col("x"), F.col("n")).alias("r")).collect()
    assert [r.r for r in got] == [float(f"{x:.{min(n, 40)}f}") for x, n in values]
    log = one.select(A.ln(F.lit(0.0)), A.ln(F.lit(-1.0)), A.ln(F.lit(math.e))).first()
    assert log[0] == -math.inf and math.isnan(log[1]) and log[2] == pytest.approx(1)
    assert one.select(A.pow_(F.lit(3), F.lit(39))).first()[0] == 3**39
    for a, b in ((3, 40), (2, -1)):
        with pytest.raises(Exception, match="negative exponent|overflow|OVERFLOW"):
            one.select(A.pow_(F.lit(a), F.lit(b))).collect()
    assert one.select(A.eq_(F.lit(1.0), F.lit(1.0 + 1e-11), "float"), A.ne_(F.lit(1.0), F.lit(1.0 + 1e-11), "float")).first()[:] == (True, True)
    a, b = F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2)), F.create_map(F.lit("y"), F.lit(3), F.lit("z"), F.lit(4))
    got = one.select(A.bit_and(a, b, "map"), A.bit_or(a, b, "map"), A.bit_xor(a, b, "map"), A.sub_(a, b, "map"), A.eq_(a, b, "map")).first()
    assert list(got) == [{"y": 2}, {"x": 1, "y": 3, "z": 4}, {"x": 1, "z": 4}, {"x": 1}, False]
    empty = F.array().cast("array<double>")
    got = one.select(A.members_mean(empty), A.members_var(empty), A.members_var(F.array(F.lit(1.0), F.lit(3.0)))).first()
    assert math.isnan(got[0]) and got[1:] == (0.0, 2.0)
    assert (A.zero("add_", "int"), A.zero("mul_", "float"), A.zero("add_", "str")) == (0, 1.0, "")
    with pytest.raises(ValueError):
        A.zero("mul_", "str")


def test_text(spark):
    words = ["", "abc", "naïve café", "日本語テキスト", None]
    rows = spark.createDataFrame([(w,) for w in words], "s string")
    for start, stop in ((0, None), (1, 4), (-5, -1), (2, 2), (0, 99), (-99, 2), (5, 1)):
        got = rows.select(X.substr_bytes(F.col("s"), start, stop)).collect()
        assert [r[0] for r in got] == [None if w is None else w.encode()[slice(start, stop)].decode(errors="replace") for w in words]
    assert spark.range(1).select(X.replace(F.lit("a1 $ b2"), r"(\w)(\d)", r"\2$\1")).first()[0] == "1$a $ 2$b"
    values = [("p", 1.5, 3), ("q", 1e22, None), (None, float("inf"), 7)]
    df = spark.createDataFrame(values, "s string, x double, n int")
    s, x, n = F.col("s"), F.col("x"), F.col("n")
    assert [r[0] for r in df.select(X.format_("{}|{b:>5.1f}|", s, b=x)).collect()] == [None if a is None else "{}|{b:>5.1f}|".format(a, b=b) for a, b, _ in values]
    assert [r[0] for r in df.select(X.format_("{1}{{}}{0}", s, n)).collect()] == ["3{}p", None, None]
    assert [r[0] for r in df.select(X.format_("{}-{}", s, n, strict=False)).collect()] == ["p-3", "q-None", "None-7"]
    assert [r[0] for r in df.select(X.str_(x, "double")).collect()] == ["1.5", "1e+22", "inf"]


def test_conversions(spark):
    one = spark.range(1)
    keys, values = F.array(*map(F.lit, "aba")), F.array(*map(F.lit, (1, 2, 3)))
    m = V.combine_map(keys, values)
    got = one.select(m, V.convert(m, "map", "set"), V.convert(F.array(F.lit(7), F.lit(8)), "list", "map"), V.getitem_(values, -1), V.getitem_(values, 9), V.getitem_(m, "zz", "map")).first()
    assert got[0] == {"b": 2, "a": 3} and sorted(got[1]) == ["a", "b"] and got[2] == {0: 7, 1: 8} and got[3:] == (3, None, None)
    assert one.select(V.combine(a=F.lit(1), b=F.lit(None).cast("int"))).first()[0] is None
    assert one.select(V.to_json(V.combine(strict=False, a=F.lit(1), b=F.lit(None).cast("int")))).first()[0] == '{"a":1,"b":null}'
    tagged = spark.createDataFrame([(("x", 1),), (("y", 2),)], "s struct<_type:string,value:int>")
    assert [r[0] for r in tagged.select(V.downcast_(F.col("s"), ["x", "y"])).collect()] == [1, 2]
    with pytest.raises(Exception, match="not a x: y"):
        tagged.select(V.downcast_(F.col("s"), ["x"])).collect()
    assert V.type_(tagged, "s") == "struct<_type:string,value:int>" and V.nothing(spark, "a int").count() == 0
    tree = F.try_parse_json(F.lit("4"))
    assert one.select(V.json_as_int(tree), V.json_as_float(tree), V.json_as_bool(F.try_parse_json(F.lit("true"))), V.json_encode(F.try_parse_json(F.lit('{"a": [1]}')))).first()[:] == (4, 4.0, True, '{"a":[1]}')
    assert one.select(C.keys_where_true(F.create_map(F.lit("a"), F.lit(True), F.lit("b"), F.lit(False)))).first()[0] == ["a"]
    for q, method, want in ((0.5, "lower", 1), (0.5, "higher", 3), (0.5, "midpoint", 2), (0.6, "nearest", 3)):
        assert one.select(C.quantile(F.array(F.lit(3.0), F.lit(1.0)), q, method)).first()[0] == want
    for us in (-1, -86_400_000_001, 5, 172_800_000_123):
        d = dt.timedelta(microseconds=us)
        assert one.select(D.days(F.lit(us)), D.seconds(F.lit(us)), D.microseconds(F.lit(us)), D.total_seconds(F.lit(us))).first()[:] == (d.days, d.seconds, d.microseconds, d.total_seconds())


def test_mesh(spark):
    own = spark.createDataFrame([(i, 1) for i in range(6)], "k long, v long")
    reads = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 2), (3, 2)], "k long, o long")
    plus = lambda a, b: a + b
    assert dict(graph.mesh_(own, reads, "k", "o", "v", F.sum, plus).collect()) == {0: 1, 1: 2, 2: 4, 3: 5, 4: 1, 5: 1}
    for more in ([(0, 3)], [(5, 99)]):
        with pytest.raises(ValueError, match="circle"):
            graph.mesh_(own, reads.unionByName(spark.createDataFrame(more, "k long, o long")), "k", "o", "v", F.sum, plus)


def test_dispatch_without_a_case(spark):
    s = spark.createDataFrame([("dog", 1), ("cat", 2), ("rock", 3)], "t string, v int")
    cases = {"animal": lambda x: x.select("v", F.lit("animal").alias("c")), "dog": lambda x: x.select("v", F.lit("dog").alias("c"))}
    parents = {"dog": "animal", "cat": "animal", "animal": None, "rock": None}
    assert sorted(graph.dispatch_(s.where("t != 'rock'"), "t", parents, cases).collect()) == [(1, "dog"), (2, "animal")]
    with pytest.raises(Exception, match="no case for rock"):
        graph.dispatch_(s, "t", parents, cases).collect()


def test_errors_overloads_and_statuses(spark):
    s = spark.createDataFrame([(1,), (0,), (None,)], "x int")
    got = [r[0] for r in s.select(graph.try_except(lambda x: 6 // x, "int", F.col("x"))).collect()]
    assert got[0] == (6, None) and got[1].out is None and got[1].exception.startswith("ZeroDivisionError") and got[2].exception.startswith("TypeError")
    f = graph.Overloads("f")
    f.add(None, None)(lambda: "any")
    f.add("int", None)(lambda: "left")
    f.add(None, "int")(lambda: "right")
    assert (f(["str", "str"]), f(["int", "str"])) == ("any", "left")
    with pytest.raises(TypeError, match="ambiguous"):
        f(["int", "int"])
    one = spark.range(1)
    assert one.select(graph.combine_statuses(F.lit("OK"), F.lit("ERROR"), F.lit("STALE"))).first()[0] == "ERROR"
    assert one.select(graph.combine_status_messages(F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b"), F.lit("a"))).first()[0] == "a; b"
    assert [r[0] for r in s.select(graph.lift(lambda x: None if x is None else x + 1, "int")(F.col("x"))).collect()] == [2, 1, None]


def test_keyed_helpers(spark):
    d = spark.createDataFrame([("g", "b", 2, "q"), ("g", "a", None, "p"), ("h", "c", None, None)], "g string, k string, x int, y string")
    assert sorted(keyed.race_by_key(d, ["g"], "k", ["x", "y"]).collect()) == [("g", 2, "p"), ("h", None, None)]
    m = keyed.make_map(d, ["g"], "k", "x")
    assert {r.g: r.map for r in m.collect()} == {"g": {"a": None, "b": 2}, "h": {"c": None}}
    assert sorted(tuple(r) for r in keyed.flatten_map(m, "map").where("value IS NOT NULL").collect()) == [("g", "b", 2)]
    pairs = spark.createDataFrame([("t", ["a", "b"], [1, 2])], "t string, ks array<string>, vs array<int>")
    assert sorted(keyed.combine_tsd(pairs, "ks", "vs").collect()) == [("t", "a", 1), ("t", "b", 2)]
    s = spark.createDataFrame([(0, "a", 1, False), (1, "b", 2, True), (2, "a", 3, False)], "ts int, k string, v int, r boolean")
    assert [tuple(x) for x in keyed.make_tsd(s, "k", "v", "r").orderBy("ts").select("k", "v", "op").collect()] == [("a", 1, "set"), ("b", None, "remove"), ("a", 3, "set")]


def test_frame_joins_keep_the_left_key(spark):
    a, b = spark.createDataFrame([(1, 10), (2, 20)], "a int, b int"), spark.createDataFrame([(2, 200), (3, 300)], "a int, b int")
    full = frames.join(a, b, ["a"], "full")
    assert full.columns == ["a", "b", "b_right"]
    assert sorted(full.collect(), key=str) == sorted([(1, 10, None), (2, 20, 200), (None, None, 300)], key=str)
    assert sorted(frames.join(a, b, ["a"], "right").collect(), key=str) == sorted([(2, 20, 200), (None, None, 300)], key=str)


def test_data_sources(spark, tmp_path):
    rows = [(at(1), "k", "x", 1, 2), (at(1), "l", "y", 3, None), (at(0), None, "z", 5, 6)]
    df = spark.createDataFrame(rows, "d timestamp, k string, j string, a int, b int")
    assert sorted(r.value for r in sources.ts_from_data_source(df, "d", "b").collect()) == [2, 6]
    assert sources.tsb_from_data_source(df, "d").columns == ["ts", "k", "j", "a", "b"]
    assert sources.tsd_k_v_from_data_source(df, "d", "k", "a").count() == sources.tsd_k_a_from_data_source(df.where("k IS NOT NULL"), "d", "k", ["a", "b"]).count() == 2
    assert sources.tsd_k_tsd_from_data_source(df, "d", "k", "j", "a").count() == 2
    assert {r.ts: r.value for r in sources.ts_of_matrix_from_data_source(df, "d", "a", ["a", "b"]).collect()} == {at(0): [[5, 6]], at(1): [[1, 2], [3, None]]}
    assert sources.out_of_order(df.withColumn("i", F.col("a")), "d", [], "i").count() == 1
    with pytest.raises(TypeError):
        sources.checked(df, "a")
    with pytest.raises(Exception, match="no time"):
        sources.ts_from_data_source(df.withColumn("d", F.lit(None).cast("timestamp")), "d", "a").collect()
    assert sources.between(df, "d", at(1), at(1)).count() == 2
    assert sources.stop_at(df, df.where("a = 5"), "d").count() == 1 and sources.stop_at(df, df.where("a = 99"), "d").count() == 3
    with pytest.raises(Exception, match="too large"):
        sources.assert_(df, F.col("a") < 5, "too large").collect()
    assert sources.assert_(df, F.col("a") < 6, "too large").count() == 3


def test_versions_are_published_once(spark, tmp_path):
    root, data = str(tmp_path), spark.range(3)
    with pytest.raises(LookupError):
        sources.subscribe_data(spark, root, "x")
    assert sources.publish_data(data, root, "x", 10) and sources.publish_data(data.limit(1), root, "x", 20)
    assert not sources.publish_data(data.limit(2), root, "x", 10)
    (tmp_path / "x/revision=30").mkdir()  # a write that did not end
    assert [sources.subscribe_data(spark, root, "x", t).count() for t in (10, 15, 20, None)] == [3, 3, 1, 1]
    with pytest.raises(LookupError):
        sources.subscribe_data(spark, root, "x", 9)


def test_generators_and_connectors(spark):
    def count(part):
        for i in range(3):
            yield (i, part * 10 + i)

    spark.dataSource.register(sources.generator(count, "t int, v int", "tickloom_count", 2))
    assert sorted(r.v for r in spark.read.format("tickloom_count").load().collect()) == [0, 1, 2, 10, 11, 12]
    spark.dataSource.register(sources.generator(lambda p: iter([(2, 0), (1, 0)]), "t int, v int", "tickloom_back"))
    with pytest.raises(Exception, match="time goes back"):
        spark.read.format("tickloom_back").load().collect()
    assert sources.kafka_options("h:1", "t", offsets={1: 5, 0: 3})["startingOffsets"] == '{"t": {"0": 3, "1": 5}}'
    assert "startingOffsets" not in sources.kafka_options("h:1", "t", timestamp=7)
