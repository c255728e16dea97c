"""Components, lowered functions, feedback and float de-duplication."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tickloom.operators import fold
from tickloom.plans import authoring as P

from .test_streams import O, stream, ticks


def test_component(spark, tmp_path):
    double = P.Component("double", lambda a: a.select("k", (F.col("v") * 2).alias("v")), str(tmp_path))
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", None)], "k string, v int")
    assert sorted(double.record(a=a).collect(), key=str) == sorted([("x", 2), ("x", 2), ("y", None)], key=str)
    assert double.compare(spark, "a").count() == 0
    changed = P.Component("double", lambda a: a.select("k", F.when(F.col("k") == "y", 5).otherwise(F.col("v") * 2).alias("v")).where("k = 'y'"), str(tmp_path))
    assert sorted(map(tuple, changed.compare(spark, "a").collect()), key=str) == sorted([("y", 5, "new", 1), ("y", None, "recorded", 1), ("x", 2, "recorded", 2)], key=str)


def test_lower(spark):
    f = P.lower(P.then(P.identity, lambda d: d.groupBy("date").agg(F.sum("v").alias("v"))), "date", "as_of", ["k"], "gone")
    rows = [(1, 1, "a", 10, False), (1, 2, "a", 20, False), (1, 1, "b", 5, False), (1, 3, "b", 5, True), (2, 1, "a", 7, False)]
    d = spark.createDataFrame(rows, "date int, as_of int, k string, v int, gone boolean")
    assert [dict(f(d, until=F.lit(t)).collect()) for t in (1, 2, 3)] == [{1: 15, 2: 7}, {1: 25, 2: 7}, {1: 20, 2: 7}]


def test_feedback(spark):
    out = fold.feedback(stream(spark, enumerate([1, 2, 3])), O, "v", lambda x, y: 10 * y + x, 9, T.StructField("y", T.LongType()))
    assert ticks(out, "y") == [(0, 91), (1, 912), (2, 9123)]
    with pytest.raises(ValueError):
        P.span_to_alpha(0)
    assert (P.span_to_alpha(3), P.center_of_mass_to_alpha(1)) == (0.5, 0.5)


def test_dedup_close(spark):
    nan, inf = float("nan"), float("inf")
    s = stream(spark, enumerate([1.0, 1.0 + 2e-16, nan, nan, None, None, inf, inf, 2.0, 2.1]), kind="double")
    assert [t for t, _ in sorted((r.seq, r.v) for r in fold.dedup_close(s, O, "v").select("seq", F.lit(0).alias("v")).collect())] == [0, 2, 4, 6, 8, 9]
