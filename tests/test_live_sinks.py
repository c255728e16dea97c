"""Micro-batch sinks and running state."""

import datetime as dt

from pyspark.sql import functions as F
from tickloom.streaming import sinks


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


ROWS = [("a", at(1), 1), ("a", at(3), 2), ("b", at(2), None), (None, at(1), 7), ("a", at(2), 9)]
SCHEMA = "k string, ts timestamp, v long"


def test_conflate_and_burst(spark):
    b = spark.createDataFrame(ROWS, SCHEMA)
    assert {r.k: r.v for r in sinks.conflate(b, ["k"], ["ts"]).collect()} == {"a": 2, "b": None, None: 7}
    assert {r.k: r["values"] for r in sinks.burst(b, ["k"], ["ts"], "v").collect()} == {"a": [1, 9, 2], "b": [None], None: [7]}
    assert sinks.conflate(b.limit(0), ["k"], ["ts"]).count() == 0


def test_batches_are_written_once(spark, tmp_path):
    path, put = str(tmp_path / "t"), None
    put = sinks.to_table(path, ["k"], ["ts"])
    b = spark.createDataFrame(ROWS, SCHEMA)
    put(b, 0)
    put(b, 0)
    put(b.where("k = 'a'").withColumn("v", F.lit(50).cast("long")), 1)
    t = spark.read.parquet(path)
    assert t.count() == 4
    assert {r.k: r.v for r in sinks.current(t, ["k"]).collect()} == {"a": 50, "b": None, None: 7}
    sinks.compact(t, ["k"], str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3


def test_running_state_over_batches(spark, tmp_path):
    for i, rows in enumerate((ROWS[:2], ROWS[2:])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = sinks.running(s.where("k IS NOT NULL"), ["k"], "v")
    q = out.writeStream.format("memory").queryName("live_running").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = spark.table("live_running").groupBy("k").agg(F.max("n").alias("n"), F.max("total").alias("total")).collect()
    assert {r.k: (r.n, r.total) for r in got} == {"a": (3, 12), "b": (0, 0)}
