"""Queries for calendar, range, container, JSON, routing and array operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arithmetic as A
from ..functions import containers as C
from ..functions import dates as D
from ..functions import scalar as S
from ..operators import control, streams
from .catalogue import query, table
from .stream_queries import EVENTS, U, W, events

ZONE = "America/New_York"
LAST5 = "(PARTITION BY user_id ORDER BY us, event_id ROWS 4 PRECEDING)"


def _long(**columns):
    return [c.cast("long").alias(n) for n, c in columns.items()]


@query(
    "SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, isodow(ts) - 1 AS wd, isodow(ts) AS iwd, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, "
    "epoch_us(ts) % 1000000 AS us, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS iso FROM events"
)
def temporal_parts(spark, d):
    us = F.col("us")
    parts = _long(y=D.year(us), mo=D.month(us), d=D.day(us), wd=D.weekday(us), iwd=D.isoweekday(us), h=D.hour(us), mi=D.minute(us), s=D.second(us))
    return events(spark, d).select("event_id", *parts, *_long(us=D.microsecond(us)), D.isoformat(us).alias("iso"))


@query(f"SELECT event_id, epoch_us(timezone('{ZONE}', timezone('UTC', ts))) AS civil, epoch_us(ts) AS instant FROM events")
def zone_civil(spark, d):
    civil = D.to_civil(F.col("us"), ZONE)
    return events(spark, d).select("event_id", civil.alias("civil"), D.resolve_civil(civil, ZONE).alias("instant"))


@query(
    f"WITH {EVENTS} SELECT event_id, CASE WHEN cents < 4000 AND cents + 500 > 1000 THEN least(cents, 1000) END AS merged_lo, CASE WHEN cents < 4000 AND cents + 500 > 1000 THEN greatest(cents + 500, 4000) END AS merged_hi, "
    "CASE WHEN cents + 500 <= 1000 OR cents >= 4000 THEN 3000 ELSE greatest(cents - 1000, 0) + greatest(4000 - cents - 500, 0) END AS rest, us - us % 900000000 + 900000000 AS bucket_end FROM e"
)
def range_algebra(spark, d):
    c, no = F.col("cents"), F.lit(False)
    a, b = (F.lit(1000).cast("long"), F.lit(4000).cast("long"), no, no), D.range_shift((c - 500, c, no, no), F.lit(500))
    both, rest = D.range_merge(a, b), D.range_difference(a, b)
    extent = F.aggregate(rest, F.lit(0).cast("long"), lambda s, r: s + D.range_extent(r["lo"], r["hi"]))
    return events(spark, d).select("event_id", *_long(merged_lo=both["lo"], merged_hi=both["hi"], rest=extent, bucket_end=D.temporal_bucket(F.col("us"), 900_000_000)[1]))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS i, CAST(props ->> '$.k' AS DOUBLE) AS f, props ->> '$.k' AS s, json_object('id', event_id, 'type', event_type)::VARCHAR AS made FROM events")
def json_values(spark, d):
    e = table(spark, d, "events").withColumn("tree", C.json_decode(F.col("props")))
    leaf = [C.json_as(F.col("tree"), "$.k", kind).alias(n) for n, kind in (("i", "bigint"), ("f", "double"), ("s", "string"))]
    return e.select("event_id", *leaf, C.combine_json(id=F.col("event_id"), type=F.col("event_type")).alias("made"))


@query("WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part) SELECT p_partkey, len(a) AS n, a[-1] AS last, coalesce(list_position(a, a[2]), 0) - 1 AS found, list_contains(a, 'part') AS has FROM w")
def container_items(spark, d):
    a = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", *_long(n=C.len_(a), found=S.index_of(a, F.get(a, F.lit(1)))), S.get(a, -1).alias("last"), C.contains(a, F.lit("part")).alias("has")).select("p_partkey", "n", "last", F.coalesce("found", F.lit(-1)).cast("long").alias("found"), "has")


@query("SELECT p_partkey, CAST(unnest(range(len(string_split(p_name, ' ')))) AS INT) AS position, unnest(string_split(p_name, ' ')) AS word FROM part")
def control_emit(spark, d):
    return control.emit(table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words")), "words", "word")


@query(f"WITH {EVENTS} SELECT CASE WHEN cents > 5000 THEN 'true' ELSE 'false' END AS route, count(*) AS n, sum(cents) AS cents FROM e WHERE cents IS NOT NULL GROUP BY ALL")
def control_if(spark, d):
    return control.if_(events(spark, d), F.col("cents") > 5000).groupBy("route").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(f"WITH {EVENTS} SELECT event_id, user_id % 5 AS route FROM e WHERE user_id % 5 < 3")
def control_route_by_index(spark, d):
    return control.route_by_index(events(spark, d), F.col("user_id") % 5, 3).select("event_id", "route")


@query(f"WITH {EVENTS} SELECT event_id, CASE WHEN cents < 3000 THEN -cents WHEN cents = 3000 THEN 0 ELSE cents - 3000 END AS v FROM e")
def control_if_cmp(spark, d):
    c = F.col("cents")
    return events(spark, d).select("event_id", control.if_cmp(S.cmp(c, F.lit(3000)), -c, F.lit(0).cast("long"), c - 3000).alias("v"))


@query(
    f"WITH {EVENTS} SELECT event_id, 2 * cents AS v FROM e WHERE event_type = 'click' UNION ALL SELECT event_id, CAST(sum(cents) OVER {W} AS BIGINT) FROM e WHERE event_type = 'purchase' "
    "UNION ALL SELECT event_id, 0 FROM e WHERE event_type NOT IN ('click', 'purchase')"
)
def control_switch(spark, d):
    branches = {
        "click": lambda s: s.select("event_id", (2 * F.col("cents")).alias("v")),
        "purchase": lambda s: streams.running(s, U, v=F.sum("cents")).select("event_id", "v"),
    }
    return control.switch_(events(spark, d), "event_type", branches, lambda s: s.select("event_id", F.lit(0).cast("long").alias("v")))


@query(f"WITH {EVENTS} SELECT event_id, CAST(sum(cents) OVER (PARTITION BY event_type, user_id ORDER BY us, event_id) AS BIGINT) AS total FROM e")
def control_map(spark, d):
    return control.map_(events(spark, d), U, lambda s, o: streams.running(s, o, total=F.sum("cents")), ["event_type"]).select("event_id", "total")


@query(
    "WITH a AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL) "
    "SELECT user_id, epoch_us(h) // 3600000000 AS hour, a.n IS NOT DISTINCT FROM b.n AS equal FROM a FULL JOIN b USING (user_id, h)"
)
def control_compare(spark, d):
    counted = events(spark, d).withColumn("hour", F.floor(F.col("us") / 3_600_000_000).cast("long"))
    a, b = (counted.where(F.col("event_type") == t).groupBy("user_id", "hour").agg(F.count("*").alias("n")) for t in ("click", "view"))
    return control.compare(a, b, ["user_id", "hour"], "n")


@query(f"WITH {EVENTS}, w AS (SELECT event_id, list(cents) OVER {LAST5} AS a FROM e) SELECT event_id, list_aggregate(a, 'string_agg', ',') AS buffer, list_aggregate(a, 'sum')::DOUBLE AS total, list_aggregate(a, 'median') AS middle FROM w WHERE len(a) = 5")
def analytics_windows(spark, d):
    s = control.collect(events(spark, d), U, "cents", 5, "a").where(F.size("a") == 5)
    return s.select("event_id", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("buffer"), F.element_at(C.cumulative_sum(F.col("a")), -1).alias("total"), C.quantile(F.col("a"), 0.5).alias("middle"))


@query(f"WITH {EVENTS} SELECT event_id, avg(cents) OVER {LAST5} AS mean FROM e")
def rolling_mean(spark, d):
    return streams.rolling(events(spark, d), U, 5, 1, mean=F.avg("cents")).select("event_id", "mean")


@query(f"WITH {EVENTS} SELECT event_id, cents & 255 AS both, cents | 255 AS either, xor(cents, 255) AS one, ~cents AS flipped, abs(3000 - cents) AS distance, CAST(sign(3000 - cents) AS INT) AS side, cents > 1000 AND NOT cents > 4000 AS inside FROM e")
def scalar_bits(spark, d):
    c, m = F.col("cents"), F.lit(255).cast("long")
    flags = control.all_(c > 1000, ~(c > 4000))
    return events(spark, d).select("event_id", A.bit_and(c, m).alias("both"), A.bit_or(c, m).alias("either"), A.bit_xor(c, m).alias("one"), A.invert_(c).alias("flipped"), A.abs_(3000 - c).alias("distance"), A.sign(3000 - c).cast("int").alias("side"), flags.alias("inside"))
