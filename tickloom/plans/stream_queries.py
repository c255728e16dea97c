"""Queries over `events` and `lineitem` for stream, keyed and frame operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import containers as C
from ..functions import convert as V
from ..functions import scalar as S
from ..operators import fold, frames, keyed, streams
from ..operators.streams import Order
from .catalogue import query, table

U = Order(keys=("user_id",), by=("us", "event_id"))
EVENTS = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
W = "(PARTITION BY user_id ORDER BY us, event_id)"
RUN = "(PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)"


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def out(df, *names):
    return df.select("event_id", "user_id", *names)


@query(f"WITH {EVENTS}, w AS (SELECT event_id, user_id, lag(cents, 2) OVER {W} AS lagged, row_number() OVER {W} AS p FROM e) SELECT event_id, user_id, lagged FROM w WHERE p > 2")
def stream_lag(spark, d):
    return out(streams.lag(events(spark, d), U, "cents", 2), "lagged")


@query(f"WITH {EVENTS} SELECT event_id, user_id, us + 5000000 AS us FROM e")
def stream_lag_time(spark, d):
    late = streams.lag_time(events(spark, d).withColumn("ts", F.timestamp_micros("us")), Order(("user_id",), ("ts", "event_id")), 5_000_000)
    return out(late, F.unix_micros("ts").alias("us"))


@query(f"WITH {EVENTS}, w AS (SELECT *, lag(event_type) OVER {W} AS b, row_number() OVER {W} AS p FROM e) SELECT event_id, user_id, event_type FROM w WHERE p = 1 OR b IS DISTINCT FROM event_type")
def stream_dedup(spark, d):
    return out(streams.dedup(events(spark, d), U, "event_type"), "event_type")


@query(f"WITH {EVENTS}, w AS (SELECT *, row_number() OVER {W} AS p FROM e) SELECT event_id, user_id FROM w WHERE p <= 3")
def stream_take(spark, d):
    return out(streams.take(events(spark, d), U, 3))


@query(f"WITH {EVENTS}, s AS (SELECT *, sum(CAST(event_type = 'purchase' AS INT)) OVER {RUN} AS g FROM e), w AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY us, event_id) AS p FROM s) SELECT event_id, user_id FROM w WHERE p <= 2")
def stream_take_reset(spark, d):
    return out(streams.take(events(spark, d).withColumn("r", F.col("event_type") == "purchase"), U, 2, "r"))


@query(f"WITH {EVENTS}, w AS (SELECT *, row_number() OVER {W} AS p FROM e) SELECT event_id, user_id FROM w WHERE p > 3")
def stream_drop(spark, d):
    return out(streams.drop(events(spark, d), U, 3))


@query(f"WITH {EVENTS}, w AS (SELECT *, row_number() OVER {W} - 1 AS p FROM e) SELECT event_id, user_id FROM w WHERE p % 3 = 0")
def stream_step(spark, d):
    return out(streams.step(events(spark, d), U, 3))


@query(f"WITH {EVENTS}, w AS (SELECT *, row_number() OVER {W} - 1 AS p FROM e) SELECT event_id, user_id FROM w WHERE p >= 2 AND p < 12 AND (p - 2) % 2 = 0")
def stream_slice(spark, d):
    return out(streams.slice_(events(spark, d), U, 2, 12, 2))


@query(f"WITH {EVENTS} SELECT event_id, user_id, CAST(sum(cents) OVER {RUN} AS BIGINT) AS total, count(*) OVER {RUN} AS n FROM e")
def running_sum_count(spark, d):
    return out(streams.running(events(spark, d), U, total=F.sum("cents"), n=F.count(F.lit(1))), "total", "n")


@query(f"WITH {EVENTS}, s AS (SELECT *, sum(CAST(event_type = 'purchase' AS INT)) OVER {RUN} AS g FROM e) SELECT event_id, user_id, CAST(sum(cents) OVER (PARTITION BY user_id, g ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM s")
def running_sum_reset(spark, d):
    return out(streams.running(events(spark, d).withColumn("r", F.col("event_type") == "purchase"), U, "r", total=F.sum("cents")), "total")


@query(f"WITH {EVENTS} SELECT event_id, user_id, round(CAST(sum(cents) OVER {RUN} AS DOUBLE) / count(*) OVER {RUN}, 6) AS mean FROM e")
def running_mean(spark, d):
    return out(streams.running(events(spark, d), U, t=F.sum("cents"), n=F.count(F.lit(1))).withColumn("mean", F.round(F.col("t").cast("double") / F.col("n"), 6)), "mean")


@query(f"WITH {EVENTS}, w AS (SELECT *, max(cents) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e) SELECT event_id, user_id, cents AS extreme FROM w WHERE b IS NULL OR cents > b")
def running_max(spark, d):
    return out(streams.improving(events(spark, d), U, "cents", True), "extreme")


@query(f"WITH {EVENTS}, w AS (SELECT *, min(cents) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e) SELECT event_id, user_id, cents AS extreme FROM w WHERE b IS NULL OR cents < b")
def running_min(spark, d):
    return out(streams.improving(events(spark, d), U, "cents", False), "extreme")


@query(f"WITH {EVENTS}, w AS (SELECT *, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 4 PRECEDING) AS BIGINT) AS total, row_number() OVER {W} AS p FROM e) SELECT event_id, user_id, total FROM w WHERE p >= 5")
def rolling_sum(spark, d):
    return out(streams.rolling(events(spark, d), U, 5, total=F.sum("cents")), "total")


@query(f"WITH {EVENTS} SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM e")
def rolling_time_count(spark, d):
    e = events(spark, d).withColumn("ts", F.timestamp_micros("us"))
    return out(streams.rolling_time(e, Order(("user_id",), ("ts", "event_id")), 3_600_000_000, n=F.count(F.lit(1))), "n")


@query(f"WITH {EVENTS}, w AS (SELECT *, cents - lag(cents) OVER {W} AS diff, row_number() OVER {W} AS p FROM e) SELECT event_id, user_id, diff FROM w WHERE p > 1")
def analytics_diff(spark, d):
    return out(streams.diff(events(spark, d), U, "cents"), "diff")


@query(f"WITH {EVENTS}, w AS (SELECT *, lag(cents) OVER {W} AS b, row_number() OVER {W} AS p FROM e) SELECT event_id, user_id, round((cents - b) / nullif(CAST(b AS DOUBLE), 0), 6) AS pct_change FROM w WHERE p > 1")
def analytics_pct_change(spark, d):
    return out(streams.pct_change(events(spark, d), U, "cents").withColumn("pct_change", F.round("pct_change", 6)), "pct_change")


@query(f"WITH {EVENTS} SELECT event_id, user_id, CASE WHEN cents < 500 THEN 500 WHEN cents > 2000 THEN 2000 ELSE cents END AS clipped, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'nan' WHEN value < 5 THEN '5' WHEN value > 20 THEN '20' ELSE 'same' END AS odd FROM e")
def analytics_clip(spark, d):
    """Null stays null, NaN stays NaN."""
    x = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    c = streams.clip(x, 5.0, 20.0)
    odd = F.when(F.isnan(c), "nan").when((c == 5) & (x < 5), "5").when((c == 20) & (x > 20), "20").when(c == x, "same")
    return out(events(spark, d), streams.clip(F.col("cents"), 500, 2000).cast("long").alias("clipped"), odd.alias("odd"))


@query(f"WITH {EVENTS}, w AS (SELECT *, sum(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM e) SELECT event_id, user_id FROM w WHERE coalesce(n, 0) = 0")
def stream_until_true(spark, d):
    return out(streams.until_true(events(spark, d).withColumn("p", F.col("event_type") == "purchase"), U, "p"))


@query(f"WITH {EVENTS}, w AS (SELECT *, count(*) FILTER (WHERE cents > 9000) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM e) SELECT event_id, user_id, cents FROM w WHERE ended = 0 AND cents IS NOT NULL")
def stream_freeze(spark, d):
    return out(streams.freeze(events(spark, d).withColumn("p", F.col("cents") > 9000), U, "p"), "cents")


def _typed(spark, d, kind, name):
    return events(spark, d).where(F.col("event_type") == kind).select("user_id", "us", "event_id", F.col("cents").alias(name))


@query(f"WITH {EVENTS}, w AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN cents END IGNORE NULLS) OVER {RUN} AS v FROM e) SELECT event_id, user_id, v FROM w WHERE event_type = 'click' AND v IS NOT NULL")
def stream_sample(spark, d):
    return out(streams.sample(_typed(spark, d, "click", "c"), _typed(spark, d, "view", "v"), U, "v"), "v")


@query(f"WITH {EVENTS}, w AS (SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN cents END IGNORE NULLS) OVER {RUN} AS v, last_value(CASE WHEN event_type = 'click' THEN cents END IGNORE NULLS) OVER {RUN} AS c, event_type FROM e) SELECT event_id, user_id, v + c AS total FROM w WHERE event_type IN ('view', 'click') AND v IS NOT NULL AND c IS NOT NULL")
def combine_latest_add(spark, d):
    return out(streams.combine_latest(_typed(spark, d, "view", "v"), _typed(spark, d, "click", "c"), U, "v", "c"), (F.col("v") + F.col("c")).alias("total"))


@query(f"WITH {EVENTS} SELECT event_id, user_id, cents AS v FROM e WHERE event_type IN ('view', 'click')")
def stream_merge(spark, d):
    return out(streams.merge([_typed(spark, d, "view", "v"), _typed(spark, d, "click", "v")], U), "v")


@query(f"WITH {EVENTS}, f AS (SELECT user_id, arg_min(event_type, (us, event_id)) AS t FROM e WHERE event_type IN ('view', 'click') GROUP BY user_id) SELECT event_id, e.user_id, cents AS v FROM e JOIN f ON e.user_id = f.user_id AND e.event_type = f.t")
def stream_race(spark, d):
    return out(streams.race([_typed(spark, d, "view", "v"), _typed(spark, d, "click", "v")], U), "v")


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, CAST(ceil(us / 3600000000.0) AS BIGINT) AS slot, arg_max(cents, (us, event_id)) AS cents FROM e GROUP BY ALL),
n AS (SELECT *, coalesce(lead(slot) OVER (PARTITION BY user_id ORDER BY slot), slot + 1) AS nx FROM s)
SELECT user_id, unnest(generate_series(slot, nx - 1)) * 3600000000 AS us, cents FROM n""")
def analytics_resample(spark, d):
    e = events(spark, d).withColumn("ts", F.timestamp_micros("us"))
    r = streams.resample(e, Order(("user_id",), ("ts", "event_id")), "cents", 3_600_000_000)
    return r.select("user_id", F.unix_micros("ts").alias("us"), "cents")


@query(f"""WITH RECURSIVE {EVENTS}, o AS (SELECT *, row_number() OVER {W} AS p FROM e), r AS (
SELECT event_id, user_id, p, CAST(cents AS DOUBLE) AS v FROM o WHERE p = 1 UNION ALL
SELECT o.event_id, o.user_id, o.p, 0.2 * o.cents + 0.8 * r.v FROM r JOIN o ON o.user_id = r.user_id AND o.p = r.p + 1) SELECT event_id, user_id, round(v, 4) AS ewma FROM r""")
def analytics_ewma(spark, d):
    return out(fold.ewma(events(spark, d), U, "cents", 0.2), F.round("ewma", 4).alias("ewma"))


@query(f"WITH {EVENTS}, w AS (SELECT event_id, user_id, count(cents) OVER {RUN} AS n, CAST(sum(cents) OVER {RUN} AS BIGINT) AS s, CAST(sum(cents * cents) OVER {RUN} AS BIGINT) AS q FROM e) SELECT event_id, user_id, CAST(n * q - s * s AS BIGINT) AS var, CAST(n * q - s * s AS BIGINT) AS std FROM w")
def analytics_std_var(spark, d):
    """n squared times the variance, and times the deviation squared: whole numbers, so nothing rests on rounding."""
    e = streams.running(events(spark, d), U, sd=F.stddev_pop("cents"), vr=F.var_pop("cents"), n=F.count("cents"))
    whole = lambda c: F.round(c * F.col("n") * F.col("n")).cast("long")
    return out(e, whole(F.col("sd") * F.col("sd")).alias("std"), whole(F.col("vr")).alias("var"))


@query(f"WITH {EVENTS} SELECT user_id, arg_max(event_id, (us, event_id)) AS event_id, arg_max(cents, (us, event_id)) AS cents FROM e GROUP BY user_id")
def keyed_snapshot(spark, d):
    return keyed.snapshot(events(spark, d), ["user_id"], ["us", "event_id"]).select("user_id", "event_id", "cents")


@query(f"WITH {EVENTS}, s AS (SELECT user_id, arg_max(event_type, (us, event_id)) AS t FROM e GROUP BY user_id) SELECT t AS event_type, count(*) AS n, min(user_id) AS first_user FROM s GROUP BY t")
def keyed_flip(spark, d):
    s = keyed.snapshot(events(spark, d), ["user_id"], ["us", "event_id"]).select("user_id", "event_type")
    f = keyed.flip(s, "user_id", "event_type", unique=False)
    return f.select(F.col("user_id").alias("event_type"), F.size("keys").cast("long").alias("n"), F.array_min("keys").alias("first_user"))


@query("SELECT n_regionkey AS region, n_nationkey AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def keyed_partition(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    g = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return keyed.partition(c, g, "nation", "region")


@query("SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def keyed_rekey(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return keyed.rekey(c, table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name"), "nation", "n_name")


_SETS = "a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND value > 50), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 50)"


def _sets(spark, d):
    e = events(spark, d).where("value > 50")
    return e.where("event_type = 'view'").select("user_id"), e.where("event_type = 'click'").select("user_id")


@query(f"WITH {_SETS} SELECT * FROM a UNION SELECT * FROM b")
def set_union(spark, d):
    return keyed.union(*_sets(spark, d))


@query(f"WITH {_SETS} SELECT * FROM a INTERSECT SELECT * FROM b")
def set_intersection(spark, d):
    return keyed.intersection(*_sets(spark, d))


@query(f"WITH {_SETS} SELECT * FROM a EXCEPT SELECT * FROM b")
def set_difference(spark, d):
    return keyed.difference(*_sets(spark, d))


@query(f"WITH {_SETS} (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def set_symmetric_difference(spark, d):
    return keyed.symmetric_difference(*_sets(spark, d))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def frame_join_left(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return frames.join(o, table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name"), ["k"], "left").select("o_orderkey", F.col("k").alias("o_custkey"), "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def frame_join_anti(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return frames.join(c, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"], "anti").select(F.col("k").alias("c_custkey"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'")
def frame_filter(spark, d):
    return frames.matching(table(spark, d, "lineitem"), l_returnflag="A", l_linestatus="F", l_shipdate=None).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_partkey, arg_max(l_linenumber, (l_shipdate, l_linenumber)) AS l_linenumber FROM lineitem WHERE l_shipdate <= TIMESTAMP '1997-01-01' GROUP BY ALL")
def frame_replay(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.struct("l_shipdate", "l_linenumber").alias("rev"), "l_shipdate")
    known = li.where(F.col("l_shipdate") <= F.lit("1997-01-01").cast("timestamp"))
    return frames.replay(known, "l_orderkey", "rev", ["l_partkey"], F.struct(F.lit("9999-01-01").cast(dict(li.dtypes)["l_shipdate"]).alias("l_shipdate"), F.lit(0).alias("l_linenumber"))).select("l_orderkey", "l_partkey", "l_linenumber")


@query(f"WITH {EVENTS} SELECT event_id, ((-cents % 700) + 700) % 700 AS m, CAST(floor(-cents / 700.0) AS BIGINT) AS q, CASE WHEN cents < 3000 THEN 'LT' WHEN cents = 3000 THEN 'EQ' ELSE 'GT' END AS c, cents << 2 AS sh FROM e")
def scalar_arithmetic(spark, d):
    n = -F.col("cents")
    return events(spark, d).select("event_id", S.mod_(n, F.lit(700)).cast("long").alias("m"), S.floordiv(n, F.lit(700)).cast("long").alias("q"), S.cmp(F.col("cents"), F.lit(3000)).alias("c"), S.lshift(F.col("cents"), 2).alias("sh"))


@query("SELECT c_custkey, c_name[2:4] AS part, regexp_matches(c_name, '0+1') AS hit, len(string_split(c_name, '#')) AS n FROM customer")
def scalar_strings(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", S.substr(F.col("c_name"), 1, 4).alias("part"), S.match(F.col("c_name"), "0+1")["is_match"].alias("hit"), F.size(S.split(F.col("c_name"), "#")).cast("long").alias("n"))


@query(f"WITH {EVENTS} SELECT event_id, us - us % 900000000 AS low, CASE WHEN us % 900000000 = 0 THEN us ELSE us - us % 900000000 + 900000000 END AS high, us // 86400000000 AS days, (us % 86400000000) // 1000000 AS seconds FROM e")
def temporal_quantize(spark, d):
    us = F.col("us")
    return events(spark, d).select("event_id", S.temporal_floor(us, 900_000_000).cast("long").alias("low"), S.temporal_ceil(us, 900_000_000).cast("long").alias("high"), S.day_part(us).cast("long").alias("days"), S.second_part(us).cast("long").alias("seconds"))


@query(f"WITH {EVENTS} SELECT event_id, (cents < 4000 AND cents >= 1000) AS inside, greatest(cents, 1000) < least(cents + 500, 4000) AS overlaps FROM e")
def range_predicates(spark, d):
    c, t, f = F.col("cents"), F.lit(True), F.lit(False)
    a, b = (F.lit(1000), F.lit(4000), t, f), (c, c + 500, t, f)
    return events(spark, d).select("event_id", S.range_contains(c, *a).alias("inside"), S.range_overlaps(a, b).alias("overlaps"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_as_int(spark, d):
    return table(spark, d, "events").select("event_id", V.json_as_int(F.try_variant_get(C.json_decode(F.col("props")), "$.k", "variant")).alias("k"))


HOUR = 3_600_000_000


# One row at a time: is the tick sent at once (it opens a period), held to the end of the running one, or does it follow a held one?
@query(f"""WITH RECURSIVE {EVENTS}, l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, us ORDER BY event_id DESC) = 1), o AS (SELECT *, row_number() OVER {W} AS p FROM l),
r AS (SELECT user_id, event_id, cents, us, p, us + {HOUR} AS due, false AS held, NULL::BIGINT AS sent_us, NULL::BIGINT AS sent_id, NULL::BIGINT AS sent_cents, true AS now FROM o WHERE p = 1
UNION ALL SELECT x.user_id, x.event_id, x.cents, x.us, x.p, CASE WHEN x.now THEN x.us + {HOUR} ELSE x.after END, NOT x.now, x.s_us, x.s_id, x.s_cents, x.now FROM (
SELECT o.user_id, o.event_id, o.cents, o.us, o.p, CASE WHEN r.held AND o.us > r.due THEN r.due + {HOUR} ELSE r.due END AS after, o.us >= CASE WHEN r.held AND o.us > r.due THEN r.due + {HOUR} ELSE r.due END AS now,
CASE WHEN r.held AND o.us > r.due THEN r.due END AS s_us, CASE WHEN r.held AND o.us > r.due THEN r.event_id END AS s_id, CASE WHEN r.held AND o.us > r.due THEN r.cents END AS s_cents
FROM r JOIN o ON o.user_id = r.user_id AND o.p = r.p + 1) x)
SELECT user_id, us, event_id, cents FROM r WHERE now UNION ALL SELECT user_id, sent_us, sent_id, sent_cents FROM r WHERE sent_us IS NOT NULL
UNION ALL SELECT user_id, due, event_id, cents FROM r WHERE held AND p = (SELECT max(p) FROM o WHERE o.user_id = r.user_id)""")
def stream_throttle(spark, d):
    e = events(spark, d).withColumn("ts", F.timestamp_micros("us")).select("user_id", "ts", "event_id", "cents")
    return out(fold.throttle(e, Order(("user_id",), ("ts", "event_id")), HOUR), F.unix_micros("ts").alias("us"), "cents")


@query(f"""WITH {EVENTS}, w AS (SELECT *, coalesce(last_value(CASE WHEN event_type IN ('click', 'view') THEN event_type = 'view' END IGNORE NULLS) OVER {RUN}, false) AS open,
min(CASE WHEN event_type = 'view' THEN us END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following FROM e),
p AS (SELECT *, CASE WHEN open THEN us ELSE following END AS leaves, row_number() OVER {W} - 1 AS k FROM w WHERE event_type = 'purchase' AND (open OR following IS NOT NULL))
SELECT event_id, user_id, cents, max(leaves - k) OVER {RUN} + k AS us FROM p""")
def stream_gate(spark, d):
    e = events(spark, d).withColumn("ts", F.timestamp_micros("us"))
    cond = e.where("event_type IN ('click', 'view')").select("user_id", "ts", "event_id", (F.col("event_type") == "view").alias("open"))
    g = streams.gate(cond, e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "cents"), Order(("user_id",), ("ts", "event_id")), "open", "cents")
    return out(g, "cents", F.unix_micros("ts").alias("us"))
