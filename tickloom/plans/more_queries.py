"""Queries for frame, dictionary, calendar, zone, range, JSON, conversion, source and sink operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import arithmetic as A
from ..functions import containers as C
from ..functions import convert as V
from ..functions import dates as D
from ..functions import scalar as S
from ..functions import text as X
from ..operators import control, fold, frames, graph, keyed, streams
from ..operators.streams import Order
from ..sources import frames as sources
from ..sources import recording
from ..streaming import sinks
from . import authoring
from .catalogue import query, table
from .graph_queries import TS
from .stream_queries import EVENTS, RUN, U, W, _typed, events, out
from .value_queries import LAST5, ZONE


def stamped(spark, d):
    return events(spark, d).withColumn("ts", F.timestamp_micros("us"))


def _folder(spark, name):
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="tickloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Frames.


@query("SELECT c_custkey, epoch_us(TIMESTAMP '2024-01-01') + 5 + c_custkey * 1000 AS us, c_nationkey AS key, c_acctbal AS value FROM customer WHERE c_acctbal IS NOT NULL")
def frame_from(spark, d):
    c = table(spark, d, "customer").withColumn("t", F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.col("c_custkey") * 1000))
    ticks = frames.from_frame(c, "t", "c_acctbal", "c_nationkey", 5)
    us = F.unix_micros("ts")
    return ticks.select(((us - us % 1000 - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1000).cast("long").alias("c_custkey"), us.alias("us"), "key", "value")


@query("SELECT count(*) AS n, min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events")
def frame_from_batches(spark, d):
    """Four frames, one after the other in time."""
    e = table(spark, d, "events")
    edge = e.select(*[F.percentile("event_id", q).cast("long").alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75))]).first()
    cuts = [e.orderBy("ts").where(F.col("event_id") <= x).agg(F.max("ts")).first()[0] for x in edge]
    bounds = [None, *sorted(cuts), None]
    parts = [e.where((F.lit(True) if lo is None else F.col("ts") > F.lit(lo)) & (F.lit(True) if hi is None else F.col("ts") <= F.lit(hi))) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    t = frames.from_frame_batches(parts, "ts", "value")
    return t.agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("ts")).alias("low"), F.max(F.unix_micros("ts")).alias("high"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query("SELECT c_custkey AS customer, c_acctbal AS balance FROM customer")
def frame_to(spark, d):
    return frames.to_frame(table(spark, d, "customer"), customer="c_custkey", balance="c_acctbal")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS place FROM customer QUALIFY place <= 50")
def frame_sorted(spark, d):
    """The first 50 rows of a sorted frame (a report)."""
    s = frames.sorted_(table(spark, d, "customer").withColumn("by", F.struct("c_acctbal", -F.col("c_custkey"))), "by", descending=True).limit(50).select("c_custkey", "by")
    return s.select("c_custkey", (F.rank().over(streams.Window.orderBy(F.col("by").desc())).cast("long")).alias("place"))


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def frame_concat(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast(dict(c.dtypes)["k"]).alias("k"), F.col("s_name").alias("name"))
    return frames.concat(c, s)


@query("SELECT c_custkey, c_nationkey * 10 AS ten, c_name FROM customer")
def frame_with_columns(spark, d):
    return frames.with_columns(table(spark, d, "customer"), ["c_custkey", "ten", "c_name"], ten=F.col("c_nationkey") * 10)


@query("SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer")
def frame_group_by(spark, d):
    g = frames.group_by(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"])
    return control.map_(g, Order((), ("c_custkey",)), lambda s, o: streams.running(s, o, place=F.count(F.lit(1))), ["c_nationkey"])


@query("SELECT c_custkey FROM customer")
def frame_ungroup(spark, d):
    g = frames.group_by(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"])
    return frames.ungroup(g, ["c_nationkey"], keep_keys=False)


@query("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def frame_join_right(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return frames.join(o, table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey")), ["k"], "right").select("o_orderkey", "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def frame_join_semi(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return frames.join(c, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"], "semi").select(F.col("k").alias("c_custkey"))


# Streams.


@query(f"WITH {EVENTS}, f AS (SELECT user_id, min(us) AS first FROM e GROUP BY user_id) SELECT event_id, e.user_id FROM e JOIN f USING (user_id) WHERE us - first > 86400000000")
def stream_drop_time(spark, d):
    return out(streams.drop_time(stamped(spark, d), TS, 86_400_000_000))


@query(f"""WITH {EVENTS}, w AS (SELECT *, last_value(CASE WHEN event_type IN ('click', 'view') THEN event_type = 'click' END IGNORE NULLS) OVER {RUN} AS open FROM e WHERE event_type IN ('click', 'view', 'purchase')),
x AS (SELECT *, coalesce(lag(open) OVER {W}, false) AS was, last_value(CASE WHEN event_type = 'purchase' THEN cents END IGNORE NULLS) OVER {RUN} AS v,
sum(CAST(event_type = 'purchase' AND NOT coalesce(open, false) AS INT)) OVER {RUN} AS missed FROM w),
y AS (SELECT *, coalesce(max(CASE WHEN coalesce(open, false) AND v IS NOT NULL THEN missed END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM x)
SELECT event_id, user_id, v AS cents FROM y WHERE v IS NOT NULL AND ((event_type = 'purchase' AND coalesce(open, false)) OR (event_type = 'click' AND NOT was AND missed > seen))""")
def stream_filter_by(spark, d):
    e = events(spark, d)
    flags = e.where("event_type IN ('click', 'view')").select("user_id", "us", "event_id", (F.col("event_type") == "click").alias("open"))
    return out(streams.filter_by(flags, _typed(spark, d, "purchase", "cents"), U, "open", "cents"), "cents")


@query("SELECT epoch_us(TIMESTAMP '2024-01-01') + i * 250000 AS us, i AS seq, true AS signal FROM range(1000) t(i)")
def stream_schedule(spark, d):
    return streams.schedule(spark, "2024-01-01", 1000, 250_000).select(F.unix_micros("ts").alias("us"), "seq", "signal")


@query(f"""WITH {EVENTS}, w AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN cents END IGNORE NULLS) OVER {RUN} AS v, last_value(CASE WHEN event_type = 'click' THEN cents END IGNORE NULLS) OVER {RUN} AS c FROM e)
SELECT event_id, user_id, v + c AS total FROM w WHERE event_type = 'view' AND v IS NOT NULL AND c IS NOT NULL""")
def combine_latest_passive(spark, d):
    return out(streams.combine_latest(_typed(spark, d, "view", "v"), _typed(spark, d, "click", "c"), U, "v", "c", passive="c"), (F.col("v") + F.col("c")).alias("total"))


@query(f"WITH {EVENTS}, w AS (SELECT *, CAST(sum(cents) OVER l AS BIGINT) AS s, CAST(sum(cents * cents) OVER l AS BIGINT) AS q, count(cents) OVER l AS n, row_number() OVER {W} AS p FROM e WINDOW l AS {LAST5}) SELECT event_id, user_id, n * q - s * s AS var, n * q - s * s AS std, n * q - s * s AS sample FROM w WHERE p >= 5")
def rolling_deviation(spark, d):
    """Compared as whole numbers: n squared times the variance."""
    e = events(spark, d)
    whole = lambda c: F.round(c).cast("long")
    one = streams.rolling_var(e, U, "cents", 5).select("event_id", "user_id", whole(F.col("var") * 25).alias("var"))
    two = streams.rolling_std(e, U, "cents", 5).select("event_id", whole(F.col("std") * F.col("std") * 25).alias("std"))
    three = streams.rolling_var(e, U, "cents", 5, ddof=1, name="sample").select("event_id", whole(F.col("sample") * 20).alias("sample"))
    return one.join(two, "event_id").join(three, "event_id")


@query(f"WITH {EVENTS} SELECT event_id, user_id, count(*) OVER {RUN} AS n, CAST(sum(cents) OVER {RUN} AS BIGINT) AS total, avg(cents) OVER {RUN} AS mean FROM e")
def running_forms(spark, d):
    e = streams.average(streams.accumulate(streams.count(events(spark, d), U, name="n"), U, "cents", name="total"), U, "cents", name="mean")
    return out(e, "n", "total", "mean")


@query(f"WITH {EVENTS} SELECT event_id, user_id, lag(cents) OVER {W} AS before FROM e")
def lag_in_blocks(spark, d):
    return out(fold.lag_in_blocks(events(spark, d), U, 86_400_000_000, "cents"), "before")


@query(f"WITH {EVENTS}, w AS (SELECT *, lag(event_type) OVER {W} AS b FROM e) SELECT event_id, user_id, event_type FROM w WHERE b IS NULL OR b <> event_type")
def dedup_in_blocks(spark, d):
    return out(fold.dedup_in_blocks(events(spark, d), U, 86_400_000_000, "event_type"), "event_type")


# Dictionaries.


def _balances(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_custkey", "c_acctbal")


@query("SELECT DISTINCT c_nationkey AS nation FROM customer")
def keyed_keys(spark, d):
    return keyed.keys_(_balances(spark, d), ["nation"])


@query("SELECT DISTINCT c_mktsegment AS segment FROM customer")
def keyed_values(spark, d):
    return keyed.values_(_balances(spark, d), "segment")


@query("SELECT c_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def keyed_unpartition(spark, d):
    """Of the orders under each customer the one with the smallest outer key."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("outer"), F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    known = table(spark, d, "customer").select("c_custkey")
    return keyed.unpartition(o.join(known, "c_custkey", "left_semi"), "outer", "c_custkey").select("c_custkey", "o_orderkey")


@query("SELECT c_mktsegment AS nation, c_nationkey AS segment, count(*) AS n FROM customer GROUP BY ALL")
def keyed_flip_keys(spark, d):
    n = keyed.reduce_(_balances(spark, d), ["nation", "segment"], n=F.count(F.lit(1)))
    return keyed.flip_keys(n, "nation", "segment")


@query("SELECT c_nationkey || '/' || c_mktsegment AS k, count(*) AS n FROM customer GROUP BY ALL")
def keyed_collapse(spark, d):
    c = keyed.collapse_keys(_balances(spark, d), "nation", "segment")
    return c.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(X.format_("{}/{}", F.col("key.nation"), F.col("key.segment")).alias("k"), "n")


@query("SELECT c_nationkey AS nation, c_mktsegment AS segment, max(c_custkey) AS last FROM customer GROUP BY ALL")
def keyed_uncollapse(spark, d):
    c = keyed.collapse_keys(_balances(spark, d), "nation", "segment").groupBy("key").agg(F.max("c_custkey").alias("last"))
    return keyed.uncollapse_keys(c)


@query("SELECT c_nationkey AS nation, c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def keyed_filter_by_matches(spark, d):
    m = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), (F.col("n_regionkey") == 1).alias("match"))
    return keyed.filter_by_matches(_balances(spark, d).select("nation", "c_custkey"), m, "nation", "match")


@query("SELECT k, arg_min(name, i) AS name FROM (SELECT c_custkey AS k, c_name AS name, 0 AS i FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier) GROUP BY k")
def keyed_merge_disjoint(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_name").alias("name"))
    return keyed.merge_disjoint([c, table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("name"))], "k")


@query("SELECT c_nationkey AS nation, count(*) AS n, sum(CAST(round(c_acctbal * 100) AS BIGINT))::BIGINT AS cents FROM customer GROUP BY ALL")
def keyed_reduce(spark, d):
    return keyed.reduce_(_balances(spark, d), ["nation"], n=F.count(F.lit(1)), cents=F.sum(F.round(F.col("c_acctbal") * 100).cast("long")))


@query("SELECT c_nationkey AS nation, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def keyed_top(spark, d):
    return keyed.top_by_key(_balances(spark, d), ["nation"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3).select("nation", "c_custkey")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(range(len(string_split(p_name, ' ')))) AS place FROM part")
def keyed_combine(spark, d):
    w = F.split("p_name", " ")
    s = table(spark, d, "part").select("p_partkey", w.alias("ks"), F.transform(w, lambda _, i: i.cast("long")).alias("vs"))
    return keyed.combine_tsd(s, "ks", "vs", "word", "place")


@query("SELECT c_nationkey AS nation, c_custkey AS key, c_acctbal AS value FROM customer")
def keyed_maps(spark, d):
    """Maps of each nation's balances, and their rows again."""
    m = keyed.make_map(_balances(spark, d), ["nation"], "c_custkey", "c_acctbal")
    return keyed.flatten_map(m, "map")


# Dates, zones and ranges.


@query(
    "SELECT event_id, day(ts) AS dom, month(ts) AS moy, epoch_us(ts) / 1000000.0 AS stamp, year(ts) || '-' || month(ts) || '-' || day(ts) AS ymd, CAST(ts AS DATE) AS modified, "
    "CASE WHEN epoch_us(ts) % 2 = 0 THEN 'EQ' ELSE 'LT' END AS place FROM events"
)
def temporal_more(spark, d):
    us = F.col("us")
    place = D.in_range(us, us + us % 2, us + 10)
    return events(spark, d).select(
        "event_id", D.day_of_month(us).cast("long").alias("dom"), D.month_of_year(us).cast("long").alias("moy"), D.timestamp(us).alias("stamp"), F.array_join(F.transform(D.explode(us), lambda x: x.cast("string")), "-").alias("ymd"), D.last_modified_date(us).alias("modified"), place.alias("place"),
    )


@query(f"SELECT event_id, epoch_us(ts) AS instant, 'UTC' AS home, '{ZONE}' AS away, epoch_us(ts) AS back, epoch_us(timezone('{ZONE}', timezone('UTC', ts))) AS shown FROM events")
def zone_convert(spark, d):
    z = D.at_zone(F.col("us"), "UTC")
    a = D.convert_zone(z, ZONE)
    return events(spark, d).select("event_id", z["instant"].alias("instant"), z["zone"].alias("home"), a["zone"].alias("away"), D.to_instant(a).alias("back"), D.to_civil(D.to_instant(a), ZONE).alias("shown"))


@query(
    f"""WITH {EVENTS}, r AS (SELECT event_id, 1000 AS a, 4000 AS b, cents AS c, cents + 500 AS z FROM e)
SELECT event_id, CASE WHEN c < b AND z > a THEN greatest(a, c) END AS low, CASE WHEN c < b AND z > a THEN least(b, z) END AS high, b = c OR z = a AS touches, b = c OR z = a AS adjacent,
(c < b AND z > a) OR b = c OR z = a AS mergeable, least(a, c) AS hull_low, greatest(b, z) AS hull_high, CASE WHEN (c < b AND z > a) OR b = c OR z = a THEN 1 ELSE 2 END AS pieces,
CASE WHEN (c < b AND z > a) OR b = c OR z = a THEN greatest(b, z) - least(a, c) ELSE 3500 END AS extent FROM r WHERE c IS NOT NULL"""
)
def range_more(spark, d):
    c, t, f = F.col("cents"), F.lit(True), F.lit(False)
    a, b = (F.lit(1000).cast("long"), F.lit(4000).cast("long"), t, f), (c, c + 500, t, f)
    i, h, u = S.range_intersection(a, b), S.range_hull(a, b), D.range_union(a, b)
    some = S.range_overlaps(a, b)
    extent = F.aggregate(u, F.lit(0).cast("long"), lambda s, r: s + D.range_extent(r["lo"], r["hi"]))
    return events(spark, d).where("cents IS NOT NULL").select(
        "event_id", F.when(some, i[0]).alias("low"), F.when(some, i[1]).alias("high"), S.range_touches(a, b).alias("touches"), S.range_adjacent(a, b).alias("adjacent"), S.range_mergeable(a, b).alias("mergeable"),
        h[0].alias("hull_low"), h[1].alias("hull_high"), F.size(u).alias("pieces"), extent.alias("extent"),
    )


@query(f"WITH {EVENTS} SELECT event_id, CAST(round_even(cents / 100.0, 0) * 100 AS BIGINT) AS nearest, (cents // 250) * 250 + 250 AS stop FROM e WHERE cents IS NOT NULL")
def temporal_rounding(spark, d):
    c = F.col("cents")
    return events(spark, d).where("cents IS NOT NULL").select("event_id", S.temporal_round(c, 100).cast("long").alias("nearest"), D.temporal_bucket(c, 250)[1].cast("long").alias("stop"))


# Numbers, logic and text.


@query(
    f"""WITH {EVENTS} SELECT event_id, CASE WHEN cents % 4 = 0 THEN 0.0 ELSE CAST(user_id AS DOUBLE) / (cents % 4) END AS ratio, cents // 700 AS q, cents % 700 AS r, cents = user_id AS same, abs(value - cents / 100.0) <= 1e-10 AS close,
cents <> 0 OR user_id <> 0 AS some, cents >> 3 AS less, cents + user_id + event_id AS total, +cents AS plus, CAST(ceil(cents / 1000.0) AS BIGINT) AS up FROM e WHERE cents IS NOT NULL"""
)
def arithmetic_more(spark, d):
    c, u, e = F.col("cents"), F.col("user_id"), F.col("event_id")
    qr = S.divmod_(c, F.lit(700))
    return events(spark, d).where("cents IS NOT NULL").select(
        "event_id", S.div(u, c % 4, "zero").alias("ratio"), qr["quotient"].cast("long").alias("q"), qr["remainder"].cast("long").alias("r"), A.eq_(c, u).alias("same"), A.eq_(F.col("value"), c / 100.0, "float").alias("close"),
        A.or_(c, u, "int").alias("some"), S.rshift(c, 3).alias("less"), A.sum_(c, u, e).alias("total"), A.pos_(c).alias("plus"), (S.temporal_ceil(c, 1000) / 1000).cast("long").alias("up"),
    )


@query(
    f"""WITH {EVENTS}, w AS (SELECT event_id, list(cents) OVER {LAST5} AS a FROM e)
SELECT event_id, list_min(a) AS low, list_max(a) AS high, round(list_avg(a), 6) AS mean, a[1] AS oldest, a[-1] AS newest, len(a) = 0 AS nothing, len(list_distinct(a)) AS members,
CAST(5 * list_sum(list_transform(a, lambda x: x * x)) - list_sum(a) * list_sum(a) AS BIGINT) AS spread, CAST(list_sum(a) AS DOUBLE) AS last_sum FROM w WHERE len(a) = 5"""
)
def array_statistics(spark, d):
    a = F.col("a")
    s = control.collect(events(spark, d), U, "cents", 5, "a").where(F.size("a") == 5)
    spread = F.round(C.array_std(a) * C.array_std(a) * 25).cast("long")
    check = F.round(C.array_var(a, 1) * 20).cast("long") == spread
    return s.select(
        "event_id", A.array_min(a).alias("low"), A.array_max(a).alias("high"), F.round(A.members_mean(a), 6).alias("mean"), C.array_get_item(a, 0).alias("oldest"), C.array_get_item(a, -1).alias("newest"), C.is_empty(a).alias("nothing"),
        F.size(V.convert(a, "list", "set")).cast("long").alias("members"), F.when(check, spread).alias("spread"), F.element_at(C.cumulative_sum(a), 5).alias("last_sum"),
    )


@query(f"""WITH {EVENTS}, w AS (SELECT event_id, list(cents) OVER {LAST5} AS a, list(user_id + cents % 7) OVER {LAST5} AS b, list(event_id) OVER {LAST5} AS c FROM e)
SELECT event_id, round(coalesce(list_aggregate(list_transform(range(1, 6), lambda i: a[i] * c[i]), 'sum') * 5.0 - list_sum(a) * list_sum(c), 0) / sqrt((5.0 * list_sum(list_transform(a, lambda x: x * x)) - list_sum(a) * list_sum(a)) * (5.0 * list_sum(list_transform(c, lambda x: x * x)) - list_sum(c) * list_sum(c))), 4) AS r
FROM w WHERE len(a) = 5 AND list_max(a) > list_min(a)""")
def array_correlation(spark, d):
    s = control.collect(control.collect(events(spark, d), U, "cents", 5, "a"), U, "event_id", 5, "c").where(F.size("a") == 5)
    return s.where(F.array_max("a") > F.array_min("a")).select("event_id", F.round(C.correlation(F.col("a").cast("array<double>"), F.col("c").cast("array<double>")), 4).alias("r"))


@query("SELECT c_custkey, c_name || '|' || c_mktsegment AS joined, encode(c_name)[3:6]::BLOB::VARCHAR AS part, upper(c_mktsegment[1:1]) AS initial FROM customer")
def text_more(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", X.join("|", F.col("c_name"), F.col("c_mktsegment")).alias("joined"), X.substr_bytes(F.col("c_name"), 2, 6).alias("part"), S.match(F.col("c_mktsegment"), "^.")["found"].alias("initial"))


# Containers, conversions and JSON.


@query("SELECT event_id, user_id AS u, event_type AS kind, coalesce(event_type, 'none') AS kind2, 'purchase' AS named, CAST(value AS BIGINT) AS whole, CAST(json_object('k', event_id) AS VARCHAR) AS js, 'bigint' AS shape FROM events")
def convert_more(spark, d):
    e = table(spark, d, "events")
    s = C.setattr_(V.combine(u=F.col("user_id"), kind=F.lit("x")), "kind", F.col("event_type"))
    tagged = F.struct(F.lit("sale").alias("_type"), F.lit("purchase").alias("value"))
    shape = V.type_(e, "event_id")
    made = V.json_encode(C.json_decode(V.to_json(F.struct(F.col("event_id").alias("k")))))
    return e.select(
        "event_id", V.getattr_(s, "u").alias("u"), V.getattr_(s, "kind").alias("kind"), C.default(F.col("event_type"), "none").alias("kind2"), V.downcast_(tagged, ["sale"]).alias("named"),
        V.cast_(F.rint("value"), "bigint").alias("whole"), made.alias("js"), F.lit(shape).alias("shape"),
    )


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS i, CAST(props ->> '$.k' AS DOUBLE) AS f, props ->> '$.k' AS s, CAST(props ->> '$.k' AS BIGINT) > 0 AS b, CAST(props ->> '$.k' AS BIGINT) AS typed FROM events")
def json_leaves(spark, d):
    leaf = F.try_variant_get(C.json_decode(F.col("props")), "$.k", "variant")
    flag = C.json_decode(F.when(V.json_as_int(leaf) > 0, "true").otherwise("false"))
    return table(spark, d, "events").select("event_id", V.json_as_int(leaf).alias("i"), V.json_as_float(leaf).alias("f"), V.json_as_str(leaf).alias("s"), V.json_as_bool(flag).alias("b"), V.from_json(F.col("props"), "k bigint")["k"].alias("typed"))


@query("SELECT event_id, len(list_distinct([user_id % 5, event_id % 5])) AS members, CASE WHEN event_id % 4 = user_id % 4 THEN event_id ELSE user_id END AS picked, [user_id, event_id][1] AS first, CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END AS odd FROM events")
def container_maps(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    m = V.combine_map(F.array(u % 4, e % 4), F.array(u, e))
    flags = C.tsl_to_tsd(F.array(u % 2 == 1, e % 2 == 1), ["u", "e"])
    return table(spark, d, "events").select(
        "event_id", F.size(V.combine_tss_from_tsl(u % 5, e % 5)).cast("long").alias("members"), V.getitem_(m, u % 4, "map").alias("picked"), F.get(C.flatten_values(F.create_map(F.lit("a"), V.combine_list(u, e))), F.lit(0)).alias("first"),
        F.size(F.array_intersect(C.keys_where_true(flags), F.map_keys(C.where_true(flags)))).cast("long").alias("odd"),
    )


@query("SELECT CAST(1700000000000005 AS BIGINT) AS us, CAST(42 AS BIGINT) AS value")
def source_const(spark, d):
    return V.const(spark, 42, "bigint", 1_700_000_000_000_000, 5).unionByName(V.nothing(spark, "us bigint, value bigint"))


# Control, sources and sinks.


@query(f"WITH {EVENTS}, w AS (SELECT *, coalesce(lag(cents > 2000) OVER {W}, false) AS was FROM e) SELECT event_id, user_id, cents > 2000 AS valid FROM w WHERE (cents > 2000) <> was")
def control_valid(spark, d):
    e = events(spark, d).withColumn("big", F.when(F.col("cents") > 2000, F.col("cents")))
    return out(control.valid(e, U, "big"), "valid")


@query(f"WITH {EVENTS} SELECT event_id, CASE WHEN cents > 2000 THEN 1 ELSE 2 END AS pick, cents > 100 OR user_id = 1 AS some FROM e WHERE cents > 50 AND user_id IS NOT NULL")
def control_choice(spark, d):
    e = control.if_true(events(spark, d), F.col("cents") > 50).withColumn("big", F.col("cents") > 2000)
    return e.select("event_id", streams.if_then_else("big", F.lit(1), F.lit(2)).alias("pick"), control.any_(F.col("cents") > 100, F.col("user_id") == 1).alias("some"))


@query("SELECT event_id, user_id, epoch_us(ts) AS us, value FROM events WHERE ts >= (SELECT min(ts) FROM events WHERE user_id = 1)")
def record_replay(spark, d):
    """Recorded under two keys, one of them replayed from a time on."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    path = _folder(spark, "recording")
    recording.record(e, path, "all")
    recording.record(e.where("user_id < 0"), path, "none")
    first = e.where("user_id = 1").agg(F.min("ts")).first()[0]
    return recording.replay(spark, path, "all", "ts", start=F.lit(first)).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM (SELECT DISTINCT ON (user_id, ts) * FROM events ORDER BY user_id, ts, event_id DESC) WHERE ts <= (SELECT ts FROM events WHERE event_id = (SELECT quantile_disc(event_id, 0.5) FROM events)) GROUP BY user_id")
def record_latest(spark, d):
    e = streams.running(table(spark, d, "events").select("event_id", "user_id", "ts"), Order(("user_id", "ts"), ("event_id",)), n=F.max("event_id")).where("n = event_id")
    e = keyed.snapshot(e, ["user_id", "ts"], ["event_id"]).select("event_id", "user_id", "ts")
    path = _folder(spark, "recording")
    recording.record(e, path, "one")
    middle = table(spark, d, "events").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)")).first()[0]
    half = table(spark, d, "events").where(F.col("event_id") == middle).select("ts").first()[0]
    return recording.replay_const(spark, path, "one", "ts", F.lit(half), ["user_id"]).select("user_id", "event_id")


@query("SELECT o_custkey, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS us, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 10 < 7 GROUP BY ALL")
def table_revisions(spark, d):
    """A bitemporal table whose revisions are order keys, as known at some of them."""
    o = table(spark, d, "orders").where("o_orderkey % 10 < 7").select("o_custkey", F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderkey")
    t = recording.to_table(o, "ts", F.col("o_orderkey"))
    known = recording.from_table(t, ["o_custkey"], F.lit(1 << 60))
    return known.select("o_custkey", F.unix_micros("date").alias("us"), "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 3")
def source_published(spark, d):
    """Two revisions of a frame; the one at or before a time is read."""
    c, root = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), _folder(spark, "published")
    for revision, most in ((10, 3), (20, 9)):
        sources.publish_data(c.where(F.col("c_nationkey") < most).select("c_custkey", "c_name"), root, "customers", revision)
    return sources.subscribe_data(spark, root, "customers", as_of=15)


@query("SELECT event_id, epoch_us(ts) AS us, value FROM events WHERE value IS NOT NULL AND user_id BETWEEN 2 AND 9")
def source_values(spark, d):
    e = sources.filter_exp(table(spark, d, "events"), F.col("user_id") >= 2, F.col("user_id") <= 9)
    v = sources.ts_from_data_source(e.withColumn("both", F.struct("event_id", "value")), "ts", "both")
    return v.select(F.col("value.event_id").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value.value").alias("value"))


@query("SELECT event_id, user_id, epoch_us(ts) AS us, value, event_type FROM events")
def source_keyed_values(spark, d):
    e = table(spark, d, "events")
    one = sources.tsd_k_v_from_data_source(e.withColumn("both", F.struct("event_id", "value")), "ts", "user_id", "both")
    two = sources.tsd_k_tsd_from_data_source(e.withColumn("both", F.struct("event_id", "event_type")), "ts", "user_id", "event_id", "both")
    whole = sources.tsb_from_data_source(e.select("ts", "event_id"), "ts")
    a = one.select(F.col("value.event_id").alias("event_id"), F.col("key").alias("user_id"), F.col("value.value").alias("value"))
    b = two.select(F.col("inner").alias("event_id"), F.col("value.event_type").alias("event_type"))
    return a.join(b, "event_id").join(whole.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), "event_id").select("event_id", "user_id", "us", "value", "event_type")


@query("SELECT event_id, user_id * 10 + event_id AS both, user_id AS first FROM events")
def source_arrays(spark, d):
    e = table(spark, d, "events")
    a = sources.ts_of_array_from_data_source(e, "ts", ["user_id", "event_id"])
    k = sources.tsd_k_a_from_data_source(e, "ts", "event_id", ["user_id", "event_id"])
    return a.select(F.get("value", F.lit(1)).alias("event_id"), (F.get("value", F.lit(0)) * 10 + F.get("value", F.lit(1))).alias("both")).join(k.select(F.col("key").alias("event_id"), F.get("value", F.lit(0)).alias("first")), "event_id")


@query("SELECT epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS us, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL")
def source_matrix(spark, d):
    m = sources.ts_of_matrix_from_data_source(table(spark, d, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp")), "t", "o_orderkey", ["o_orderkey", "o_custkey"])
    return m.select(F.unix_micros("ts").alias("us"), F.size("value").cast("long").alias("n"), F.get(F.get("value", F.lit(0)), F.lit(0)).alias("first"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def sink_conflate(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    return sinks.conflate(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT user_id, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first FROM events GROUP BY user_id")
def sink_burst(spark, d):
    b = sinks.burst(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "event_id")
    return b.select("user_id", F.size("values").cast("long").alias("n"), F.get("values", F.lit(0)).alias("first"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def sink_table_of_batches(spark, d):
    """Three batches in order of time, published, compacted and read back."""
    e, path = table(spark, d, "events").select("user_id", "ts", "event_id"), _folder(spark, "batches")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = e.withColumn("us", us).select(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY us)").alias(f"c{i}") for i, q in enumerate((0.3, 0.6))]).first()
    publish = sinks.to_table(path, ["user_id"], ["ts", "event_id"])
    for i, (lo, hi) in enumerate(((None, cuts[0]), (cuts[0], cuts[1]), (cuts[1], None))):
        publish(e.where((F.lit(True) if lo is None else us > lo) & (F.lit(True) if hi is None else us <= hi)), i)
    sinks.compact(spark.read.parquet(path), ["user_id"], f"{path}-whole")
    return spark.read.parquet(f"{path}-whole").select("user_id", "event_id")


@query("SELECT o_orderkey, o_custkey, 'low' AS asked FROM orders WHERE o_custkey <= 40 UNION ALL SELECT o_orderkey, o_custkey, 'all' FROM orders WHERE o_custkey <= 80")
def source_split_back(spark, d):
    asked = spark.range(81).select(F.col("id").alias("o_custkey"), F.explode(F.when(F.col("id") <= 40, F.array(F.lit("low"), F.lit("all"))).otherwise(F.array(F.lit("all")))).alias("asked"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"))
    return sources.split_back(asked, o, ["o_custkey"]).select("o_orderkey", "o_custkey", "asked")


@query("SELECT event_id FROM events WHERE ts <= (SELECT min(ts) FROM events WHERE event_type = 'purchase')")
def sink_stop(spark, d):
    e = sources.assert_(table(spark, d, "events"), F.col("event_id").isNotNull(), "an event has no identifier")
    return sources.stop_at(e, e.where("event_type = 'purchase'"), "ts").select("event_id")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN 'ERROR' WHEN n_nationkey % 3 = 1 OR n_nationkey % 2 = 1 THEN 'STALE' ELSE 'OK' END AS status, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || '; odd' END AS message FROM nation")
def graph_statuses(spark, d):
    n = F.col("n_nationkey")
    a = F.when(n % 3 == 2, "ERROR").when(n % 3 == 1, "STALE").otherwise("OK")
    b = F.when(n % 2 == 1, "STALE").otherwise("OK")
    return table(spark, d, "nation").select("n_nationkey", graph.combine_statuses(a, b).alias("status"), graph.combine_status_messages(F.col("n_name"), F.when(n % 2 == 1, "odd").otherwise(""), F.col("n_name")).alias("message"))


@query(f"WITH {EVENTS} SELECT event_id, user_id, cents * 2 + 1 AS lifted, cents * 2 + 1 AS applied FROM e WHERE cents IS NOT NULL")
def graph_lift(spark, d):
    twice = graph.lift(lambda x: int(x) * 2 + 1, "long")
    e = events(spark, d).where("cents IS NOT NULL")
    return e.select("event_id", "user_id", twice(F.col("cents")).alias("lifted"), graph.apply_(lambda x: int(x) * 2 + 1, "long", F.col("cents")).alias("applied"))


@query(f"WITH {EVENTS} SELECT event_id, user_id, CAST(sum(cents) OVER {RUN} AS BIGINT) AS total, CAST(sum(cents) OVER {RUN} AS BIGINT) AS node FROM e WHERE cents IS NOT NULL")
def graph_feedback(spark, d):
    from pyspark.sql import types as T

    def add(state, row):
        state["x"] = state.get("x", 0) + row["cents"]
        return state["x"]

    e = events(spark, d).where("cents IS NOT NULL").select("event_id", "user_id", "us", "cents")
    fed = fold.feedback(e, U, "cents", lambda x, last: x + last, 0, T.StructField("total", T.LongType()))
    return out(fold.compute_node(fed, U, add, T.StructField("node", T.LongType())), "total", "node")


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) AS BIGINT) AS person FROM orders")
def stream_request_id(spark, d):
    """Identifiers differ from run to run of a cluster; their order of customers does not matter, so they are ranked by customer."""
    r = streams.request_id(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])
    one = r.groupBy("request_id").agg(F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high")).where("low = high")
    ranks = one.select("request_id", F.dense_rank().over(streams.Window.orderBy("low")).cast("long").alias("person"))
    return r.join(ranks, "request_id").select("o_orderkey", "person")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL")
def authoring_component(spark, d):
    """A part of a plan, recorded with its input, and its output recovered."""
    part = authoring.Component("counts", lambda li: li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")), _folder(spark, "component"))
    part.record(li=table(spark, d, "lineitem").where("l_linenumber <= 3").select("l_orderkey", "l_linenumber"))
    return part.recover(spark)
