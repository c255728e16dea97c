"""Mixing sources to target weights (DataFrame operations only).

Sizes are words.  Each source is cut in blocks by a seeded permutation of its
rows (a hash of the identifier); the number of blocks follows the source's
share, `BLOCKS` in all.  A source's exact quota of block draws (whole passes,
then blocks in permuted order up to the target) is split over the output
shards by a recursive multivariate-hypergeometric tree: at each node the
quotas of all sources are dealt to the two halves of the shards, so that every
shard holds a random, exact share.  A shard then draws its disjoint run of the
permuted blocks of each source and orders its rows by a local hash.

Only one row per source and one per block (BLOCKS plus the number of sources)
reach the driver and the broadcast.  The number of sources is a parameter of
the mixture (each has a weight); `MAX_SOURCES` guards it.

The last block that a source draws is taken up to the target only: its rows
in hash order, the last row in part, so each source gives exactly its target,
rounded to a word.  No row is taken more than three times its size.

Special cases: a null text has size 0 and is never taken; null is a source of
its own, last in order; a source without words has target 0; repeated rows
are rows of their own, and rows with the same identifier share a block; a very
long text counts all its words and may be taken in part; an empty table gives
an empty result; other columns, of any name, are ignored by `mix` and returned
unchanged by `mixed_rows`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import fresh, local, partitions, table, written

BLOCKS = 4096
SHARDS = 16
SEED = 20240229
CAP = 3.0
WEIGHTS = (5.0, 2.0, 1.0)
MAX_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of the total by weight; no target above cap times its size, the
    excess going to the others by weight until none is above."""
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = rest / sum(weights[i] for i in free)
        over = sorted(i for i in free if weights[i] * unit > cap * sizes[i])
        if not over:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = cap * sizes[i]
            rest -= out[i]
            free.discard(i)
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Deal the quotas (draws by source) to the shards: rows are shards.  A
    node draws its left half's exact share from the multivariate
    hypergeometric distribution, and both halves are split again."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    take = int(quotas.sum()) * left // shards
    mine = rng.multivariate_hypergeometric(quotas, take, method="marginals") if take else np.zeros_like(quotas)
    return np.vstack([split(mine, left, rng), split(quotas - mine, shards - left, rng)])


_PLAN = T.StructType([
    T.StructField("p_source", T.StringType()), T.StructField("p_block", T.LongType()), T.StructField("source_size", T.LongType()),
    T.StructField("target", T.DoubleType()), T.StructField("passes", T.LongType()), T.StructField("rest", T.LongType()), T.StructField("shards", T.ArrayType(T.IntegerType())),
])
_COUNTS = T.StructType([T.StructField("p_source", T.StringType()), T.StructField("p_blocks", T.LongType())])


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken,
    source, shards (the shard of each draw) and place (order in a shard)."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
    d = written(d.withColumn("u", F.xxhash64(F.lit(seed), "doc_id")), "sizes")
    found = d.groupBy("source").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to weigh")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    names, sizes = [r["source"] for r in found], [int(r["s"]) for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))])
    total = max(1, sum(sizes))
    blocks = [max(1, round(BLOCKS * s / total)) for s in sizes]
    d = d.join(F.broadcast(local(spark, list(zip(names, blocks, strict=True)), _COUNTS)), F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    d = d.withColumn("block", F.pmod("u", F.col("p_blocks"))).drop("p_blocks")
    held: dict = {name: [] for name in names}
    for r in d.groupBy("source", "block").agg(F.sum("size").alias("s")).collect():  # at most BLOCKS * 1.5 + sources rows
        held[r["source"]].append((int(r["block"]), int(r["s"])))
    rng = np.random.Generator(np.random.PCG64(seed))
    draws, plan = [], []
    for name, size, to in zip(names, sizes, goal, strict=True):
        order = sorted(held[name])
        order = [order[i] for i in rng.permutation(len(order))]
        want = round(to)
        passes, left = divmod(want, size) if size else (0, 0)
        own = [(b, passes) for b, _ in order for _ in range(passes)]
        for b, s in order:
            part = min(s, left)
            left -= part
            if part:
                own.append((b, passes))
            plan.append([name, b, size, float(to), passes, part, []])
        draws.append([own[i][0] for i in rng.permutation(len(own))])
    dealt = split(np.array([len(x) for x in draws], dtype=np.int64), shards, rng) if names else np.zeros((shards, 0), np.int64)
    at = {(p[0], p[1]): p[6] for p in plan}
    for k, (name, own) in enumerate(zip(names, draws, strict=True)):
        for b, shard in zip(own, np.repeat(np.arange(shards), dealt[:, k]), strict=True):
            at[name, b].append(int(shard))
    plan = local(spark, [tuple(p) for p in plan], _PLAN)
    d = d.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block")))
    # a block is taken once for each of its draws that the tree dealt to a shard, the cut one of a source in part
    whole = F.size("shards") * F.col("size")
    # only a block that is taken in part needs its rows in order: one block of a source
    sums = written(d.groupBy("source", "block").agg(F.sum("size").alias("held")), "blocks")
    d = d.join(F.broadcast(sums.select(F.col("source").alias("h_source"), F.col("block").alias("h_block"), "held")), F.col("source").eqNullSafe(F.col("h_source")) & (F.col("block") == F.col("h_block")))
    cut = (F.col("rest") > 0) & (F.col("rest") < F.col("held"))
    run = Window.partitionBy("source", "block").orderBy("u", F.col("size").desc(), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    full = d.where(~cut).withColumn("taken", whole)
    edge = d.where(cut).withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    edge = edge.withColumn("taken", whole - F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))).drop("before")
    out = full.unionByName(edge)
    return out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source", "shards", F.xxhash64(F.lit(seed + 1), "doc_id").alias("place"))


def mixed_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mixture itself: every row of `docs` as often as it is taken (to the
    nearest whole number of times), ordered at random within its shard.  Of each
    source one row at most is rounded: the last that it takes.  Rows that share
    identifier, source and size are taken alike, as often as the most taken."""
    ident, origin, size, times, shards, place, draw, shard = fresh(docs, "ident", "origin", "size", "times", "shards", "place", "draw", "shard")
    took = mix(docs, text, key, source, **options).where("taken > 0")
    took = took.groupBy(F.col("doc_id").alias(ident), F.col("source").alias(origin), F.col("size").alias(size)).agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias(times), F.first("shards").alias(shards), F.first("place").alias(place))
    d = docs.join(took.where(F.col(times) > 0), F.col(key).eqNullSafe(F.col(ident)) & F.col(source).eqNullSafe(F.col(origin)) & (words(F.col(text)) == F.col(size)))
    d = d.withColumn(draw, F.explode(F.sequence(F.lit(0), F.col(times) - 1)))
    d = d.withColumn(shard, F.coalesce(F.try_element_at(shards, F.col(draw) + 1), F.lit(0)))
    d = d.repartition(partitions(docs.sparkSession), shard, F.pmod(place, F.lit(1024))).sortWithinPartitions(shard, F.xxhash64(place, draw))
    return d.select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards", "place")
