"""Exact de-duplication by content sort (DataFrame operations only).

Normalised texts are range-partitioned by splitters that Spark samples, on a
bounded key (the first characters and a 64-bit hash), so that no sampled key
is larger than a few bytes.  Within a partition an external sort puts equal
texts side by side; a window over the *whole* text compares neighbours and
keeps the row with the most code points, then the smallest identifier.

Hot contents: a content that holds more than 1/`HOT_SHARE` of all rows (so at
most `HOT_SHARE` of them exist) is cut in `SALTS` parts by identifier; each
part is sorted on its own and only its one best row meets the others.

Results for special cases: a null text counts as empty, and all empty texts
are one group; a null identifier orders after all others; repeated rows are
rows of their own and are all counted; an empty table gives an empty result;
very long texts are shuffled and compared whole; further columns of any name
are ignored by `copies` and returned unchanged by `drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import fresh, partitions, table, written

HOT_SHARE = 256
SALTS = 64
WHITE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    norm = normalised(F.col(text))
    d = docs.select(F.col(key).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"), norm.alias("norm"))
    d = d.withColumn("h", F.xxhash64("norm"))
    counts = docs.select(F.xxhash64(norm).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    total = docs.select(F.count(F.lit(1)).alias("total"))
    # at most HOT_SHARE rows can pass, whatever the input: safe to broadcast
    hot = counts.join(F.broadcast(total), F.col("c") * HOT_SHARE > F.greatest(F.col("total"), F.lit(HOT_SHARE * 1000))).select(F.col("h").alias("hot_h"))
    d = d.join(F.broadcast(hot), F.col("h") == F.col("hot_h"), "left")
    d = d.withColumn("salt", F.when(F.col("hot_h").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(-1)).cast("int")).drop("hot_h")
    d = d.withColumn("prefix", F.substring("norm", 1, 16))
    d = d.repartitionByRange(partitions(spark), "prefix", "h", "salt")
    same = Window.partitionBy("prefix", "h", "salt", "norm")
    order = same.orderBy(F.col("n").desc(), F.col("doc_id").asc_nulls_last())
    part = d.select(
        "doc_id", "salt", "norm",
        F.first("doc_id").over(order).alias("best_id"),
        F.first("n").over(order).alias("best_n"),
        F.count(F.lit(1)).over(same).alias("rows"),
        F.row_number().over(order).alias("rn"),
    )
    part = written(part.select("doc_id", "salt", "best_id", "best_n", "rows", "rn", F.sha2("norm", 256).alias("text_sha256")), "copies")
    # the parts of the hot contents: at most HOT_SHARE * SALTS rows, then HOT_SHARE
    tops = part.where("salt >= 0 AND rn = 1").groupBy("text_sha256").agg(
        F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best_id").isNull().alias("z"), F.col("best_id").alias("id"))).alias("top"), F.sum("rows").alias("hot_rows"))
    tops = tops.select(F.col("text_sha256").alias("hot_sha"), F.col("top.id").alias("hot_id"), F.col("top.m").alias("hot_m"), "hot_rows", F.lit(True).alias("hot"))
    out = part.join(F.broadcast(tops), (F.col("text_sha256") == F.col("hot_sha")) & (F.col("salt") >= 0), "left")
    keep = F.when(F.col("hot"), F.col("hot_id")).otherwise(F.col("best_id"))
    kept = (F.col("rn") == 1) & (F.col("hot").isNull() | (F.col("best_id").eqNullSafe(F.col("hot_id")) & (F.col("best_n") == -F.col("hot_m"))))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("hot_rows", "rows").alias("group_size"), kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.  Rows that share
    an identifier and a text are one and the same; one of them stays."""
    sha, place, keep, keep_sha = fresh(docs, "sha", "place", "keep", "keep_sha")
    kept = copies(docs, text, key).where("kept").select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(keep_sha))
    d = docs.withColumn(sha, F.sha2(normalised(F.col(text)), 256))
    d = d.join(kept, (F.col(sha) == F.col(keep_sha)) & F.col(key).eqNullSafe(F.col(keep)), "left_semi")
    twice = docs.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count()
    if twice:
        w = Window.partitionBy(sha, key).orderBy(F.length(F.coalesce(F.col(text), F.lit(""))).desc())
        d = d.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1)
    return d.select(*docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
